"""Filter interaction audit (operator 11): what each filter of a chain removes, in every order of the filters.

Documents are first counted by part and by mask, the set of filters that they fail, so that a part has at most 2^k cells. A Gray code then
visits all subsets of filters, toggling one filter at a time: each cell counts how many active filters it fails, and the running survivors
change when that counter leaves or reaches nought. The survivors of the 2^k states are stored; a step of an order is the difference
of two of them, since what a chain keeps depends on the set of its filters only.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import checkpoint, scratch

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")
_SPACE = re.compile(rb"[ \t-\r]")
_CAPITALS, _SYMBOLS, _INNER = bytes(range(0x41, 0x5B)), b"#$%&*|", bytes(range(0x80, 0xC0))
_FACTS = pa.struct([("mask", pa.int32()), ("digest", pa.binary())])


def _pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about size bytes that end after white space, so that no word is cut."""
    at = 0
    while len(data) - at > size and (found := _SPACE.search(data, at + size)):
        yield data[at : found.end()]
        at = found.end()
    yield data[at:] if at else data


def measure(data: bytes) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words, distinct = 0, set()
    for piece in _pieces(data):
        found = piece.split()  # of bytes: at the six ASCII space characters
        words += len(found)
        distinct.update(found)
    held = lambda some: len(data) - len(data.translate(None, some))
    fails = (words < 200, 100 * len(distinct) < 50 * words, 100 * held(_CAPITALS) > 3 * (len(data) - held(_INNER)), held(_SYMBOLS) > 0)
    return sum(1 << k for k, x in enumerate(fails) if x)


@F.arrow_udf(StructType().add("mask", "integer").add("digest", "binary"))
def _facts(texts: pa.Array) -> pa.Array:
    held = [t.as_buffer() for t in texts.cast(pa.binary())]
    found = [(measure(data := b.to_pybytes() if b is not None else b""), hashlib.sha256(data).digest()) for b in held]
    return pa.array([{"mask": m, "digest": d} for m, d in found], _FACTS)


def failures(docs: DataFrame, labels: DataFrame, keep, *, id_col: str = "doc_id", text_col: str = "text", part: str | Column = "lang") -> DataFrame:
    """(part, mask, good, toxic) for each row of docs; bits 0 to 4 of mask are the filters A to E that it fails.

    A: under 200 words; B: under half of the words distinct; C: over 3 % capitals A-Z; D: holds one of ``#$%&*|``; E: the same text as a
    smaller id. Texts are judged whole, null as empty. A null id is smaller than none and fails no E; rows that repeat an id and its text don't
    make each other fail. Labels of an id are joined by "any of its rows says 1"; ids without labels count as neither. A null part is "".

    Texts meet as 256-bit digests. A row is the first of its text if (digest, id) is among the (digest, smallest id), a join on a key
    that hardly repeats, so a text with very many copies isn't gathered anywhere.
    """
    part = F.col(part) if isinstance(part, str) else part
    rows = keep(docs.select(F.col(id_col).alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), _facts(F.coalesce(F.col(text_col), F.lit(""))).alias("x")).select("id", "part", "x.*"))
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    later = F.col("id").isNotNull() & F.col("first").isNull()
    marked = rows.join(first, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(later, 1 << FILTERS.index("E")).otherwise(0))
    return marked.join(said, "id", "left").select("part", "mask", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")])


def survivors(masks: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """What is kept under each subset of filters (row: the subset as bits; columns as in counts), by a Gray-code walk over the cells."""
    out = np.zeros((1 << filters, counts.shape[1]), np.int64)
    active, failing, now = 0, np.zeros(len(masks), np.int64), counts.sum(axis=0)
    out[0] = now
    for k in range(1, 1 << filters):
        bit = k & -k  # the one filter that toggles
        active ^= bit
        hit = (masks & bit) != 0
        if active & bit:
            now = now - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            now = now + counts[hit & (failing == 0)].sum(axis=0)
        out[active] = now
    return out


def steps(kept: np.ndarray, filters: str = FILTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order and step, from the stored states."""
    k, full = len(filters), (1 << len(filters)) - 1
    alone = {f: 1 << j for j, f in enumerate(filters)}
    failing = {f: kept[0, 0] - kept[b, 0] for f, b in alone.items()}
    unique = {f: kept[full ^ b, 0] - kept[full, 0] for f, b in alone.items()}
    ways = [math.factorial(s.bit_count()) * math.factorial(max(0, k - 1 - s.bit_count())) for s in range(full + 1)]
    shapley = {f: sum(ways[s] * (kept[s, 0] - kept[s | b, 0]) for s in range(full + 1) if not s & b) for f, b in alone.items()}
    for order in itertools.permutations(sorted(filters)):
        before = 0
        for j, f in enumerate(order, 1):
            gone = kept[before] - kept[before | alone[f]]
            before |= alone[f]
            yield ("".join(order), j, *map(int, (kept[before, 0], gone[0], failing[f] - gone[0], unique[f], gone[1], gone[2], shapley[f])))


def audit(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row for each part, order of the five filters and step; params go to ``failures``, which says what counts as failing.

    kept: rows left after the step; removed: rows that the step takes; redundant: rows that fail its filter but left before; unique_fails:
    rows that fail its filter and no other; good_lost, toxic_lost: of removed, those with that label; shapley: rows that its filter removes
    at whatever step, summed over all orders. Parts are those of docs, so an empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        rows = failures(docs, labels, keep, **params)
        cells = checkpoint(rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")))
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:  # at most 2^5 cells
        kept = survivors(frame["mask"].to_numpy(np.int64), frame[list(COUNTS)].to_numpy(np.int64), len(FILTERS))
        return pd.DataFrame([(frame["part"].iloc[0], *row) for row in steps(kept)], columns=names)

    return cells.groupBy("part").applyInPandas(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in names[3:]))
