"""Benchmark decontamination (operator 10): Wu-Manber search for benchmark windows, over words.

The alphabet of the search is the word. A pattern is a window of consecutive words of a benchmark item; a block is the last two
words of a window of text (one word if the pattern has one). The shift table says how far the search may jump after a block; blocks
that no pattern holds allow the longest jump, so most words of a clean text are never looked at. A block with shift 0 selects a
bucket of patterns by its hash, and the words themselves are compared with each pattern of the bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh
from .words import ALNUM, LOWER, parts, span_hashes, text_bytes, word_spans

RESULT = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("item_ids", ArrayType(StringType())), StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _tokens(column: pa.Array):
    body, offsets = text_bytes(column)
    body = LOWER[body]
    starts, ends, first = word_spans(body, offsets, ALNUM)
    return body, starts, ends, first, span_hashes(body, starts, ends)


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """blocks[i]: the hash of the block of words that ends with word i."""
    if size == 1:
        return hashes
    out = hashes.copy()
    out[1:] = hashes[:-1] * _PAIR + hashes[1:]
    return out


class Searcher:
    """Shift tables and buckets for the patterns of a set of items, one table for each pattern length."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        patterns: dict[bytes, tuple[int, int, list[int], list[str]]] = {}
        body, starts, ends, first, hashes = _tokens(pa.array([t for _, t in items], pa.large_string()))
        for k, (item, _) in enumerate(items):
            low, high = int(first[k]), int(first[k + 1])
            length = min(window, high - low)
            block = _blocks(hashes[low:high], min(2, length)).tolist() if length else []
            for i in range(high - low - length + 1 if length else 0):
                words = b" ".join(body[s:e].tobytes() for s, e in zip(starts[low + i : low + i + length], ends[low + i : low + i + length], strict=True))
                known = patterns.setdefault(words, (length, min(2, length), block[i : i + length], []))
                if item not in known[3]:
                    known[3].append(item)
        self.tables: dict[int, tuple[dict[int, int], dict[int, dict[bytes, list[str]]]]] = {}
        for words, (length, size, block, owners) in patterns.items():
            shift, buckets = self.tables.setdefault(length, ({}, {}))
            for j in range(size - 1, length):
                shift[block[j]] = min(shift.get(block[j], length), length - 1 - j)
            buckets.setdefault(block[-1], {})[words] = owners

    def search(self, column: pa.Array) -> list[dict]:
        body, starts, ends, first, hashes = _tokens(column)
        out = []
        per_size = {size: _blocks(hashes, size) for size in {min(2, m) for m in self.tables}}
        for k in range(len(column)):
            low, high = int(first[k]), int(first[k + 1])
            hits: list[tuple[int, int]] = []
            items: set[str] = set()
            lists = {size: block[low:high].tolist() for size, block in per_size.items()}
            for m, (shift, buckets) in self.tables.items():
                size = min(2, m)
                block, furthest, n, i = lists[size], m - size + 1, high - low, m - 1
                get = shift.get
                while i < n:
                    step = get(block[i], furthest)
                    if step:
                        i += step
                        continue
                    a = low + i - m + 1
                    words = b" ".join(body[s:e].tobytes() for s, e in zip(starts[a : a + m], ends[a : a + m], strict=True))
                    owners = buckets[block[i]].get(words)
                    if owners is not None:
                        hits.append((i - m + 1, i + 1))
                        items.update(owners)
                    i += 1
            spans: list[dict] = []
            for s, e in sorted(hits):
                if spans and s <= spans[-1]["end"]:
                    spans[-1]["end"] = max(e, spans[-1]["end"])
                else:
                    spans.append({"start": s, "end": e})
            out.append({"n_words": high - low, "n_hit": sum(x["end"] - x["start"] for x in spans), "item_ids": sorted(items), "spans": spans})
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_pattern_bytes: int = 32 << 20, out: str = "contamination") -> DataFrame:
    """docs with a struct column ``out``: n_words, n_hit, item_ids (sorted strings) and spans (word positions, end exclusive).

    The benchmark travels to the executors inside the function, as its size is checked: beyond max_pattern_bytes of text the items
    are searched in blocks of at most that size, one after another over the same rows, and the results are merged.
    Null or empty texts have no words and no hits. An item of fewer than ``window`` words is one window; an item without words, or
    null, matches nothing. Repeated rows each get their result; a column of docs called ``out`` is replaced; other columns stay.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).filter("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t")), F.max(F.octet_length("t"))).first()
    n_blocks = -(-(total[0] or 0) // max_pattern_bytes) or 1
    finds = []
    docs = docs.drop(out)
    for b in range(n_blocks):
        rows = [(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == b).toLocalIterator()] if n_blocks > 1 else [(r.i, r.t) for r in items.collect()]
        finds.append(_finder(rows, window)(F.col(text_col)))
    if len(finds) == 1:
        return docs.withColumn(out, finds[0])
    names = [fresh(docs, f"part{b}") for b in range(n_blocks)]
    found = docs.withColumns(dict(zip(names, finds, strict=True)))
    return found.withColumn(out, _merge(*[F.col(n) for n in names])).drop(*names)


def _finder(items: list[tuple[str, str]], window: int):
    made: list[Searcher] = []

    @F.arrow_udf(RESULT)
    def find(column: pa.Array) -> pa.Array:
        if not made:
            made.append(Searcher(items, window))
        return pa.array([r for part in parts(column) for r in made[0].search(part)], _ARROW)

    return find


def _merge(*found):
    first = found[0]
    spans = F.array_sort(F.flatten(F.array(*[p["spans"] for p in found])))
    join = F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))))
    hit = F.aggregate(join, F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return F.struct(first["n_words"].alias("n_words"), hit.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.array(*[p["item_ids"] for p in found])))).alias("item_ids"), join.alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of docs that hold no benchmark window, with the columns of docs."""
    out = fresh(docs, "contamination")
    return contamination(docs, benchmark, out=out, **params).filter(F.col(out)["n_hit"] == 0).drop(out)
