"""Suffix-array dedup (operator 3): repeated byte strings, found over a difference cover.

To decide which strings of ``length`` bytes stand at two places, suffixes need to be compared to that depth only. A difference cover
modulo V picks 17 of every 273 positions of a text so that for any two positions some shift below V brings both to picked ones.

1. The prefixes of picked suffixes that every match must contain (length - V + 1 bytes from the shifted start) are named, and equal
   names are brought together. A picked suffix with a unique name lies in no repeat.
2. Picked suffixes whose name occurs twice are named again, with all bytes that a match around them can hold (V - 1 before, length
   after, cut at the text's ends). Where that wide name occurs twice, all strings of ``length`` bytes around the suffix are repeated.
3. What no wide name settles are suffixes at the edges of matches. They tell at which distances they stand before picked suffixes,
   by these suffixes' names; suffixes at such distances from equal names anywhere are named one by one, by their whole prefix of
   ``length`` bytes, and equal names meet again: the comparison of adjacent prefixes.
4. Each text gets back the names that occur twice, and removes the bytes that they cover.

Names are 62-bit hashes of the bytes. Blocks of texts send each distinct name once, sorted and packed by ranges of names (see _sent);
a range stands for a fixed size of text, so the names that meet in one task don't grow with the corpus. A passage that stands in a
third of all documents is one name for each block. Blocks stay where they lie.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import arrow_bytes, checkpoint, release_shuffles
from .words import mix, powers

V = 273
BLOCK_BYTES = 2 << 20
#: A perfect difference set modulo 273.
COVER = (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256)
_PICKED = np.zeros(V, bool)
_PICKED[list(COVER)] = True


#: So many bytes of text send their names to one range of names.
SHARD_BYTES = 8 << 20
#: A range is sorted about so many names at a time, which bounds a task's memory.
MEET_NAMES = 1 << 19


def _name(x: np.ndarray) -> np.ndarray:
    """62 mixed bits; the two lowest are left free."""
    return (mix(x) & ~np.uint64(3)).view(np.int64)


class _Texts:
    """The bytes of a block's texts, and names of the windows in them."""

    def __init__(self, body: bytes, sizes: list[int]) -> None:
        self.data = np.frombuffer(b"".join(B.texts_of(body, sizes)), np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        up, self.down = powers(len(self.data) + 1)  # a block's size bounds these tables
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        rest = self.sums[1:]
        rest[:] = self.data
        rest += np.uint64(1)
        rest *= up[: len(rest)]
        np.cumsum(rest, out=rest)

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        return _name((self.sums[at + length] - self.sums[at]) * self.down[at])

    def fitting(self, length: int) -> np.ndarray:
        """True at the positions from which length bytes of the same text follow."""
        out = np.ones(len(self.data), bool)
        for a, z in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            out[max(a, z - length + 1) : z] = False
        return out

    def picked(self, length: int) -> np.ndarray:
        own, out = np.resize(_PICKED, int(self.sizes.max(initial=0))), self.fitting(length)
        for a, z in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            out[a:z] &= own[: z - a]
        return np.flatnonzero(out)

    def wide(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For those of the positions around which length bytes fit: the position, bytes before it (at most V - 1), and the wide name."""
        text = np.searchsorted(self.starts, at, side="right") - 1
        before = np.minimum(at - self.starts[text], V - 1)
        ends = np.minimum(at + length, self.starts[text + 1])
        fits = ends - at + before >= length
        at, before, ends = at[fits], before[fits], ends[fits]
        body = (self.sums[ends] - self.sums[at - before]) * self.down[at - before]
        return at, before, _name(body + mix((before * 1024 + ends - at).astype(np.uint64)))

    def marked(self, stems: np.ndarray, stem: int) -> np.ndarray:
        """The picked suffixes named in stems."""
        at = self.picked(stem)
        return at[_among(self.names(at, stem), stems)]

    def near(self, stems: np.ndarray, length: int) -> np.ndarray:
        """Positions of strings of ``length`` bytes that hold, from one of their first V positions on, a picked suffix named in stems."""
        marked = self.marked(stems, length - V + 1)
        first = self.starts[np.searchsorted(self.starts, marked, side="right") - 1]
        return np.flatnonzero(self.within(np.maximum(marked - V + 1, first), marked) & self.fitting(length))

    def settled(self, whole: np.ndarray, length: int) -> np.ndarray:
        """True at the positions of strings of ``length`` bytes within the surroundings that a name in whole stands for."""
        if not len(whole):
            return np.zeros(len(self.data), bool)
        at, before, names = self.wide(self.picked(length - V + 1), length)
        held = _among(names, whole)
        at, low = at[held], (at - before)[held]
        last = self.starts[np.searchsorted(self.starts, at, side="right")]
        return self.within(low, np.minimum(at + length, last) - length)

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """True at the positions between any low and its high, both included."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, low, 1)
        np.add.at(edge, high + 1, -1)
        return np.cumsum(edge, out=edge)[:-1] > 0


_SENT = "array<struct<shard:int,names:binary>>"


def _packed(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values, prepend=np.uint64(0)).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint64), dtype=np.uint64)


def _sent(names: np.ndarray, shards: int, wanted: np.ndarray | None = None) -> list[dict]:
    """The distinct names of a block, packed for each of ``shards`` equal ranges.

    The lowest bit of a sent name tells that it stands twice in the block, the next one that some place with it wants an answer.
    """
    values = np.sort(names.view(np.uint64) | (np.uint64(2) if wanted is None else wanted.astype(np.uint64) << np.uint64(1)))
    last = np.flatnonzero(np.append(np.diff(values >> np.uint64(2)) > 0, True)) if len(values) else np.zeros(0, np.int64)
    twice = np.diff(last, prepend=-1) > 1
    values = values[last] | twice.astype(np.uint64)  # of equal names the last one is wanted if any is
    shard = ((values >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(values)] if len(values) else []
    return [{"shard": int(shard[a]), "names": _packed(values[a:z])} for a, z in zip(cuts, cuts[1:], strict=False)]


def _meet(rows: pa.Table, any_asks: bool = False) -> pa.Table:
    """Of one range: for each block its names that want an answer and stand at two places or more anywhere.

    With any_asks the names for which some block wants an answer, for all blocks that hold them.
    """
    B.give_back()
    lists = [_unpacked(x.as_py()) for x in rows.column("names")]
    values, of = np.concatenate(lists), np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    del lists
    numbers, order = np.unique(rows.column("block").to_numpy(), return_inverse=True)
    of = order.astype(np.int32)[of]
    parts, found = len(values) // MEET_NAMES + 1, []
    low, high = int(values.min()) >> 2, (int(values.max()) >> 2) + 1
    bounds = [(low + (high - low) * k // parts) << 2 for k in range(parts + 1)]
    for a, z in itertools.pairwise(bounds):
        some = np.flatnonzero((values >= np.uint64(a)) & (values <= np.uint64(z - 1)))
        found.append(_agreed(values[some], of[some], any_asks))
    del values, of
    names, block = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    order = np.argsort(block, kind="stable")
    names, block = names[order], numbers[block[order]]
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else []
    return pa.table({"block": pa.array(block[cuts[:-1]] if cuts else block, pa.int64()), "names": pa.array([_packed(names[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def _agreed(values: np.ndarray, of: np.ndarray, any_asks: bool) -> tuple[np.ndarray, np.ndarray]:
    """The names, and whose they are, that _meet sends back of these values; all values of a name are among them."""
    if not len(values):
        return values, of
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    names, asks = values >> np.uint64(2), (values & np.uint64(2)) > 0
    starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    sizes = np.diff(starts, append=len(names))
    if any_asks:
        good = np.repeat(np.logical_or.reduceat(asks, starts), sizes)
    else:
        good = np.repeat((sizes > 1) | np.logical_or.reduceat((values & np.uint64(1)) > 0, starts), sizes) & asks
    return names[good] << np.uint64(2), of[good]


def _known(got: pa.Scalar) -> np.ndarray:
    """The names of a block, from what the ranges sent."""
    return np.concatenate([_unpacked(x.as_py()) for x in got.values]).view(np.int64) if got.is_valid else np.zeros(0, np.int64)


def _among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    return pd.Index(known).get_indexer(names) >= 0 if len(known) else np.zeros(len(names), bool)


def _answers(asks: DataFrame, name: str, any_asks: bool = False) -> DataFrame:
    """(block, name): the packed names that _meet gives each block; checkpointed, after which the shuffles before it may go."""
    rows = asks.select("block", F.explode("sent").alias("x")).select("block", "x.shard", "x.names")
    met = rows.groupBy("shard").applyInArrow(lambda t: _meet(t, any_asks), "block bigint, names binary")
    out = checkpoint(met.groupBy("block").agg(F.collect_list("names").alias(name)))
    release_shuffles(asks.sparkSession)
    return out


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_bytes: bool = True) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, spans (maximal runs of removed bytes, end exclusive), kept (binary), kept_sha256.

    A byte is removed if a string of ``length`` bytes of its text covers it that also starts at another place of any text; length must
    be over 273. Null and empty texts, and texts shorter than length, keep all bytes; a repeated row is another place. kept is
    null unless keep_bytes. Other columns of docs aren't returned. The result is checkpointed.
    """
    if length <= V:
        raise ValueError(f"length must be over {V}")
    stem = length - V + 1

    def asked(frame: DataFrame, names_of, *lists: str) -> DataFrame:
        """(block, sent): names_of(texts, *lists of known names) gives a block's names, and which of them want an answer."""

        @F.arrow_udf(_SENT)
        def ask(sizes: pa.Array, body: pa.Array, *got: pa.Array) -> pa.Array:
            out = []
            for s, b, *known in zip(sizes, body, *got, strict=True):
                B.give_back()
                names, wanted = names_of(_Texts(b.as_py(), s.as_py()), *map(_known, known))
                out.append(_sent(names, shards, wanted))
            B.give_back()
            return pa.array(out, pa.list_(pa.struct([("shard", pa.int32()), ("names", pa.binary())])))

        return frame.select("block", ask("sizes", "body", *lists).alias("sent"))

    def sample(t: _Texts):
        return t.names(t.picked(stem), stem), None

    def widen(t: _Texts, stems: np.ndarray):
        return t.wide(t.marked(stems, stem), length)[2], None

    def edge(t: _Texts, stems: np.ndarray, whole: np.ndarray):
        at, _, names = t.wide(t.marked(stems, stem), length)
        return t.names(at, stem), ~_among(names, whole)

    def merge(t: _Texts, edges: np.ndarray, whole: np.ndarray):
        at = t.near(edges, length)
        return t.names(at, length), ~t.settled(whole, length)[at]

    @F.arrow_udf("array<struct<spans:array<struct<start:bigint,end:bigint>>,kept:binary,sha:string>>")
    def cut(sizes: pa.Array, body: pa.Array, edges: pa.Array, whole: pa.Array, single: pa.Array) -> pa.Array:
        out = []
        for s, b, e, w, n in zip(sizes, body, edges, whole, single, strict=True):
            B.give_back()
            t = _Texts(b.as_py(), s.as_py())
            found = t.settled(_known(w), length)
            if n.is_valid:
                at = t.near(_known(e), length)
                at = at[~found[at]]
                found[at[_among(t.names(at, length), _known(n))]] = True
            at = np.flatnonzero(found)
            gone = t.within(at, at + length - 1)
            rows = []
            for a, z in zip(t.starts[:-1].tolist(), t.starts[1:].tolist(), strict=True):
                part = np.concatenate(([False], gone[a:z], [False]))
                turns = np.flatnonzero(part[1:] != part[:-1]).tolist()
                kept = t.data[a:z][~gone[a:z]].tobytes() if turns else t.data[a:z].tobytes()
                rows.append({"spans": [{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2], strict=True)], "kept": kept if keep_bytes else None, "sha": hashlib.sha256(kept).hexdigest()})
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("sha", pa.string())])))

    with B.packed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], block_bytes=BLOCK_BYTES) as packed, arrow_bytes(docs.sparkSession, 1 << 20):  # about a block at a time
        total = packed.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()[0] or 0
        shards = total // SHARD_BYTES + 1
        stems = _answers(asked(packed, sample), "stems")
        going = packed.join(stems, "block")  # blocks without a repeated name are done
        whole = _answers(asked(going, widen, "stems"), "whole")
        edges = _answers(asked(going.join(whole, "block", "left"), edge, "stems", "whole"), "edges", any_asks=True)
        near = packed.join(edges, "block").join(whole, "block", "left")
        single = _answers(asked(near, merge, "edges", "whole"), "single")
        all_of = packed.join(edges, "block", "left").join(whole, "block", "left").join(single, "block", "left")
        each = all_of.select(F.explode(F.arrays_zip("rows", "sizes", cut("sizes", "body", "edges", "whole", "single").alias("c"))).alias("x"))
        return checkpoint(each.select(F.col("x.rows.id").alias(id_col), F.col("x.sizes").cast("bigint").alias("n_bytes"), F.col("x.c.spans").alias("spans"), F.col("x.c.kept").alias("kept"), F.col("x.c.sha").alias("kept_sha256")))
