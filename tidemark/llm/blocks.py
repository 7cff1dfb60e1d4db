"""Texts packed into blocks of a few megabytes, and tables of byte n-grams that blocks ask for.

A job over all n-grams of a corpus would shuffle a row for each position. Here a block sends each n-gram that it holds once, with its
count; the counts are joined by n-gram, and each block gets back one value for each n-gram it asked for. A frequent n-gram is thus
one row for each block, however often it stands there. A block is one row that holds its texts, so what comes back meets them again
by an ordinary join on the block's number.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, bucketed, whole_text

#: Stand for the places before a text and for its end; neither byte occurs in UTF-8.
START, END = 0xFF, 0xFE
BLOCK_BYTES = 8 << 20
#: So many bytes of a block are searched at a time, which bounds a task's memory.
RUN_BYTES = 1 << 20


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from stage to stage, and what earlier blocks and stages freed stays theirs otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def packed(docs: DataFrame, keys: list[str], *, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[DataFrame]:
    """(block, rows array<struct<keys>>, sizes, body): texts of a partition in order, until a block holds block_bytes.

    body holds the compressed UTF-8 bytes. Null texts are empty. A text over block_bytes makes a block of its own. The blocks are a
    table dealt out by block's number while the context lasts, so what is joined to them comes to where they lie.
    """
    frame = docs.select(F.struct(*keys).alias("row"), whole_text(text_col).alias("text"))
    row_type = frame.schema["row"].dataType.simpleString()

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        rows, sizes, held, total, kind = [], [], [], 0, None

        def block():
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([rows], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int32())), pa.array([body], pa.binary())], names=["block", "rows", "sizes", "body"])

        for batch in batches:
            kind = batch.schema.field("row").type
            for row, text in zip(batch.column("row"), batch.column("text"), strict=True):
                data = text.as_py().encode()
                rows.append(row.as_py())
                sizes.append(len(data))
                held.append(data)
                total += len(data)
                if total >= block_bytes:
                    yield block()
                    rows, sizes, held, total, number = [], [], [], 0, number + 1
        if rows:
            yield block()

    with contextlib.ExitStack() as stack:
        with arrow_bytes(docs.sparkSession):
            found = stack.enter_context(bucketed(frame.mapInArrow(run, f"block bigint, rows array<{row_type}>, sizes array<int>, body binary"), "block"))
        yield found


def texts_of(body: bytes, sizes: list[int]) -> list[bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    for n in sizes:
        out.append(data[at : at + n])
        at += n
    return out


def grams_of(texts: list[bytes], order: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """All byte n-grams of this order, as integers whose lowest byte is the last one, and the first position of each text.

    Each text is padded in front; with end, the END byte counts as its last one.
    """
    pad, stop = bytes([START]) * (order - 1), bytes([END]) * end
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, stop)), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + int(end)
    grams = np.zeros(max(0, len(data) - order + 1), np.int64)
    for k in range(order):
        grams |= data[order - 1 - k : len(data) - k].astype(np.int64) << (8 * k)
    keep = np.ones(len(grams), bool)
    tops = np.cumsum(sizes + order - 1)[:-1]  # the windows that would reach into the next text's padding
    for k in range(1, order):
        keep[tops + k - order] = False if len(tops) else keep[tops + k - order]
    grams = grams[keep]
    return grams, np.concatenate(([0], np.cumsum(sizes)))


def runs(texts: list[bytes], most_bytes: int = RUN_BYTES):
    """(from, to) of runs of texts of about most_bytes; a longer text is a run of its own."""
    at = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most_bytes:
            yield at, k
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def _turns(keys: np.ndarray) -> np.ndarray:
    """The first place of each value of sorted keys, one at least."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def counted(texts: list[bytes], keys_of, groups: np.ndarray, n_groups: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block's texts, and for each of n_groups how often they stand in its texts; texts of a negative group don't count.

    keys_of(texts) gives keys and each text's first.
    """
    found, counts, pending = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(found)
        order = np.argsort(keys)
        keys = keys[order]
        at = _turns(keys)
        return keys[at], np.add.reduceat(np.concatenate(counts)[order], at)

    for a, z in runs(texts):
        keys, first = keys_of(texts[a:z])
        of = np.repeat(groups[a:z], np.diff(first))
        for g in range(-1, n_groups):
            own = np.sort(keys[of == g if g >= 0 else of < 0])
            if not len(own):
                continue
            at = _turns(own)
            total = np.zeros((len(at), n_groups), np.int64)
            if g >= 0:
                total[:, g] = np.diff(at, append=len(own))
            found.append(own[at])
            counts.append(total)
            pending += len(at)
        if pending > max(1 << 19, len(found[0]) if found else 0):  # so what runs share isn't held once for each
            distinct, total = merged()
            found, counts, pending = [distinct], [total], 0
    give_back()
    return merged() if found else (np.zeros(0, np.int64), np.zeros((0, n_groups), np.int64))


def counts_array(blocks: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> pa.Array:
    """Lists of (k, names...), one for each block."""
    kind = pa.struct([(n, pa.int64()) for n in ("k", *names)])
    made = [pa.StructArray.from_arrays([pa.array(k, pa.int64()), *[pa.array(np.ascontiguousarray(c[:, j]), pa.int64()) for j in range(len(names))]], fields=list(kind)) for k, c in blocks]
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32), pa.concat_arrays(made) if made else pa.array([], kind))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values between each two firsts; empty ranges give 0."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


class Answers:
    """The value of each key; every key asked for is known."""

    def __init__(self, known: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(known)
        self.known, self.values = known[order], values[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if len(self.known) > 1 << 17 and len(keys):  # more than a processor's cache holds: sorting takes less time than a hash table
            order = np.argsort(keys)
            keys = keys[order]
            at = _turns(keys)
            out = np.empty(len(keys), self.values.dtype)
            out[order] = np.repeat(self.values[np.searchsorted(self.known, keys[at])], np.diff(at, append=len(keys)))
            return out
        codes, distinct = pd.factorize(keys)
        return self.values[np.searchsorted(self.known, distinct)][codes]


def with_answers(blocks: DataFrame, answers: DataFrame, values: list[str]) -> DataFrame:
    """blocks with arrays of the keys and values that answers (block, k, values...) holds for each; a block's arrays are bounded by its size."""
    got = answers.groupBy("block").agg(F.collect_list(F.struct("k", *values)).alias("got"))
    return blocks.join(got, "block", "left")
