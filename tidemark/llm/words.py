"""Words of many texts at once: the bytes of an Arrow string column, cut and hashed with numpy."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: A-Z to a-z on bytes; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What a word may hold: any byte but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: What a benchmark word may hold: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.ones(256, dtype=bool)
ALNUM[:0x80] = False
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    ALNUM[_low:_high] = True
#: An odd base of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the offset of each text (one more than texts); null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def parts(column: pa.Array, most_bytes: int = 2 << 20):
    """The column in runs of rows of about most_bytes, without a copy; a longer text is a run of its own."""
    sizes = np.cumsum([0, *(len(x.as_buffer() or b"") if x.is_valid else 0 for x in column)])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most_bytes, side="right")) - 1)
        yield column.slice(at, to - at)
        at = to


def word_spans(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of its text; a word never crosses two texts."""
    if not len(body):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = kind[body]
    cuts = offsets[(offsets > 0) & (offsets < len(body))]
    before = np.concatenate(([False], inside[:-1]))
    before[cuts] = False
    after = np.concatenate((inside[1:], [False]))
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Spans are hashed about so many bytes at a time; tables of powers of that size are kept, larger ones aren't.
CHUNK = 1 << 17


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of BASE and of its inverse."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_kept_powers = functools.lru_cache(maxsize=1)(powers)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, spans in order; equal bytes have equal hashes wherever they stand."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + CHUNK)))
        part = body[base : int(ends[at:to].max())]
        up, down = _kept_powers(2 * CHUNK) if len(part) < 2 * CHUNK else powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        a, z = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))
        at = to
    return out
