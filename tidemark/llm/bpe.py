"""BPE encoding and decoding (operator 5): speculate and verify.

A word is first cut greedily into the longest tokens, all new words of a batch walking down one trie together. A cut is the exact one
if and only if merging the text of every two adjacent tokens gives back these two tokens. Those checks are made for all new words of
a batch at once, on the distinct pairs of token ids that aren't known yet. Words that fail go through exact merging, again many at
a time. What was found for words and pairs is kept in tables of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import fresh
from .words import parts

RESULT = StructType([StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded_sha256", StringType())])
_ARROW = pa.struct([("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded_sha256", pa.string())])
#: Words of more symbols are merged one by one with a heap; shorter ones together in a padded table.
_LONG = 64


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


class _Lookup:
    """Values of sorted integer keys; ``missing`` for all others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values, self.missing = keys[order], values[order], missing

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(keys.shape, self.missing, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.missing)


class Merges:
    """A word-level BPE vocabulary file: merges within words, an end-of-word mark, lower case, bytes as characters."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.names = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for name, i in (*ids.items(), *self.special.items()):
            self.names[i] = name
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        # the same on ASCII, for which the standard library is faster
        self.ascii_words = re.compile(split.replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r "))
        characters = _byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.none = len(model["merges"])
        made = [(ids[a], ids[b], ids[a + b]) for a, b in map(tuple, model["merges"])]
        first, second, self.result = (np.array([*x, -1], np.int64) for x in zip(*made, strict=True))
        self.rank_of = _Lookup((first << 32 | second)[:-1], np.arange(self.none), self.none)
        self.first_ids = np.array([ids[c] for c in characters], np.int64)
        self.last_ids = np.array([ids[c + end] for c in characters], np.int64)
        # the bytes of each token, whether it ends a word, and a trie over the bytes with the inner and the last token at each node
        self.token_bytes = [bytes(byte_of[c] for c in name.removesuffix(end)) if name not in self.special else b"" for name in self.names]
        self.is_last = np.array([name.endswith(end) for name in self.names])
        nodes: dict[bytes, int] = {b"": 0}
        for token in self.token_bytes:
            for n in range(1, len(token) + 1):
                nodes.setdefault(token[:n], len(nodes))
        edges = [(nodes[t[:-1]] << 8 | t[-1], k) for t, k in nodes.items() if t]
        self.step = _Lookup(np.array([e for e, _ in edges]), np.array([k for _, k in edges]), -1)
        self.inner, self.last = np.full(len(nodes), -1), np.full(len(nodes), -1)
        for i, token in enumerate(self.token_bytes):
            if token:
                (self.last if self.is_last[i] else self.inner)[nodes[token]] = i

    def greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest tokens of all words data[start:end] from left to right: token ids, and where in data each begins, in order."""
        ids, places = [], []
        at, stop = starts.copy(), ends.copy()
        cur, node = at.copy(), np.zeros(len(at), np.int64)
        best, size = np.full(len(at), -1), np.zeros(len(at), np.int64)
        while len(at):
            on = cur < stop
            node = np.where(on, self.step(node << 8 | data[np.minimum(cur, len(data) - 1)]), -1)
            walks = node >= 0
            cur = cur + walks
            token = np.where(cur == stop, self.last[node], self.inner[node])
            found = walks & (token >= 0)
            best, size = np.where(found, token, best), np.where(found, cur - at, size)
            cut = ~walks
            if cut.any():
                if (best[cut] < 0).any():
                    raise ValueError("the vocabulary has no token for a byte of a word")
                ids.append(best[cut])
                places.append(at[cut])
                at = np.where(cut, at + size, at)
                cur, node, best = np.where(cut, at, cur), np.where(cut, 0, node), np.where(cut, -1, best)
                live = at < stop
                if not live.all():
                    at, stop, cur, node, best, size = (x[live] for x in (at, stop, cur, node, best, size))
        ids, places = np.concatenate(ids), np.concatenate(places)
        order = np.argsort(places, kind="stable")
        return ids[order], places[order]

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of words given as byte tokens, one after the other: their tokens and how many each has.

        The pair of the lowest rank goes first, the leftmost of equal ones.
        """
        firsts = np.cumsum(sizes) - sizes
        counts, done = np.zeros(len(sizes), np.int64), []
        low = 0
        for width in (8, 16, 32, _LONG):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(rows), 1 << 14):
                done += self._merged_table(rows[at : at + (1 << 14)], symbols, firsts, sizes, width)
        for r in np.flatnonzero(sizes > _LONG).tolist():
            done.append((np.array([r]), np.array([self._merged_long(symbols[firsts[r] : firsts[r] + sizes[r]].tolist())], np.int64)))
        for rows, tokens in done:
            counts[rows] = (tokens >= 0).sum(1)
        to = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for rows, tokens in done:
            real = tokens >= 0
            out[(to[rows][:, None] + np.arange(tokens.shape[1]))[real]] = tokens[real]
        return out, counts

    def _merged_table(self, rows: np.ndarray, symbols: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        places = firsts[rows][:, None] + np.arange(width)
        t = np.where(np.arange(width) < sizes[rows][:, None], symbols[np.minimum(places, len(symbols) - 1)], -1)
        ranks = np.where(t[:, 1:] >= 0, self.rank_of(t[:, :-1] << 32 | np.maximum(t[:, 1:], 0)), self.none)
        done = []
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            over = best == self.none
            if over.any():
                done.append((rows[over], t[over]))
                going = ~over
                rows, t, ranks, at, best = rows[going], t[going], ranks[going], at[going], best[going]
                if not len(rows):
                    break
            n, w = t.shape
            line = np.arange(n)
            t[line, at] = self.result[best]
            keep = np.ones((n, w), bool)
            keep[line, at + 1] = False
            t = t[keep].reshape(n, w - 1)
            if w == 2:
                done.append((rows, t))
                break
            keep = np.ones((n, w - 1), bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(n, w - 2)
            for shift in (-1, 0):
                x = at + shift
                ok = np.flatnonzero((x >= 0) & (x < w - 2))
                ok = ok[t[ok, x[ok] + 1] >= 0]
                ranks[ok, x[ok]] = self.rank_of(t[ok, x[ok]] << 32 | t[ok, x[ok] + 1])
        return done

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same merges for a long word, in time n log n: a heap of pairs, each merge renews its two neighbours."""
        n, flat = len(parts), np.array(parts, np.int64)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.rank_of(flat[:-1] << 32 | flat[1:])
        known = dict(zip(zip(parts, parts[1:], strict=False), ranks.tolist(), strict=True))
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(ranks.tolist()) if r < self.none]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue  # a neighbour has been merged since
            parts[i], parts[j] = int(self.result[rank]), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0:
                    pair = (parts[x], parts[y])
                    if pair not in known:
                        known[pair] = int(self.rank_of(np.array([pair[0] << 32 | pair[1]]))[0])
                    if known[pair] < self.none:
                        heapq.heappush(heap, (known[pair], x, *pair))
        return [p for p in parts if p >= 0]

    def symbols_of(self, data: np.ndarray, ends: np.ndarray, last: np.ndarray | bool = True) -> np.ndarray:
        """The byte tokens of words that end at ends; where last is true the final byte ends a word."""
        out = self.first_ids[data]
        finals = (ends - 1)[last] if last is not True else ends - 1
        out[finals] = self.last_ids[data[finals]]
        return out

    def fits(self, codes: np.ndarray) -> np.ndarray:
        """For each code of two tokens, (a + 1) << 32 | b: merging the joined text of a and b gives a and b; b alone if a is -1."""
        a, b = (codes >> 32) - 1, codes & 0xFFFFFFFF
        texts = [(self.token_bytes[x] if x >= 0 else b"") + self.token_bytes[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = self.symbols_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes), self.is_last[b])
        out, counts = self.merged(symbols, sizes)
        at = np.cumsum(counts) - counts
        alone = (a < 0) & (counts == 1)
        alone[alone] = out[at[alone]] == b[alone]
        both = (a >= 0) & (counts == 2)
        both[both] = (out[at[both]] == a[both]) & (out[at[both] + 1] == b[both])
        return alone | both


@functools.lru_cache(maxsize=1)
def _merges(path: str) -> Merges:
    return Merges(path)


class WordBpe:
    """Encodes and decodes texts, and keeps what it found for words and pairs of tokens, within keep_bytes and keep_pairs."""

    def __init__(self, path: str, keep_bytes: int = 24 << 20, keep_pairs: int = 200_000) -> None:
        self.merges = _merges(path)
        self.keep_bytes, self.keep_pairs = keep_bytes, keep_pairs
        self.known: dict[str | int, bytes] = {}
        self.held = 0
        self.pairs = _Lookup(np.zeros(0, np.int64), np.zeros(0, np.int64), -1)

    def _checked(self, codes: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(codes, return_inverse=True)
        got = self.pairs(distinct)
        new = distinct[got < 0]
        if len(new):
            got[got < 0] = self.merges.fits(new)
            room = len(self.pairs.keys) + len(new) <= self.keep_pairs
            old = (self.pairs.keys, self.pairs.values) if room else (distinct[:0], got[:0])
            added = (new, self.pairs.values[:0]) if len(new) > self.keep_pairs else (new, got[np.searchsorted(distinct, new)])
            if len(added[1]):
                self.pairs = _Lookup(np.concatenate((old[0], added[0])), np.concatenate((old[1], added[1])), -1)
        return got[where] > 0

    def learn(self, new: list[str]) -> None:
        """Encode distinct words that aren't in the table yet."""
        m = self.merges
        texts = [w.encode() for w in new]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        tokens, places = m.greedy(data, starts, ends)
        word = np.searchsorted(starts, places, side="right") - 1
        before = np.concatenate(([-1], tokens[:-1]))
        before[places == starts[word]] = -1  # the first token of a word has none before it; alone it must stand as it is
        bad = np.unique(word[~self._checked((before + 1) << 32 | tokens)])
        failed = np.zeros(len(new), bool)
        failed[bad] = True
        inside = np.repeat(failed, sizes)
        again, counts = m.merged(m.symbols_of(data, ends)[inside], sizes[failed])
        good = ~failed[word]
        words = np.concatenate((word[good], np.repeat(bad, counts)))
        order = np.argsort(words, kind="stable")
        blob = np.concatenate((tokens[good], again))[order].astype("<u4").tobytes()
        to = (np.cumsum(np.bincount(words, minlength=len(new))) * 4).tolist()
        at = 0
        for w, z in zip(new, to, strict=True):
            self.known[w] = blob[at:z]
            at = z
        self.held += len(data) + len(blob) + 150 * len(new)

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text in order, and the ids of special tokens that stand in it."""
        m = self.merges
        if "<|" in text and m.split_special:
            found = m.split_special.split(text)
        else:
            found = [text]
        out: list[str | int] = []
        for k, part in enumerate(found):
            if k % 2:
                out.append(m.special[part])
            elif part:
                if part.isascii():
                    out += m.ascii_words.findall(part.lower())
                else:
                    out += m.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        if self.held > self.keep_bytes:
            self.known.clear()
            self.held = 0
        lists = list(map(self.pieces, texts))
        wanted = {w for ws in lists for w in ws}
        for w in wanted:
            if w.__class__ is int:
                self.known[w] = w.to_bytes(4, "little")
        if new := list(wanted - self.known.keys()):
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in lists]

    def decode(self, ids: bytes) -> str:
        """The vocabulary has no decoder of its own, so token strings are joined by spaces."""
        return " ".join(map(self.merges.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", out: str = "tokens", keep_text: bool = True) -> DataFrame:
    """docs with a struct column ``out``: n_tokens, ids as packed little-endian unsigned 32-bit integers, decoded_sha256 of their text.

    vocabulary: a word-level BPE file that every executor has. No special tokens are added, those in a text count. Null and empty
    texts have no tokens. Repeated rows each get their ids; a column of docs called ``out`` is replaced; other columns stay, but for
    the text itself where keep_text is false. Texts are read about 1 MB at a time; a longer one is read alone.
    """
    names = [c for c in docs.columns if c.lower() != out.lower() and (keep_text or c.lower() != text_col.lower())]
    mark = fresh(docs, "encoded_text")
    frame = docs.select(*[F.col(c) for c in names], F.col(text_col).alias(mark))
    schema = StructType([*[docs.schema[c] for c in names], StructField(out, RESULT)])

    def run(batches):
        bpe = WordBpe(vocabulary)  # lives as long as the task
        for batch in batches:
            at = 0
            for part in parts(batch.column(len(names)), 1 << 20):
                ids = bpe.encode_all([t or "" for t in part.to_pylist()])
                shas = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
                made = pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(shas, pa.string())], fields=list(_ARROW))
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(part)) for c in batch.columns[:-1]], made], names=[*names, out])
                at += len(part)

    return frame.mapInArrow(run, schema)


def decoded(ids: Column, vocabulary: str) -> Column:
    """The text that packed ids stand for; null for null."""

    @F.arrow_udf(StringType())
    def run(column: pa.Array) -> pa.Array:
        bpe = WordBpe(vocabulary)
        return pa.chunked_array([pa.array([None if x is None else bpe.decode(x) for x in part.to_pylist()], pa.string()) for part in parts(column, 1 << 20)], pa.string()).combine_chunks()

    return run(ids)
