"""SimHash near-duplicates (operator 7): pigeonhole blocks, then a check of the Hamming distance.

A 64-bit fingerprint is split into blocks; two fingerprints that differ in at most d bits agree on all but d of the blocks. So for
every choice of d blocks the others make a key, and close pairs meet under at least one key. Copies share a fingerprint and are
collapsed before. Under one key only the left-out blocks can differ, which bounds a bucket (8 blocks and d = 2: at most 2**16
fingerprints); each bucket checks the distances and emits a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import give_back
from .common import arrow_bytes, arrow_rows, checkpoint, fresh, release_shuffles, scratch, small_side
from .components import connected_components
from .words import BASE, LOWER, NOT_SPACE, mix, parts, span_hashes, text_bytes, word_spans

BITS = 64
#: So many pairs leave a Python worker at a time.
PAIRS = 1 << 16


def _shingle_hashes(words: bytes, starts: list[int], ends: list[int], size: int, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if len(starts) < size:
        return np.array([digest(words, seed)], np.uint64)
    return np.fromiter((digest(words[s:e], seed) for s, e in zip(starts, ends[size - 1 :], strict=False)), np.uint64, len(starts) - size + 1)


def each_shingles(column: pa.Array, size: int, seed: int):
    """For each text the hashes of its shingles, repeats included: words in lower case (A-Z), joined by single spaces."""
    for part in parts(column):
        yield from _shingles_of(part, size, seed)


def _shingles_of(column: pa.Array, size: int, seed: int):
    body, offsets = text_bytes(column)
    body = LOWER[body]
    starts, ends, first = word_spans(body, offsets, NOT_SPACE)
    # words joined by single spaces: word i of a text starts behind all earlier words and as many spaces
    lengths = ends - starts
    for k in range(len(column)):
        low, high = int(first[k]), int(first[k + 1])
        if low == high:
            yield np.zeros(0, np.uint64)
            continue
        text = body[offsets[k] : offsets[k + 1]].tobytes()
        joined = b" ".join(text.split())
        n = lengths[low:high]
        to = np.cumsum(n + 1)
        if len(joined) != to[-1] - 1:  # bytes.split() and the definition of a word agree; this guards the assumption
            raise ValueError("words and their joined text disagree")
        yield _shingle_hashes(joined, (to - n - 1).tolist(), (to - 1).tolist(), size, seed)


def simhash_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; without hashes all bits are 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", size: int = 3, seed: int = 42, out: str = "fingerprint") -> DataFrame:
    """docs with a bigint column ``out`` (replaced if docs has it). Null, empty and blank texts get 0."""

    @F.arrow_udf("bigint")
    def make(column: pa.Array) -> pa.Array:
        return pa.array([simhash_of(h) for h in each_shingles(column, size, seed)], pa.int64())

    return docs.withColumn(out, make(F.col(text_col)))


def _masks(distance: int, blocks: int) -> list[int]:
    width = BITS // blocks
    masks = []
    for left_out in itertools.combinations(range(blocks), distance):
        m = (1 << BITS) - 1
        for b in left_out:
            m &= ~(((1 << width) - 1) << (b * width))
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is within distance, at most one fewer than prints."""
    n = len(prints)
    label = np.arange(n)
    us, vs = [], []
    for at in range(0, n, 512):  # 512 rows at a time against all, so memory stays bounded
        i, j = np.nonzero(np.bitwise_count(prints[at : at + 512, None] ^ prints[None, :]) <= distance)
        keep = i + at < j
        us.append(i[keep] + at)
        vs.append(j[keep])
    u, v = np.concatenate(us), np.concatenate(vs)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(n))
    signed = prints.view(np.int64)
    return [(int(signed[label[k]]), int(signed[k])) for k in far]


def links(prints: DataFrame, *, column: str = "fingerprint", distance: int = 2, blocks: int = 8) -> DataFrame:
    """(a, b): pairs of one component, enough to join every two fingerprints within distance; prints holds distinct fingerprints.

    blocks must divide 64; a bucket holds at most 2**(64 / blocks * distance) fingerprints.
    """
    masks = _masks(distance, blocks)
    keyed = prints.select(F.explode(F.array(*[F.struct(F.lit(t).cast("smallint").alias("t"), F.col(column).bitwiseAND(F.lit(m)).alias("key"), F.col(column).alias("f")) for t, m in enumerate(masks)])).alias("x")).select("x.*")
    buckets = keyed.groupBy("t", "key").agg(F.collect_list("f").alias("fs")).filter(F.size("fs") > 1)

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def forest(column: pa.Array) -> pa.Array:
        out = []
        for k in range(len(column)):
            fs = np.sort(column[k].values.to_numpy(zero_copy_only=False)).view(np.uint64)
            out.append([{"a": a, "b": b} for a, b in _forest(fs, distance)])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return buckets.select(F.explode(forest("fs")).alias("x")).select("x.*").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42, distance: int = 2, blocks: int = 8) -> DataFrame:
    """(id_col, fingerprint bigint, component): one row for each row of docs; component is the smallest id reachable.

    Fingerprints within ``distance`` bits are linked, equal ones too. Texts without words have fingerprint 0 and are linked like any
    other; repeated rows share a fingerprint. Null ids never name a component unless it has no other. Other columns aren't returned.
    """
    made = checkpoint(fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col=text_col, size=size, seed=seed, out="fingerprint").select(id_col, "fingerprint"))
    prints = made.groupBy("fingerprint").agg(F.min(id_col).alias("low"))
    roots = connected_components(links(prints, distance=distance, blocks=blocks))
    rooted = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select("fingerprint", "low", F.coalesce("root", "fingerprint").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    of = rooted.join(lowest, "root").select("fingerprint", "component")
    return made.join(of, "fingerprint").select(id_col, "fingerprint", "component")


# Near copies: exact similarity of shingle sets, found by a prefix-filter join.


def each_shingle_set(column: pa.Array, size: int):
    """For each text the distinct hashes of its shingles, sorted; words in lower case (A-Z), fewer than size words are one shingle.

    A shingle's hash is a polynomial of its words' hashes, made for all words of many texts at once.
    """
    for part in parts(column):
        body, offsets = text_bytes(part)
        body = LOWER[body]
        starts, ends, first = word_spans(body, offsets, NOT_SPACE)
        words = span_hashes(body, starts, ends)
        rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(BASE) + words[k : k + len(rolled)]
        rolled = mix(rolled)
        for low, high in itertools.pairwise(first.tolist()):
            if high - low >= size:
                yield np.unique(rolled[low : high - size + 1])
            elif high > low:
                own = np.array([high - low], np.uint64)
                for k in range(low, high):
                    own = own * np.uint64(BASE) + words[k : k + 1]
                yield mix(own)
            else:
                yield np.zeros(0, np.uint64)


def _prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all sets (common ones last), so many that two sets of this similarity share one."""
    if not len(hashes):
        return hashes
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, ranks[at], 0)
        if rank.any():
            hashes = hashes[np.lexsort((hashes, rank))]
    return hashes[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]


def _common_shingles(docs: DataFrame, id_col: str, text_col: str, size: int, sample: int, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur repeatedly in about ``sample`` texts, sorted, and their ranks from 1 by frequency. They only steer the order."""

    @F.arrow_udf("array<bigint>")
    def shingles(column: pa.Array) -> pa.Array:
        give_back()
        return pa.array([h.view(np.int64) for h in each_shingle_set(column, size)], pa.list_(pa.int64()))

    share = min(1.0, sample / max(docs.count(), 1))
    drawn = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40)) < int((1 << 40) * share)).select(text_col)
    counts = drawn.select(F.explode(shingles(F.col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    rows = counts.orderBy(F.desc("c"), "h").limit(most).collect()
    values = np.array([r.h for r in rows], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(rows) - np.arange(len(rows)))[order]


def _packed_set(hashes: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes, as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(np.unique(hashes >> np.uint64(24)), prepend=np.uint64(0)).tobytes())


def _unpacked_set(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint64), dtype=np.uint64)


def _sketch(hashes: np.ndarray, most_bits: int = 1 << 15) -> bytes:
    """Bit i is the parity of the hashes that end in i; two to four bits a hash, in whole powers of two.

    The bits in which two sketches differ are at most as many as the hashes that only one of the sets has.
    """
    bits = min(max(1 << int(2 * len(hashes) - 1).bit_length() if len(hashes) else 64, 64), most_bits)
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: bytes, n_bytes: int) -> np.ndarray:
    """The sketch at a smaller number of bytes (a power of two), as words."""
    words = np.frombuffer(sketch, np.uint64)
    while len(words) * 8 > n_bytes:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def _close(i: np.ndarray, j: np.ndarray, size: np.ndarray, sketches: list[bytes], similarity: float) -> np.ndarray:
    """Whether the sketches of rows i and j leave room for the similarity; false only where it can't be reached."""
    width = np.array([len(s) for s in sketches], np.int64)
    both = np.minimum(width[i], width[j])
    out = np.ones(len(i), bool)
    for w in np.unique(both).tolist():
        pairs = np.flatnonzero(both == w)
        rows = np.unique(np.concatenate((i[pairs], j[pairs])))
        at = np.zeros(len(sketches), np.int64)
        at[rows] = np.arange(len(rows))
        words = np.stack([_folded(sketches[r], w) for r in rows.tolist()])
        for k in range(0, len(pairs), max(1, (1 << 19) // words.shape[1])):  # 4 MB of words at a time
            some = pairs[k : k + max(1, (1 << 19) // words.shape[1])]
            apart = np.bitwise_count(words[at[i[some]]] ^ words[at[j[some]]]).sum(axis=1, dtype=np.int64)
            out[some] = apart <= (1 - similarity) / (1 + similarity) * (size[i[some]].astype(np.int64) + size[j[some]]) + 1e-9
    return out


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def _able(size_a, size_b, pos_a, pos_b, similarity: float):
    """Whether sets of these sizes, whose first common shingle has these positions in them, can be similar enough. Arrays or columns."""
    least = F.least if isinstance(size_a, Column) else np.minimum
    needed = similarity / (1 + similarity) * (size_a + size_b) - 1e-9
    return (least(size_a, size_b) >= needed) & (least(size_a - pos_a, size_b - pos_b) >= needed)


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bucket_rows: int = 1024, sample: int = 5000) -> DataFrame:
    """(id_col, component): groups of texts whose word shingles have at least this similarity, component being the smallest id.

    The similarity is the exact Jaccard similarity of the sets of shingles (compared as 40-bit hashes, of which two of a set or pair
    agree by chance about once in ten million pairs of usual texts), and a group holds everything
    that a chain of such pairs reaches; no pair is lost or added. Two sets of this similarity share one of the first shingles of
    each in any fixed order, so these are the keys under which sets meet. A sample of texts tells which shingles are common and go
    last, which changes the cost only. First sets whose SimHash fingerprints (of the same shingles) differ in at most two bits are checked,
    and every set against a few neighbours under its keys, which joins large groups; then all pairs under a key that aren't joined yet
    are checked, keys of over bucket_rows sets as blocks of rows against blocks. A pair's sets are only compared if their parity sketches,
    which bound from below what one set has and the other lacks, don't rule the similarity out. Sketches come to the distinct pairs, not to
    the keys, of which a set has dozens.
    Sets that meet under common keys without being similar are still compared by pairs. Texts without words are copies of each
    other. Repeated rows share a group; null ids never name a group of others.
    """
    return _grouped(docs, id_col, text_col, size, similarity, bucket_rows, sample).select(F.col("id").alias(id_col), "component")


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bucket_rows: int = 1024, sample: int = 5000) -> DataFrame:
    """(id, th, root, component) for each row: th is the hash of its text, root a number that its group alone has; see ``near_groups``."""
    spark = docs.sparkSession
    common, ranks = _common_shingles(docs, id_col, text_col, size, sample)

    @F.arrow_udf("struct<n:bigint,size:int,print:bigint,prefix:array<bigint>,sketch:binary>")
    def make(column: pa.Array) -> pa.Array:
        give_back()
        ns, sizes, prints, prefixes, sketches = [], [], [], [], []
        for hashes in each_shingle_set(column, size):
            ns.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
            sizes.append(len(hashes))
            prints.append(simhash_of(hashes))
            prefixes.append(_prefix(hashes, similarity, common, ranks).view(np.int64))
            sketches.append(_sketch(hashes))
        give_back()
        return pa.StructArray.from_arrays([pa.array(np.array(ns, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["n", "size", "print", "prefix", "sketch"])

    @F.arrow_udf("struct<n:bigint,packed:binary>")
    def whole(column: pa.Array) -> pa.Array:
        give_back()
        ns, packed = [], []
        for hashes in each_shingle_set(column, size):
            ns.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
            packed.append(_packed_set(hashes))
        give_back()
        return pa.StructArray.from_arrays([pa.array(np.array(ns, np.uint64).view(np.int64)), pa.array(packed, pa.binary())], ["n", "packed"])

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        give_back()
        return pa.array([_jaccard(_unpacked_set(a.as_py()), _unpacked_set(b.as_py())) >= similarity - 1e-9 for a, b in zip(x, y, strict=True)], pa.bool_())

    @F.arrow_udf("boolean")
    def close(size_a: pa.Array, size_b: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        n = len(x)
        sizes = np.concatenate((size_a.to_numpy(zero_copy_only=False), size_b.to_numpy(zero_copy_only=False)))
        return pa.array(_close(np.arange(n), np.arange(n, 2 * n), sizes, [*x.to_pylist(), *y.to_pylist()], similarity))

    with scratch(spark) as keep, arrow_rows(spark, 1000), arrow_bytes(spark):
        return _near_groups(docs, id_col, text_col, make, whole, alike, close, similarity, bucket_rows, keep)


def _near_groups(docs: DataFrame, id_col: str, text_col: str, make, whole, alike, close, similarity: float, bucket_rows: int, keep) -> DataFrame:
    """The groups, given the functions on shingles; keep cuts the lineage of a step's table."""
    spark = docs.sparkSession
    text_hash = F.xxhash64(F.col(text_col))
    made = keep(docs.select(F.col(id_col).alias("id"), text_hash.alias("th"), make(F.col(text_col)).alias("s")).select("id", "th", "s.*"))
    prints = made.groupBy("n").agg(F.min("id").alias("low"), F.min("th").alias("th"))
    sets = made.groupBy("n").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    keyed = sets.select("n", "size", F.posexplode("prefix").alias("pos", "h"))
    along = Window.partitionBy("h").orderBy(F.xxhash64("h", "n"))
    nexts = {f"{c}_2": F.lead(c).over(along) for c in ("n", "size", "pos")}
    met = keep(keyed.withColumns({"rows": F.count("*").over(Window.partitionBy("h")), **nexts}).filter("rows > 1"))
    release_shuffles(spark)

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that have the similarity."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        wanted = small_side(asked.join(prints, "n").select("th").distinct())
        texts = docs.select(text_hash.alias("th"), F.col(text_col).alias("t")).join(wanted, "th", "left_semi").groupBy("th").agg(F.first("t").alias("t"))
        known = keep(texts.select(whole(F.col("t")).alias("s")).select("s.*"))
        release_shuffles(spark)
        both = pairs.join(known.select(F.col("n").alias("a"), F.col("packed").alias("x")), "a").join(known.select(F.col("n").alias("b"), F.col("packed").alias("y")), "b")
        found = keep(both.select("a", "b", alike("x", "y").alias("ok")).filter("ok").select("a", "b"))
        release_shuffles(spark)
        return found

    able = met.filter("n_2 is not null").filter(_able(F.col("size"), F.col("size_2"), F.col("pos"), F.col("pos_2"), similarity))
    pairs = able.select(F.least("n", "n_2").alias("a"), F.greatest("n", "n_2").alias("b")).distinct()
    few = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))
    tried = keep(pairs.withColumn("k", few).filter("k <= 4").select("a", "b").union(_print_pairs(made)).distinct())
    first = similar(tried)

    roots = connected_components(first)
    release_shuffles(spark)
    rooted = met.join(roots.withColumnRenamed("node", "n"), "n", "left").select("n", "h", "size", "pos", "rows", F.coalesce("root", "n").alias("root"))
    of_key = Window.partitionBy("h")
    split = keep(rooted.select("*", F.min("root").over(of_key).alias("low"), F.max("root").over(of_key).alias("high")).filter("low <> high").drop("low", "high"))
    release_shuffles(spark)
    blocks = _key_blocks(split, bucket_rows)

    def open_pairs(batches):
        for batch in batches:
            for i, j, xs in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("xs"), strict=True):
                a, b = _open_pairs(xs.values, i != j, similarity)
                for at in range(0, len(a), PAIRS):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + PAIRS]) for x in (a, b)], ["a", "b"])
                del a, b
            give_back()

    rest = keep(blocks.select("i", "j", "xs").mapInArrow(open_pairs, "a bigint, b bigint").distinct().join(tried, ["a", "b"], "left_anti"))
    release_shuffles(spark)
    sketches = keep(made.groupBy("n").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    side = lambda c, size, sketch: sketches.toDF(c, size, sketch)
    rest = keep(rest.join(side("a", "size_a", "x"), "a").join(side("b", "size_b", "y"), "b").filter(close("size_a", "size_b", "x", "y")).select("a", "b"))
    release_shuffles(spark)
    edges = first if rest.isEmpty() else first.union(similar(rest))
    roots = connected_components(edges)
    rooted = prints.join(roots, prints["n"] == roots["node"], "left").select("n", "low", F.coalesce("root", "n").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    of = rooted.join(lowest, "root").select("n", "root", "component")
    return checkpoint(made.select("id", "th", "n").join(of, "n").select("id", "th", "root", "component"))


def _key_blocks(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """(h, i, j, xs): the rows (n, h, size, pos, rows, root) of each key, those of over bucket_rows as parts i against parts j."""
    parts_of = F.ceil(F.col("rows") / bucket_rows)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("n"), parts_of).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (parts_of - 1).cast("int"))))
    return dealt.groupBy("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(F.struct("n", "size", "pos", "root", "part")).alias("xs"))


def _print_pairs(made: DataFrame) -> DataFrame:
    """(a, b): sets whose SimHash fingerprints differ in at most two bits, enough pairs to connect them; of made's columns n and print."""
    own = checkpoint(made.select("n", "print").distinct())
    first = own.groupBy("print").agg(F.min("n").alias("low"))
    same = own.join(first, "print").filter("n <> low").select("low", "n")
    near = links(first.select("print"), column="print").join(first.select(F.col("print").alias("a"), F.col("low").alias("n_a")), "a").join(first.select(F.col("print").alias("b"), F.col("low").alias("n_b")), "b").select("n_a", "n_b")
    return same.union(near).toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _open_pairs(rows: pa.Array, across: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows under one key that have different roots and can be similar enough, by size, place and, where rows hold it, sketch; only those of different parts if across."""
    n, size, pos, root, part = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("n", "size", "pos", "root", "part"))
    sketches = rows.field("sketch").to_pylist() if rows.type.get_field_index("sketch") >= 0 else None
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(n), 512):  # 512 rows at a time against all, so memory stays bounded
        to = slice(at, at + 512)
        good = (root[to, None] != root[None, :]) & (n[to, None] < n[None, :]) & _able(size[to, None], size[None, :], pos[to, None], pos[None, :], similarity)
        if across:
            good &= part[to, None] != part[None, :]
        i, j = np.nonzero(good)
        i += at
        keep = slice(None) if sketches is None else _close(i, j, size, sketches, similarity)
        low.append(n[i[keep]])
        high.append(n[j[keep]])
    return np.concatenate(low), np.concatenate(high)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without near copies: one row of each group stays, with all its columns.

    It is the row with the smallest id (null ids last), then the smallest hash of the text; of rows that agree in both, that with the smallest hash of all
    columns. Groups are of rows, so unlike texts stay whether their ids are null, repeated or unique.
    """
    groups = _grouped(docs, id_col, text_col, **params)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("w"))
    th, kept, row = (fresh(docs, c) for c in ("text_hash", "kept_id", "row"))
    winners = first.select(F.col("w.id").alias(kept), F.col("w.th").alias(th))
    hashed = docs.withColumn(th, F.xxhash64(F.col(text_col)))
    rows = hashed.join(winners, (hashed[th] == winners[th]) & hashed[id_col].eqNullSafe(winners[kept]), "left_semi")
    columns = [F.col(c) for c in docs.columns]
    return rows.groupBy(id_col, th).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row)).select(f"{row}.*")
