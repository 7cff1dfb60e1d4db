"""Sharding (operator 1): sampled splitters.

Keys are sampled with a chance in proportion to a row's size, so that quantiles of the sample cut the keys into ranges of near equal
bytes. The key is a hash of the text, then a hash of the id: equal texts stand together, and a text with very many copies can still
be cut. Ranges that turn out overfull are cut again at quantiles of their own sample. Shards are runs of ranges, closed at the range
edge nearest to the ideal size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh

KEY = ("hi", "lo")
_SPAN = 2.0**64


def _search(splitters: list[tuple[int, int]], key: tuple[str, str] = KEY) -> Column:
    """How many splitters are at most the row's key: a binary search in steps of halving width over an array literal."""
    if not splitters:
        return F.lit(0)
    his, los = (F.array(*[F.lit(x) for x in column]) for column in zip(*splitters, strict=True))
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))])

    def step(at: Column, width: Column) -> Column:
        hi, lo = F.get(his, at + width - 1), F.get(los, at + width - 1)
        return F.when((hi < F.col(key[0])) | ((hi == F.col(key[0])) & (lo <= F.col(key[1]))), at + width).otherwise(at)  # null beyond the end

    return F.aggregate(widths, F.lit(0), step)


def _quantile_splitters(sample: DataFrame, by: list[str], parts: Column) -> DataFrame:
    """For each group the keys that cut its sample into ``parts`` equal runs."""
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*KEY))
    ranked = sample.withColumns({"n": n, "place": place, "parts": parts})
    return ranked.filter(F.floor(F.col("place") * F.col("parts") / F.col("n")) > F.floor((F.col("place") - 1) * F.col("parts") / F.col("n"))).filter("place < n").select(*by, *KEY)


def plan(keyed: DataFrame, shards: int, *, per_shard: int = 24, tolerance: float = 0.02, sample_rows: int = 30_000, max_rounds: int = 6) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Splitters in order, and (bytes, rows) of the ranges between them.

    keyed: (hi, lo, size). The sample is bounded by sample_rows whatever the data's size, and so is the number of splitters. A range is overfull above 2.25 times ``tolerance`` of a shard (the sample scatters);
    it is cut at quantiles of a sample of its own rows, for at most max_rounds rounds. Ranges of a single key stay.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], []
    ideal = total / shards

    def sampled(rows: DataFrame, rate: Column, salt: int) -> DataFrame:
        chance = (F.xxhash64("hi", "lo", F.lit(salt)).cast("double") + 2.0**63) / _SPAN
        return rows.filter(chance < F.col("size") * rate).select(*[c for c in ("range", *KEY) if c in rows.columns])

    first = sampled(keyed, F.lit(sample_rows / total), 0).withColumn("range", F.lit(0))
    splitters = sorted({(r.hi, r.lo) for r in _quantile_splitters(first, ["range"], F.lit(shards * per_shard)).collect()})
    for salt in range(1, max_rounds + 1):
        ranged = keyed.withColumn("range", _search(splitters))
        filled = {r.range: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max(F.struct(*KEY)).alias("top"), F.min(F.struct(*KEY)).alias("bottom")).collect()}
        full = {k: r.bytes for k, r in filled.items() if r.bytes > tolerance * 1.5 * ideal * 1.5 and r.top != r.bottom}
        if not full or salt == max_rounds:
            break
        at = F.create_map(*[x for k, b in full.items() for x in (F.lit(k), F.lit(float(b)))])[F.col("range")]
        own = ranged.filter(F.col("range").isin(*full))
        again = sampled(own, F.lit(sample_rows / len(full)) / at, salt)
        more = _quantile_splitters(again, ["range"], F.ceil(at / (tolerance * ideal)))
        grown = sorted({*splitters, *((r.hi, r.lo) for r in more.collect())})
        if len(grown) == len(splitters):
            break
        splitters = grown
    return splitters, [(filled[k].bytes, filled[k].rows) if k in filled else (0, 0) for k in range(len(splitters) + 1)]


def close(sizes: list[int], shards: int) -> list[int]:
    """The shard of each range: range edges nearest to the ideal boundaries, in order."""
    total, out, done, shard = sum(sizes), [], 0, 0
    for size in sizes:
        while shard < shards - 1 and done + size / 2 >= (shard + 1) * total / shards:
            shard += 1
        out.append(shard)
        done += size
    return out


def assign(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 500, **params) -> DataFrame:
    """docs with columns size, text_crc32, shard and slot (gapless from 0 in each shard); columns of docs with these names are replaced.

    Size is the text's UTF-8 bytes plus 1 (null: 1). Shards hold near equal bytes. Equal texts have equal keys and share a shard unless a boundary
    falls among their copies. Rows are numbered within small cells, whose counts give each cell's first slot, so no shard is sorted
    in one task; repeated rows get different slots. Only columns that are used later are carried along.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "text_crc32", "shard", "slot")])
    own = {k: fresh(docs, f"shard_{k}") for k in ("hi", "lo", "range", "cell", "place", "from")}
    key = own["hi"], own["lo"]
    text = F.col(text_col)
    hi, lo = F.xxhash64(text), F.xxhash64(F.col(id_col), F.lit("row"))
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")
    keyed = checkpoint(docs.select(hi.alias("hi"), lo.alias("lo"), size.alias("size")))
    splitters, filled = plan(keyed, shards, **params)
    of = close([b for b, _ in filled], shards) or [0]
    rows = docs.withColumns({"size": size, "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")), own["hi"]: hi, own["lo"]: lo})
    cells = {k: max(1, math.ceil(n / cell_rows)) for k, (_, n) in enumerate(filled)}
    # the tables below have an entry for each range, and the number of ranges is bounded by the sample
    shard_of, cells_of = F.array(*[F.lit(s) for s in of]), F.array(*[F.lit(cells.get(k, 1)) for k in range(len(of))])

    def dealt(frame: DataFrame) -> DataFrame:
        ranged = frame.withColumn(own["range"], _search(splitters, key))
        return ranged.withColumns({"shard": F.get(shard_of, F.col(own["range"])), own["cell"]: F.pmod(F.xxhash64(own["lo"], own["hi"]), F.get(cells_of, F.col(own["range"])))})

    counts = dealt(keyed.withColumnsRenamed({"hi": own["hi"], "lo": own["lo"]})).groupBy("shard", own["range"], own["cell"]).agg(F.count("*").alias("n"))
    ranges = counts.groupBy("shard", own["range"]).agg(F.sum("n").alias("n"))
    before = ranges.select(own["range"], (F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(own["range"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("range_from"))
    within = F.sum("n").over(Window.partitionBy(own["range"]).orderBy(own["cell"]).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.join(before, own["range"]).select(own["range"], own["cell"], (F.col("range_from") + F.coalesce(within, F.lit(0))).alias(own["from"]))
    numbered = dealt(rows).withColumn(own["place"], F.row_number().over(Window.partitionBy(own["range"], own["cell"]).orderBy(*key)) - 1)
    placed = numbered.join(starts, [own["range"], own["cell"]])
    return placed.withColumn("slot", (F.col(own["from"]) + F.col(own["place"])).cast("bigint")).select(*docs.columns, "size", "text_crc32", "shard", "slot")
