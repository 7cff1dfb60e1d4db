"""Mixing sources to target weights (operator 13): capped water-filling, then seeded whole and fractional repetitions.

Each source's share of the mix follows its weight, but a source is read at most a given number of times. Sources above that limit are clamped
and what they can't give goes to the others in proportion to their weights, until no source is above. A source is then
taken whole as often as its target allows, and the rest of the target is a fractional repetition: rows in a seeded order from its start, the last of
them in part. All of it is DataFrame work: no row of a source meets more of that source than a range of the order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, scratch, whole_text

WORD = r"[^\x20\x09-\x0D]+"
_LOCAL = (1 << 33) - 1  # the lower bits of monotonically_increasing_id count the rows of a partition


def numbered(df: DataFrame, keep, *order: Column, name: str) -> DataFrame:
    """df with a gapless number from 0 in the given order; counted by ranges, so that no task holds all rows."""
    cut = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(_LOCAL)}))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = cut.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_start"))
    return cut.join(starts, "_range").select(*df.columns, (F.col("_start") + F.col("_place")).alias(name))


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which least(cap, weight x level) adds up to total; sources: (weight, cap). A round is one aggregation to one row.

    Infinite if all caps together are below total.
    """
    level = 0.0
    while True:
        over = F.col("cap") < F.col("weight") * level
        clamped, free = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight").cast("double")))).first()
        if not free:
            return math.inf
        higher = (total - clamped) / free
        if higher <= level:
            return level
        level = higher


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carry..., source, size, source_size, target, whole, part, taken) for every row of docs.

    size: words of the whole text (null: 0). Sources in order of code points, null last, take the weights in turn and again from the first;
    targets add up to share x all sizes and none is above most x its source's size. whole: how often the row is taken in full; part: words that the
    fractional repetition takes from it, all of them but for one row of a source; taken = whole x size + part, at most most rounded up x size.
    A source's taken words are its target rounded, whatever its rows' sizes.

    The order within a source is that of md5(seed:id), then size. Rows that are alike in id, size and source are
    interchangeable: which of them is taken in part isn't defined, the rows of the result are. Null ids count as "". An empty table gives no rows; a source of empty texts has a target of 0.
    carry: columns of docs to keep; those with a name of the result are replaced.
    """
    carry = [c for c in carry if c.lower() not in ("source", "size", "source_size", "target", "whole", "part", "taken")]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    kept = {f"c{k}": c for k, c in enumerate(carry)}  # so that no column of docs clashes
    by = ["source", "key", "size", "tie"]
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(*[F.col(c).alias(k) for k, c in kept.items()], F.struct(F.col(source_col).alias("v")).alias("source"), F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("bigint").alias("size"), key.alias("key"))
        rows = keep(rows.withColumn("tie", F.monotonically_increasing_id()))
        sums = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), keep, F.asc_nulls_last("source.v"), name="number")
        weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights)).cast("int"))
        sources = keep(sums.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
        total = sources.agg(F.sum("source_size")).first()[0] or 0
        level = water_level(sources, total * share)
        target = F.least(F.col("cap"), F.col("weight") * level) if total else F.lit(0.0)
        aimed = sources.select("source", "source_size", target.alias("target"))
        aimed = aimed.withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
        aimed = aimed.withColumn("extra", F.round("target").cast("bigint") - F.col("whole") * F.col("source_size"))
        # ranges of the order are of near equal size whatever the sources' sizes
        cut = keep(rows.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
        runs = cut.groupBy("source", "range").agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
        starts = runs.select("source", "range", F.coalesce(before, F.lit(0)).alias("start")).join(aimed, "source")
        inside = F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1))
        placed = cut.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["source", "range"])
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("start") - F.col("inside"))).cast("bigint")
        out = placed.withColumn("part", part)
        return checkpoint(out.select(*[F.col(k).alias(c) for k, c in kept.items()], F.col("source.v").alias("source"), "size", "source_size", "target", F.col("whole").cast("int").alias("whole"), "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken")))
