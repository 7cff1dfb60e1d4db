"""Connected components of a link table, with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(links: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has a link, and the smallest node it can reach.

    Each round hooks a node's parent below the smallest grandparent next to it and then shortens the paths, so the number of rounds
    follows the logarithm of a component's width. Each round's parents are checkpointed. Minima are pre-aggregated before they
    are shuffled, so a node with very many links is no hot key. Null ends and links of a node with itself are dropped.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    both = checkpoint(pairs.union(pairs.select(F.col("v"), F.col("u"))).distinct())
    parent = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
    parent = checkpoint(parent)
    for _ in range(max_rounds):
        grand = parent.join(parent.select(F.col("u").alias("p"), F.col("p").alias("g")), "p").select("u", "p", "g")
        near = both.join(grand.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("n"))
        seen = grand.join(near, "u").select("u", "p", "g", "n")
        offers = seen.select(F.explode(F.array(F.struct(F.col("p").alias("u"), F.col("n").alias("o")), F.struct(F.col("u").alias("u"), F.least("p", "g", "n").alias("o")))).alias("x")).select("x.*")
        best = offers.groupBy("u").agg(F.min("o").alias("o"))
        step = checkpoint(parent.join(best, "u").select("u", F.least("p", "o").alias("q"), F.col("p")))
        changed = not step.filter("q <> p").isEmpty()
        parent = step.select("u", F.col("q").alias("p"))
        if not changed:
            return parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
    raise RuntimeError(f"components still change after {max_rounds} rounds")
