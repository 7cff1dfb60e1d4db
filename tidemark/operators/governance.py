"""Diagnostics, lineage, scans and release gates over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

#: Texts that must not be published.
SENSITIVE = ("contact_email_to_be_set", "api_key", "secret", "password", "private_key", "bearer ", "authorization:")


def diagnostics(df: DataFrame, *, keys: tuple[str, ...] = (), means: tuple[str, ...] = (), flags: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(diagnostic, value): rows, distinct keys, means, and counts of the named flag values, from one aggregation."""
    found = {"rows": F.count("*")} | {f"distinct_{k}": F.count_distinct(k) for k in keys} | {f"mean_{c}": F.avg(c) for c in means}
    found |= {f"{c}_{v}": F.count_if(F.col(c) == v) for c, vs in (flags or {}).items() for v in vs}
    return df.agg(F.array(*[F.struct(F.lit(k).alias("diagnostic"), c.cast("double").alias("value")) for k, c in found.items()]).alias("xs")).select(F.explode("xs").alias("x")).select("x.*")


def downstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, reached): all that follows each start node. edges: (source, target); cycles end, since a pair is followed once.

    A round is one step further, so there are as many as the longest shortest path has edges.
    """
    new = cut(starts.select("node").distinct().join(edges, F.col("node") == F.col("source")).select("node", F.col("target").alias("reached")).distinct())
    known = new
    while True:
        ahead = new.join(edges, F.col("reached") == F.col("source")).select("node", F.col("target").alias("reached")).distinct()
        new = cut(ahead.join(known, ["node", "reached"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def node_id(kind, value):
    return F.substring(F.sha1(F.concat_ws(":", kind, value)), 1, 16)


def step_edges(steps: DataFrame, run: str | None = None) -> DataFrame:
    """([run,] source, target, relation, step_order) of steps (step_order, name, inputs, outputs): consumes, produces and runs_before.

    A step runs before the one of the next step_order (of its run, if a run column is named), ties by name. Null or empty inputs and outputs have no edge.
    """
    by = [run] if run else []
    used = steps.select(*by, F.explode("inputs").alias("source"), F.col("name").alias("target"), F.lit("consumes").alias("relation"), "step_order")
    made = steps.select(*by, F.col("name").alias("source"), F.explode("outputs").alias("target"), F.lit("produces").alias("relation"), "step_order")
    before = F.lag("name").over(Window.partitionBy(*by).orderBy("step_order", "name"))
    runs = steps.select(*by, before.alias("source"), F.col("name").alias("target"), F.lit("runs_before").alias("relation"), "step_order").filter("source is not null")
    return used.unionByName(made).unionByName(runs)


def upstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, reached): all that leads to each start node; see ``downstream``."""
    return downstream(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), starts)


def sensitive_scan(df: DataFrame, key: str, text: str, patterns: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """(key, found array, status): the patterns that a text holds, in any case."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in patterns]))
    return df.select(key, found.alias("found")).withColumn("status", F.when(F.size("found") > 0, "FAIL").otherwise("PASS"))


#: Beginnings and endings of paths that must not be published.
FORBIDDEN_STARTS = (
    "data/raw/",
    "data/interim/",
    "data/external/",
    "data/processed/text/",
    "data/processed/source_tables/",
    "data/processed/features/",
    "data/processed/model/",
    "data/processed/portfolio/",
    "data/processed/targets/",
    "logs/",
    "outputs/logs/",
    ".git/",
    ".pytest_cache/",
    "__pycache__/",
)
FORBIDDEN_ENDS = (".pyc", ".pyo", ".zip")


def path_scan(df: DataFrame, path: str = "path", starts: tuple[str, ...] = FORBIDDEN_STARTS, ends: tuple[str, ...] = FORBIDDEN_ENDS) -> DataFrame:
    """df with path_problem (the first forbidden beginning, else ending of its relative path, else null) and path_status. Backslashes are slashes."""
    plain = F.replace(F.coalesce(F.col(path), F.lit("")), F.lit("\\"), F.lit("/"))
    found = F.coalesce(*[F.when(F.startswith(plain, F.lit(p)), F.lit(p)) for p in starts], *[F.when(F.endswith(F.lower(plain), F.lit(e)), F.lit(e)) for e in ends])
    return df.withColumn("path_problem", found).withColumn("path_status", F.when(F.col("path_problem").isNull(), "PASS").otherwise("FAIL"))


def scan_rollup(scanned: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rows, failed, patterns, status) of a scan's rows: the patterns that any of them holds, sorted, and FAIL if there are any."""
    hits = F.flatten(F.collect_set("found"))  # sets of a few patterns
    out = scanned.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.array_join(F.sort_array(F.array_distinct(hits)), ",").alias("patterns"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "FAIL").otherwise("PASS"))


def release_gate(checks: DataFrame, run: str = "run_id") -> DataFrame:
    """One row for each run of (run, status, critical): PASS, PASS_WITH_WARNINGS, or BLOCKED by a critical failure."""
    out = checks.groupBy(run).agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "WARN").alias("warnings"), F.count_if(F.col("critical") & (F.col("status") == "FAIL")).alias("critical_failures"))
    return out.withColumn("gate_status", F.when(F.col("critical_failures") > 0, "BLOCKED").when(F.col("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))
