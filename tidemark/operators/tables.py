"""Operators on keyed tables: one row for each key, lookups, pivots of facts, comparable periods, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_row = 1").drop("_row")


def mark_repeats(df: DataFrame, keys: list[str], order: list[Column], out: str = "is_duplicate") -> DataFrame:
    """True for the second and later rows of a key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def pivot_facts(facts: DataFrame, key: str, concept: str, value: str, concepts: list[str], rank: list[Column]) -> DataFrame:
    """One row for each key: the best fact's value of each concept, and how many concepts there are."""
    best = keep_one(facts.filter(F.col(concept).isin(concepts)), [key, concept], rank)
    wide = best.groupBy(key).pivot(concept, concepts).agg(F.first(value))
    return wide.withColumn("coverage", sum((F.col(f"`{c}`").isNotNull().cast("int") for c in concepts), F.lit(0)))


def comparable_deltas(df: DataFrame, entity: str, period: Column, order: list[Column], values: list[str]) -> DataFrame:
    """Each row with the changes since the entity's last earlier row of the same fiscal period; none where the period is null."""
    w = Window.partitionBy(entity, "period_key").orderBy(*order)
    made = df.withColumn("period_key", period)
    prior = {v: F.when(F.col("period_key").isNotNull(), F.lag(v).over(w)) for v in values}
    linked = made.select("*", *[c.alias(f"{v}_prior") for v, c in prior.items()], F.when(F.col("period_key").isNotNull(), F.lag(F.lit(True)).over(w)).alias("linked"))
    deltas = [c.alias(f"{v}_{k}") for v in values for k, c in E.changes(F.col(v), F.col(f"{v}_prior")).items()]
    return linked.select("*", *deltas, E.flag(F.col("linked").isNull(), F.lit(False)).alias("link_flag")).drop("linked")


def composites(df: DataFrame, spec: dict[str, tuple[str, int]], least: int = 1, clip: float = 5.0) -> DataFrame:
    """Stress and improvement scores: means of the positive parts of clipped, signed components. spec: name -> (column, stress sign)."""
    raw = {n: E.clipped(F.lit(float(s)) * F.col(c), clip) for n, (c, s) in spec.items()}
    valid = sum((c.isNotNull().cast("int") for c in raw.values()), F.lit(0))
    stress, better = E.mean_of([E.positive(c) for c in raw.values()]), E.mean_of([E.positive(-c) for c in raw.values()])
    return df.select("*", valid.alias("valid_components"), F.round(stress, 12).alias("stress_score"), F.round(better, 12).alias("improvement_score"), F.round(stress - better, 12).alias("net_stress"), E.flag(valid == 0, valid < least).alias("composite_flag"))


def validate(df: DataFrame, artifact: str, *, min_rows: int = 1, not_null: tuple = (), unique: tuple = (), allowed: dict[str, tuple] | None = None) -> DataFrame:
    """(artifact, check_name, failures, status): every rule of a table's contract, from one aggregation."""
    checks = {"min_rows": F.greatest(F.lit(min_rows) - F.count("*"), F.lit(0))}
    checks |= {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in not_null}
    checks |= {f"unique:{'+'.join(k)}": F.count("*") - F.count_distinct(*[F.col(c) for c in k]) for k in unique}
    checks |= {f"allowed:{c}": F.count_if(~F.col(c).isin(*vs)) for c, vs in (allowed or {}).items()}
    row = df.agg(F.array(*[F.struct(F.lit(n).alias("check_name"), c.cast("bigint").alias("failures")) for n, c in checks.items()]).alias("xs"))
    return row.select(F.lit(artifact).alias("artifact"), F.explode("xs").alias("x")).select("artifact", "x.*", F.when(F.col("x.failures") == 0, "PASS").otherwise("FAIL").alias("status"))


def lexicon_shares(docs: DataFrame, lexicon: dict[str, tuple[str, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count, and count and share of each category's words; words are runs of A-Z once a-z are upper-cased."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("[A-Z]+"), 0)
    made = docs.select(id_col, words.alias("ws")).select(id_col, F.size("ws").alias("n_tokens"), *[F.size(_members(vs)).alias(f"{k}_count") for k, vs in lexicon.items()])
    return made.select("*", *[F.round(F.coalesce(F.try_divide(F.col(f"{k}_count"), F.col("n_tokens")), F.lit(0.0)), 12).alias(f"{k}_share") for k in lexicon])


def _members(words: tuple[str, ...]) -> Column:
    return F.filter("ws", lambda w: w.isin(*words))


def clean_html(html: Column, remove_tables: bool = True) -> Column:
    """Text of a page: scripts, styles, head and tables dropped, tags to spaces, a few entities, single spaces."""
    out = F.coalesce(html, F.lit(""))
    for name in ("script", "style", "head", *(["table"] if remove_tables else [])):
        out = F.regexp_replace(out, f"(?is)<{name}[^>]*>.*?</{name}>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))
