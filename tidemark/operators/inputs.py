"""Checks and normal forms of inputs: price tables, contracts of artifacts, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators.panel import blank
from tidemark.operators.tables import keep_one

PRICE_COLUMNS = ("date", "adj_close")
IDENTIFIERS = ("ticker", "cik10")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns that df lacks, sorted; names are compared without case."""
    have = {c.lower() for c in df.columns}
    return sorted(c for c in required if c.lower() not in have)


def normal_prices(df: DataFrame, order: list[Column] = ()) -> DataFrame:
    """(ticker, cik10, sector, date, adj_close): trimmed and cast; rows without a date, price or identifier are left out.

    Of repeated (ticker, cik10, date) the last in ``order`` stays, the highest price where that is open. Raises ValueError if a
    required column is missing.
    """
    low = df.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns])
    if lost := missing_columns(low, PRICE_COLUMNS):
        raise ValueError(f"columns are missing: {lost}")
    if not set(IDENTIFIERS) & set(low.columns):
        raise ValueError(f"one of these columns is needed: {IDENTIFIERS}")
    text = lambda c: F.trim(F.col(c).cast("string")) if c in low.columns else F.lit(None).cast("string")
    full = lambda c: F.when(~blank(c), c)
    made = low.withColumns({"ticker": full(F.upper(text("ticker"))), "cik10": E.cik10(full(text("cik10"))), "sector": F.coalesce(full(text("sector")), F.lit("UNKNOWN")), "date": F.col("date").try_cast("date"), "adj_close": E.strict_double(F.col("adj_close"))})
    good = made.filter("date is not null and adj_close is not null and coalesce(ticker, cik10) is not null")
    return keep_one(good, ["ticker", "cik10", "date"], [*order, F.desc("adj_close"), F.col("sector")]).select("ticker", "cik10", "sector", "date", "adj_close")


def price_checks(df: DataFrame) -> DataFrame:
    """(check_id, status, is_blocker, failures): columns of a price table and how many of its rows lack them."""
    have = {c.strip().lower(): c for c in df.columns}
    pick = lambda *names: [F.col(f"`{have[n]}`") for n in names if n in have]
    needs = {"date": (pick("date"), True), "identifier": (pick("ticker", "cik10", "security_id"), True), "adjusted_close": (pick("adj_close", "adjusted_close"), True), "sector": (pick("sector"), False)}
    lost = lambda cs: F.count_if(blank(F.coalesce(*[F.when(~blank(c), c.cast("string")) for c in cs]))) if cs else F.count("*")
    row = df.agg(F.array(*[F.struct(F.lit(f"price_{n}").alias("check_id"), F.lit(bool(cs)).alias("present"), F.lit(block).alias("blocker"), lost(cs).alias("failures")) for n, (cs, block) in needs.items()]).alias("xs"), F.count("*").alias("n"))
    x = row.select("n", F.explode("xs").alias("x")).select("n", "x.*")
    bad = ~F.col("present") | (F.col("failures") == F.col("n"))
    status = F.when(bad & F.col("blocker"), "FAIL").when(bad | (F.col("failures") > 0), "WARN").otherwise("PASS")
    return x.select("check_id", status.alias("status"), (bad & F.col("blocker")).alias("is_blocker"), "failures")


def validate_registry(tables: dict[str, DataFrame | None], contracts: dict[str, dict]) -> DataFrame:
    """(artifact, check_name, failures, status) of every contract: exists, min_rows, columns, blank, numeric, unique, allowed.

    A contract: {"min_rows": 1, "columns": [...], "not_blank": [...], "numeric": [...], "unique": [[...], ...], "allowed": {...}}. A
    table that is None fails ``exists`` and nothing else is asked; rules on columns that a table lacks fail with one failure.
    """
    out = None
    for artifact, rules in contracts.items():
        df = tables.get(artifact)
        spark_row = F.array(*[F.struct(F.lit(n).alias("check_name"), c.cast("bigint").alias("failures")) for n, c in _checks(df, rules).items()]).alias("xs")
        source = df if df is not None else next(t for t in tables.values() if t is not None).limit(0)
        rows = source.agg(spark_row).select(F.lit(artifact).alias("artifact"), F.explode("xs").alias("x")).select("artifact", "x.*", F.when(F.col("x.failures") == 0, "PASS").otherwise("FAIL").alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _checks(df: DataFrame | None, rules: dict) -> dict[str, Column]:
    if df is None:
        return {"exists": F.lit(1)}
    have = set(df.columns)
    on = lambda columns, c: c if set(columns) <= have else F.lit(1)
    found = {"exists": F.lit(0), "min_rows": F.greatest(F.lit(rules.get("min_rows", 1)) - F.count("*"), F.lit(0)), "required_columns": F.lit(len(missing_columns(df, tuple(rules.get("columns", ())))))}
    found |= {f"not_blank:{c}": on([c], F.count_if(blank(F.col(c))) if c in have else None) for c in rules.get("not_blank", ())}
    found |= {f"numeric:{c}": on([c], F.count_if(~blank(F.col(c)) & E.strict_double(F.col(c)).isNull()) if c in have else None) for c in rules.get("numeric", ())}
    found |= {f"unique:{'+'.join(k)}": on(k, F.count("*") - F.count_distinct(F.struct(*[F.col(c) for c in k])) if set(k) <= have else None) for k in rules.get("unique", ())}
    found |= {f"allowed:{c}": on([c], F.count_if(~F.col(c).isin(*vs)) if c in have else None) for c, vs in rules.get("allowed", {}).items()}
    return found


def inventory_summary(inventory: DataFrame, required: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and bytes of each kind (suffix) of (path, suffix, size), and the required paths that aren't there."""
    kinds = inventory.groupBy("suffix").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))
    return kinds, required.join(inventory.select("path"), "path", "left_anti")
