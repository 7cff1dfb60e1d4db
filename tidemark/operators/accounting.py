"""Accounting facts: quarter tables, canonical concepts, ratios, coverage and flags, and changes between comparable periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators.tables import comparable_deltas, keep_one

#: The canonical concepts, and the ratios as numerator and denominator.
CONCEPTS = ("revenue", "net_income", "cfo", "assets", "liabilities", "debt", "cash", "receivables", "inventory", "capex", "shares")
RATIOS = {"net_margin": ("net_income", "revenue"), "cfo_to_net_income": ("cfo", "net_income"), "cfo_to_revenue": ("cfo", "revenue"), "liabilities_to_assets": ("liabilities", "assets"), "debt_to_assets": ("debt", "assets"), "cash_to_assets": ("cash", "assets"), "receivables_to_assets": ("receivables", "assets"), "inventory_to_assets": ("inventory", "assets"), "capex_to_revenue": ("capex", "revenue"), "asset_turnover": ("revenue", "assets")}
ALIASES = {"margin": "net_margin", "cfo_quality": "cfo_to_net_income", "cash_conversion": "cfo_to_revenue", "leverage": "debt_to_assets", "liability_intensity": "liabilities_to_assets", "working_capital_proxy": "working_capital_proxy_to_assets", "capex_intensity": "capex_to_revenue"}
FLAGS = ("GREEN", "YELLOW", "RED")
CORE, CASH_FLOW = ("assets", "net_income", "revenue"), ("capex", "cfo")


def compact_date(c: Column) -> Column:
    """YYYYMMDD as a date, null if it is none."""
    return F.to_date(F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")))


def compact_year(c: Column) -> Column:
    return F.left(c.cast("string"), F.lit(4)).try_cast("int")


def fiscal_period(fp: Column, form: Column) -> Column:
    """FY or Q1 to Q4; FY for a yearly report without one; else null."""
    up = F.upper(F.trim(fp))
    return F.when(up.isin("FY", "Q1", "Q2", "Q3", "Q4"), up).when(F.coalesce(up, F.lit("")).isin("") & F.upper(form).isin("10-K"), "FY")


def quarter_tables(tables: dict[str, DataFrame], *, forms: tuple[str, ...] = ("10-K", "10-Q"), quarters: list[str] | None = None, form: str = "form", filing: str = "adsh", tag_keys: tuple[str, ...] = ("tag", "version")) -> dict[str, DataFrame]:
    """sub, num, pre and tag rows of all quarters (column source_quarter): filings of the forms, their facts, and each tag once.

    quarters keeps only those; of a tag's rows the one of the first quarter stays.
    """
    held = {n: t.filter(F.col("source_quarter").isin(quarters)) if quarters else t for n, t in tables.items()}
    sub = held["sub"].filter(F.upper(F.trim(form)).isin(*forms))
    keys = sub.select("source_quarter", filing).distinct()
    facts = {n: held[n].join(keys, ["source_quarter", filing], "left_semi") for n in ("num", "pre")}
    rest = [F.col(c) for c in held["tag"].columns if c not in (*tag_keys, "source_quarter")]
    return {"sub": sub, **facts, "tag": keep_one(held["tag"], list(tag_keys), [F.col("source_quarter"), *rest])}


def source_diagnostics(df: DataFrame, filing: str = "adsh") -> DataFrame:
    """Rows and distinct filings of each quarter."""
    return df.groupBy("source_quarter").agg(F.count("*").alias("n_rows"), F.count_distinct(filing).alias("n_filings"))


def select_facts(facts: DataFrame, concept_map: DataFrame, *, filing: str = "accession_number", tie: list[str] = ()) -> DataFrame:
    """One fact of each filing and canonical concept, with its flag and notes.

    facts: (filing, tag, value, unit, coreg, ddate, period, qtrs); concept_map: (tag, concept, tag_rank, expected_unit, expected_qtrs),
    a few rows for each concept. Preferred are, in this order: the tag's rank, the expected unit, no co-registrant, the filing's own
    period, the expected number of quarters. A fact of another length, as a year to date, isn't converted but flagged YELLOW; one of
    another unit is RED.
    """
    value = E.strict_double(F.col("value"))
    rows = facts.join(concept_map, "tag").filter(value.isNotNull())
    off = {"unexpected_unit": ~F.col("unit").eqNullSafe(F.col("expected_unit")), "co_registrant": F.coalesce(F.trim("coreg") != "", F.lit(False)), "other_period": ~F.col("ddate").eqNullSafe(F.col("period")), "other_length": ~F.col("qtrs").eqNullSafe(F.col("expected_qtrs"))}
    best = keep_one(rows, [filing, "concept"], [F.col("tag_rank"), *[c.cast("int") for c in off.values()], F.desc_nulls_last("ddate"), F.col("tag"), *[F.col(c) for c in tie], F.desc(value)])
    return best.select(filing, "concept", "tag", "unit", "qtrs", "ddate", value.alias("value"), E.flag(off["unexpected_unit"], off["co_registrant"] | off["other_period"] | off["other_length"]).alias("fact_flag"), E.notes(off).alias("fact_notes"))


def fundamental_features(facts: DataFrame, *, filing: str = "accession_number", concepts: tuple[str, ...] = CONCEPTS, details: tuple[str, ...] = ("tag", "unit", "qtrs", "ddate")) -> DataFrame:
    """One row of each filing: value, availability, flag and details of each concept, the ratios, coverage, flag and notes.

    facts: (filing, concept, value, fact_flag, details...), one of each filing and concept (see select_facts).
    """
    wide = facts.groupBy(filing).pivot("concept", list(concepts)).agg(F.first(F.struct("value", "fact_flag", *details)))
    flat = wide.select(filing, *[c for k in concepts for c in (F.col(f"{k}.value").alias(k), F.col(f"{k}.value").isNotNull().alias(f"{k}_available"), F.col(f"{k}.fact_flag").alias(f"{k}_fact_flag"), *[F.col(f"{k}.{d}").alias(f"{k}_{d}") for d in details])])
    return with_ratios(flat, concepts)


def with_ratios(flat: DataFrame, concepts: tuple[str, ...] = CONCEPTS) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ratios = {n: E.safe_divide(F.col(a), F.col(b)) for n, (a, b) in RATIOS.items()}
    ratios["cash_minus_debt_to_assets"] = E.safe_divide(F.col("cash") - F.col("debt"), F.col("assets"))
    ratios["working_capital_proxy_to_assets"] = E.safe_divide(zero("cash") + zero("receivables") + zero("inventory") - zero("liabilities"), F.col("assets"))
    made = flat.withColumns({n: F.round(c, 12) for n, c in ratios.items()})
    listed = lambda names, cond: F.array_compact(F.array(*[F.when(cond(n), F.lit(n)) for n in sorted(names)]))
    groups = {"missing_core_concepts": listed(CORE, lambda c: F.col(c).isNull()), "missing_cashflow_concepts": listed(CASH_FLOW, lambda c: F.col(c).isNull()), "red_fact_quality": listed(concepts, lambda c: F.col(f"{c}_fact_flag") == "RED"), "yellow_fact_quality": listed(concepts, lambda c: F.col(f"{c}_fact_flag") == "YELLOW"), "unavailable_ratios": listed(ratios, lambda c: F.col(c).isNull())}
    some = {n: F.size(g) > 0 for n, g in groups.items()}
    notes = F.array_join(F.array_compact(F.array(*[F.when(some[n], F.concat(F.lit(n + "="), F.array_join(F.slice(g, 1, 8), "|"))) for n, g in groups.items()])), ";")
    count = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in concepts])
    red = some["missing_core_concepts"] | some["red_fact_quality"]
    return made.withColumns({"concept_coverage_count": count, "concept_coverage_ratio": F.round(count / len(concepts), 12), "fundamental_quality_flag": E.flag(red, some["missing_cashflow_concepts"] | some["yellow_fact_quality"] | some["unavailable_ratios"]), "fundamental_quality_notes": notes})


def fundamental_deltas(df: DataFrame, *, entity: str, period: Column, year: Column, order: list[Column], values: tuple[str, ...] = CONCEPTS) -> DataFrame:
    """Rows of fundamental_features with changes since the entity's last earlier filing of the same fiscal period.

    Each value gets _prior, _abs, _pct and _log, each ratio _prior and _delta, well-known ratio changes a second name; period_year_gap
    is the distance in years, link_flag and link_notes tell how good the link is, prior_fundamental_quality_flag how good the earlier filing.
    """
    ratios = [*RATIOS, "cash_minus_debt_to_assets", "working_capital_proxy_to_assets"]
    level = F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(FLAGS) for x in (f, k)]), F.col("fundamental_quality_flag"))
    made = df.withColumns({"period_year": year, "_level": level})
    out = comparable_deltas(made, entity, period, order, [*values, *ratios, "period_year", "_level"]).drop("link_flag")
    out = out.withColumn("prior_fundamental_quality_flag", F.get(F.array(*[F.lit(f) for f in FLAGS]), F.col("_level_prior"))).drop("_level", *[f"_level_{k}" for k in ("prior", "abs", "pct", "log")])
    linked = F.col("period_year_prior").isNotNull()
    gap = F.col("period_year") - F.col("period_year_prior")
    out = out.withColumns({f"{r}_delta": F.col(f"{r}_abs") for r in ratios} | {f"{a}_delta": F.col(f"{r}_abs") for a, r in ALIASES.items()} | {"period_year_gap": gap})
    red = {"missing_prior_comparable_filing": ~linked, "current_fundamental_quality_red": F.col("fundamental_quality_flag") == "RED"}
    yellow = {"period_year_gap_not_one": linked & (gap != 1), "current_fundamental_quality_yellow": F.col("fundamental_quality_flag") == "YELLOW"}
    out = out.withColumns({"link_flag": E.flag(reduce(lambda a, b: a | b, red.values()), reduce(lambda a, b: a | b, yellow.values())), "link_notes": E.notes(red | yellow)})
    return out.drop(*[f"{c}_{k}" for c in [*ratios, "period_year"] for k in ("abs", "pct", "log")])
