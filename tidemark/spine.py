"""Registered queries of the spine from features to models, over whole tables, with their SQL (shared parts in ``sql/parts/``).

Orders stand for filings and their lines for documents of them. What a side lacks, it lacks in the tables: orders without lines of
the status F have no accounting, orders whose number no document has have no text, orders without events have no availability and
no targets, pending orders have no date, and lines without discount or tax have no score or label.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import panel
from tidemark.queries import _t

_KEYS = ("accession_lineage_key", "cik10", "accession_number")


def _day(c: str):
    return F.to_date(c).cast("string")


def _grade(red, yellow):
    return F.when(red, "RED").when(yellow, "YELLOW").otherwise("GREEN")


def _filings(spark: SparkSession, d: str) -> DataFrame:
    padded = {"cik10": F.lpad(F.col("o_custkey").cast("string"), 10, "0"), "accession_number": F.lpad(F.col("o_orderkey").cast("string"), 18, "0")}
    return _t(spark, d, "orders").withColumns(padded)


def _documents(spark: SparkSession, d: str, filings: DataFrame | None = None) -> DataFrame:
    """Every line of every order (or of those in ``filings``), with the key of its document."""
    rows = _t(spark, d, "lineitem").join(_filings(spark, d) if filings is None else filings, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.withColumn("accession_lineage_key", panel.lineage_key(F.col("cik10"), F.col("accession_number"), F.concat(F.lit("d"), "l_linenumber")))


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    """Filings with their events, two numbers of events for each order; a filing is accepted some days after its date."""
    rows = _t(spark, d, "events").withColumn("of", F.expr("event_id div 2")).join(_filings(spark, d), F.col("of") == F.col("o_orderkey"))
    return rows.withColumn("first_allowed_execution_date", F.date_add(F.to_date("o_orderdate"), F.dayofmonth("ts")).cast("string"))


def _mismatch(spark: SparkSession, d: str) -> DataFrame:
    asof = F.when(F.col("o_orderstatus") == "P", "").otherwise(_day("o_orderdate"))
    return _documents(spark, d).select(*_KEYS, "l_quantity", asof.alias("feature_asof_date"), _returned().alias("mismatch_quality_flag"), F.expr("nullif(l_discount, 0)").alias("dfm_score_simple"))


def _returned():
    return _grade(F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")


def _accounting(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are final are the accounting rows of their filing."""
    final = _documents(spark, d).filter("l_linestatus = 'F'")
    return final.select(*_KEYS, _day("l_shipdate").alias("feature_asof_date"), _returned().alias("fundamental_quality_flag"), F.col("l_extendedprice").alias("revenue"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    rows = _documents(spark, d, _filings(spark, d).join(docs, F.col("o_orderkey") == F.col("doc_id")))
    return rows.select(*_KEYS, _day("o_orderdate").alias("feature_asof_date"), _grade(F.col("n_chars") < 200, F.col("n_chars") < 1000).alias("full_parse_quality_flag"), "lang")


def _availability(spark: SparkSession, d: str) -> DataFrame:
    time = F.concat("first_allowed_execution_date", F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("Z"))
    flag = _grade(F.col("event_type") == "error", F.col("event_type") == "click")
    return _accepted(spark, d).select("cik10", "accession_number", "first_allowed_execution_date", time.alias("accepted_at_edgar"), flag.alias("timestamp_quality_flag"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).join(_accepted(spark, d).select("of", "event_type"), F.col("l_orderkey") == F.col("of"))
    entry = F.to_date("l_shipdate")
    left = F.date_add(entry, F.col("l_quantity").cast("int") - 10).cast("string")
    flag = _grade(F.col("l_tax") >= 0.07, F.col("l_tax") >= 0.04)
    label = F.when(F.col("l_tax") > 0, F.col("l_discount") - 0.05)
    return rows.select(
        F.col("accession_lineage_key").alias("panel_row_id"), F.col("l_partkey").cast("string").alias("ticker"), (F.col("event_type") != "view").alias("target_available"),
        flag.alias("target_quality_flag"), entry.cast("string").alias("target_entry_date"), left.alias("target_exit_date"), label.alias("forward_63d_sector_adjusted_return"),
    )


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.research_panel(_mismatch(spark, d), _accounting(spark, d), _texts(spark, d), _availability(spark, d))


def research_panel(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).select("panel_row_id", "feature_asof_date", "accepted_at_edgar", "timestamp_quality_flag", "fund_fundamental_quality_flag", "fund_revenue", "text_full_parse_quality_flag", "text_lang", "panel_quality_notes", "panel_quality_flag", "panel_eligible")


def model_dataset(spark: SparkSession, d: str) -> DataFrame:
    out = panel.model_dataset(_panel(spark, d), _targets(spark, d))
    return out.select("model_row_id", "ticker", "target_entry_date", "model_dataset_quality_notes", "model_dataset_quality_flag", "model_dataset_eligible", "sample_weight")


def feature_list(spark: SparkSession, d: str) -> DataFrame:
    return panel.feature_list(panel.model_dataset(_panel(spark, d), _targets(spark, d)))


def availability_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its filing's availability; pending orders don't give their company's number, so their key tells the filing."""
    rows = _documents(spark, d)
    asked = rows.select("l_orderkey", "l_linenumber", "accession_lineage_key", "accession_number", F.when(F.col("o_orderstatus") != "P", F.col("cik10")).alias("cik10"))
    values = ["first_allowed_execution_date", "timestamp_quality_flag"]
    found = panel.with_availability(asked, _availability(spark, d), values, [F.desc(values[0]), F.col(values[1])])
    return found.select("l_orderkey", "l_linenumber", *values)


def text_accounting(spark: SparkSession, d: str) -> DataFrame:
    fund = _accounting(spark, d).withColumn("accession", panel.accession_key(F.col("accession_lineage_key")))
    one = panel.best_rows(fund.select("accession", "feature_asof_date", "fundamental_quality_flag", "revenue"), ["accession"], "fundamental_quality_flag", "feature_asof_date")
    out = panel.text_accounting(_texts(spark, d), one.withColumn("accession_lineage_key", F.col("accession")))
    return out.select("accession_key", "accession_lineage_key_text", "lang_text", "revenue_accounting", "fundamental_quality_flag_accounting")


def lineage_versions(spark: SparkSession, d: str) -> DataFrame:
    return panel.lineage_version(_t(spark, d, "documents").select(F.col("source").alias("version")), "version")


def _sql(select: str, *parts: str) -> str:
    folder = Path(__file__).with_name("sql") / "parts"
    return f"with {', '.join((folder / f'{p}.sql').read_text() for p in parts)} {select}"


QUERIES = {f.__name__: f for f in (research_panel, model_dataset, feature_list, availability_fallback, text_accounting, lineage_versions)}
ORACLES = {
    "research_panel": _sql(
        "select panel_row_id, feature_asof_date, accepted_at_edgar, timestamp_quality_flag, fq as fund_fundamental_quality_flag, revenue as fund_revenue, tq as text_full_parse_quality_flag, "
        "lang as text_lang, panel_quality_notes, panel_quality_flag, panel_quality_flag <> 'RED' as panel_eligible from pf",
        "spine",
    ),
    "model_dataset": _sql(
        "select model_row_id, ticker, target_entry_date, array_to_string(reds, ';') || case when late and len(reds) > 0 then ';' else '' end || case when late then 'target_exit_not_after_entry' else '' end as model_dataset_quality_notes, "
        "case when len(reds) > 0 then 'RED' when late then 'YELLOW' else 'GREEN' end as model_dataset_quality_flag, len(reds) = 0 as model_dataset_eligible, case when len(reds) = 0 then 1::double else 0::double end as sample_weight from ds",
        "spine", "targets",
    ),
    "feature_list": _sql("select * from (select 'dfm_score_simple' as feature, count(dfm) as numeric_rows from pf union all select 'l_quantity', count(l_quantity) from pf union all select 'fund_revenue', count(revenue) from pf) where numeric_rows > 0", "spine"),
    "availability_fallback": _sql(
        "select l_orderkey, l_linenumber, av_date as first_allowed_execution_date, av_flag as timestamp_quality_flag from ll left join "
        "(select * from av0 qualify row_number() over (partition by acc order by av_date desc, av_flag) = 1) a on ll.acc = a.acc",
        "spine",
    ),
    "text_accounting": _sql(
        "select te0.acc as accession_key, lineage as accession_lineage_key_text, lang as lang_text, revenue as revenue_accounting, fq as fundamental_quality_flag_accounting from te0 join fu on te0.acc = fu.acc",
        "spine",
    ),
    "lineage_versions": "select min(source) as lineage_version from documents where trim(source) <> ''",
}
