"""The research panel: where availability is looked up, and how often its rows are dealt anew."""

import contextlib
import io

from tidemark import spine
from tidemark.operators import panel

SMALL = "/root/testdata/sf0.001"


def _sides(spark):
    rows = [("1:a:d1", "1", "a"), ("1:a:d2", "1", "b"), ("1:a:d3", "9", "z"), ("1:c:d1", None, None), ("1:c:d1", "1", "a"), ("", "1", "b"), (None, "1", "a"), ("7:q", "7", "r")]
    mismatch = spark.createDataFrame([(*r, "2020-01-01", "GREEN", 1.0) for r in rows], "accession_lineage_key string, cik10 string, accession_number string, feature_asof_date string, mismatch_quality_flag string, dfm_score_simple double")
    fund = spark.createDataFrame([("1:a:d1", "1", "a", "GREEN", None, 1.0), ("1:a:d2", "1", "a", "GREEN", "2020-01-02", 2.0), ("1:a", "1", "a", "GREEN", "2020-01-02", None), ("1:c", "1", "c", "odd", "2020-01-01", 5.0)], "accession_lineage_key string, cik10 string, accession_number string, fundamental_quality_flag string, feature_asof_date string, revenue double")
    text = spark.createDataFrame([("1:a:d1", "1", "a", "GREEN", "2020-01-01", "en"), ("1:a:d1", "1", "a", "RED", "2019-01-01", "fr")], "accession_lineage_key string, cik10 string, accession_number string, full_parse_quality_flag string, feature_asof_date string, lang string")
    times = spark.createDataFrame([("1", "a", "2020-02-01", "t1", "GREEN"), ("1", "a", "2020-02-01", None, "RED"), ("1", "b", "2020-02-02", "t2", "YELLOW"), ("1", "c", "2020-02-03", "t3", "RED"), (None, None, "2020-02-04", "t4", "GREEN")], "cik10 string, accession_number string, first_allowed_execution_date string, accepted_at_edgar string, timestamp_quality_flag string")
    return mismatch, fund, text, times


def test_availability_by_own_numbers_then_by_key(spark):
    got = {r.panel_row_id: r for r in panel.research_panel(*_sides(spark)).collect()}
    assert {k: r.accepted_at_edgar for k, r in got.items()} == {"1:a:d1": "t1", "1:a:d2": "t2", "1:a:d3": "t1", "1:c:d1": "t4", "": "t2", None: "t1", "7:q": None}
    assert {k: r.fund_revenue for k, r in got.items() if r.fund_revenue is not None} == {"1:c:d1": 5.0}  # of the earliest rows of 1:a the one without revenue
    assert got["1:a:d1"].fund_feature_asof_date == "2020-01-02" and got["1:a:d1"].text_lang == "en" and got["1:a:d2"].text_lang is None


def test_rows_of_the_panel_are_dealt_twice(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            spine.research_panel(spark, SMALL).explain("simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in out.getvalue().splitlines() if "Exchange hashpartitioning(_acc#" in line or "Exchange hashpartitioning(accession_lineage_key#" in line]
    # rows by accession (in the plan once more for rows with numbers of their own), rows and texts by document; accounting and availability by accession
    assert len([x for x in dealt if "REPARTITION_BY_COL" in x]) == 2 and len([x for x in dealt if "(accession_lineage_key#" in x]) == 2
