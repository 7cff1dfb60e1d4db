"""Composites and mismatch on small rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scores

CHANGES = {"revenue_pct": -0.10, "net_income_pct": -0.30, "margin_delta": -0.05, "cfo_quality_delta": -0.20, "cash_conversion_delta": -0.08, "assets_pct": 0.20, "liability_intensity_delta": 0.05, "leverage_delta": 0.04, "cash_to_assets_delta": -0.03, "receivables_to_assets_delta": 0.02, "inventory_to_assets_delta": 0.01, "capex_intensity_delta": 0.02, "shares_pct": 0.05, "working_capital_proxy_delta": -0.04}
SIGNS = {c: s for c, s in scores.STRESS.values()}


def _frame(spark, rows):
    schema = "id int, link_flag string, fundamental_quality_flag string, prior_fundamental_quality_flag string, " + ", ".join(f"{c} double" for c in CHANGES)
    return spark.createDataFrame(rows, schema)


def test_stress_and_improvement_mirror_each_other(spark):
    stress, better = list(CHANGES.values()), [-SIGNS[c] * abs(v) for c, v in CHANGES.items()]
    rows = [(1, "GREEN", "GREEN", "GREEN", *stress), (2, "GREEN", "GREEN", "GREEN", *better), (3, "red", "YELLOW", None, *stress), (4, "GREEN", "GREEN", "GREEN", *[None] * 9, *stress[9:]), (5, "GREEN", "GREEN", "GREEN", 99.0, float("nan"), *[None] * 12), (6, "GREEN", "GREEN", "GREEN", *[None] * 14)]
    got = {r.id: r for r in scores.composites(_frame(spark, rows)).collect()}
    s, b = got[1], got[2]
    assert (s.stress_revenue_decline_pos, s.stress_margin_deterioration_pos, s.stress_leverage_increase_pos, s.improve_revenue_growth_pos) == (0.1, 0.05, 0.04, 0.0)
    assert s.fund_stress_score == pytest.approx(sum(map(abs, stress)) / 14) and s.fund_improve_score == 0.0 and s.fund_net_stress_score > 0 and s.fundamental_composite_quality_flag == "GREEN"
    assert (b.improve_revenue_growth_pos, b.improve_margin_improvement_pos, b.improve_leverage_decline_pos) == (0.1, 0.05, 0.04) and b.fundamental_reality_score > 0
    assert b.fund_improve_score == s.fund_stress_score and b.improve_revenue_growth_raw == 0.1 and s.improve_revenue_growth_raw == -0.1
    assert (got[3].fundamental_composite_quality_flag, got[3].fundamental_composite_quality_notes) == ("RED", "comparable_link_quality_red;current_fundamental_quality_yellow")
    assert got[4].fundamental_composite_quality_notes == "low_valid_stress_components=5;low_valid_improve_components=5" and got[4].fundamental_composite_quality_flag == "YELLOW"
    assert got[4].fund_stress_component_coverage_ratio == pytest.approx(5 / 14)
    assert got[5].improve_revenue_growth_raw == 5.0 and got[5].fund_stress_component_valid_count == 1  # clipped; nan is missing
    assert got[6].fund_stress_score is None and got[6].fund_net_stress_score is None


FUND = {"fund_stress_score": 0.20, "fund_improve_score": 0.03, "stress_margin_deterioration_pos": 0.05, "stress_cfo_quality_deterioration_pos": 0.04, "stress_cash_conversion_deterioration_pos": 0.03, "stress_leverage_increase_pos": 0.02, "stress_liability_intensity_increase_pos": 0.02, "stress_receivables_intensity_increase_pos": 0.01, "stress_inventory_intensity_increase_pos": 0.01, "stress_share_dilution_pos": 0.02, "improve_margin_improvement_pos": 0.0, "improve_cfo_quality_improvement_pos": 0.0, "improve_cash_conversion_improvement_pos": 0.0, "improve_leverage_decline_pos": 0.0, "improve_cash_buffer_improvement_pos": 0.0, "improve_working_capital_proxy_improvement_pos": 0.0}
TEXT = {"full_lm_positive_share": 0.05, "full_lm_negative_share": 0.01, "full_lm_uncertainty_share": 0.02, "full_lm_constraining_share": 0.004, "full_lm_modal_total_share": 0.01, "full_lm_pos_neg_balance": 0.6666666667, "mda_lm_positive_share": 0.04, "mda_lm_negative_share": 0.01, "mda_lm_uncertainty_share": 0.02, "mda_lm_pos_neg_balance": 0.60, "risk_lm_negative_share": 0.005, "risk_lm_litigious_share": 0.01, "risk_lm_constraining_share": 0.02, "liquidity_lm_negative_share": 0.01}


def test_products_gates_and_documents_of_one_accession(spark):
    fund = spark.createDataFrame([("a", "GREEN", *FUND.values()), ("b", "GREEN", *FUND.values())], "k string, fundamental_composite_quality_flag string, " + ", ".join(f"{c} double" for c in FUND))
    flags = "parse_quality_flag string, mda_section_quality_flag string, risk_section_quality_flag string, liquidity_section_quality_flag string, timestamp_quality_flag string"
    green = ("GREEN",) * 5
    text = spark.createDataFrame([("a", 1, *green, *TEXT.values()), ("a", 2, "GREEN", "GREEN", "YELLOW", "GREEN", "red", *TEXT.values()), ("c", 3, *green, *TEXT.values())], f"k string, d int, {flags}, " + ", ".join(f"{c} double" for c in TEXT))
    got = {r.d: r for r in scores.mismatch_features(fund, text, "k").collect()}
    assert set(got) == {1, 2}
    r = got[1]
    assert r.downside_stress_x_full_positive_tone == 0.01 and r.downside_stress_x_full_net_positive_tone > 0.1 and r.upside_improvement_x_full_negative_tone == 0.0003
    assert r.downside_mismatch_score > r.upside_mismatch_score and r.net_mismatch_score == r.dfm_score_simple < 0
    # the product without its accounting column is missing, and the count says so
    assert (r.downside_component_valid_count, r.upside_component_valid_count, r.upside_share_count_decline_x_low_positive_tone) == (19, 13, None)
    assert (r.mismatch_quality_flag, r.mismatch_quality_notes) == ("GREEN", "")
    assert (got[2].mismatch_quality_flag, got[2].mismatch_quality_notes) == ("RED", "risk_section_quality_yellow;timestamp_quality_red")
    few = scores.mismatch_features(fund.select("k", "fund_stress_score"), text.filter("d = 1"), "k").first()
    assert few.mismatch_quality_notes == "low_upside_component_count=0" and few.downside_component_valid_count == 11 and few.upside_mismatch_score is None
    assert few.net_mismatch_score == pytest.approx(-few.downside_mismatch_score)
    assert scores.mismatch_features(fund.filter(F.lit(False)), text, "k").count() == 0
