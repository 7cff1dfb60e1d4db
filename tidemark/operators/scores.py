"""Stress and improvement scores from accounting changes, and their mismatch with the tone of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators.models import text_proxies

#: Components of both scores, the change that each reads, and its sign.
STRESS = {
    "revenue_decline": ("revenue_pct", -1),
    "net_income_decline": ("net_income_pct", -1),
    "margin_deterioration": ("margin_delta", -1),
    "cfo_quality_deterioration": ("cfo_quality_delta", -1),
    "cash_conversion_deterioration": ("cash_conversion_delta", -1),
    "asset_growth_pressure": ("assets_pct", 1),
    "liability_intensity_increase": ("liability_intensity_delta", 1),
    "leverage_increase": ("leverage_delta", 1),
    "cash_buffer_decline": ("cash_to_assets_delta", -1),
    "receivables_intensity_increase": ("receivables_to_assets_delta", 1),
    "inventory_intensity_increase": ("inventory_to_assets_delta", 1),
    "capex_intensity_increase": ("capex_intensity_delta", 1),
    "share_dilution": ("shares_pct", 1),
    "working_capital_proxy_deterioration": ("working_capital_proxy_delta", -1),
}
IMPROVEMENT = {
    "revenue_growth": ("revenue_pct", 1),
    "net_income_growth": ("net_income_pct", 1),
    "margin_improvement": ("margin_delta", 1),
    "cfo_quality_improvement": ("cfo_quality_delta", 1),
    "cash_conversion_improvement": ("cash_conversion_delta", 1),
    "asset_contraction_or_efficiency": ("assets_pct", -1),
    "liability_intensity_decline": ("liability_intensity_delta", -1),
    "leverage_decline": ("leverage_delta", -1),
    "cash_buffer_improvement": ("cash_to_assets_delta", 1),
    "receivables_intensity_decline": ("receivables_to_assets_delta", -1),
    "inventory_intensity_decline": ("inventory_to_assets_delta", -1),
    "capex_intensity_decline": ("capex_intensity_delta", -1),
    "share_count_decline": ("shares_pct", -1),
    "working_capital_proxy_improvement": ("working_capital_proxy_delta", 1),
}
#: Products of an accounting column and a text column.
DOWNSIDE = {
    "stress_x_full_positive_tone": ("fund_stress_score", "full_lm_positive_share"),
    "stress_x_full_net_positive_tone": ("fund_stress_score", "full_lm_pos_neg_balance_pos"),
    "stress_x_mda_positive_tone": ("fund_stress_score", "mda_lm_positive_share"),
    "stress_x_mda_net_positive_tone": ("fund_stress_score", "mda_lm_pos_neg_balance_pos"),
    "stress_x_low_full_negative_tone": ("fund_stress_score", "full_low_negative_proxy"),
    "stress_x_low_risk_negative_tone": ("fund_stress_score", "risk_low_negative_proxy"),
    "stress_x_full_uncertainty": ("fund_stress_score", "full_lm_uncertainty_share"),
    "stress_x_mda_uncertainty": ("fund_stress_score", "mda_lm_uncertainty_share"),
    "stress_x_risk_litigious": ("fund_stress_score", "risk_lm_litigious_share"),
    "stress_x_full_constraining": ("fund_stress_score", "full_lm_constraining_share"),
    "stress_x_risk_constraining": ("fund_stress_score", "risk_lm_constraining_share"),
    "margin_deterioration_x_positive_tone": ("stress_margin_deterioration_pos", "full_lm_positive_share"),
    "cfo_deterioration_x_positive_tone": ("stress_cfo_quality_deterioration_pos", "mda_lm_positive_share"),
    "cash_conversion_deterioration_x_positive_tone": ("stress_cash_conversion_deterioration_pos", "mda_lm_positive_share"),
    "leverage_increase_x_weak_warning": ("stress_leverage_increase_pos", "risk_low_negative_proxy"),
    "liability_intensity_increase_x_constraining": ("stress_liability_intensity_increase_pos", "risk_lm_constraining_share"),
    "receivables_intensity_increase_x_low_warning": ("stress_receivables_intensity_increase_pos", "risk_low_negative_proxy"),
    "inventory_intensity_increase_x_low_warning": ("stress_inventory_intensity_increase_pos", "risk_low_negative_proxy"),
    "share_dilution_x_positive_tone": ("stress_share_dilution_pos", "full_lm_positive_share"),
}
UPSIDE = {
    "improvement_x_full_negative_tone": ("fund_improve_score", "full_lm_negative_share"),
    "improvement_x_full_net_negative_tone": ("fund_improve_score", "full_lm_pos_neg_balance_neg"),
    "improvement_x_mda_negative_tone": ("fund_improve_score", "mda_lm_negative_share"),
    "improvement_x_risk_negative_tone": ("fund_improve_score", "risk_lm_negative_share"),
    "improvement_x_uncertainty": ("fund_improve_score", "full_lm_uncertainty_share"),
    "improvement_x_constraining": ("fund_improve_score", "full_lm_constraining_share"),
    "improvement_x_modal_caution": ("fund_improve_score", "full_lm_modal_total_share"),
    "margin_improvement_x_negative_tone": ("improve_margin_improvement_pos", "full_lm_negative_share"),
    "cfo_improvement_x_negative_tone": ("improve_cfo_quality_improvement_pos", "mda_lm_negative_share"),
    "cash_conversion_improvement_x_negative_tone": ("improve_cash_conversion_improvement_pos", "mda_lm_negative_share"),
    "leverage_decline_x_risk_caution": ("improve_leverage_decline_pos", "risk_lm_negative_share"),
    "cash_buffer_improvement_x_caution": ("improve_cash_buffer_improvement_pos", "liquidity_lm_negative_share"),
    "working_capital_improvement_x_caution": ("improve_working_capital_proxy_improvement_pos", "liquidity_lm_negative_share"),
    "share_count_decline_x_low_positive_tone": ("improve_share_count_decline_pos", "full_low_positive_proxy"),
}


def _valid(columns: list[Column]) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0))


def _net(a: Column, b: Column) -> Column:
    """a less b, what is missing counting as 0; null if both are."""
    return F.when(a.isNotNull() | b.isNotNull(), F.round(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), 12))


def _flags(levels: dict[str, Column], counts: dict[str, Column]) -> tuple[Column, Column]:
    """Flag and notes: a note for each RED or YELLOW source flag and for each count that is too low (null: none)."""
    said = lambda c: F.upper(F.coalesce(c, F.lit("")))
    found = [F.when(said(c) == level, F.lit(f"{name}_{level.lower()}")) for name, c in levels.items() for level in ("RED", "YELLOW")]
    low = [F.concat(F.lit(f"{name}="), c.cast("string")) for name, c in counts.items()]
    red = sum(((said(c) == "RED").cast("int") for c in levels.values()), F.lit(0)) > 0
    notes = F.array_join(F.array_compact(F.array(*found, *low)), ";")
    return E.flag(red, notes != ""), notes


def composites(df: DataFrame, *, clip: float = 5.0, least_stress: int = 6, least_improve: int = 6) -> DataFrame:
    """df with 14 stress and 14 improvement components, their scores, coverage, flag and notes, from one projection.

    df: changes as ``accounting.fundamental_deltas`` gives them, with link_flag, fundamental_quality_flag and prior_fundamental_quality_flag; each
    component is <side>_<name>_raw, the signed change clipped, and _pos, its positive part. Scores are means of those that aren't null.
    """
    sides = {"stress": STRESS, "improve": IMPROVEMENT}
    raw = {f"{side}_{n}": E.clipped(F.lit(float(sign)) * E.strict_double(F.col(c)), clip) for side, spec in sides.items() for n, (c, sign) in spec.items()}
    made = df.select("*", *[c.alias(f"{n}_raw") for n, c in raw.items()])
    made = made.select("*", *[E.positive(F.col(f"{n}_raw")).alias(f"{n}_pos") for n in raw])
    of = lambda side, kind: [F.col(f"{side}_{n}_{kind}") for n in sides[side]]
    mean = lambda side, kind: F.round(E.mean_of(of(side, kind)), 12)
    made = made.withColumns({"fund_stress_score": mean("stress", "pos"), "fund_improve_score": mean("improve", "pos"), "fund_stress_signed_mean": mean("stress", "raw"), "fund_improve_signed_mean": mean("improve", "raw"), "fund_stress_component_valid_count": _valid(of("stress", "pos")), "fund_improve_component_valid_count": _valid(of("improve", "pos"))})
    stress, improve = F.col("fund_stress_score"), F.col("fund_improve_score")
    low = {f"low_valid_{n}_components": F.when(F.col(c) < least, F.col(c)) for n, c, least in (("stress", "fund_stress_component_valid_count", least_stress), ("improve", "fund_improve_component_valid_count", least_improve))}
    flag, notes = _flags({"comparable_link_quality": F.col("link_flag"), "current_fundamental_quality": F.col("fundamental_quality_flag"), "prior_fundamental_quality": F.col("prior_fundamental_quality_flag")}, low)
    coverage = {f"fund_{s}_component_coverage_ratio": F.col(f"fund_{s}_component_valid_count") / len(spec) for s, spec in sides.items()}
    net = {"fund_net_stress_score": _net(stress, improve), "fund_net_improvement_score": _net(improve, stress), "fundamental_reality_score": _net(improve, stress)}
    rounded = [F.round(F.col(f"{n}_{kind}"), 12).alias(f"{n}_{kind}") for n in raw for kind in ("raw", "pos")]
    kept = [c for c in made.columns if c not in {f"{n}_{kind}" for n in raw for kind in ("raw", "pos")}]
    return made.select(*kept, *rounded, *[c.alias(n) for n, c in (net | coverage).items()], flag.alias("fundamental_composite_quality_flag"), notes.alias("fundamental_composite_quality_notes"))


#: Source flags of the mismatch and what their notes are called.
MISMATCH_FLAGS = {
    "fundamental_composite_quality": "fundamental_composite_quality_flag",
    "full_text_parse_quality": "parse_quality_flag",
    "mda_section_quality": "mda_section_quality_flag",
    "risk_section_quality": "risk_section_quality_flag",
    "liquidity_section_quality": "liquidity_section_quality_flag",
    "timestamp_quality": "timestamp_quality_flag",
}


def mismatch_features(fund: DataFrame, text: DataFrame, on: str, *, least_downside: int = 8, least_upside: int = 6) -> DataFrame:
    """All 19 downside and 14 upside products of an accession's scores and its documents' tone, with means, net score, coverage, flag and notes.

    fund: one row for each key ``on``, from ``composites``; text: any number of documents for a key, from ``texts.text_features``. Columns that both sides have besides
    the key are taken from text. A column that neither side has is null, and a flag that neither has gives no note.
    """
    both = text_proxies(text).join(fund.drop(*[c for c in fund.columns if c in text.columns and c != on]), on)
    specs = {"downside": DOWNSIDE, "upside": UPSIDE}
    value = lambda c: E.strict_double(F.col(c)) if c in both.columns else F.lit(None).cast("double")
    part = {f"{side}_{n}": value(a) * value(b) for side, spec in specs.items() for n, (a, b) in spec.items()}
    made = both.select("*", *[c.alias(n) for n, c in part.items()])
    of = lambda side: [F.col(f"{side}_{n}") for n in specs[side]]
    made = made.withColumns({f"{side}_mismatch_score": F.round(E.mean_of(of(side)), 12) for side in specs} | {f"{side}_component_valid_count": _valid(of(side)) for side in specs})
    net = _net(F.col("upside_mismatch_score"), F.col("downside_mismatch_score"))
    low = {f"low_{side}_component_count": F.when(F.col(f"{side}_component_valid_count") < least, F.col(f"{side}_component_valid_count")) for side, least in (("downside", least_downside), ("upside", least_upside))}
    flag, notes = _flags({n: F.col(c) for n, c in MISMATCH_FLAGS.items() if c in made.columns}, low)
    coverage = {f"{side}_component_coverage_ratio": F.col(f"{side}_component_valid_count") / len(spec) for side, spec in specs.items()}
    return made.select(*both.columns, *[F.round(F.col(n), 12).alias(n) for n in part], *[f"{s}_{k}" for s in specs for k in ("mismatch_score", "component_valid_count")], net.alias("net_mismatch_score"), net.alias("dfm_score_simple"), *[c.alias(n) for n, c in coverage.items()], flag.alias("mismatch_quality_flag"), notes.alias("mismatch_quality_notes"))
