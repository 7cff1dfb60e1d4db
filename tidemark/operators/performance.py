"""From holdings to evidence: period returns with legs, monthly diagnostics, metric tables, ablation summaries, verdict evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(c: Column) -> Column:
    """The sum of values rounded to 12 places, as decimals, so that it doesn't depend on the order of rows."""
    return F.sum(F.round(c, 12).cast("decimal(30,12)"))


def rebalance_period(date: Column, quarterly: bool = False) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string")) if quarterly else F.date_format(date, "yyyy-MM")


def period_returns(held: DataFrame, *, period: str, name: str, outcome: str, group: list[str] = (), flag: str | None = None, bps: float = 10.0) -> DataFrame:
    """One row of each period with holdings: gross, turnover, cost, net, legs, means, counts, exposures and the worst flag.

    held: (group..., period, name, weight, outcome), see holdings. Turnover is half the absolute weight change since the previous
    period with holdings; cost is turnover times bps / 10,000. Sums are exact decimals. flag: a column of GREEN, YELLOW, RED.
    """
    order = Window.partitionBy(*group).orderBy(period)
    periods = held.select(*group, period).distinct().withColumn("_k", F.row_number().over(order))  # a row for each group and period
    on = [*group, period]
    now = held.join(periods, on)
    w = F.col("weight")
    old = now.select(*group, (F.col("_k") + 1).alias("_k"), name, w.alias("_old"))
    change = F.abs(F.coalesce(w, F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)))
    turnover = now.select(*group, "_k", name, "weight").join(old, [*group, "_k", name], "full").groupBy(*group, "_k").agg((exact_sum(change) / 2).cast("decimal(30,12)").alias("turnover"))
    leg = lambda side, c: F.when(w > 0 if side == "long" else w < 0, c)
    gain = w * F.col(outcome)
    worst = F.max(F.when(F.col(flag) == "RED", 2).when(F.col(flag) == "YELLOW", 1).otherwise(0)) if flag else F.lit(0)
    sums = now.groupBy(*on, "_k").agg(
        exact_sum(gain).alias("gross_return"),
        *[exact_sum(leg(s, gain)).alias(f"{s}_leg_contribution") for s in ("long", "short")],
        *[F.try_divide(exact_sum(leg(s, F.col(outcome))), F.count(leg(s, F.col(outcome)))).alias(f"{s}_avg_forward_return") for s in ("long", "short")],
        *[F.count(leg(s, w)).alias(f"{s}_count") for s in ("long", "short")],
        exact_sum(F.abs(w)).alias("gross_exposure"),
        exact_sum(w).alias("net_exposure"),
        worst.alias("_worst"),
    )
    cost = (F.col("turnover") * F.lit(bps).cast("decimal(10,4)") / 10_000).cast("decimal(30,12)")
    out = sums.join(turnover, [*group, "_k"]).withColumn("cost", cost).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return out.withColumn("quality_flag", F.when(F.col("_worst") == 2, "RED").when(F.col("_worst") == 1, "YELLOW").otherwise("GREEN")).drop("_k", "_worst")


def monthly_diagnostics(returns: DataFrame, *, period: str, group: list[str] = ()) -> DataFrame:
    """Period returns with growth, cumulative returns, cost drag, running peaks and drawdowns, rounded to 12 places.

    A group is one strategy; its periods, a few hundred, are walked through in order.
    """
    w = Window.partitionBy(*group).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    out = returns
    for side in ("gross", "net"):
        out = out.withColumn(f"{side}_growth", 1 + F.col(f"{side}_return").cast("double"))
        out = out.withColumn(f"cumulative_{side}_index", F.product(f"{side}_growth").over(w))
        out = out.withColumn(f"{side}_running_peak", F.max(f"cumulative_{side}_index").over(w))
        out = out.withColumns({f"cumulative_{side}_return": F.round(F.col(f"cumulative_{side}_index") - 1, 12), f"{side}_drawdown": F.round(F.col(f"cumulative_{side}_index") / F.col(f"{side}_running_peak") - 1, 12), f"{side}_return_positive": F.col(f"{side}_return") > 0})
    return out.withColumns({"cost_drag_period": F.col("gross_return") - F.col("net_return"), "cumulative_cost_drag": F.round(F.col("cumulative_gross_return") - F.col("cumulative_net_return"), 12)})


def performance_metrics(returns: DataFrame, *, period: str, group: list[str], model: str | None = None, per_year: int = 12, version: str = "1") -> DataFrame:
    """(group..., metric, value_num, value_str): the 34 measures of each strategy, one row each.

    Annualized is (1 + cumulative) ^ (per_year / periods) - 1, and -1 where all is lost. Sharpe needs two periods with some spread,
    Sortino two negative ones; profit factor is null without losses.
    """
    monthly = monthly_diagnostics(returns, period=period, group=group)
    number = lambda c: F.col(c).cast("double")
    nums: dict[str, Column] = {"period_count": F.count("*").cast("double"), "annualization_periods": F.lit(float(per_year))}
    for side in ("gross", "net"):
        r = number(f"{side}_return")
        total = F.max_by(f"cumulative_{side}_return", period)
        spread, low = F.stddev_samp(r), F.stddev_samp(F.when(r < 0, r))
        nums |= {f"cumulative_{side}_return": total, f"annualized_{side}_return": F.when(total <= -1, -1.0).otherwise(F.pow(1 + total, F.lit(float(per_year)) / F.count("*")) - 1), f"mean_{side}_return": F.avg(r), f"vol_{side}_return": F.nullif(spread, F.lit(0.0)), f"{side}_sharpe": F.try_divide(F.avg(r), spread) * per_year**0.5, f"{side}_sortino": F.try_divide(F.avg(r), low) * per_year**0.5, f"{side}_max_drawdown": F.min(f"{side}_drawdown"), f"{side}_hit_rate": F.avg((r > 0).cast("double")), f"{side}_profit_factor": F.try_divide(F.sum(F.when(r > 0, r).otherwise(0.0)), F.nullif(-F.sum(F.when(r < 0, r).otherwise(0.0)), F.lit(0.0)))}
    nums["cumulative_cost_drag"] = F.max_by("cumulative_cost_drag", period)
    nums |= {"mean_turnover": F.avg(number("turnover")), "median_turnover": F.median(number("turnover")), "mean_transaction_cost_return": F.avg(number("cost")), "total_transaction_cost_return": F.sum(number("cost")), "mean_long_count": F.avg("long_count"), "mean_short_count": F.avg("short_count"), "mean_gross_exposure": F.avg(number("gross_exposure")), "mean_net_exposure": F.avg(number("net_exposure"))}
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    texts = {"report_version": F.lit(version), "first_period": F.min(period), "last_period": F.max(period), "quality_flags": names("quality_flag"), "primary_model_name": names(model) if model else F.lit("")}
    one = monthly.groupBy(*group).agg(*[c.alias(k) for k, c in (nums | texts).items()])
    rows = [F.struct(F.lit(k).alias("metric"), F.round(F.col(k), 12).alias("value_num"), F.lit(None).cast("string").alias("value_str")) for k in nums]
    rows += [F.struct(F.lit(k).alias("metric"), F.lit(None).cast("double").alias("value_num"), F.col(k).alias("value_str")) for k in texts]
    return one.select(*group, F.explode(F.array(*rows)).alias("x")).select(*group, "x.*")


def prediction_counts(predictions: DataFrame) -> DataFrame:
    """Rows and distinct folds of each model and role."""
    return predictions.groupBy("model_name", "role").agg(F.count("*").alias("prediction_rows"), F.count_distinct("fold_id").alias("prediction_folds"))


def role_report(metrics: DataFrame, predictions: DataFrame) -> DataFrame:
    """Means and medians of fold metrics for each model and role, with prediction counts (zero where there are none)."""
    stats = {f"{how}_{m}": F.round(f(m), 9) for m in ("spearman", "mae", "rmse") for how, f in (("mean", F.avg), ("median", F.median))}
    roles = metrics.groupBy("model_name", "role").agg(*[c.alias(k) for k, c in stats.items()], F.count_distinct("fold_id").alias("folds_success"))
    return roles.join(prediction_counts(predictions), ["model_name", "role"], "left").fillna(0, ["prediction_rows", "prediction_folds"])


def primary_models(report: DataFrame, group: list[str]) -> DataFrame:
    """One model of each group: a flagged one, else the best rank, else the first name."""
    order = [F.desc(F.coalesce(F.col("is_primary_model"), F.lit(False))), F.asc_nulls_last("model_selection_rank"), F.col("model_name")]
    return report.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_r = 1").drop("_r")


def ablation_summary(metrics: DataFrame, returns: DataFrame, *, group: list[str] = ()) -> DataFrame:
    """One row of each ablation: fold metrics, portfolio results, and its place by the combined score (missing values last)."""
    on = [*group, "ablation_name"]
    m = metrics.groupBy(*on).agg(F.count_distinct("fold_id").alias("folds_success"), F.avg("spearman").alias("mean_spearman_ic"), F.median("spearman").alias("median_spearman_ic"), F.avg("pearson").alias("mean_pearson_ic"), F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"))
    r = {c: F.col(c).cast("double") for c in ("gross_return", "net_return", "turnover", "cost")}
    p = returns.groupBy(*on).agg(F.count("*").alias("portfolio_periods"), (F.product(1 + r["gross_return"]) - 1).alias("cumulative_gross_return"), (F.product(1 + r["net_return"]) - 1).alias("cumulative_net_return"), F.avg(r["net_return"]).alias("mean_net_return"), F.avg((r["net_return"] > 0).cast("double")).alias("hit_rate"), F.avg(r["turnover"]).alias("mean_turnover"), F.sum(r["cost"]).alias("total_transaction_cost"))
    joined = m.join(p, on, "left").fillna(0, ["portfolio_periods"])
    of = Window.partitionBy(*group)  # a few ablations of each group
    rank = lambda c, down, missing: F.rank().over(of.orderBy((F.desc if down else F.asc)(F.round(F.coalesce(F.col(c), F.lit(missing)), 9))))
    ranked = joined.withColumns({"rank_ic": rank("mean_spearman_ic", True, -1e9), "rank_mae": rank("mean_mae", False, 1e9), "rank_portfolio_net": rank("cumulative_net_return", True, -1e9)})
    return ranked.withColumn("ablation_score_rank", F.row_number().over(of.orderBy(F.col("rank_ic") * 10 + F.col("rank_mae") * 2 + F.col("rank_portfolio_net"), "ablation_name")))


def best_or_tied(summary: DataFrame, name: str, *, group: list[str] = (), tolerance: float = 1e-12) -> DataFrame:
    """(group..., best_ablation_by_ic, is_best_or_tied): whether the ablation ``name`` reaches the best mean information coefficient."""
    ic = F.col("mean_spearman_ic")
    best = F.min_by("ablation_name", F.struct(F.when(ic.isNull(), 1).otherwise(0), -F.coalesce(ic, F.lit(0.0)), F.col("ablation_name")))
    own = F.max(F.when(F.col("ablation_name") == name, ic))
    return summary.groupBy(*group).agg(best.alias("best_ablation_by_ic"), F.coalesce(own >= F.max(ic) - tolerance, F.lit(False)).alias("is_best_or_tied"))


#: What a verdict looks at, by source.
EVIDENCE = {
    "portfolio_performance_summary": ("primary_model_name", "period_count", "cumulative_net_return", "annualized_net_return", "net_sharpe", "net_sortino", "net_max_drawdown", "net_hit_rate", "mean_turnover", "total_transaction_cost_return"),
    "model_selection_report": ("model_name", "validation_mean_spearman_ic", "validation_mean_mae", "validation_mean_rmse", "test_mean_spearman_ic", "model_selection_rank"),
    "ablation_summary": ("mean_spearman_ic", "mean_mae", "mean_rmse", "cumulative_net_return", "ablation_score_rank"),
}


def evidence(metrics: DataFrame, selection: DataFrame, ablations: DataFrame, name: str, group: list[str]) -> DataFrame:
    """(group..., source, metric, value): evidence rows of each strategy as text, from its metric table, primary model and ablation.

    metrics: (group..., metric, value_num, value_str); selection, ablations: wide tables with the group's columns.
    """
    text = lambda c: F.round(c, 9).cast("string")
    first, second, third = EVIDENCE

    def rows(df: DataFrame, source: str) -> DataFrame:
        kinds = dict(df.dtypes)
        found = [F.struct(F.lit(c).alias("metric"), (text(F.col(c)) if kinds[c] == "double" else F.col(c).cast("string")).alias("value")) for c in EVIDENCE[source] if c in kinds]
        return df.select(*group, F.explode(F.array(*found)).alias("x")).select(*group, F.lit(source).alias("source"), "x.*")

    found = metrics.filter(F.col("metric").isin(*EVIDENCE[first])).select(*group, F.lit(first).alias("source"), "metric", F.coalesce("value_str", text(F.col("value_num"))).alias("value"))
    best = best_or_tied(ablations, name, group=group).select(*group, F.lit(third).alias("source"), F.lit("best_ablation_by_ic").alias("metric"), F.col("best_ablation_by_ic").alias("value"))
    return found.unionByName(rows(primary_models(selection, group), second)).unionByName(rows(ablations.filter(F.col("ablation_name") == name), third)).unionByName(best)


def critical_verdicts(metrics: DataFrame, criteria: dict[str, tuple[Column, bool]], group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Criteria rows (group..., criterion, critical, passed), and one verdict of each group: PASS if no critical criterion fails.

    metrics has one row of each group; a criterion that is null fails.
    """
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), F.lit(critical).alias("critical"), F.coalesce(c, F.lit(False)).alias("passed")) for n, (c, critical) in criteria.items()])
    checks = metrics.select(*group, F.explode(rows).alias("x")).select(*group, "x.*")
    out = checks.groupBy(*group).agg(F.count_if("passed").alias("passed_criteria"), F.count("*").alias("total_criteria"), F.count_if(F.col("critical") & ~F.col("passed")).alias("critical_failures"))
    return checks, out.withColumn("final_verdict", F.when(F.col("critical_failures") == 0, "PASS").otherwise("FAIL"))
