"""Registered queries of panels, accounting features, text features, portfolios and evidence over the given tables, with their SQL.

The given tables hold no filings, so each query makes the operator's input from rows that are there: documents stand for filings,
lineitem for facts, suppliers for securities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import accounting, inputs, market, panel, performance, texts
from tidemark.queries import _SCORES, _scores, _t
from tidemark.research import _HTML


def _plain(df: DataFrame) -> DataFrame:
    """Doubles and decimals to six places, as doubles."""
    return df.select(*[F.round(F.col(c), 6).cast("double").alias(c) if k == "double" or k.startswith("decimal") else F.col(c) for c, k in df.dtypes])


# Portfolios


def _held(spark: SparkSession, d: str) -> DataFrame:
    held = market.holdings(_scores(spark, d), period="month", name="l_suppkey", score="score", outcome="outcome")
    return held.withColumn("strategy", F.lit("price")).withColumn("flag", F.when(F.col("l_suppkey") % 50 == 0, "RED").when(F.col("l_suppkey") % 7 == 0, "YELLOW").otherwise("GREEN"))


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return performance.period_returns(_held(spark, d), period="month", name="l_suppkey", outcome="outcome", group=["strategy"], flag="flag")


def portfolio_returns(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_returns(spark, d))


def monthly_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    out = performance.monthly_diagnostics(_returns(spark, d), period="month", group=["strategy"])
    return _plain(out.select("month", "cumulative_gross_return", "cumulative_net_return", "gross_drawdown", "net_drawdown", "cost_drag_period", "cumulative_cost_drag", "gross_running_peak", "net_running_peak", "net_return_positive"))


def performance_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _plain(performance.performance_metrics(_returns(spark, d), period="month", group=["strategy"], model="strategy"))


def _ablations(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("a"), F.sum("l_quantity").alias("b"), F.round(F.avg("l_discount") - 0.05, 6).alias("outcome"))
    return rows.select("month", "l_suppkey", "outcome", F.explode(F.map_from_arrays(F.array(F.lit("price_score"), F.lit("quantity_score"), F.lit("zero_score")), F.array(F.round(F.col("a") / 1e6, 9), F.round(F.col("b") / 1e3, 9), F.lit(0.0)))).alias("ablation_name", "y_pred"))


def _ablation_returns(spark: SparkSession, d: str) -> DataFrame:
    held = market.holdings(_ablations(spark, d), period="month", name="l_suppkey", score="y_pred", group=["ablation_name"], outcome="outcome")
    return performance.period_returns(held, period="month", name="l_suppkey", outcome="outcome", group=["ablation_name"])


def _ablation_summary(spark: SparkSession, d: str) -> DataFrame:
    metrics = market.fold_metrics(_ablations(spark, d), ["ablation_name", "month"], "outcome", "y_pred").withColumnRenamed("month", "fold_id")
    return performance.ablation_summary(metrics, _ablation_returns(spark, d))


def ablation_portfolios(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_ablation_returns(spark, d).select("ablation_name", "month", "gross_return", "turnover", "net_return", "long_count", "short_count"))


def ablation_summary(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_ablation_summary(spark, d))


def best_ablation(spark: SparkSession, d: str) -> DataFrame:
    return performance.best_or_tied(_ablation_summary(spark, d), "price_score")


_LEG = "sum(cast(round({}, 12) as decimal(30,12)))"


def _returns_sql(held: str, by: str) -> str:
    """CTEs k, tv, ret over holdings ``held`` (by, month, name, weight, outcome, flag)."""
    leg = lambda side, c: f"case when weight {'>' if side == 'long' else '<'} 0 then {c} end"
    legs = ", ".join(f"{_LEG.format(leg(s, 'weight * outcome'))} as {s}_leg_contribution, {_LEG.format(leg(s, 'outcome'))} / nullif(count({leg(s, 'outcome')}), 0) as {s}_avg_forward_return, count({leg(s, 'weight')}) as {s}_count" for s in ("long", "short"))
    return (
        f"k as (select *, dense_rank() over (partition by {by} order by month) as k from {held}), "
        f"tv as (select g as {by}, k, cast({_LEG.format('abs(w - o)')} / 2 as decimal(30,12)) as turnover from (select coalesce(a.{by}, b.{by}) as g, coalesce(a.k, b.k + 1) as k, coalesce(a.weight, 0) as w, coalesce(b.weight, 0) as o from k a full join k b on a.{by} = b.{by} and a.k = b.k + 1 and a.l_suppkey = b.l_suppkey) group by g, k), "
        f"g as (select {by}, month, k, {_LEG.format('weight * outcome')} as gross_return, {legs}, {_LEG.format('abs(weight)')} as gross_exposure, {_LEG.format('weight')} as net_exposure, max(case flag when 'RED' then 2 when 'YELLOW' then 1 else 0 end) as worst from k group by {by}, month, k), "
        f"ret as (select g.*, turnover, cast(turnover * 10 / 10000 as decimal(30,12)) as cost, gross_return - cast(turnover * 10 / 10000 as decimal(30,12)) as net_return, case worst when 2 then 'RED' when 1 then 'YELLOW' else 'GREEN' end as quality_flag from g join tv on g.{by} = tv.{by} and g.k = tv.k)"
    )


_d = lambda c, name=None: f"cast(round({c}, 6) as double) as {name or c}"
_HELD_SQL = _SCORES + ", h2 as (select *, 'price' as strategy, case when l_suppkey % 50 = 0 then 'RED' when l_suppkey % 7 = 0 then 'YELLOW' else 'GREEN' end as flag from h)"
_RET_SQL = _HELD_SQL + ", " + _returns_sql("h2", "strategy")
_MONEY = ("gross_return", "long_leg_contribution", "short_leg_contribution", "long_avg_forward_return", "short_avg_forward_return", "gross_exposure", "net_exposure", "turnover", "cost", "net_return")
_MONTHLY_SQL = _RET_SQL + ", lg as (select *, sum(ln(1 + cast(gross_return as double))) over w as lgg, sum(ln(1 + cast(net_return as double))) over w as lgn from ret window w as (partition by strategy order by month)), ix as (select *, exp(lgg) as gi, exp(lgn) as ni, exp(max(lgg) over w) as gp, exp(max(lgn) over w) as np from lg window w as (partition by strategy order by month)), md as (select *, round(gi - 1, 12) as cg, round(ni - 1, 12) as cn, round(gi / gp - 1, 12) as dg, round(ni / np - 1, 12) as dn from ix)"


def _metrics_sql(places: int = 6) -> str:
    nums = {"period_count": "count(*)", "annualization_periods": "12", "cumulative_cost_drag": "max_by(cg - cn, month)", "mean_turnover": "avg(cast(turnover as double))", "median_turnover": "median(cast(turnover as double))", "mean_transaction_cost_return": "avg(cast(cost as double))", "total_transaction_cost_return": "sum(cast(cost as double))", "mean_long_count": "avg(long_count)", "mean_short_count": "avg(short_count)", "mean_gross_exposure": "avg(cast(gross_exposure as double))", "mean_net_exposure": "avg(cast(net_exposure as double))"}
    for side, total, fall in (("gross", "cg", "dg"), ("net", "cn", "dn")):
        r = f"cast({side}_return as double)"
        last = f"max_by({total}, month)"
        nums |= {f"cumulative_{side}_return": last, f"annualized_{side}_return": f"case when {last} <= -1 then -1 else (1 + {last}) ** (12.0 / count(*)) - 1 end", f"mean_{side}_return": f"avg({r})", f"vol_{side}_return": f"nullif(stddev_samp({r}), 0)", f"{side}_sharpe": f"avg({r}) / nullif(stddev_samp({r}), 0) * sqrt(12)", f"{side}_sortino": f"avg({r}) / nullif(stddev_samp({r}) filter ({side}_return < 0), 0) * sqrt(12)", f"{side}_max_drawdown": f"min({fall})", f"{side}_hit_rate": f"avg(case when {side}_return > 0 then 1.0 else 0.0 end)", f"{side}_profit_factor": f"coalesce(sum({r}) filter ({side}_return > 0), 0) / nullif(-sum({r}) filter ({side}_return < 0), 0)"}
    strs = {"report_version": "'1'", "first_period": "min(month)", "last_period": "max(month)", "quality_flags": "string_agg(distinct quality_flag, ',' order by quality_flag)", "primary_model_name": "string_agg(distinct strategy, ',' order by strategy)"}
    rows = [f"select strategy, '{k}' as metric, cast(round({c}, {places}) as double) as value_num, cast(null as varchar) as value_str from md group by strategy" for k, c in nums.items()]
    rows += [f"select strategy, '{k}' as metric, cast(null as double) as value_num, cast({c} as varchar) as value_str from md group by strategy" for k, c in strs.items()]
    return f"with {_MONTHLY_SQL}, mt as ({' union all '.join(rows)}) "


_AB_SQL = "s0 as (select strftime(l_shipdate, '%Y-%m') as month, l_suppkey, round(sum(l_extendedprice), 2) as a, sum(l_quantity) as b, round(avg(l_discount) - 0.05, 6) as outcome from lineitem group by all), ab as (select month, l_suppkey, outcome, 'price_score' as ablation_name, round(a / 1e6, 9) as y_pred from s0 union all select month, l_suppkey, outcome, 'quantity_score', round(b / 1e3, 9) from s0 union all select month, l_suppkey, outcome, 'zero_score', 0.0::double from s0), rk as (select *, count(*) over (partition by ablation_name, month) as n, row_number() over (partition by ablation_name, month order by y_pred, l_suppkey) as r from ab), hh as (select * from (select *, 'GREEN' as flag, case when r > n - greatest(1, ceil(n * (1 - 0.9::double))) then 1 / greatest(1, ceil(n * (1 - 0.9::double))) when r <= greatest(1, ceil(n * 0.1::double)) then -1 / greatest(1, ceil(n * 0.1::double)) end as weight from rk where n >= 10) where weight is not null), " + _returns_sql("hh", "ablation_name")
_avg_rank = lambda c: f"rank() over (partition by ablation_name, month order by {c}) + (count(*) over (partition by ablation_name, month, {c}) - 1) / 2.0"
_ABS_SQL = _AB_SQL + f", rr as (select ablation_name, month, outcome as y, y_pred as p, {_avg_rank('outcome')} as ry, {_avg_rank('y_pred')} as rp from ab), fm as (select ablation_name, month, sqrt(avg((y - p) ** 2)) as rmse, avg(abs(y - p)) as mae, covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0) as pearson, covar_pop(ry, rp) / nullif(stddev_pop(ry) * stddev_pop(rp), 0) as spearman from rr group by ablation_name, month), m as (select ablation_name, count(*) as folds_success, avg(spearman) as mean_spearman_ic, median(spearman) as median_spearman_ic, avg(pearson) as mean_pearson_ic, avg(mae) as mean_mae, avg(rmse) as mean_rmse from fm group by 1), pp as (select ablation_name, count(*) as portfolio_periods, exp(sum(ln(1 + cast(gross_return as double)))) - 1 as cumulative_gross_return, exp(sum(ln(1 + cast(net_return as double)))) - 1 as cumulative_net_return, avg(cast(net_return as double)) as mean_net_return, avg(case when net_return > 0 then 1.0 else 0.0 end) as hit_rate, avg(cast(turnover as double)) as mean_turnover, sum(cast(cost as double)) as total_transaction_cost from ret group by 1), sm as (select *, rank() over (order by round(coalesce(mean_spearman_ic, -1e9), 9) desc) as rank_ic, rank() over (order by round(coalesce(mean_mae, 1e9), 9)) as rank_mae, rank() over (order by round(coalesce(cumulative_net_return, -1e9), 9) desc) as rank_portfolio_net from m left join pp using (ablation_name))"
_SUMMARY = ("mean_spearman_ic", "median_spearman_ic", "mean_pearson_ic", "mean_mae", "mean_rmse", "cumulative_gross_return", "cumulative_net_return", "mean_net_return", "hit_rate", "mean_turnover", "total_transaction_cost")


# Evidence


def _reports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A selection report: three models of each strategy, from orders by priority and status."""
    o = _t(spark, d, "orders").withColumns({"fold_id": F.date_format("o_orderdate", "yyyy"), "model_name": F.substring("o_orderpriority", 1, 1), "role": F.when(F.col("o_orderstatus") == "F", "validation").otherwise("test")})
    metrics = o.groupBy("model_name", "role", "fold_id").agg(F.round(F.avg("o_totalprice") / 1e6, 6).alias("spearman"), F.round(F.stddev_samp("o_totalprice") / 1e5, 6).alias("mae"), F.round(F.max("o_totalprice") / 1e5, 6).alias("rmse"))
    return metrics, o.select("model_name", "role", "fold_id")


def role_report(spark: SparkSession, d: str) -> DataFrame:
    return _plain(performance.role_report(*_reports(spark, d)))


def _selection(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.max("c_acctbal"), 2).alias("validation_mean_mae"))
    return c.select(F.concat(F.lit("n"), "c_nationkey").alias("strategy"), F.col("c_mktsegment").alias("model_name"), F.col("n").alias("model_selection_rank"), (F.col("n") % 5 == 0).alias("is_primary_model"), "validation_mean_mae")


def primary_model(spark: SparkSession, d: str) -> DataFrame:
    return performance.primary_models(_selection(spark, d), ["strategy"]).select("strategy", "model_name", "model_selection_rank", "is_primary_model")


def verdict_evidence(spark: SparkSession, d: str) -> DataFrame:
    metrics = performance.performance_metrics(_returns(spark, d), period="month", group=["strategy"], model="strategy")
    whole = F.lit("price").alias("strategy")
    selection = _selection(spark, d).withColumns({"model_name": F.concat_ws(":", "strategy", "model_name"), "strategy": whole})
    found = performance.evidence(metrics, selection, _ablation_summary(spark, d).withColumn("strategy", whole), "price_score", ["strategy"])
    number = F.col("value").try_cast("double")
    return found.select("strategy", "source", "metric", F.round(number, 5).alias("value_num"), F.when(number.isNull(), F.col("value")).alias("value_str"))


def critical_verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("total"), F.min("s_acctbal").alias("low"))
    criteria = {"enough": (F.col("n") >= 2, True), "positive": (F.col("total") > 0, True), "drawdown": (F.col("low") >= -500, False)}
    return performance.critical_verdicts(s, criteria, ["s_nationkey"])[1]


_SEL_SQL = "sel as (select 'n' || c_nationkey as strategy, c_mktsegment as model_name, count(*) as model_selection_rank, count(*) % 5 = 0 as is_primary_model, round(max(c_acctbal), 2) as validation_mean_mae from customer group by c_mktsegment, c_nationkey), pm as (select * from sel qualify row_number() over (partition by strategy order by is_primary_model desc, model_selection_rank, model_name) = 1)"


# Panels


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """documents as filings: four documents for an accession, 20 companies."""
    docs = _t(spark, d, "documents")
    accession = F.lpad(F.floor(F.col("doc_id") / 4).cast("string"), 18, "0")
    return docs.select(F.lpad(F.regexp_extract("source", r"(\d+)", 1), 10, "0").alias("cik10"), accession.alias("accession_number"), F.concat(F.lit("d"), F.col("doc_id") % 4).alias("primary_document"), "doc_id", "n_chars", "lang", "text").withColumn("accession_lineage_key", panel.lineage_key(F.col("cik10"), F.col("accession_number"), F.col("primary_document")))


_DOCS_SQL = "d0 as (select *, lpad(regexp_extract(source, '([0-9]+)', 1), 10, '0') as cik10, lpad(cast(doc_id // 4 as varchar), 18, '0') as accession_number, strftime(date '2020-01-01' + cast(doc_id % 700 as integer), '%Y-%m-%d') as day from documents), dd as (select *, cik10 || ':' || accession_number || ':d' || (doc_id % 4) as accession_lineage_key, cik10 || ':' || accession_number as acc from d0)"


# Accounting


def _concept_map(spark: SparkSession) -> DataFrame:
    """22 tags, two for each concept: tag k stands for concept k % 11 with rank k // 11."""
    names = F.array(*[F.lit(c) for c in accounting.CONCEPTS])
    k = F.col("id")
    return spark.range(22).select(F.concat(F.lit("T"), k).alias("tag"), F.get(names, (k % 11).cast("int")).alias("concept"), F.floor(k / 11).cast("int").alias("tag_rank"), F.lit("N").alias("expected_unit"), F.lit(1).alias("expected_qtrs"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as facts of orders: tag from part, unit from return flag, length from line number."""
    day = lambda c: F.date_format(F.trunc(c, "month"), "yyyyMMdd")
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("accession_number"), F.concat(F.lit("T"), F.col("l_partkey") % 22).alias("tag"), F.col("l_extendedprice").cast("string").alias("value"), F.col("l_returnflag").alias("unit"), F.when(F.col("l_linenumber") == 7, "X").otherwise("").alias("coreg"), day("l_shipdate").alias("ddate"), day(F.date_add("l_shipdate", F.col("l_linenumber").cast("int") * 3)).alias("period"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("qtrs"), "l_linenumber")
    return accounting.select_facts(rows, F.broadcast(_concept_map(spark)), tie=["l_linenumber"])


def _fundamentals(spark: SparkSession, d: str) -> DataFrame:
    return accounting.fundamental_features(_facts(spark, d))


def accounting_facts(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_facts(spark, d))


def fundamental_features(spark: SparkSession, d: str) -> DataFrame:
    ratios = [*accounting.RATIOS, "cash_minus_debt_to_assets", "working_capital_proxy_to_assets"]
    return _plain(_fundamentals(spark, d).select("accession_number", *accounting.CONCEPTS, "revenue_available", "revenue_tag", *ratios, "concept_coverage_count", "concept_coverage_ratio", "fundamental_quality_flag", "fundamental_quality_notes"))


def fundamental_deltas(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("accession_number"), "o_custkey", F.date_format("o_orderdate", "yyyyMMdd").alias("period"), F.when(F.col("o_orderpriority") > "3", F.concat(F.lit(" q"), F.quarter("o_orderdate"))).otherwise("").alias("fp"), F.when(F.col("o_orderstatus") == "F", "10-k").otherwise("10-Q").alias("form"))
    rows = _fundamentals(spark, d).join(o, "accession_number")
    out = accounting.fundamental_deltas(rows, entity="o_custkey", period=accounting.fiscal_period(F.col("fp"), F.col("form")), year=accounting.compact_year(F.col("period")), order=[F.asc_nulls_last("period_year"), F.col("period"), F.col("accession_number")])
    return _plain(out.select("accession_number", "period_key", accounting.compact_date(F.col("period")).alias("period_date"), "revenue_prior", "revenue_abs", "revenue_pct", "revenue_log", "net_margin_prior", "margin_delta", "asset_turnover_delta", "period_year_gap", "link_flag", "link_notes"))


def quarter_tables(spark: SparkSession, d: str) -> DataFrame:
    quarter = lambda c: performance.rebalance_period(F.col(c), quarterly=True)
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    sub = o.select(quarter("o_orderdate").alias("source_quarter"), F.col("o_orderkey").alias("adsh"), F.lower("o_orderpriority").alias("form"))
    num = li.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).select(quarter("o_orderdate").alias("source_quarter"), F.col("l_orderkey").alias("adsh"), F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("version"), "l_quantity")
    tag = num.select("source_quarter", "tag", "version").distinct()
    made = accounting.quarter_tables({"sub": sub, "num": num, "pre": num.drop("l_quantity"), "tag": tag}, forms=("1-URGENT", "2-HIGH"))
    counts = [accounting.source_diagnostics(made[n]).select(F.lit(n).alias("table_name"), "source_quarter", "n_rows", "n_filings") for n in ("sub", "num", "pre")]
    tags = made["tag"].groupBy("source_quarter").agg(F.count("*").alias("n_rows")).select(F.lit("tag").alias("table_name"), "source_quarter", "n_rows", F.lit(0).cast("bigint").alias("n_filings"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(tags)


_ratio = lambda a, b: f"round(({a}) / nullif({b}, 0), 12)"
_RATIO_SQL = {n: _ratio(a, b) for n, (a, b) in accounting.RATIOS.items()} | {"cash_minus_debt_to_assets": _ratio("cash - debt", "assets"), "working_capital_proxy_to_assets": _ratio("coalesce(cash, 0) + coalesce(receivables, 0) + coalesce(inventory, 0) - coalesce(liabilities, 0)", "assets")}
_FACT_SQL = f"f0 as (select l_orderkey as accession_number, 'T' || (l_partkey % 22) as tag, {list(accounting.CONCEPTS)}[1 + (l_partkey % 22) % 11] as concept, (l_partkey % 22) // 11 as tag_rank, l_extendedprice as value, l_returnflag as unit, l_linenumber, l_linenumber % 2 + 1 as qtrs, strftime(date_trunc('month', l_shipdate), '%Y%m%d') as ddate, strftime(date_trunc('month', cast(l_shipdate as date) + cast(l_linenumber * 3 as integer)), '%Y%m%d') as period from lineitem), f1 as (select *, (unit <> 'N')::int as b1, (l_linenumber = 7)::int as b2, (ddate <> period)::int as b3, (qtrs <> 1)::int as b4 from f0), fs as (select accession_number, concept, tag, unit, qtrs, ddate, value, case when b1 = 1 then 'RED' when b2 + b3 + b4 > 0 then 'YELLOW' else 'GREEN' end as fact_flag, array_to_string(list_filter([case when b1 = 1 then 'unexpected_unit' end, case when b2 = 1 then 'co_registrant' end, case when b3 = 1 then 'other_period' end, case when b4 = 1 then 'other_length' end], lambda x: x is not null), ';') as fact_notes from f1 qualify row_number() over (partition by accession_number, concept order by tag_rank, b1, b2, b3, b4, ddate desc, tag, l_linenumber, value desc) = 1)"
_listed = lambda pairs: f"list_filter([{', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in pairs)}], lambda x: x is not null)"
_GROUPS = {"missing_core_concepts": _listed([(c, f"{c} is null") for c in accounting.CORE]), "missing_cashflow_concepts": _listed([(c, f"{c} is null") for c in accounting.CASH_FLOW]), "red_fact_quality": _listed([(c, f"{c}_f = 'RED'") for c in sorted(accounting.CONCEPTS)]), "yellow_fact_quality": _listed([(c, f"{c}_f = 'YELLOW'") for c in sorted(accounting.CONCEPTS)]), "unavailable_ratios": _listed([(n, f"{n} is null") for n in sorted(_RATIO_SQL)])}
_FUND_SQL = _FACT_SQL + ", fw as (select accession_number, " + ", ".join(f"max(value) filter (concept = '{c}') as {c}, max(fact_flag) filter (concept = '{c}') as {c}_f, max(tag) filter (concept = '{c}') as {c}_tag" for c in accounting.CONCEPTS) + " from fs group by 1), fr as (select *, " + ", ".join(f"{c} as {n}" for n, c in _RATIO_SQL.items()) + ", " + " + ".join(f"({c} is not null)::int" for c in accounting.CONCEPTS) + " as cov from fw), fg as (select *, " + ", ".join(f"{g} as g_{n}" for n, g in _GROUPS.items()) + " from fr), fq as (select *, case when len(g_missing_core_concepts) + len(g_red_fact_quality) > 0 then 'RED' when len(g_missing_cashflow_concepts) + len(g_yellow_fact_quality) + len(g_unavailable_ratios) > 0 then 'YELLOW' else 'GREEN' end as fundamental_quality_flag, array_to_string(list_filter([" + ", ".join(f"case when len(g_{n}) > 0 then '{n}=' || array_to_string(g_{n}[1:8], '|') end" for n in _GROUPS) + "], lambda x: x is not null), ';') as fundamental_quality_notes from fg)"
_DELTA_SQL = _FUND_SQL + ", fo as (select fq.*, o_custkey, strftime(o_orderdate, '%Y%m%d') as period, o_orderdate, year(o_orderdate) as py, case when o_orderpriority > '3' then 'Q' || quarter(o_orderdate) when o_orderstatus = 'F' then 'FY' end as period_key from fq join orders on accession_number = o_orderkey), fl as (select *, case when period_key is not null then lag(revenue) over w end as rp, case when period_key is not null then lag(net_margin) over w end as mp, case when period_key is not null then lag(asset_turnover) over w end as tp, case when period_key is not null then lag(py) over w end as pp from fo window w as (partition by o_custkey, period_key order by py, period, accession_number))"


# Texts


def _sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Full texts, and three sections of every document that has such lines: every third line from the first, second and third on."""
    docs = _documents(spark, d)
    full = docs.select("accession_lineage_key", F.col("text").alias("clean_text"), F.when(F.col("n_chars") < 200, "RED").when(F.col("n_chars") < 1000, "YELLOW").otherwise("GREEN").alias("parse_quality_flag"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    third = lambda k: lambda x, i: i % 3 == k
    part = lambda k: F.array_join(F.filter(lines, third(k)), "\n")
    made = docs.select("accession_lineage_key", F.explode(F.array(*[F.struct(F.lit(n).alias("section_name"), part(k).alias("section_text")) for k, n in enumerate(texts.SECTIONS)])).alias("x")).select("accession_lineage_key", "x.*")
    made = made.withColumn("section_word_count", texts.word_count(F.col("section_text")))
    return full, made.filter("section_word_count > 0").withColumn("section_quality_flag", F.when(F.col("section_word_count") < 80, "YELLOW").otherwise("GREEN"))


TONES = {"positive": ("WAS", "FOR", "AND"), "negative": ("NOT", "NO", "ON"), "strong_modal": ("THAT", "OF"), "weak_modal": ("IT", "OR")}
_TONE = ("lm_token_count", "lm_positive_count", "lm_negative_share", "lm_net_tone_count", "lm_net_tone_share", "lm_pos_neg_balance", "lm_modal_total_share")


def text_features(spark: SparkSession, d: str) -> DataFrame:
    out = texts.text_features(*_sections(spark, d), texts.as_lexicon(spark, TONES), categories=tuple(TONES))
    prefixes = list(texts.SECTIONS.values())
    return _plain(out.select("accession_lineage_key", "parse_quality_flag", *[f"{p}{c}" for p in ("full_", *prefixes) for c in _TONE], *[f"{p}{c}" for p in prefixes for c in ("section_available", "section_quality_flag", "section_word_count_source")]))


def text_counts(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.tables import clean_html

    pages = _t(spark, d, "pages").select("page_id", "html", clean_html(F.col("html")).alias("clean"))
    return _plain(texts.text_counts(pages, "html", "clean", min_words=50).drop("html", "clean"))


def _tone_sql(text: str, prefix: str) -> tuple[str, str]:
    w = f"regexp_extract_all(translate(coalesce({text}, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z]+') as w"
    n = {k: f"len(list_filter(w, lambda x: x in {vs}))" for k, vs in TONES.items()}
    share = lambda c: f"coalesce(({c}) / nullif(len(w), 0), 0)"
    cols = {"lm_token_count": "len(w)", "lm_positive_count": n["positive"], "lm_negative_share": f"round({share(n['negative'])}, 6)", "lm_net_tone_count": f"{n['positive']} - {n['negative']}", "lm_net_tone_share": f"round({share(n['positive'] + ' - ' + n['negative'])}, 6)", "lm_pos_neg_balance": f"round(coalesce(({n['positive']} - {n['negative']}) / nullif({n['positive']} + {n['negative']}, 0), 0), 6)", "lm_modal_total_share": f"round({share(n['strong_modal'] + ' + ' + n['weak_modal'])}, 6)"}
    return w, ", ".join(f"{c} as {prefix}{k}" for k, c in cols.items())


def _text_sql() -> str:
    parts = [f"full0 as (select accession_lineage_key, case when n_chars < 200 then 'RED' when n_chars < 1000 then 'YELLOW' else 'GREEN' end as parse_quality_flag, {_tone_sql('text', 'full_')[0]} from dd), t_full as (select accession_lineage_key, parse_quality_flag, {_tone_sql('text', 'full_')[1]} from full0)"]
    out, joins = [], ""
    for k, (name, p) in enumerate(texts.SECTIONS.items()):
        w, cols = _tone_sql("sx", p)
        parts.append(f"s_{name} as (select * from (select accession_lineage_key, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x, i: (i - 1) % 3 = {k}), chr(10)) as sx from dd) where len(regexp_extract_all(sx, '[^ \\t\\n\\r\\f\\v]+')) > 0), w_{name} as (select accession_lineage_key, len(regexp_extract_all(sx, '[^ \\t\\n\\r\\f\\v]+')) as swc, {w} from s_{name}), t_{name} as (select accession_lineage_key, swc, {cols} from w_{name})")
        joins += f" left join t_{name} on t_full.accession_lineage_key = t_{name}.accession_lineage_key"
        out += [f"coalesce(t_{name}.{p}{c}, 0) as {p}{c}" for c in _TONE] + [f"t_{name}.swc is not null as {p}section_available", f"case when t_{name}.swc is null then 'RED' when t_{name}.swc < 80 then 'YELLOW' else 'GREEN' end as {p}section_quality_flag", f"coalesce(t_{name}.swc, 0) as {p}section_word_count_source"]
    return f"with {_DOCS_SQL}, {', '.join(parts)} select t_full.*, {', '.join(out)} from t_full{joins}"


# Inputs


def _raw_prices(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return _t(spark, d, "lineitem").select(F.when(n == 6, " ").otherwise(F.concat(F.lit(" "), F.lower("l_returnflag"))).alias(" Ticker"), F.when(n == 5, F.lit(None)).otherwise(F.col("l_suppkey").cast("string")).alias("CIK10"), F.when(n == 4, "").otherwise(F.col("l_linestatus")).alias("sector"), F.when(n == 3, "not a day").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"), F.when(n == 7, "nan").otherwise(F.col("l_extendedprice").cast("string")).alias("adj_close"))


def price_table(spark: SparkSession, d: str) -> DataFrame:
    return _plain(inputs.normal_prices(_raw_prices(spark, d)))


def price_checks(spark: SparkSession, d: str) -> DataFrame:
    return inputs.price_checks(_raw_prices(spark, d))


CONTRACTS = {
    "orders": {"columns": ("o_orderkey", "o_custkey", "o_clerk", "o_missing"), "not_blank": ("o_orderpriority",), "numeric": ("o_totalprice", "o_orderstatus"), "unique": (("o_orderkey",), ("o_custkey",)), "allowed": {"o_orderstatus": ("F", "O")}},
    "documents": {"min_rows": 1_000_000_000, "not_blank": ("text", "absent"), "unique": (("text",),)},
    "nowhere": {"columns": ("a",)},
}


def contract_registry(spark: SparkSession, d: str) -> DataFrame:
    return inputs.validate_registry({"orders": _t(spark, d, "orders"), "documents": _t(spark, d, "documents"), "nowhere": None}, CONTRACTS)


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select(F.col("url").alias("path"), F.regexp_extract("url", r"([^/.]+)$", 1).alias("suffix"), F.octet_length("html").cast("bigint").alias("size"))


def inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    wanted = _t(spark, d, "documents").select(F.concat(F.lit("https://none/"), "doc_id").alias("path")).unionByName(_t(spark, d, "pages").select(F.col("url").alias("path")))
    kinds, lost = inputs.inventory_summary(_inventory(spark, d), wanted)
    return kinds.unionByName(lost.agg(F.lit("(missing)").alias("suffix"), F.count("*").alias("n_files"), F.lit(0).cast("bigint").alias("total_size")))


def period_keys(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 10 == 0, "20240231").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", performance.rebalance_period(F.col("o_orderdate")).alias("month"), performance.rebalance_period(F.col("o_orderdate"), quarterly=True).alias("quarter"), accounting.compact_date(text).alias("day"), accounting.compact_year(text).alias("year"), accounting.fiscal_period(F.when(F.col("o_orderkey") % 3 == 0, "fy").when(F.col("o_orderkey") % 3 == 1, ""), F.when(F.col("o_orderstatus") == "F", "10-k").otherwise("10-Q")).alias("fiscal"))


_EVIDENCE_NUM = [("model_selection_report", "model_selection_rank", "(select model_selection_rank from pm1)"), ("model_selection_report", "validation_mean_mae", "(select validation_mean_mae from pm1)"), *[("ablation_summary", c, f"(select max({c}) from sx where ablation_name = 'price_score')") for c in performance.EVIDENCE["ablation_summary"]]]
_EVIDENCE_SQL = _metrics_sql(9) + f", {_SEL_SQL}, pm1 as (select *, strategy || ':' || model_name as name from sel order by is_primary_model desc, model_selection_rank, name limit 1), ab_all as (with {_ABS_SQL} select *, row_number() over (order by rank_ic * 10 + rank_mae * 2 + rank_portfolio_net, ablation_name) as ablation_score_rank from sm), sx as (select * from ab_all), ev as (select 'portfolio_performance_summary' as source, metric, value_num, value_str from mt where metric in {performance.EVIDENCE['portfolio_performance_summary']} union all " + " union all ".join(f"select '{a}', '{b}', round({c}, 9), null" for a, b, c in _EVIDENCE_NUM) + " union all select 'model_selection_report', 'model_name', null, (select name from pm1) union all select 'ablation_summary', 'best_ablation_by_ic', null, (select ablation_name from sx order by mean_spearman_ic desc nulls last, ablation_name limit 1)) select 'price' as strategy, source, metric, cast(round(value_num, 5) as double) as value_num, value_str from ev"

_HTML_SQL = rf"trim(regexp_replace({_HTML}, '[ \t\r\n]+', ' ', 'g'))"

ORACLES = {
    "verdict_evidence": _EVIDENCE_SQL,
    "text_counts": f"with h as (select page_id, html, {_HTML_SQL} as clean from pages), c as (select page_id, coalesce(length(html), 0) as raw_char_count, length(clean) as clean_char_count, len(regexp_extract_all(clean, '[^ \\t\\n\\r\\f\\v]+')) as clean_word_count from h) select *, round(coalesce(clean_char_count / nullif(raw_char_count, 0), 0), 6) as clean_raw_ratio, case when clean_word_count = 0 then 'RED' when clean_word_count < 50 then 'YELLOW' else 'GREEN' end as parse_quality_flag, case when clean_word_count = 0 then 'empty_text' when clean_word_count < 50 then 'few_words' else '' end as parse_quality_notes from c",
    "portfolio_returns": f"with {_RET_SQL} select strategy, month, {', '.join(_d(c) for c in _MONEY)}, long_count, short_count, quality_flag from ret",
    "monthly_diagnostics": f"with {_MONTHLY_SQL} select month, {_d('cg', 'cumulative_gross_return')}, {_d('cn', 'cumulative_net_return')}, {_d('dg', 'gross_drawdown')}, {_d('dn', 'net_drawdown')}, {_d('cost', 'cost_drag_period')}, {_d('cg - cn', 'cumulative_cost_drag')}, {_d('gp', 'gross_running_peak')}, {_d('np', 'net_running_peak')}, net_return > 0 as net_return_positive from md",
    "performance_metrics": _metrics_sql() + "select * from mt",
    "ablation_portfolios": f"with {_AB_SQL} select ablation_name, month, {_d('gross_return')}, {_d('turnover')}, {_d('net_return')}, long_count, short_count from ret",
    "ablation_summary": f"with {_ABS_SQL} select ablation_name, folds_success, coalesce(portfolio_periods, 0) as portfolio_periods, {', '.join(_d(c) for c in _SUMMARY)}, rank_ic, rank_mae, rank_portfolio_net, row_number() over (order by rank_ic * 10 + rank_mae * 2 + rank_portfolio_net, ablation_name) as ablation_score_rank from sm",
    "best_ablation": f"with {_ABS_SQL} select (select ablation_name from sm order by mean_spearman_ic desc nulls last, ablation_name limit 1) as best_ablation_by_ic, coalesce((select mean_spearman_ic from sm where ablation_name = 'price_score') >= (select max(mean_spearman_ic) from sm) - 1e-12, false) as is_best_or_tied",
    "role_report": "with o as (select *, strftime(o_orderdate, '%Y') as fold_id, substring(o_orderpriority, 1, 1) as model_name, case when o_orderstatus = 'F' then 'validation' else 'test' end as role from orders), m as (select model_name, role, fold_id, round(avg(o_totalprice) / 1e6, 6) as spearman, round(stddev_samp(o_totalprice) / 1e5, 6) as mae, round(max(o_totalprice) / 1e5, 6) as rmse from o group by 1, 2, 3), r as (select model_name, role, " + ", ".join(f"round({f}({c}), 6) as {n}_{c}" for c in ("spearman", "mae", "rmse") for n, f in (("mean", "avg"), ("median", "median"))) + ", count(distinct fold_id) as folds_success from m group by 1, 2), p as (select model_name, role, count(*) as prediction_rows, count(distinct fold_id) as prediction_folds from o group by 1, 2) select r.*, coalesce(prediction_rows, 0) as prediction_rows, coalesce(prediction_folds, 0) as prediction_folds from r left join p on r.model_name = p.model_name and r.role = p.role",
    "primary_model": f"with {_SEL_SQL} select strategy, model_name, model_selection_rank, is_primary_model from pm",
    "critical_verdicts": "with s as (select s_nationkey, count(*) >= 2 as a, sum(s_acctbal) > 0 as b, min(s_acctbal) >= -500 as c from supplier group by 1) select s_nationkey, a::int + b::int + c::int as passed_criteria, 3 as total_criteria, 2 - a::int - b::int as critical_failures, case when a and b then 'PASS' else 'FAIL' end as final_verdict from s",
    "accounting_facts": f"with {_FACT_SQL} select accession_number, concept, tag, unit, qtrs, ddate, round(value, 6) as value, fact_flag, fact_notes from fs",
    "fundamental_features": f"with {_FUND_SQL} select accession_number, {', '.join(f'round({c}, 6) as {c}' for c in (*accounting.CONCEPTS, *_RATIO_SQL))}, revenue is not null as revenue_available, revenue_tag, cov as concept_coverage_count, round(cov / 11, 6) as concept_coverage_ratio, fundamental_quality_flag, fundamental_quality_notes from fq",
    "fundamental_deltas": f"with {_DELTA_SQL} select accession_number, period_key, cast(o_orderdate as date) as period_date, round(rp, 6) as revenue_prior, round(revenue - rp, 6) as revenue_abs, round((revenue - rp) / nullif(abs(rp), 0), 6) as revenue_pct, round(sign(revenue) * ln(1 + abs(revenue)) - sign(rp) * ln(1 + abs(rp)), 6) as revenue_log, round(mp, 6) as net_margin_prior, round(net_margin - mp, 6) as margin_delta, round(asset_turnover - tp, 6) as asset_turnover_delta, py - pp as period_year_gap, case when pp is null or fundamental_quality_flag = 'RED' then 'RED' when py - pp <> 1 or fundamental_quality_flag = 'YELLOW' then 'YELLOW' else 'GREEN' end as link_flag, array_to_string(list_filter([case when pp is null then 'missing_prior_comparable_filing' end, case when fundamental_quality_flag = 'RED' then 'current_fundamental_quality_red' end, case when py - pp <> 1 then 'period_year_gap_not_one' end, case when fundamental_quality_flag = 'YELLOW' then 'current_fundamental_quality_yellow' end], lambda x: x is not null), ';') as link_notes from fl",
    "quarter_tables": "with o as (select *, year(o_orderdate) || 'Q' || quarter(o_orderdate) as q from orders), k as (select * from o where o_orderpriority in ('1-URGENT', '2-HIGH')), n as (select q, l_orderkey from lineitem join k on l_orderkey = o_orderkey), t as (select l_returnflag, l_linestatus, min(q) as q from lineitem join o on l_orderkey = o_orderkey group by 1, 2), z as (select q as source_quarter, count(*) as n_rows, count(distinct l_orderkey) as n_filings from n group by 1) select 'sub' as table_name, q as source_quarter, count(*) as n_rows, count(distinct o_orderkey) as n_filings from k group by q union all select 'num', * from z union all select 'pre', * from z union all select 'tag', q, count(*), 0 from t group by q",
    "text_features": _text_sql(),
    "price_table": "with r as (select case when l_linenumber <> 6 then upper(trim(l_returnflag)) end as ticker, case when l_linenumber <> 5 then lpad(cast(l_suppkey as varchar), 10, '0') end as cik10, case when l_linenumber = 4 then 'UNKNOWN' else l_linestatus end as sector, cast(l_shipdate as date) as date, l_extendedprice as adj_close from lineitem where l_linenumber not in (3, 7)) select ticker, cik10, sector, date, round(adj_close, 6) as adj_close from r qualify row_number() over (partition by ticker, cik10, date order by adj_close desc, sector) = 1",
    "price_checks": "with c(check_id, blocker, failures, n) as (select 'price_date', true, 0, count(*) from lineitem union all select 'price_identifier', true, 0, count(*) from lineitem union all select 'price_adjusted_close', true, 0, count(*) from lineitem union all select 'price_sector', false, count(*) filter (l_linenumber = 4), count(*) from lineitem) select check_id, case when failures = n and blocker then 'FAIL' when failures > 0 then 'WARN' else 'PASS' end as status, failures = n and blocker as is_blocker, failures from c",
    "contract_registry": "with c(artifact, check_name, failures) as (select 'orders', 'exists', 0 union all select 'orders', 'min_rows', greatest(1 - count(*), 0) from orders union all select 'orders', 'required_columns', 2 union all select 'orders', 'not_blank:o_orderpriority', count(*) filter (coalesce(trim(o_orderpriority), '') = '') from orders union all select 'orders', 'numeric:o_totalprice', 0 union all select 'orders', 'numeric:o_orderstatus', count(*) from orders union all select 'orders', 'unique:o_orderkey', count(*) - count(distinct o_orderkey) from orders union all select 'orders', 'unique:o_custkey', count(*) - count(distinct o_custkey) from orders union all select 'orders', 'allowed:o_orderstatus', count(*) filter (o_orderstatus not in ('F', 'O')) from orders union all select 'documents', 'exists', 0 union all select 'documents', 'min_rows', 1000000000 - count(*) from documents union all select 'documents', 'required_columns', 0 union all select 'documents', 'not_blank:text', count(*) filter (coalesce(trim(text), '') = '') from documents union all select 'documents', 'not_blank:absent', 1 union all select 'documents', 'unique:text', count(*) - count(distinct text) from documents union all select 'nowhere', 'exists', 1) select *, case when failures = 0 then 'PASS' else 'FAIL' end as status from c",
    "inventory_summary": "select regexp_extract(url, '([^/.]+)$', 1) as suffix, count(*) as n_files, sum(strlen(html)) as total_size from pages group by 1 union all select '(missing)', (select count(*) from documents), 0",
    "period_keys": "select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, year(o_orderdate) || 'Q' || quarter(o_orderdate) as quarter, case when o_orderkey % 10 <> 0 then cast(o_orderdate as date) end as day, case when o_orderkey % 10 = 0 then 2024 else year(o_orderdate) end as year, case when o_orderkey % 3 = 0 then 'FY' when o_orderstatus = 'F' then 'FY' end as fiscal from orders",
}
QUERIES = {f.__name__: f for f in (portfolio_returns, monthly_diagnostics, performance_metrics, ablation_portfolios, ablation_summary, best_ablation, role_report, primary_model, critical_verdicts, verdict_evidence, accounting_facts, fundamental_features, fundamental_deltas, quarter_tables, text_features, text_counts, price_table, price_checks, contract_registry, inventory_summary, period_keys)}
