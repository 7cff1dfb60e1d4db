"""Registered queries of models, verdicts, governance and filing dates over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import filings, governance, market, models, tables
from tidemark.queries import LEXICON, _rounded, _t


def execution_dates(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    days = filings.calendar(e.agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi")))
    return filings.execution_dates(e.select("event_id", "ts"), F.col("ts"), days).select("event_id", "accepted_date", "execution_date")


def sensitive_scan(spark: SparkSession, d: str) -> DataFrame:
    found = governance.sensitive_scan(_t(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", F.array_join("found", ",").alias("found"), "status")


def lineage_impact(spark: SparkSession, d: str) -> DataFrame:
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    pairs = (("region", "nation", "nation", "n_regionkey", "n_nationkey"), ("nation", "customer", "customer", "c_nationkey", "c_custkey"), ("customer", "order", "orders", "o_custkey", "o_orderkey"))
    edges = [_t(spark, d, t).select(node(a, x).alias("source"), node(b, y).alias("target")) for a, b, t, x, y in pairs]
    reach = governance.downstream(edges[0].unionByName(edges[1]).unionByName(edges[2]), _t(spark, d, "region").select(node("region", "r_regionkey").alias("node")))
    return reach.withColumn("node_id", governance.node_id(F.lit("artifact"), F.col("reached")))


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    e = tables.keep_one(_t(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    status = F.when(F.col("value") < 5, "FAIL").when(F.col("value") < 20, "WARN").otherwise("PASS")
    return governance.release_gate(e.select(F.col("user_id").alias("run_id"), status.alias("status"), (F.col("event_type") != "click").alias("critical")))


def stage_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(governance.diagnostics(_t(spark, d, "orders"), keys=("o_custkey",), means=("o_totalprice",), flags={"o_orderstatus": ("F", "O", "P")}), "value")


def dataset_features(spark: SparkSession, d: str) -> DataFrame:
    return models.feature_counts(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag"])


def model_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.concat(F.lit("m"), "l_linenumber").alias("model_name"), F.when(F.col("l_linestatus") == "O", "validation").otherwise("test").alias("role"), F.year("l_shipdate").alias("fold_id"), "l_tax", "l_discount")
    return models.select_models(market.fold_metrics(rows, ["model_name", "role", "fold_id"], "l_tax", "l_discount"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    net = _t(spark, d, "lineitem").groupBy(F.concat(F.lit("m"), "l_linenumber").alias("strategy"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("l_discount") - 0.05, 6).alias("net_return"))
    found = market.performance(net, period="month", group=["strategy"])
    c = F.col
    return models.verdicts(found, "strategy", {"minimum_oos_periods": c("periods") >= 12, "positive_cumulative_net_return": c("cumulative") > 0, "minimum_net_sharpe": c("sharpe") >= 0, "max_drawdown_control": c("max_drawdown") >= -0.02})


def mismatch_scores(spark: SparkSession, d: str) -> DataFrame:
    text = tables.lexicon_shares(_t(spark, d, "documents"), LEXICON).withColumns({f"full_lm_{k}_share": F.col(f"{k}_share") for k in LEXICON})
    joined = models.text_proxies(text, ("full",)).join(_t(spark, d, "labels"), "doc_id")
    down = {"toxic_x_positive_tone": ("toxic", "full_lm_positive_share"), "toxic_x_low_negative_tone": ("toxic", "full_low_negative_proxy")}
    up = {"quality_x_negative_tone": ("quality", "full_lm_negative_share"), "quality_x_uncertainty": ("quality", "full_lm_uncertainty_share")}
    out = models.mismatch(joined, down, up, ["doc_id"])
    return _rounded(out.select("doc_id", "downside_mismatch_score", "upside_mismatch_score", "net_mismatch_score"), "downside_mismatch_score", "upside_mismatch_score", "net_mismatch_score")


def ablation_ics(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    each = models.ablation_scores(rows, ["month", "l_tax"], {"dfm_score": F.col("l_discount"), "fundamentals_only": -F.col("l_quantity"), "naive_baseline": F.lit(0.0)})
    folds = market.fold_metrics(each, ["ablation_name", "month"], "l_tax", "y_pred")
    out = folds.groupBy("ablation_name").agg(F.count("*").alias("folds"), F.avg("spearman").alias("mean_ic"), F.median("spearman").alias("median_ic"), F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"))
    return _rounded(out, "mean_ic", "median_ic", "mean_mae", "mean_rmse")


_NEXT = "{0} + case isodow({0}) when 5 then 3 when 6 then 2 else 1 end"
_FM = "rank() over (partition by {g} order by {y}) + (count(*) over (partition by {g}, {y}) - 1) / 2"


def _metrics_sql(source: str, g: str, y: str, p: str) -> str:
    ranks = f"select *, {_FM.format(g=g, y=y)} as ry, {_FM.format(g=g, y=p)} as rp from {source}"
    corr = "case when stddev_pop(ry) > 0 and stddev_pop(rp) > 0 then covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)) end"
    return f"select {g}, sqrt(avg(({y} - {p}) * ({y} - {p}))) as rmse, avg(abs({y} - {p})) as mae, {corr} as spearman from ({ranks}) group by {g}"


_HTML = "coalesce(html, '')"
for _name in ("script", "style", "head", "table"):
    _HTML = f"regexp_replace({_HTML}, '<{_name}[^>]*>.*?</{_name}>', ' ', 'gis')"
_HTML = f"regexp_replace({_HTML}, '<[^>]*>', ' ', 'gs')"
for _entity, _text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_text}')"

ORACLES = {
    "html_clean": rf"select page_id, trim(regexp_replace({_HTML}, '[ \t\r\n]+', ' ', 'g')) as clean_text from pages",
    "walk_forward_folds": "with o as (select cast(o_orderdate as date) as d from orders), b as (select min(d) as lo, max(d) as hi from o), k as (select lo, hi, cast(date_trunc('month', lo) + to_months(36 + k) as date) as ts from b, range(0, 600) as t(k)), w1 as (select *, cast(ts + interval 1 month as date) - 1 as te, ts - 64 as ve from k where ts <= hi), w2 as (select *, cast(ve - interval 12 month as date) + 1 as vs from w1), w3 as (select *, vs - 64 as tre from w2), w as (select *, row_number() over (order by ts) as n from w3 where tre >= cast(lo + interval 24 month as date) - 1), f as (select printf('WF%04d_', n) || strftime(ts, '%Y%m') as fold_id, case when d between lo and tre then 'train' when d between vs and ve then 'validation' when d between ts and te then 'test' end as role, d from w, o) select fold_id, role, count(*) as n_rows, min(d) as first_date, max(d) as last_date from f where role is not null group by all",
    "execution_dates": f"with e as (select event_id, cast(ts as date) as a, hour(ts) >= 16 as late from events), n as (select *, {_NEXT.format('a')} as x from e) select event_id, a as accepted_date, case when late then {_NEXT.format('x')} else x end as execution_date from n",
    "sensitive_scan": f"with f as (select doc_id, list_filter({list(governance.SENSITIVE)}, lambda p: contains(lower(coalesce(text, '')), p)) as x from documents) select doc_id, array_to_string(x, ',') as found, case when len(x) > 0 then 'FAIL' else 'PASS' end as status from f",
    "lineage_impact": "with recursive e as (select 'region:' || n_regionkey as s, 'nation:' || n_nationkey as t from nation union select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer union select 'customer:' || o_custkey, 'order:' || o_orderkey from orders), r as (select 'region:' || r_regionkey as node, t as reached from region join e on s = 'region:' || r_regionkey union select node, t from r join e on s = reached) select node, reached, left(sha1('artifact:' || reached), 16) as node_id from r",
    "release_gate": "with l as (select * from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1), s as (select user_id as run_id, event_type <> 'click' as critical, case when value < 5 then 'FAIL' when value < 20 then 'WARN' else 'PASS' end as status from l), g as (select run_id, count(*) as checks, count(*) filter (status = 'PASS') as passed, count(*) filter (status = 'WARN') as warnings, count(*) filter (critical and status = 'FAIL') as critical_failures from s group by 1) select *, case when critical_failures > 0 then 'BLOCKED' when warnings > 0 then 'PASS_WITH_WARNINGS' else 'PASS' end as gate_status from g",
    "stage_diagnostics": "select 'rows' as diagnostic, cast(count(*) as double) as value from orders union all select 'distinct_o_custkey', count(distinct o_custkey) from orders union all select 'mean_o_totalprice', round(avg(o_totalprice), 6) from orders union all select 'o_orderstatus_' || s, (select count(*) from orders where o_orderstatus = s) from (values ('F'), ('O'), ('P')) t(s)",
    "dataset_features": " union all ".join(f"select '{c}' as feature, count(try_cast({c} as double)) as n_numeric from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag")),
    "model_selection": f"with s as (select 'm' || l_linenumber as model_name, case when l_linestatus = 'O' then 'validation' else 'test' end as role, year(l_shipdate) as fold_id, l_tax, l_discount from lineitem), m as ({_metrics_sql('s', 'model_name, role, fold_id', 'l_tax', 'l_discount')}), w as (select model_name, " + ", ".join(f"round(avg(spearman) filter (role = '{r}'), 9) as {r}_mean_spearman_ic, round(avg(mae) filter (role = '{r}'), 9) as {r}_mean_mae, round(avg(rmse) filter (role = '{r}'), 9) as {r}_mean_rmse, count(distinct fold_id) filter (role = '{r}') as {r}_folds_success" for r in ("validation", "test")) + " from m group by 1), k as (select *, rank() over (order by validation_mean_spearman_ic desc nulls last) as rank_validation_ic, rank() over (order by validation_mean_mae nulls last) as rank_validation_mae, rank() over (order by validation_mean_rmse nulls last) as rank_validation_rmse from w), z as (select *, rank_validation_ic * 10.0 + rank_validation_mae * 2.0 + rank_validation_rmse + case when validation_folds_success >= 1 then 0.0 else 1000000.0 end as sc from k) select * exclude (sc), cast(sc as double) as model_selection_score, row_number() over (order by sc, rank_validation_ic, rank_validation_mae, rank_validation_rmse, model_name) as model_selection_rank, row_number() over (order by sc, rank_validation_ic, rank_validation_mae, rank_validation_rmse, model_name) = 1 as is_primary_model from z",
    "verdicts": "with n as (select 'm' || l_linenumber as strategy, strftime(l_shipdate, '%Y-%m') as month, round(avg(l_discount) - 0.05, 6) as r from lineitem group by all), i as (select *, exp(sum(ln(1 + r)) over (partition by strategy order by month)) as ix from n), dd as (select *, ix / max(ix) over (partition by strategy order by month) - 1 as x from i), p as (select strategy, count(*) >= 12 as a, exp(sum(ln(1 + r))) - 1 > 0 as b, coalesce(avg(r) / nullif(stddev_samp(r), 0) >= 0, false) as c, min(x) >= -0.02 as e from dd group by 1) select strategy, a::int + b::int + c::int + e::int as passed_criteria, 4 as total_criteria, concat_ws(';', case when not a then 'minimum_oos_periods' end, case when not b then 'positive_cumulative_net_return' end, case when not c then 'minimum_net_sharpe' end, case when not e then 'max_drawdown_control' end) as failed, case when a and b and c and e then 'PASS' else 'FAIL' end as final_verdict from p",
    "mismatch_scores": "with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z]+') as w from documents), s as (select doc_id, " + ", ".join(f"coalesce(len(list_filter(w, lambda x: x in {v})) / nullif(len(w), 0), 0) as {k}" for k, v in LEXICON.items()) + " from t), p as (select doc_id, (toxic * positive + toxic / (1 + negative)) / 2 as dn, (quality * negative + quality * uncertainty) / 2 as up from s join labels using (doc_id)) select doc_id, round(dn, 6) as downside_mismatch_score, round(up, 6) as upside_mismatch_score, round(up - dn, 6) as net_mismatch_score from p",
    "ablation_ics": f"with a as (select strftime(l_shipdate, '%Y-%m') as month, l_tax, unnest([{{'n': 'dfm_score', 'p': l_discount}}, {{'n': 'fundamentals_only', 'p': -l_quantity}}, {{'n': 'naive_baseline', 'p': 0.0}}]) as u from lineitem), s as (select month, l_tax, u.n as ablation_name, cast(u.p as double) as y_pred from a), m as ({_metrics_sql('s', 'ablation_name, month', 'l_tax', 'y_pred')}) select ablation_name, count(*) as folds, round(avg(spearman), 6) as mean_ic, round(median(spearman), 6) as median_ic, round(avg(mae), 6) as mean_mae, round(avg(rmse), 6) as mean_rmse from m group by 1",
}
QUERIES = {f.__name__: f for f in (execution_dates, sensitive_scan, lineage_impact, release_gate, stage_diagnostics, dataset_features, model_selection, verdicts, mismatch_scores, ablation_ics)}
