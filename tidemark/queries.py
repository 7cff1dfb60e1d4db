"""The registered queries of the library's point-in-time operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds, market, performance, tables

LEXICON = {"positive": ("WAS", "FOR", "AND"), "negative": ("NOT", "NO", "ON"), "uncertainty": ("THAT", "IT", "OR")}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _prices(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("security"), F.col("p_type").alias("sector"), F.to_date("l_shipdate").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


PRICES_SQL = "p as (select concat_ws(' ', p_brand, p_type) as security, p_type as sector, cast(l_shipdate as date) as date, avg(l_extendedprice / l_quantity) as price from lineitem join part on l_partkey = p_partkey group by all), pr as (select *, row_number() over (partition by security order by date) - 1 as day_index, price / lag(price) over (partition by security order by date) - 1 as daily_return from p)"


def forward_returns_asof(spark: SparkSession, d: str) -> DataFrame:
    prices = _prices(spark, d)
    asof = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.concat_ws(" ", "p_brand", "p_type").alias("security"), F.to_date("o_orderdate").alias("asof_date")).distinct()
    return _rounded(market.return_targets(asof, prices), "raw_return", "sector_return", "adjusted_return")


def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(market.price_returns(_prices(spark, d)), "price", "daily_return")


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return tables.keep_one(_t(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def first_seen_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return tables.mark_repeats(_t(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "is_duplicate")


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.sum("o_totalprice").alias("revenue"))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return tables.comparable_deltas(_quarters(spark, d), "o_custkey", F.concat(F.lit("Q"), "q"), [F.col("y")], ["revenue"])


def comparable_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_deltas(spark, d), "revenue", "revenue_prior", "revenue_abs", "revenue_pct", "revenue_log")


def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    out = tables.composites(_deltas(spark, d), {"decline": ("revenue_pct", -1), "shrink": ("revenue_log", -1)}, least=2)
    return out.withColumns({c: F.round(c, 4) for c in ("stress_score", "improvement_score", "net_stress")}).select("o_custkey", "y", "q", "valid_components", "stress_score", "improvement_score", "net_stress", "composite_flag")


def concept_pivot_ratios(spark: SparkSession, d: str) -> DataFrame:
    facts = _t(spark, d, "lineitem").withColumn("concept", F.concat("l_returnflag", "l_linestatus"))
    wide = tables.pivot_facts(facts, "l_orderkey", "concept", "l_extendedprice", ["AF", "NO", "RF"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return wide.withColumn("return_ratio", F.round(F.try_divide(F.col("RF"), F.col("AF")), 6))


def lexicon_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tables.lexicon_shares(_t(spark, d, "documents"), LEXICON), *[f"{k}_share" for k in LEXICON])


def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", tables.clean_html(F.col("html")).alias("clean_text"))


def semi_join_facts(spark: SparkSession, d: str) -> DataFrame:
    keys = _t(spark, d, "orders").filter("o_orderstatus = 'F'")
    return _t(spark, d, "lineitem").join(keys, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    windows = market.fold_windows(F.col("lo"), F.col("hi"), o.agg(F.min("d").alias("lo"), F.max("d").alias("hi")))
    return folds.fold_counts(o, "d", windows)


def fold_ic(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return _rounded(market.fold_metrics(rows, ["month"], "l_tax", "l_discount"), "rmse", "mae", "pearson", "spearman")


def fold_errors(spark: SparkSession, d: str) -> DataFrame:
    """The whole metric set of each month, with R squared and means."""
    rows = _t(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    found = market.fold_metrics(rows, ["month"], "l_tax", "l_discount", full=True).select("month", "n_rows", "mse", "r2", "mean_y_true", "mean_y_pred")
    return _rounded(found, "mse", "r2", "mean_y_true", "mean_y_pred")


_ERRORS_SQL = """
select strftime(l_shipdate, '%Y-%m') as month, count(*) as n_rows, round(avg((l_tax - l_discount) ** 2), 6) as mse,
  round(1 - avg((l_tax - l_discount) ** 2) / nullif(case when count(*) > 1 then var_pop(l_tax) end, 0), 6) as r2,
  round(avg(l_tax), 6) as mean_y_true, round(avg(l_discount), 6) as mean_y_pred
from lineitem group by 1
"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return rows.groupBy("month", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("score"), F.round(F.avg("l_discount") - 0.05, 6).alias("outcome"))


def decile_holdings(spark: SparkSession, d: str) -> DataFrame:
    held = market.holdings(_scores(spark, d), period="month", name="l_suppkey", score="score")
    return _rounded(held, "weight").select("month", "l_suppkey", "score", "weight")


def performance_summary(spark: SparkSession, d: str) -> DataFrame:
    held = market.holdings(_scores(spark, d), period="month", name="l_suppkey", score="score", outcome="outcome").withColumn("strategy", F.lit("discount"))
    out = market.performance(performance.period_returns(held, period="month", name="l_suppkey", outcome="outcome", group=["strategy"]), period="month", group=["strategy"])
    return _rounded(out, "cumulative", "mean_return", "volatility", "max_drawdown", "hit_rate", "profit_factor", "annualized", "sharpe")


def contract_validation(spark: SparkSession, d: str) -> DataFrame:
    a = tables.validate(_t(spark, d, "orders"), "orders", not_null=("o_orderkey", "o_custkey"), unique=(("o_orderkey",),), allowed={"o_orderstatus": ("F", "O", "P")})
    return a.unionByName(tables.validate(_t(spark, d, "lineitem"), "lineitem", not_null=("l_orderkey",), unique=(("l_orderkey", "l_linenumber"),), allowed={"l_returnflag": ("A", "N")}))


_SCORES = "s as (select strftime(l_shipdate, '%Y-%m') as month, l_suppkey, round(sum(l_extendedprice), 2) as score, round(avg(l_discount) - 0.05, 6) as outcome from lineitem group by all), r as (select *, count(*) over (partition by month) as n, row_number() over (partition by month order by score, l_suppkey) as r from s), h as (select * from (select month, l_suppkey, score, outcome, case when r > n - greatest(1, ceil(n * (1 - 0.9::double))) then 1 / greatest(1, ceil(n * (1 - 0.9::double))) when r <= greatest(1, ceil(n * 0.1::double)) then -1 / greatest(1, ceil(n * 0.1::double)) end as weight from r where n >= 10) where weight is not null)"
_RETURNS = _SCORES + ", k as (select *, dense_rank() over (order by month) as k from h), tv as (select k, sum(abs(w - o)) / 2 as turnover from (select coalesce(a.k, b.k + 1) as k, coalesce(a.weight, 0) as w, coalesce(b.weight, 0) as o from k a full join k b on a.k = b.k + 1 and a.l_suppkey = b.l_suppkey) group by 1), g as (select month, k, sum(weight * outcome) as gross_return, count(*) filter (weight > 0) as long_count, count(*) filter (weight < 0) as short_count from k group by all), ret as (select month, gross_return, long_count, short_count, turnover, turnover * 10.0::double / 10000 as cost, gross_return - turnover * 10.0::double / 10000 as net_return from g join tv using (k))"
_DELTAS = "b as (select o_custkey, year(o_orderdate) as y, quarter(o_orderdate) as q, sum(o_totalprice) as revenue from orders group by all), c as (select *, 'Q' || q as period_key, lag(revenue) over (partition by o_custkey, q order by y) as p from b), dl as (select o_custkey, y, q, period_key, revenue, p, round(revenue - p, 12) as a, round((revenue - p) / nullif(abs(p), 0), 12) as pc, round(sign(revenue) * ln(1 + abs(revenue)) - sign(p) * ln(1 + abs(p)), 12) as lg from c)"
_LEX = ", ".join(f"len(list_filter(w, lambda x: x in {vs})) as {k}_count, round(coalesce(len(list_filter(w, lambda x: x in {vs})) / nullif(len(w), 0), 0), 6) as {k}_share" for k, vs in LEXICON.items())

ORACLES = {
    "forward_returns_asof": f"with {PRICES_SQL}, q as (select distinct concat_ws(' ', p_brand, p_type) as security, cast(o_orderdate as date) as asof_date from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey), e as (select q.security, q.asof_date, pr.date as entry_date, pr.sector, pr.price as ep, pr.day_index as i from q asof left join pr on q.security = pr.security and q.asof_date <= pr.date), x as (select e.*, pr.date as exit_date, pr.price / e.ep - 1 as raw from e left join pr on e.security = pr.security and pr.day_index = e.i + 63), sp as (select distinct sector, entry_date, exit_date from x where exit_date is not null), m as (select sp.*, avg(b.price / a.price - 1) as sr, count(*) as n from sp join pr a on a.sector = sp.sector and a.date = sp.entry_date join pr b on b.security = a.security and b.date = sp.exit_date group by all) select security, asof_date, entry_date, exit_date, round(raw, 6) as raw_return, round(sr, 6) as sector_return, round(raw - sr, 6) as adjusted_return, case when raw is null then 'RED' when n < 2 then 'YELLOW' else 'GREEN' end as target_flag from x left join m using (sector, entry_date, exit_date)",
    "daily_returns": f"with {PRICES_SQL} select security, sector, date, round(price, 6) as price, round(daily_return, 6) as daily_return, day_index from pr",
    "latest_per_key": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "first_seen_duplicates": "select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) > 1 as is_duplicate from events",
    "comparable_deltas": f"with {_DELTAS} select o_custkey, y, q, period_key, round(revenue, 6) as revenue, round(p, 6) as revenue_prior, round(a, 6) as revenue_abs, round(pc, 6) as revenue_pct, round(lg, 6) as revenue_log, case when p is null then 'RED' else 'GREEN' end as link_flag from dl",
    "composite_scores": f"with {_DELTAS}, cl as (select o_custkey, y, q, case when pc is not null then least(greatest(-pc, -5), 5) end as u, case when lg is not null then least(greatest(-lg, -5), 5) end as v from dl), z as (select *, (u is not null)::int + (v is not null)::int as n from cl) select o_custkey, y, q, n as valid_components, round(case when n > 0 then (coalesce(greatest(u, 0), 0) * (u is not null)::int + coalesce(greatest(v, 0), 0) * (v is not null)::int) / n end, 4) as stress_score, round(case when n > 0 then (coalesce(greatest(-u, 0), 0) * (u is not null)::int + coalesce(greatest(-v, 0), 0) * (v is not null)::int) / n end, 4) as improvement_score, round(case when n > 0 then (coalesce(u, 0) + coalesce(v, 0)) / n end, 4) as net_stress, case when n = 0 then 'RED' when n < 2 then 'YELLOW' else 'GREEN' end as composite_flag from z",
    "concept_pivot_ratios": "with f as (select l_orderkey, l_returnflag || l_linestatus as c, l_extendedprice as v from lineitem where l_returnflag || l_linestatus in ('AF', 'NO', 'RF') qualify row_number() over (partition by l_orderkey, c order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) = 1), w as (select l_orderkey, max(v) filter (c = 'AF') as AF, max(v) filter (c = 'NO') as NO, max(v) filter (c = 'RF') as RF, count(*) as coverage from f group by 1) select *, round(RF / nullif(AF, 0), 6) as return_ratio from w",
    "lexicon_features": f"with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z]+') as w from documents) select doc_id, len(w) as n_tokens, {_LEX} from t",
    "semi_join_facts": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')",
    "fold_errors": _ERRORS_SQL,
    "fold_ic": "with a as (select strftime(l_shipdate, '%Y-%m') as month, l_tax as y, l_discount as p, rank() over (partition by strftime(l_shipdate, '%Y-%m') order by l_tax) + (count(*) over (partition by strftime(l_shipdate, '%Y-%m'), l_tax) - 1) / 2 as ry, rank() over (partition by strftime(l_shipdate, '%Y-%m') order by l_discount) + (count(*) over (partition by strftime(l_shipdate, '%Y-%m'), l_discount) - 1) / 2 as rp from lineitem) select month, count(*) as n_rows, round(sqrt(avg((y - p) ** 2)), 6) as rmse, round(avg(abs(y - p)), 6) as mae, round(covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0), 6) as pearson, round(covar_pop(ry, rp) / nullif(stddev_pop(ry) * stddev_pop(rp), 0), 6) as spearman from a group by month",
    "decile_holdings": f"with {_SCORES} select month, l_suppkey, score, round(weight, 6) as weight from h",
    "performance_summary": f"with {_RETURNS}, ix as (select *, exp(sum(ln(1 + net_return)) over (order by month)) as i from ret), dd as (select *, i / max(i) over (order by month) - 1 as dd from ix), z as (select 'discount' as strategy, count(*) as periods, exp(sum(ln(1 + net_return))) - 1 as cumulative, avg(net_return) as mean_return, stddev_samp(net_return) as volatility, min(dd) as max_drawdown, avg((net_return > 0)::double) as hit_rate, sum(net_return) filter (net_return > 0) / nullif(-sum(net_return) filter (net_return < 0), 0) as profit_factor from dd) select strategy, periods, round(cumulative, 6) as cumulative, round(mean_return, 6) as mean_return, round(volatility, 6) as volatility, round(max_drawdown, 6) as max_drawdown, round(hit_rate, 6) as hit_rate, round(profit_factor, 6) as profit_factor, round((1 + cumulative) ** (12.0 / periods) - 1, 6) as annualized, round(mean_return / nullif(volatility, 0) * sqrt(12), 6) as sharpe from z",
    "contract_validation": "with c(artifact, check_name, failures) as (select 'orders', 'min_rows', greatest(1 - count(*), 0) from orders union all select 'orders', 'not_null:o_orderkey', count(*) filter (o_orderkey is null) from orders union all select 'orders', 'not_null:o_custkey', count(*) filter (o_custkey is null) from orders union all select 'orders', 'unique:o_orderkey', count(*) - count(distinct o_orderkey) from orders union all select 'orders', 'allowed:o_orderstatus', count(*) filter (o_orderstatus not in ('F', 'O', 'P')) from orders union all select 'lineitem', 'min_rows', greatest(1 - count(*), 0) from lineitem union all select 'lineitem', 'not_null:l_orderkey', count(*) filter (l_orderkey is null) from lineitem union all select 'lineitem', 'unique:l_orderkey+l_linenumber', count(*) - count(distinct (l_orderkey, l_linenumber)) from lineitem union all select 'lineitem', 'allowed:l_returnflag', count(*) filter (l_returnflag not in ('A', 'N')) from lineitem) select *, case when failures = 0 then 'PASS' else 'FAIL' end as status from c",
}
QUERIES = {f.__name__: f for f in (forward_returns_asof, daily_returns, latest_per_key, first_seen_duplicates, comparable_deltas, composite_scores, concept_pivot_ratios, lexicon_features, html_clean, semi_join_facts, walk_forward_folds, fold_ic, fold_errors, decile_holdings, performance_summary, contract_validation)}
