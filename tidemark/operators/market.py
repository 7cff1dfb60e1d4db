"""Operators on prices and predictions: returns, as-of entries, forward targets, folds, information coefficients, portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut


def price_returns(prices: DataFrame, security: str = "security") -> DataFrame:
    """prices (security, date, price, ...) with daily_return and a trading-day index from 0."""
    w = Window.partitionBy(security).orderBy("date")
    return prices.select("*", (F.try_divide(F.col("price"), F.lag("price").over(w)) - 1).alias("daily_return"), (F.row_number().over(w) - 1).alias("day_index"))


def entry_dates(asof: DataFrame, prices: DataFrame, security: str = "security") -> DataFrame:
    """asof (security, asof_date, ...) with entry_date, the first priced day on or after the as-of date; null dates and securities have none.

    Both tables are ordered together by month of a security, as-of rows before prices of their day, so a security with all rows runs in many
    tasks. Where the month has no later price, the first price of later months is carried back: one row for each security and month.
    """
    rest = [c for c in asof.columns if c not in (security, "asof_date")]
    month = lambda c: F.trunc(c, "month").alias("_month")
    asked = asof.select(security, F.col("asof_date").alias("date"), month("asof_date"), F.lit(0).alias("_kind"), F.struct(*rest, F.lit(1).alias("_")).alias("_row"))
    both = asked.unionByName(prices.select(security, "date", month("date"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    w = Window.partitionBy(security, "_month").orderBy("date", "_kind").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_own", F.first(F.when(F.col("_kind") == 1, F.col("date")), ignorenulls=True).over(w)).filter("_kind = 0")
    months = both.groupBy(security, "_month").agg(F.min(F.when(F.col("_kind") == 1, F.col("date"))).alias("_first"))
    later = F.min("_first").over(Window.partitionBy(security).orderBy("_month").rowsBetween(1, Window.unboundedFollowing))
    carried = months.filter(F.col("_month").isNotNull()).select(security, "_month", later.alias("_later"))
    entry = F.when(F.col("date").isNotNull() & F.col(security).isNotNull(), F.coalesce("_own", "_later"))
    return found.join(carried, [security, "_month"], "left").select(security, F.col("date").alias("asof_date"), *[F.col(f"_row.{c}").alias(c) for c in rest], entry.alias("entry_date"))


def return_targets(asof: DataFrame, prices: DataFrame, *, horizon: int = 63, min_members: int = 2) -> DataFrame:
    """Forward raw, sector and sector-adjusted returns from the entry date to the horizon-th trading day after it.

    Prices are read five times, so they are written once.
    """
    priced = cut(price_returns(prices).select("security", "sector", "date", "price", "day_index"))
    entered = entry_dates(asof, priced).join(priced.select("security", "sector", F.col("date").alias("entry_date"), F.col("price").alias("entry_price"), F.col("day_index").alias("entry_index")), ["security", "entry_date"], "left")
    exits = priced.select("security", F.col("date").alias("exit_date"), F.col("price").alias("exit_price"), (F.col("day_index") - horizon).alias("entry_index"))
    held = entered.join(exits, ["security", "entry_index"], "left")
    spans = held.filter("exit_date is not null").select("sector", "entry_date", "exit_date").distinct()
    own = lambda name: priced.select("sector", "security", F.col("date").alias(f"{name}_date"), F.col("price").alias(f"{name}_p"))
    peers = spans.join(own("entry"), ["sector", "entry_date"]).join(own("exit"), ["sector", "exit_date", "security"])
    sector = peers.groupBy("sector", "entry_date", "exit_date").agg(F.avg(F.col("exit_p") / F.col("entry_p") - 1).alias("sector_return"), F.count("*").alias("members"))
    out = held.join(sector, ["sector", "entry_date", "exit_date"], "left").withColumn("raw_return", F.col("exit_price") / F.col("entry_price") - 1)
    flag = F.when(F.col("raw_return").isNull(), "RED").when(F.col("members") < min_members, "YELLOW").otherwise("GREEN")
    return out.select(*asof.columns, "entry_date", "exit_date", "raw_return", "sector_return", (F.col("raw_return") - F.col("sector_return")).alias("adjusted_return"), flag.alias("target_flag"))


def fold_windows(first: Column, last: Column, bounds: DataFrame, *, train: int = 24, validation: int = 12, test: int = 1, step: int = 1, embargo: int = 63) -> DataFrame:
    """Accepted walk-forward windows from a one-row table of the first and last date; numbered in order."""
    start = F.add_months(F.trunc(first, "month"), train + validation)
    steps = bounds.select(first.alias("lo"), last.alias("hi"), F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.months_between(last, start) / step).cast("int"), F.lit(-1)) + 1)).alias("k"), start.alias("s0"))
    w = steps.select("lo", "hi", "k", F.add_months("s0", F.col("k") * step).alias("test_start"))
    w = w.select("*", F.date_sub(F.add_months("test_start", test), 1).alias("test_end"), F.date_sub("test_start", embargo + 1).alias("validation_end"))
    w = w.withColumn("validation_start", F.date_add(F.add_months("validation_end", -validation), 1))
    w = w.withColumn("train_end", F.date_sub("validation_start", embargo + 1)).filter((F.col("train_end") >= F.date_sub(F.add_months("lo", train), 1)) & (F.col("test_start") <= F.col("hi")))
    n = F.row_number().over(Window.orderBy("test_start"))  # a few hundred windows
    return w.select(F.concat(F.format_string("WF%04d_", n), F.date_format("test_start", "yyyyMM")).alias("fold_id"), F.col("lo").alias("train_start"), "train_end", "validation_start", "validation_end", "test_start", "test_end")


def assign_folds(df: DataFrame, date: str, windows: DataFrame) -> DataFrame:
    """Each row once for each fold and role whose window holds its date: an equal join with the days of the windows."""
    roles = ("train", "validation", "test")
    spans = F.array(*[F.struct(F.lit(r).alias("role"), F.sequence(f"{r}_start", f"{r}_end").alias("days")) for r in roles])
    seats = windows.select("*", F.explode(spans).alias("_x")).select(*windows.columns, F.col("_x.role").alias("role"), F.explode("_x.days").alias("_day"))
    return df.join(seats, F.col(date) == F.col("_day")).select(*[df[c] for c in df.columns], *windows.columns, "role")


def varied(x: str) -> Column:
    """An aggregate: whether a column has two values. Deviations don't tell, as partial means of equal values may differ in their last bit."""
    return F.min(x) < F.max(x)


def correlation(x: str, y: str) -> Column:
    """Null where a side is constant."""
    return F.when(varied(x) & varied(y), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def average_ranks(df: DataFrame, group: str, columns: list[str], weight: str | None = None) -> DataFrame:
    """(group, _which, _value, _rank): the average rank of every distinct value of each column within its group, counted from 1.

    A row stands for as many as weight says. Values are counted first, so ties are one row. The counts are cut into ranges of (group, column, value) of near equal size and ranks are the rows of lower
    ranges plus those before in the own range: no task holds a group that is larger than a range.
    """
    each = F.array(*[F.struct(F.lit(k).alias("_which"), F.col(c).alias("_value")) for k, c in enumerate(columns)])
    w = F.col(weight) if weight else F.lit(1)
    counts = df.select(group, w.alias("_w"), F.explode(each).alias("_x")).select(group, "_w", "_x.*").groupBy(group, "_which", "_value").agg(F.sum("_w").alias("_n"))
    by = [group, "_which"]
    ranged = cut(counts.repartitionByRange(*by, "_value").withColumn("_range", F.spark_partition_id()))  # written, as ranges are drawn anew by every run
    total = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = total.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(starts, [*by, "_range"])
    return placed.select(*by, "_value", (F.col("_before") + F.col("_inside") + (F.col("_n") + 1) / 2).alias("_rank"))


def fold_metrics(df: DataFrame, group: list[str], truth: str, predicted: str, *, full: bool = False, weight: str | None = None) -> DataFrame:
    """Count, errors, Pearson and Spearman correlations (average ranks) for each group; rows with a null are left out.

    full: also mse, r2 (null under two rows or for a constant truth) and the means. weight: how many rows a row stands for; groups must then be
    few, as their means go to all tasks.
    """
    rows = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).select(F.struct(*group).alias("_g"), (F.col(weight) if weight else F.lit(1)).alias("_w"), F.col(truth).cast("double").alias("_t"), F.col(predicted).cast("double").alias("_p"))
    ranks = average_ranks(rows, "_g", ["_t", "_p"], "_w")
    of = lambda k, c: ranks.filter(F.col("_which") == k).select("_g", F.col("_value").alias(c), F.col("_rank").alias(f"_r{c}"))
    ranked = rows.join(of(0, "_t"), ["_g", "_t"]).join(of(1, "_p"), ["_g", "_p"])
    t, p = F.col("_t"), F.col("_p")
    if weight:
        return _weighted_metrics(ranked, group, full)
    mse = F.avg(F.pow(t - p, 2))
    more = [mse.alias("mse"), (1 - F.try_divide(mse, F.when(varied("_t"), F.var_pop(t)))).alias("r2"), F.avg(t).alias("mean_y_true"), F.avg(p).alias("mean_y_pred")] if full else []
    found = ranked.groupBy("_g").agg(F.count("*").alias("n_rows"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(t - p)).alias("mae"), correlation("_t", "_p").alias("pearson"), correlation("_r_t", "_r_p").alias("spearman"), *more)
    return found.select("_g.*", *found.columns[1:])


def _weighted_metrics(ranked: DataFrame, group: list[str], full: bool) -> DataFrame:
    """``fold_metrics`` of rows that stand for _w rows each. Deviations are taken from the means; the mean of n average ranks is (n + 1) / 2."""
    w, t, p = F.col("_w"), F.col("_t"), F.col("_p")
    means = ranked.groupBy("_g").agg(F.sum(w).alias("_n"), (F.sum(w * t) / F.sum(w)).alias("_mt"), (F.sum(w * p) / F.sum(w)).alias("_mp"))
    middle = (F.col("_n") + 1) / 2
    off = ranked.join(F.broadcast(means), "_g").withColumns({"_dt": t - F.col("_mt"), "_dp": p - F.col("_mp"), "_drt": F.col("_r_t") - middle, "_drp": F.col("_r_p") - middle})
    both = lambda x, y: F.sum(w * F.col(x) * F.col(y))
    r = lambda x, y: F.when(varied("_t") & varied("_p"), F.try_divide(both(x, y), F.sqrt(both(x, x)) * F.sqrt(both(y, y))))
    n = F.sum(w)
    mse = F.sum(w * F.pow(t - p, 2)) / n
    more = [mse.alias("mse"), (1 - F.try_divide(mse, F.when(varied("_t"), both("_dt", "_dt") / n))).alias("r2"), F.max("_mt").alias("mean_y_true"), F.max("_mp").alias("mean_y_pred")] if full else []
    found = off.groupBy("_g").agg(n.alias("n_rows"), F.sqrt(mse).alias("rmse"), (F.sum(w * F.abs(t - p)) / n).alias("mae"), r("_dt", "_dp").alias("pearson"), r("_drt", "_drp").alias("spearman"), *more)
    return found.select("_g.*", *found.columns[1:])


def holdings(df: DataFrame, *, period: str, name: str, score: str, group: list[str] = (), outcome: str | None = None, long_q: float = 0.9, short_q: float = 0.1, min_names: int = 10) -> DataFrame:
    """Top and bottom share of names of each period with weights +1/k and -1/k; periods under min_names have none; long wins overlaps.

    Rows without a score, or without an outcome if one is named, leave before names are ranked.
    """
    by = [*group, period]
    n = F.count("*").over(Window.partitionBy(*by))
    known = df.filter(F.col(score).isNotNull() & (F.col(outcome).isNotNull() if outcome else F.lit(True)))
    ranked = known.withColumns({"_n": n, "_r": F.row_number().over(Window.partitionBy(*by).orderBy(score, name))}).filter(F.col("_n") >= min_names)
    k_long, k_short = F.greatest(F.lit(1), F.ceil(F.col("_n") * (1 - F.lit(long_q)))), F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(short_q)))
    weight = F.when(F.col("_r") > F.col("_n") - k_long, 1 / k_long).when(F.col("_r") <= k_short, -1 / k_short)
    return ranked.withColumn("weight", weight).filter("weight is not null").drop("_n", "_r")


def performance(returns: DataFrame, *, period: str, net: str = "net_return", group: list[str] = (), per_year: int = 12) -> DataFrame:
    """One row for each group: cumulative and annual return, volatility, Sharpe, worst drawdown, hit rate, profit factor."""
    w = Window.partitionBy(*group).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    returns = returns.withColumn(net, F.col(net).cast("double"))
    grown = returns.withColumn("_index", F.product(1 + F.col(net)).over(w))
    grown = grown.withColumn("_drawdown", F.col("_index") / F.max("_index").over(w) - 1)
    c = F.col(net)
    out = grown.groupBy(*group).agg(F.count("*").alias("periods"), (F.product(1 + c) - 1).alias("cumulative"), F.avg(c).alias("mean_return"), F.stddev_samp(c).alias("volatility"), F.min("_drawdown").alias("max_drawdown"), F.avg((c > 0).cast("double")).alias("hit_rate"), F.try_divide(F.sum(F.when(c > 0, c)), -F.sum(F.when(c < 0, c))).alias("profit_factor"))
    annual = F.when(F.col("cumulative") <= -1, -1.0).otherwise(F.pow(1 + F.col("cumulative"), F.lit(float(per_year)) / F.col("periods")) - 1)
    return out.select("*", annual.alias("annualized"), (F.try_divide(F.col("mean_return"), F.col("volatility")) * per_year**0.5).alias("sharpe"))
