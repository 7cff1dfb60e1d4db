"""What holds whatever the order and number of rows."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from tidemark import panels, stories
from tidemark.operators import folds, market, texts


def test_a_constant_side_has_no_correlation_however_rows_are_dealt(spark):
    n = next(k for k in range(2, 1000) if 0.1 / k * k != 0.1)  # a part of n rows comes back with another mean than its rows have
    df = spark.range(0, 5 * n, 1, 5).select((F.col("id") % 7).cast("double").alias("y"), F.lit(0.1).alias("p"))
    df = df.unionByName(spark.range(0, 3, 1, 1).select(F.col("id").cast("double").alias("y"), F.lit(0.1).alias("p")))
    assert df.agg(F.stddev_pop("p")).first()[0] > 0
    assert tuple(df.agg(market.correlation("y", "p"), market.correlation("p", "y")).first()) == (None, None)
    for truth, predicted, r2 in (("y", "p", True), ("p", "y", False)):
        row = market.fold_metrics(df.withColumn("g", F.lit("a")), ["g"], truth, predicted, full=True).first()
        assert row.pearson is None and row.spearman is None and (row.r2 is not None) == r2


def test_a_mean_on_a_limit_does_not_depend_on_the_order_of_lines(spark):
    df = spark.createDataFrame([(0.1,), (0.1,), (0.1,), (0.08,)], "l_discount double").coalesce(1)
    found = {df.sort(order).agg(F.expr(stories._MEASURES["b"])).first()[0] for order in (F.asc("l_discount"), F.desc("l_discount"))}
    assert found == {1.9}


def test_rows_counted_together_measure_like_rows(spark):
    rows = [(g, float(k % 5), float(k * k % 7) + 1e6, 1 + k % 3) for g in ("a", "b") for k in range(24)] + [("c", 1.0, 2.0, 9)]
    held = spark.createDataFrame(rows, "g string, y double, p double, n int")
    single = held.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("_", "n")
    by = lambda df: {r.g: r.asDict() for r in df.collect()}
    want, got = by(market.fold_metrics(single, ["g"], "y", "p", full=True)), by(market.fold_metrics(held, ["g"], "y", "p", full=True, weight="n"))
    assert got.keys() == want.keys() and got["c"]["pearson"] is None and got["c"]["r2"] is None
    assert all(got[g][c] == (v if v is None or isinstance(v, str) else pytest.approx(v, rel=1e-9)) for g in want for c, v in want[g].items())


def test_folds_write_a_row_for_rows_that_agree_and_no_seats(spark):
    rows = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=k % 1800), float(k % 2), 1.0) for k in range(3600)], "day date, a double, y double")
    windows = market.fold_windows(F.col("lo"), F.col("hi"), rows.agg(F.min("day").alias("lo"), F.max("day").alias("hi")))
    ready, seats = folds.alike(rows, "day", ["a"], "y", windows)
    assert set(ready.columns) == {"first_fold", "span", "y", "a", "n_alike"}
    counts = ready.agg(F.count("*"), F.sum("n_alike")).first()
    assert counts[0] < 200 and counts[1] > 3000
    every = rows.join(folds.fold_days(windows), "day").filter("seats is not null").select(F.explode("seats").alias("s")).groupBy("s.fold", "s.role").count()
    ours = ready.join(seats, "span").select("n_alike", F.explode("seats").alias("s")).groupBy("s.fold", "s.role").agg(F.sum("n_alike"))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, ours.collect()))


def test_tokens_of_texts_are_not_dealt_out_for_a_few_words(spark):
    words = texts.as_lexicon(spark, panels.TONES)
    assert sorted(map(tuple, words.collect())) == sorted((w, k) for k, ws in panels.TONES.items() for w in ws)
    assert texts.as_lexicon(spark, {}).collect() == [] and texts.as_lexicon(spark, {}).columns == ["word", "category"]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        panels.text_features(spark, "/root/testdata/sf0.001").explain("simple")
    assert "Exchange hashpartitioning(word" not in out.getvalue().split("BroadcastExchange")[0] and out.getvalue().count("BroadcastHashJoin [word") == 2


def test_folds_are_measured_without_a_row_for_each_window(spark, monkeypatch):
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=k % 1800) for k in range(4000)]
    rows = spark.createDataFrame([(d, None if k % 11 == 0 else float(k % 7), float(k % 3), float(k * 37 % 1009) + k % 7, k) for k, d in enumerate(days)], "day date, a double, b double, y double, k int")
    windows = market.fold_windows(F.col("lo"), F.col("hi"), rows.agg(F.min("day").alias("lo"), F.max("day").alias("hi")))
    n = windows.count()
    ready, seats = folds.alike(rows, "day", ["a", "b"], "y", windows)
    fitted, edges = folds.fit_folds(ready, ["a", "b"], "y", n, trees=3, weight="n_alike")
    by = lambda df: {(r.fold, r.model_name, r.role): r for r in df.collect()}
    seen = folds.predict_folds(folds.prepared(rows, ["k"], "day", ["a", "b"], "y", windows), ["k"], ["a", "b"], "y", fitted, edges)
    want = by(market.fold_metrics(seen, ["fold", "model_name", "role"], "y_true", "y_pred"))
    asked = []
    monkeypatch.setattr(folds, "predict_folds", lambda *a, f=folds.predict_folds: asked.append(1) or f(*a))
    for how, calls in (({"lines_a_range": 100}, False), ({}, False), ({"most_numbers": 0}, True)):
        got = by(folds.window_metrics(ready, seats, ["a", "b"], "y", fitted, edges, **how))
        assert got.keys() == want.keys() and len(want) > 60 and bool(asked) == calls
        assert all(got[k].n_rows == w.n_rows and [got[k][c] for c in ("rmse", "mae", "pearson", "spearman")] == pytest.approx([w[c] for c in ("rmse", "mae", "pearson", "spearman")], rel=1e-8) for k, w in want.items())
    asked.clear()
    folds.fold_report(rows, ["k"], "day", ["a", "b"], "y", windows, models=("ridge",))
    assert not asked


def test_a_rule_of_words_counts_like_its_table_and_deals_no_tokens(spark):
    df = spark.createDataFrame([(1, "Gain loss, gain\nand more"), (2, None), (3, ""), (3, "loss LOSS x")], "k int, t string")
    table = spark.createDataFrame([("GAIN", "positive"), ("LOSS", "negative")], "word string, category string")
    rule = lambda w: F.when(w == "GAIN", "positive").when(w == "LOSS", "negative")
    want, got = (texts.dictionary_counts(df, "t", x, ["k"]) for x in (table, rule))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        stories.mismatch_components(spark, "/root/testdata/sf0.001").explain("simple")
    assert "hashpartitioning(word" not in out.getvalue()


def test_only_orders_with_a_document_are_measured(spark):
    keys = spark.createDataFrame([(1,), (2,), (10**12,)], "o_orderkey long")
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, stories._changes(spark, d, keys).collect()))
    assert 0 < len(got) < 3 and got == sorted(map(tuple, stories._changes(spark, d).filter("o_orderkey in (1, 2)").collect()))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        stories.mismatch_components(spark, d).explain("simple")
    assert out.getvalue().count("LeftSemi") >= 2
