"""Walk-forward models of all folds at once against plain versions; distributed ranks and as-of entries against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, market

KEYS, FEATURES = ["k"], ["a", "b", "c"]
SCHEMA = "k int, day date, y double, a double, b double, c double"


def _sample(n=1500, seed=5):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.lognormal(sigma=3, size=n), rng.integers(0, 5, n).astype(float)
    y = 2 * a + np.log(b) * (c > 2) + rng.normal(size=n)
    c[rng.random(n) < 0.2] = np.nan
    y[rng.random(n) < 0.05] = np.nan
    day = np.array([dt.date(2020, 1, 1) + dt.timedelta(int(d)) for d in rng.integers(0, 420, n)])
    return pd.DataFrame({"k": range(n), "day": day, "y": y, "a": a, "b": b, "c": c})


def _windows(spark, rows, **more):
    bounds = rows.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return market.fold_windows(F.col("lo"), F.col("hi"), bounds, **{"train": 4, "validation": 2, "embargo": 5} | more)


def _spark_rows(spark, t):
    return spark.createDataFrame([tuple(None if x != x else x for x in r) for r in t.itertuples(index=False)], SCHEMA)


@pytest.fixture(scope="module")
def made(spark):
    t = _sample()
    rows = _spark_rows(spark, t)
    w = _windows(spark, rows)
    return t, rows, w, w.orderBy("test_start").toPandas()


def test_windows_meet_rows_by_day(spark, made):
    t, rows, w, plain = made
    got = {(r.fold_id, r.role): (r.n_rows, r.first_date, r.last_date) for r in folds.fold_counts(rows, "day", w).collect()}
    dealt = {(r.fold_id, r.role): r.n for r in market.assign_folds(rows, "day", w).groupBy("fold_id", "role").agg(F.count("*").alias("n")).collect()}
    want = {}
    for r in plain.itertuples():
        for role in ("train", "validation", "test"):
            own = t[(t.day >= getattr(r, f"{role}_start")) & (t.day <= getattr(r, f"{role}_end"))]
            if len(own):
                want[r.fold_id, role] = (len(own), own.day.min(), own.day.max())
    assert len(plain) > 3 and got == want and dealt == {k: v[0] for k, v in want.items()}


def test_medians_of_expanding_windows_are_exact(spark, made):
    t, rows, w, plain = made
    first = rows.join(folds.fold_days(w), "day")
    for width in (1024, 50):
        got = folds.expanding_medians(first, [*FEATURES, "y"], len(plain), width=width)
        want = np.array([t[(t.day >= r.train_start) & (t.day <= r.train_end)][[*FEATURES, "y"]].median().to_numpy() for r in plain.itertuples()])
        assert np.array_equal(got, want)
    empty = folds.expanding_medians(first.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(1.7e308) * F.when(F.col("k") % 2 == 0, 1).otherwise(-1)), ["a", "b"], len(plain))
    assert np.isnan(empty[:, 0]).all() and set(np.abs(empty[:, 1])) <= {0.0, 1.7e308}


def _plain_boost(x, y, *, trees, rate, depth, leaf):
    """Least-squares boosting on rows, a node at a time."""
    value, grown = np.full(len(y), y.mean()), []
    for _ in range(trees):
        rest = y - value

        def grow(own, level):
            best = (-np.inf, None, None)
            if level:
                for j in range(x.shape[1]):
                    for b in np.unique(x[own, j]):
                        left = own[x[own, j] <= b]
                        right = own[x[own, j] > b]
                        if len(left) >= leaf and len(right) >= leaf:
                            gain = rest[left].sum() ** 2 / len(left) + rest[right].sum() ** 2 / len(right)
                            if gain > best[0] * (1 + 1e-12) if best[1] is not None else True:
                                best = (gain, j, b)
            if best[1] is None:
                return rate * rest[own].mean()
            _, j, b = best
            return j, b, grow(own[x[own, j] <= b], level - 1), grow(own[x[own, j] > b], level - 1)

        def ask(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        tree = grow(np.arange(len(y)), depth)
        value = value + np.array([ask(tree, r) for r in x])
        grown.append((tree, ask))
    start = y.mean()
    return lambda rows: start + sum(np.array([ask(tree, r) for r in rows]) for tree, ask in grown)


@pytest.mark.parametrize("most_cells", [100_000, 0])
def test_boosting_equals_a_plain_version_on_the_same_bins(spark, made, most_cells):
    t, rows, w, plain = made
    ready = folds.prepared(rows, KEYS, "day", FEATURES, "y", w)
    params = {"trees": 5, "rate": 0.3, "depth": 2, "leaf": 5}
    fitted, edges = folds.fit_folds(ready, FEATURES, "y", len(plain), models=("gradient_boosting",), bins=16, most_cells=most_cells, **params)
    seen = folds.predict_folds(ready, KEYS, FEATURES, "y", fitted, edges).toPandas()
    assert set(seen.role) == {"validation", "test"} and len(edges[0]) == 15
    for f, r in enumerate(plain.itertuples()):
        train = t[(t.day >= r.train_start) & (t.day <= r.train_end)]
        medians = train[train.y.notna()][FEATURES].median()
        train = train[train.y.notna()].fillna(medians)
        predict = _plain_boost(folds.coded(train[FEATURES].to_numpy(), edges).astype(int), train.y.to_numpy(), **params)
        own = seen[seen.fold == f].set_index("k")
        x = t.set_index("k").loc[own.index, FEATURES].fillna(medians)
        assert np.allclose(own.y_pred, predict(folds.coded(x.to_numpy(), edges).astype(int)), atol=1e-9)


def test_linear_models_with_nulls_equal_plain_algebra(spark, made):
    t, rows, w, plain = made
    ready = folds.prepared(rows, KEYS, "day", FEATURES, "y", w)
    fitted, _ = folds.fit_folds(ready, FEATURES, "y", len(plain), models=("ridge", "elastic_net"), l1_alpha=0.1)
    for f, r in zip(fitted, plain.itertuples(), strict=True):
        train = t[(t.day >= r.train_start) & (t.day <= r.train_end) & t.y.notna()]
        x, y = train[FEATURES].fillna(train[FEATURES].median()).to_numpy(), train.y.to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        ridge = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / x.std(0)
        assert f["train_rows"] == len(y) and np.allclose(f["models"]["ridge"][0], ridge, rtol=1e-7)
        weights, intercept = f["models"]["elastic_net"]
        net, rest = weights * x.std(0), y - intercept - x @ weights
        slope = z.T @ rest / len(y) - 0.1 * 0.75 * net  # at the least, the l1 term balances it
        assert np.allclose(np.where(net != 0, slope - 0.1 * 0.25 * np.sign(net), 0), 0, atol=1e-6) and (np.abs(slope) <= 0.025 + 1e-6).all()


def test_folds_without_rows_are_skipped_with_a_note(spark):
    t = _sample(400)
    t.loc[t.day < dt.date(2020, 8, 1), "y"] = np.nan  # hardly any label to train on in early folds
    t.loc[(t.day >= dt.date(2020, 11, 1)) & (t.day < dt.date(2020, 12, 1)), "y"] = np.nan
    rows = _spark_rows(spark, t)
    got = folds.fold_report(rows, KEYS, "day", FEATURES, "y", _windows(spark, rows), trees=3).collect()
    by = {(r.fold_id[-6:], r.model_name, r.role): r for r in got}
    assert len(by) == len(got) and {m for _, m, _ in by} == set(folds.MODELS)
    early = by["202008", "gradient_boosting", "test"]
    assert early.status == "skipped" and early.notes == f"insufficient_train_rows={early.train_rows}<min_train_rows=20" and early.rmse is None
    gap = by["202011", "ridge", "test"]
    assert gap.notes.startswith("insufficient_") and gap.n_rows == 0
    late = by[max(f for f, *_ in by), "gradient_boosting", "validation"]
    assert late.status == "success" and late.notes == "" and late.rmse > 0
    none = folds.fold_report(rows.limit(0), KEYS, "day", FEATURES, "y", _windows(spark, rows.limit(0)))
    assert none.count() == 0


def test_boosting_beats_the_mean_on_held_out_rows(spark, made):
    t, rows, w, _ = made
    got = folds.fold_report(rows, KEYS, "day", FEATURES, "y", w, roles=("validation",)).toPandas()
    rmse = got.groupby("model_name").rmse.mean()
    assert rmse["gradient_boosting"] < rmse["ridge"] < t.y.std()


def test_ranks_and_metrics_equal_pandas(spark):
    rng = np.random.default_rng(1)
    t = pd.DataFrame({"g": rng.choice(["x", "y", None], 3000, p=[0.8, 0.15, 0.05]), "t": rng.integers(0, 40, 3000) / 2.0, "p": rng.normal(size=3000).round(2)})
    t.loc[::50, "t"] = np.nan
    t.loc[t.g == "y", "p"] = 1.0
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in t.itertuples(index=False)], "g string, t double, p double")
    got = {r.g: r for r in market.fold_metrics(df, ["g"], "t", "p", full=True).collect()}
    for g in ("x", "y", None):
        own = t[(t.g == g) if g else t.g.isna()].dropna(subset=["t"])
        r = got[g]
        assert (r.n_rows, r.mean_y_true) == (len(own), pytest.approx(own.t.mean())) and r.mse == pytest.approx(((own.t - own.p) ** 2).mean())
        assert r.r2 == pytest.approx(1 - ((own.t - own.p) ** 2).sum() / ((own.t - own.t.mean()) ** 2).sum())
        if g == "y":
            assert r.spearman is None and r.pearson is None
        else:
            assert r.spearman == pytest.approx(own.t.rank().corr(own.p.rank())) and r.pearson == pytest.approx(own.t.corr(own.p))


def test_entries_across_months(spark):
    day = lambda m, d: dt.date(2024, m, d)
    prices = spark.createDataFrame([("a", "s", day(1, 5), 1.0), ("a", "s", day(4, 2), 1.0), ("b", "s", day(2, 1), 1.0)], "security string, sector string, date date, price double")
    asof = [("a", day(1, 5), 1), ("a", day(1, 6), 2), ("a", day(2, 1), 3), ("a", day(4, 3), 4), ("b", day(1, 31), 5), ("c", day(1, 1), 6), ("a", None, 7), (None, day(1, 1), 8)]
    got = {r.n: r.entry_date for r in market.entry_dates(spark.createDataFrame(asof, "security string, asof_date date, n int"), prices).collect()}
    assert got == {1: day(1, 5), 2: day(4, 2), 3: day(4, 2), 4: None, 5: day(2, 1), 6: None, 7: None, 8: None}
