"""Models over folds, their selection, ablations, mismatch scores and verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as E


def feature_counts(df: DataFrame, candidates: list[str]) -> DataFrame:
    """(feature, n_numeric) of all candidates from one aggregation; a feature is usable if it has a number."""
    xs = F.array(*[F.struct(F.lit(c).alias("feature"), F.count(E.strict_double(F.col(c))).alias("n_numeric")) for c in sorted(candidates)])
    return df.agg(xs.alias("xs")).select(F.explode("xs").alias("x")).select("x.*")


def _fit(features: int, alpha: float, l1_alpha: float, l1_ratio: float):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.itertuples(index=False):
            n, p = r.n, features
            sx, sxx, sxy = np.array(r.sx), np.array(r.sxx).reshape(p, p), np.array(r.sxy)
            mean, ybar = sx / n, r.sy / n
            cov, cxy = sxx / n - np.outer(mean, mean), sxy / n - mean * ybar
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            sd[sd < 1e-12] = 1.0
            c, b = cov / np.outer(sd, sd), cxy / sd
            ridge = np.linalg.solve(c * n + alpha * np.eye(p), b * n)
            net = np.zeros(p)
            for _ in range(1000):
                before = net.copy()
                for j in range(p):
                    rest = b[j] - c[j] @ net + c[j, j] * net[j]
                    net[j] = np.sign(rest) * max(abs(rest) - l1_alpha * l1_ratio, 0) / (c[j, j] + l1_alpha * (1 - l1_ratio))
                if np.max(np.abs(net - before), initial=0) < 1e-10:
                    break
            for name, w in (("ridge", ridge), ("elastic_net", net)):
                w = w / sd
                out.append({"fold_id": r.fold_id, "model_name": name, "weights": w.tolist(), "intercept": float(ybar - w @ mean), "train_rows": int(n)})
        return pd.DataFrame(out, columns=["fold_id", "model_name", "weights", "intercept", "train_rows"])

    return fit


def linear_models(rows: DataFrame, features: list[str], label: str, *, alpha: float = 1.0, l1_alpha: float = 0.001, l1_ratio: float = 0.25, least_train: int = 20) -> DataFrame:
    """(fold_id, model_name, weights, intercept, train_rows): ridge and elastic net of every fold, on standardized features.

    rows: (fold_id, role, features..., label). All folds are fitted from one grouped sum of products of the train rows, so the data are
    read once whatever the number of folds; a fold is then one small row. Rows without a label don't train; folds under
    least_train rows are left out. Features must be without nulls (see impute).
    """
    train = rows.filter((F.col("role") == "train") & F.col(label).isNotNull())
    x = [F.col(c).cast("double") for c in features]
    y = F.col(label).cast("double")
    sums = train.groupBy("fold_id").agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.array(*[F.sum(a) for a in x]).alias("sx"), F.array(*[F.sum(a * b) for a in x for b in x]).alias("sxx"), F.array(*[F.sum(a * y) for a in x]).alias("sxy"))
    make = _fit(len(features), alpha, l1_alpha, l1_ratio)
    return sums.filter(F.col("n") >= least_train).mapInPandas(lambda frames: map(make, frames), f"fold_id {rows.schema['fold_id'].dataType.simpleString()}, model_name string, weights array<double>, intercept double, train_rows bigint")


def impute(rows: DataFrame, features: list[str]) -> DataFrame:
    """Nulls of features become the fold's train median (0 if it has none). One row for each fold is joined."""
    medians = rows.filter("role = 'train'").groupBy("fold_id").agg(*[F.median(c).alias(f"_m_{c}") for c in features])
    return rows.join(medians, "fold_id", "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in features}).drop(*[f"_m_{c}" for c in features])


def predict(rows: DataFrame, models: DataFrame, features: list[str], label: str, keys: list[str]) -> DataFrame:
    """(keys..., fold_id, role, model_name, y_true, y_pred) for every row and model of its fold."""
    value = F.aggregate(F.zip_with("weights", F.array(*[F.col(c).cast("double") for c in features]), lambda w, v: w * v), F.col("intercept"), lambda a, v: a + v)
    return rows.join(models, "fold_id").select(*keys, "fold_id", "role", "model_name", F.col(label).alias("y_true"), value.alias("y_pred"))


def select_models(metrics: DataFrame, *, role: str = "validation", other: str = "test", least_folds: int = 1) -> DataFrame:
    """One row for each model of (model_name, role, fold_id, spearman, mae, rmse): role means, ranks, score, selection rank, primary."""
    stats = {"mean_spearman_ic": F.round(F.avg("spearman"), 9), "mean_mae": F.round(F.avg("mae"), 9), "mean_rmse": F.round(F.avg("rmse"), 9), "folds_success": F.count_distinct("fold_id")}
    wide = metrics.groupBy("model_name").pivot("role", [role, other]).agg(*[c.alias(k) for k, c in stats.items()])
    one = Window.orderBy(F.lit(0))  # a row for each model
    rank = lambda c: F.rank().over(one.orderBy(c))
    ranked = wide.withColumns({"rank_validation_ic": rank(F.desc_nulls_last(f"{role}_mean_spearman_ic")), "rank_validation_mae": rank(F.asc_nulls_last(f"{role}_mean_mae")), "rank_validation_rmse": rank(F.asc_nulls_last(f"{role}_mean_rmse"))})
    few = F.when(F.coalesce(F.col(f"{role}_folds_success"), F.lit(0)) >= least_folds, 0.0).otherwise(1_000_000.0)
    scored = ranked.withColumn("model_selection_score", F.col("rank_validation_ic") * 10.0 + F.col("rank_validation_mae") * 2.0 + F.col("rank_validation_rmse") + few)
    place = F.row_number().over(Window.orderBy("model_selection_score", "rank_validation_ic", "rank_validation_mae", "rank_validation_rmse", "model_name"))
    return scored.withColumn("model_selection_rank", place).withColumn("is_primary_model", F.col("model_selection_rank") == 1)


def ablation_scores(df: DataFrame, keys: list[str], scores: dict[str, Column]) -> DataFrame:
    """(keys..., ablation_name, y_pred): each row once for each score."""
    xs = F.array(*[F.struct(F.lit(n).alias("ablation_name"), c.cast("double").alias("y_pred")) for n, c in scores.items()])
    return df.select(*keys, F.explode(xs).alias("x")).select(*keys, "x.*")


def mismatch(df: DataFrame, downside: dict[str, tuple[str, str]], upside: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """(keys..., components, downside and upside means of valid products, their difference under two names): spec is name -> (accounting column, text column)."""
    part = {n: F.round(F.col(a) * F.col(b), 12) for n, (a, b) in (downside | upside).items()}
    made = df.select(*keys, *[c.alias(n) for n, c in part.items()])
    mean = lambda spec: F.round(E.mean_of([F.col(n) for n in spec]), 12)
    scored = made.withColumns({"downside_mismatch_score": mean(downside), "upside_mismatch_score": mean(upside)})
    up, down = F.col("upside_mismatch_score"), F.col("downside_mismatch_score")
    net = F.when(up.isNotNull() | down.isNotNull(), F.round(F.coalesce(up, F.lit(0.0)) - F.coalesce(down, F.lit(0.0)), 12))
    return scored.withColumns({"net_mismatch_score": net, "dfm_score_simple": net})


def verdicts(found: DataFrame, key: str, criteria: dict[str, Column]) -> DataFrame:
    """One row for each key: PASS if all criteria hold (null fails), how many do, and the names of those that don't."""
    passed = {n: F.coalesce(c, F.lit(False)) for n, c in criteria.items()}
    n = sum((c.cast("int") for c in passed.values()), F.lit(0))
    out = found.select(key, n.alias("passed_criteria"), F.lit(len(passed)).alias("total_criteria"), E.notes({k: ~c for k, c in passed.items()}).alias("failed"))
    return out.withColumn("final_verdict", F.when(F.col("passed_criteria") == F.col("total_criteria"), "PASS").otherwise("FAIL"))


def text_proxies(df: DataFrame, prefixes: tuple[str, ...] = ("full", "mda", "risk", "liquidity")) -> DataFrame:
    """df with low-tone proxies 1 / (1 + share) and the two sides of the balance, missing shares counting as 0."""
    have = set(df.columns)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    out = {}
    for p in prefixes:
        out |= {f"{p}_low_{tone}_proxy": 1 / (1 + value(f"{p}_lm_{tone}_share")) for tone in ("negative", "positive")}
        balance = value(f"{p}_lm_pos_neg_balance")
        out |= {f"{p}_lm_pos_neg_balance_pos": E.positive(balance), f"{p}_lm_pos_neg_balance_neg": E.positive(-balance)}
    return df.withColumns(out)
