"""Walk-forward models of all folds at once, without rows multiplied by folds.

Train windows expand: a row trains in some fold and in every later one. So a row has one number, the first fold that it trains in, and what a
fold needs of its train rows is a running total over folds of what each number's rows add: sums of products for the linear models, counts of
values for medians, counts and label sums of binned rows for boosting. Windows meet rows by day through a small calendar, an equal join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import market
from tidemark.plans.lineage import Written, cut, release

MODELS = ("ridge", "elastic_net", "gradient_boosting")
MISSING = 255  # the bin of a null until a fold's median takes its place


def fold_days(windows: DataFrame) -> DataFrame:
    """(day, first_fold, seats): the first fold whose train window holds the day, and (fold, role) of the windows that evaluate it.

    windows: as market.fold_windows gives them, a few hundred; folds are numbered from 0 by test_start.
    """
    order = Window.orderBy("test_start")  # a row for each fold
    w = windows.select("*", (F.row_number().over(order) - 1).alias("fold"), F.lag("train_end").over(order).alias("prior"))
    begin = F.coalesce(F.date_add("prior", 1), F.col("train_start"))
    new = w.filter(begin <= F.col("train_end")).select(F.explode(F.sequence(begin, F.col("train_end"))).alias("day"), F.col("fold").alias("first_fold"))
    span = lambda role: F.transform(F.sequence(f"{role}_start", f"{role}_end"), lambda d: F.struct(d.alias("day"), F.lit(role).alias("role")))
    seats = w.select("fold", F.explode(F.concat(span("validation"), span("test"))).alias("x")).groupBy(F.col("x.day").alias("day")).agg(F.sort_array(F.collect_list(F.struct("fold", F.col("x.role").alias("role")))).alias("seats"))
    return new.join(seats, "day", "full")


def fold_counts(df: DataFrame, date: str, windows: DataFrame) -> DataFrame:
    """(fold_id, role, n_rows, first_date, last_date) of every fold and role with rows, from counts by day."""
    days = df.filter(F.col(date).isNotNull()).groupBy(F.col(date).alias("day")).agg(F.count("*").alias("n"))
    spans = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_start").alias("lo"), F.col(f"{r}_end").alias("hi")) for r in ("train", "validation", "test")])
    each = windows.select("fold_id", F.explode(spans).alias("x")).select("fold_id", "x.role", F.explode(F.sequence("x.lo", "x.hi")).alias("day"))
    return each.join(days, "day").groupBy("fold_id", "role").agg(F.sum("n").alias("n_rows"), F.min("day").alias("first_date"), F.max("day").alias("last_date"))


def _weight(weight: str | None):
    """How many rows a row stands for, as w."""
    return (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("w")


# Medians of expanding windows


def _narrowed(width: int):
    """For the counts of one range of values and the (fold, rank) that lie in it: the bin of each rank, and the rank inside of that bin."""

    def narrow(counts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or counts.empty:
            return asked.iloc[:0]
        bins, at = np.unique(counts["bin"].to_numpy(), return_inverse=True)
        folds = int(max(counts["first_fold"].max(), asked["fold"].max())) + 1
        table = np.zeros((len(bins), folds), np.int64)
        np.add.at(table, (at, counts["first_fold"].to_numpy()), counts["n"].to_numpy())
        upto = table.cumsum(axis=1).cumsum(axis=0)  # rows in this bin or lower that the fold trains on
        lo, hi = np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
        np.minimum.at(lo, at, counts["lo"].to_numpy())
        np.maximum.at(hi, at, counts["hi"].to_numpy())
        out = asked.copy()
        place = [int(np.searchsorted(upto[:, f], r, side="right")) for f, r in zip(asked["fold"], asked["rank"], strict=True)]
        out["rank"] = [r - (upto[b - 1, f] if b else 0) for f, r, b in zip(asked["fold"], asked["rank"], place, strict=True)]
        out["path"], out["lo"], out["hi"] = [f"{p}.{bins[b]}" for p, b in zip(asked["path"], place, strict=True)], lo[place], hi[place]
        return out

    return narrow


def expanding_medians(rows: DataFrame, features: list[str], folds: int, *, width: int = 1024, weight: str | None = None) -> np.ndarray:
    """The exact median of each feature over each fold's train rows (folds x features), nan without values.

    rows: (first_fold, features...), finite numbers or nulls, each standing for as many as ``weight`` says. Values are counted in ``width`` bins of their range; the bins that hold a fold's middle rows are cut again
    over the values that they really hold, until such a bin has a single value. A round reads only rows of the bins that are still open, and
    what meets in one task is width x folds counts. Two rounds settle data of up to about a million distinct values.
    """
    spark = rows.sparkSession
    values = rows.filter("first_fold is not null").select("first_fold", _weight(weight), F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("feature", "v")).filter("v is not null and not isnan(v)")
    sizes = values.groupBy("feature", "first_fold").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # features x folds
    n, lo, hi = np.zeros((folds, len(features)), np.int64), {}, {}
    for r in sizes:
        n[r.first_fold, r.feature] += r.n
        lo[r.feature], hi[r.feature] = min(lo.get(r.feature, r.lo), r.lo), max(hi.get(r.feature, r.hi), r.hi)
    total, found = n.cumsum(axis=0), np.full((folds, len(features), 2), np.nan)
    asked = [(f, j, half, int(rank), str(j), lo[j], hi[j]) for f in range(folds) for j in range(len(features)) if total[f, j] for half, rank in enumerate(((total[f, j] - 1) // 2, total[f, j] // 2))]
    schema = "fold int, feature int, half int, rank bigint, path string, lo double, hi double"
    settle = lambda some: [found.__setitem__((r[0], r[1], r[2]), r[5]) for r in some if r[5] == r[6]]
    settle(asked)
    asked, open_rows = [r for r in asked if r[5] < r[6]], values.withColumn("path", F.col("feature").cast("string"))
    narrow = _narrowed(width)
    while asked:
        ranges = spark.createDataFrame(sorted({(p, a, b) for *_, p, a, b in asked}), "path string, from double, to double")
        # halves before the difference, which could overflow
        share = (F.col("v") / 2 - F.col("from") / 2) / (F.col("to") / 2 - F.col("from") / 2)
        inside = open_rows.join(F.broadcast(ranges), "path").withColumn("bin", F.least(F.lit(width - 1), F.floor(share * width).cast("int")))
        counts = inside.groupBy("path", "bin", "first_fold").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        wanted = spark.createDataFrame(asked, schema)
        asked = [tuple(r) for r in counts.groupBy("path").cogroup(wanted.groupBy("path")).applyInPandas(narrow, schema).collect()]
        settle(asked)
        asked = [r for r in asked if r[5] < r[6]]
        open_rows = inside.select("first_fold", "w", "feature", "v", F.concat_ws(".", "path", "bin").alias("path"))
    return found[:, :, 0] / 2 + found[:, :, 1] / 2  # their sum could overflow


# Sums of products


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def train_sums(rows: DataFrame, features: list[str], label: str, *, weight: str | None = None) -> DataFrame:
    """(first_fold, i, j, value): sums over rows of z_i z_j, where z is 1, the label, the features (null: 0), and for each feature 1 where it is null.

    With a fold's medians m, its imputed features are x + m null, so their products are linear in these sums. Rows without a label or first fold are
    left out. Each task adds its rows up before anything is sent.
    """
    asked = rows.filter(F.col("first_fold").isNotNull() & F.col(label).isNotNull()).select(F.col("first_fold").cast("int").alias("first_fold"), _weight(weight), F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)])
    xs = [f"_x{k}" for k in range(len(features))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x, first = _matrix(b, xs), b.column("first_fold").to_numpy()
            null = np.isnan(x)
            z = np.column_stack([np.ones(len(x)), _matrix(b, ["_y"]), np.where(null, 0.0, x), null])
            times = z * _matrix(b, ["w"])
            for f in np.unique(first):
                at = first == f
                sums[int(f)] = sums.get(int(f), 0) + times[at].T @ z[at]
        for f, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, f), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(s.ravel())], ["first_fold", "i", "j", "value"])

    return asked.mapInArrow(add, "first_fold int, i int, j int, value double").groupBy("first_fold", "i", "j").agg(F.sum("value").alias("value"))


def _linear(s: np.ndarray, m: np.ndarray, alpha: float, l1_alpha: float, l1_ratio: float) -> dict[str, tuple[np.ndarray, float]]:
    """Weights and intercept of ridge and elastic net on standardized, imputed features, from a fold's sums."""
    p = len(m)
    lift = np.zeros((2 + p, 2 + 2 * p))
    lift[:2, :2] = np.eye(2)
    lift[2:, 2 : 2 + p], lift[2:, 2 + p :] = np.eye(p), np.diag(m)
    t = lift @ s @ lift.T
    n, mean, ybar = t[0, 0], t[0, 2:] / t[0, 0], t[0, 1] / t[0, 0]
    cov, cxy = t[2:, 2:] / n - np.outer(mean, mean), t[1, 2:] / n - mean * ybar
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-12] = 1.0
    c, b = cov / np.outer(sd, sd), cxy / sd
    net = np.zeros(p)
    for _ in range(1000):
        before = net.copy()
        for j in range(p):
            rest = b[j] - c[j] @ net + c[j, j] * net[j]
            net[j] = np.sign(rest) * max(abs(rest) - l1_alpha * l1_ratio, 0) / (c[j, j] + l1_alpha * (1 - l1_ratio))
        if np.max(np.abs(net - before), initial=0) < 1e-10:
            break
    found = {"ridge": np.linalg.solve(c * n + alpha * np.eye(p), b * n), "elastic_net": net}
    return {k: (w / sd, float(ybar - (w / sd) @ mean)) for k, w in found.items()}


# Boosting on binned rows


def bin_edges(rows: DataFrame, features: list[str], bins: int, *, weight: str | None = None) -> list[np.ndarray]:
    """Quantiles of each feature over rows that every fold trains on, so that no fold's bins look ahead. A value is in the bin after all edges below it."""
    share = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    first = rows.filter("first_fold = 0")
    if weight:
        first = first.withColumn("_", F.explode(F.sequence(F.lit(1), F.col(weight))))  # the quantile takes no weights; nothing is sent
    found = first.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), share, 10_000).alias(f"q{k}") for k, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def binned_cells(rows: DataFrame, features: list[str], label: str, edges: list[np.ndarray], *, weight: str | None = None) -> DataFrame:
    """(first_fold, code, n, total): rows that agree in all bins, counted, with the sum of their labels. code has a byte for each feature."""
    asked = rows.filter(F.col("first_fold").isNotNull() & F.col(label).isNotNull()).select(F.col("first_fold").cast("int").alias("first_fold"), _weight(weight), F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first, y, w = b.column("first_fold").to_numpy(), _matrix(b, ["_y"])[:, 0], b.column("w").to_numpy()
            code = coded(_matrix(b, [f"_x{k}" for k in range(len(edges))]), edges)
            key = np.column_stack([np.ascontiguousarray(first.astype(">i4")).view(np.uint8).reshape(-1, 4), code])
            kept, at = np.unique(key, axis=0, return_inverse=True)
            at = at.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, :4].copy().view(">i4")[:, 0].astype(np.int32)), pa.array([k.tobytes() for k in kept[:, 4:]], pa.binary()), pa.array(np.bincount(at, weights=w).astype(np.int64)), pa.array(np.bincount(at, weights=w * y))], ["first_fold", "code", "n", "total"])

    return asked.mapInArrow(cells, "first_fold int, code binary, n bigint, total double").groupBy("first_fold", "code").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.full(x.shape, MISSING, np.uint8)
    for j, e in enumerate(edges):
        known = ~np.isnan(x[:, j])
        out[known, j] = np.searchsorted(e, x[known, j], side="left")
    return out


def histograms(x: np.ndarray, node: np.ndarray, nodes: int, n: np.ndarray, g: np.ndarray) -> np.ndarray:
    """(2, nodes, features, 256): rows and gradients by node, feature and bin."""
    return np.stack([np.stack([np.bincount(node * 256 + x[:, j], weights=w, minlength=nodes * 256).reshape(nodes, 256) for j in range(x.shape[1])], axis=1) for w in (n, g)])


def best_splits(table: np.ndarray, leaf: int) -> list[tuple[int, int, float, float, float, float]]:
    """For each node (feature, bin, n_left, g_left, n_right, g_right) of the largest drop in squared error; feature -1 and all rows left if no split leaves both sides enough rows.

    Of equal drops the first feature and bin wins.
    """
    n, g = table.cumsum(axis=-1)
    out = []
    for k in range(n.shape[0]):
        all_n, all_g = n[k, 0, -1], g[k, 0, -1]
        ok = (n[k] >= leaf) & (all_n - n[k] >= leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, g[k] ** 2 / n[k] + (all_g - g[k]) ** 2 / (all_n - n[k]), -np.inf)
        j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if not ok[j, b] or gain[j, b] <= all_g**2 / all_n * (1 + 1e-12):
            out.append((-1, MISSING, all_n, all_g, 0.0, 0.0))
        else:
            out.append((int(j), int(b), n[k, j, b], g[k, j, b], all_n - n[k, j, b], all_g - g[k, j, b]))
    return out


def moved(x: np.ndarray, node: np.ndarray, splits: list[tuple]) -> np.ndarray:
    """The node of each row one level below."""
    feature, at = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    right = (feature[node] >= 0) & (x[np.arange(len(x)), np.maximum(feature[node], 0)] > at[node])
    return 2 * node + right


Tree = tuple[list[list[tuple[int, int]]], list[float]]  # splits by level, values of the leaves


def tree_values(x: np.ndarray, tree: Tree) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for level in tree[0]:
        node = moved(x, node, level)
    return np.array(tree[1])[node]


def _leaves(splits: list[tuple], rate: float) -> list[float]:
    return [rate * g / n if n else 0.0 for s in splits for n, g in ((s[2], s[3]), (s[4], s[5]))]


def boosted(x: np.ndarray, n: np.ndarray, total: np.ndarray, *, trees: int, rate: float, depth: int, leaf: int) -> tuple[float, list[Tree]]:
    """Start value and trees of least-squares boosting over cells of n rows with label sums ``total``."""
    start = float(total.sum() / n.sum())
    value, grown = np.full(len(x), start), []
    for _ in range(trees):
        g, node, levels = total - n * value, np.zeros(len(x), np.int64), []
        for level in range(depth):
            splits = best_splits(histograms(x, node, 1 << level, n, g), leaf)
            node = moved(x, node, splits)
            levels.append([(s[0], s[1]) for s in splits])
        tree = (levels, _leaves(splits, rate))
        value = value + np.array(tree[1])[node]
        grown.append(tree)
    return start, grown


def _filled(code: np.ndarray, medians: np.ndarray) -> np.ndarray:
    return np.where(code == MISSING, medians[None, :], code).astype(np.int64)


def _cells_arrays(frame: pd.DataFrame, features: int) -> tuple[np.ndarray, ...]:
    code = np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(-1, features)
    return code, frame["first_fold"].to_numpy(), frame["n"].to_numpy(float), frame["total"].to_numpy(float)


def boost_folds(cells: DataFrame, features: int, medians: np.ndarray, folds: list[int], *, trees: int, rate: float, depth: int, leaf: int, most_cells: int) -> dict[int, tuple[float, list[Tree]]]:
    """Start value and trees of every fold in ``folds``. medians: the bin of each fold's median, for nulls.

    Up to most_cells cells (some 70 bytes each) go to every task, and each task boosts some folds. Beyond that cells stay where they are: each level of a
    tree is one aggregation of gradient sums by (fold, node, feature, bin) for all folds, and only splits come back.
    """
    spark, cells = cells.sparkSession, cut(cells)
    if not folds:
        return {}
    if cells.count() <= most_cells:
        held = spark.sparkContext.broadcast(cells.toPandas().sort_values(["first_fold", "code"]))

        def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            code, first, n, total = _cells_arrays(held.value, features)
            for frame in frames:
                for f in map(int, frame["fold"]):
                    own = first <= f
                    x, at = np.unique(_filled(code[own], medians[f]), axis=0, return_inverse=True)
                    sums = (np.bincount(at.ravel(), weights=w[own]) for w in (n, total))
                    start, grown = boosted(x, *sums, trees=trees, rate=rate, depth=depth, leaf=leaf)
                    yield pd.DataFrame([{"fold": f, "start": start, "trees": [{"splits": [[a, b] for level in t[0] for a, b in level], "leaves": list(t[1])} for t in grown]}])

        tasks = spark.createDataFrame([(f,) for f in folds], "fold int").repartition(len(folds))
        rows = tasks.mapInPandas(grow, "fold int, start double, trees array<struct<splits:array<array<int>>,leaves:array<double>>>").collect()
        out = {r.fold: (r.start, [([[tuple(t.splits[k]) for k in range((1 << d) - 1, (2 << d) - 1)] for d in range(depth)], list(t.leaves)) for t in r.trees]) for r in rows}
        held.unpersist()
        return out
    sums = {r.first_fold: (r.n, r.total) for r in cells.groupBy("first_fold").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    start = {f: sum(t for k, (_, t) in sums.items() if k <= f) / sum(n for k, (n, _) in sums.items() if k <= f) for f in folds}
    grown: dict[int, list[Tree]] = {f: [] for f in folds}
    state = cells.withColumn("value", F.array(*[F.lit(start[f]) for f in folds]))

    def partial(levels: dict[int, list]):
        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if frame.empty:
                    continue
                code, first, n, total = _cells_arrays(frame, features)
                value = np.stack(frame["value"].to_numpy())
                for k, f in enumerate(folds):
                    own = first <= f
                    if not own.any():
                        continue
                    x, node = _filled(code[own], medians[f]), np.zeros(int(own.sum()), np.int64)
                    for level in levels[f]:
                        node = moved(x, node, level)
                    table = histograms(x, node, 1 << len(levels[f]), n[own], total[own] - n[own] * value[own, k])
                    at = np.nonzero(table[0])
                    yield pd.DataFrame({"fold": f, "node": at[0], "feature": at[1], "bin": at[2], "n": table[0][at], "g": table[1][at]})

        return add

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((2, int(frame["nodes"].iloc[0]), features, 256))
        for k, c in enumerate(("n", "g")):
            np.add.at(table[k], (frame["node"].to_numpy(), frame["feature"].to_numpy(), frame["bin"].to_numpy()), frame[c].to_numpy())
        return pd.DataFrame([{"fold": frame["fold"].iloc[0], "splits": [[float(v) for v in s] for s in best_splits(table, leaf)]}])

    def grow_tree(made: dict[int, Tree]):
        def more(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if frame.empty:
                    continue
                code = _cells_arrays(frame, features)[0]
                value = np.stack(frame["value"].to_numpy()) + np.column_stack([tree_values(_filled(code, medians[f]), made[f]) for f in folds])
                yield frame.assign(value=list(value))

        return more

    for _ in range(trees):
        levels: dict[int, list] = {f: [] for f in folds}
        for level in range(depth):
            summed = state.mapInPandas(partial(levels), "fold int, node int, feature int, bin int, n double, g double").groupBy("fold", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
            found = summed.withColumn("nodes", F.lit(1 << level)).groupBy("fold").applyInPandas(choose, "fold int, splits array<array<double>>").collect()
            last = {r.fold: [(int(s[0]), int(s[1]), *s[2:]) for s in r.splits] for r in found}
            for f in folds:
                levels[f].append([(s[0], s[1]) for s in last[f]])
        made = {f: (levels[f], _leaves(last[f], rate)) for f in folds}
        for f in folds:
            grown[f].append(made[f])
        state = cut(state.mapInPandas(grow_tree(made), state.schema))
    return {f: (start[f], grown[f]) for f in folds}


# Fitting and evaluation of all folds


def prepared(rows: DataFrame, keys: list[str], date: str, features: list[str], label: str, windows: DataFrame) -> DataFrame:
    """(keys..., label, features..., first_fold, seats), written once; days outside of all windows keep their rows, with nulls."""
    days = fold_days(windows)
    asked = rows.select(*keys, F.col(date).alias("day"), label, *[c for c in features if c not in (*keys, label)])
    return cut(asked.join(F.broadcast(days), "day", "left").drop("day"))


def alike(rows: DataFrame, date: str, features: list[str], label: str, windows: DataFrame, *, held: Written | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that agree in label, features and the windows that hold them, counted: (first_fold, span, label, features..., n_alike), written once; and (span, seats).

    A span is a set of days that lie in the same windows. Its seats, some dozen, are looked up, not written with each row; what the windows don't hold is left out.
    The rows are one of held's tables if it is given.
    """
    calendar = cut(fold_days(windows).withColumn("span", F.min("day").over(Window.partitionBy("first_fold", "seats"))))  # a row for each day
    asked = rows.select(F.col(date).alias("day"), label, *[c for c in features if c != label])
    placed = asked.join(F.broadcast(calendar.drop("seats")), "day").drop("day")
    return (held.cut if held else cut)(placed.groupBy(*placed.columns).agg(F.count("*").alias("n_alike"))), calendar.filter("seats is not null").select("span", "seats").distinct()


def fit_folds(rows: DataFrame, features: list[str], label: str, folds: int, *, models: tuple[str, ...] = MODELS, alpha: float = 1.0, l1_alpha: float = 0.001, l1_ratio: float = 0.25, trees: int = 100, rate: float = 0.03, depth: int = 2, leaf: int = 5, bins: int = 64, least_train: int = 20, most_cells: int = 1_000_000, weight: str | None = None) -> tuple[list[dict], list[np.ndarray]]:
    """(a dict for each fold: train_rows, medians, and of folds with enough rows the fitted models; bin edges). rows: from ``prepared``, or from ``alike`` with its weight.

    Comes back to the driver: folds x (2 features + 2)^2 sums, medians, and trees; nothing that grows with rows.
    """
    if not folds:
        return [], []
    width = 2 * len(features) + 2
    sums = np.zeros((folds, width, width))
    for r in train_sums(rows, features, label, weight=weight).toLocalIterator():
        sums[r.first_fold, r.i, r.j] = r.value
    sums = sums.cumsum(axis=0)
    labelled = rows.filter(F.col(label).isNotNull())
    medians = expanding_medians(labelled, features, folds, weight=weight)
    medians = np.where(np.isnan(medians), 0.0, medians)  # a feature without any value
    out = [{"train_rows": int(s[0, 0]), "medians": m, "models": {}} for s, m in zip(sums, medians, strict=True)]
    able = [f for f in range(folds) if out[f]["train_rows"] >= least_train]
    for f in able:
        out[f]["models"] |= {k: v for k, v in _linear(sums[f], medians[f], alpha, l1_alpha, l1_ratio).items() if k in models}
    edges: list[np.ndarray] = []
    if "gradient_boosting" in models and able:
        edges = bin_edges(labelled, features, bins, weight=weight)
        cells = binned_cells(rows, features, label, edges, weight=weight)
        middle = coded(medians, edges)
        for f, found in boost_folds(cells, len(features), middle, able, trees=trees, rate=rate, depth=depth, leaf=leaf, most_cells=most_cells).items():
            out[f]["models"]["gradient_boosting"] = found
    return out, edges


def predict_folds(rows: DataFrame, keys: list[str], features: list[str], label: str, fitted: list[dict], edges: list[np.ndarray]) -> DataFrame:
    """(keys..., fold, role, model_name, y_true, y_pred) for every seat of a row with a label and every model of its fold.

    The models go to the tasks: at most folds x trees numbers.
    """
    held = rows.sparkSession.sparkContext.broadcast((fitted, edges))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    asked = rows.filter(F.col(label).isNotNull() & F.col("seats").isNotNull()).select(*keys, F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)], F.explode("seats").alias("_s")).select("*", "_s.*").drop("_s")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, edges = held.value
        for b in batches:
            x, fold = _matrix(b, [f"_x{k}" for k in range(len(features))]), b.column("fold").to_numpy()
            for f in np.unique(fold):
                at = np.nonzero(fold == f)[0]
                own, median = b.take(pa.array(at)), fitted[f]["medians"]
                for name, model in fitted[f]["models"].items():
                    y = _predicted(model, name, x[at], median, edges)
                    yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), own.column("fold"), own.column("role"), pa.array([name] * len(at)), own.column("_y"), pa.array(y)], [*keys, "fold", "role", "model_name", "y_true", "y_pred"])

    return asked.mapInArrow(predict, f"{kinds}, fold int, role string, model_name string, y_true double, y_pred double")


# Evaluation by sums of windows


class _Codes:
    """Numbers of the distinct rows of a matrix of finite numbers and nan."""

    def __init__(self, x: np.ndarray):
        self.values, self.pairs = [], []
        code = np.zeros(len(x), np.int64)
        for column in x.T:
            self.values.append(np.unique(column[~np.isnan(column)]))
            key = self._key(code, column, self.values[-1])
            self.pairs.append(np.unique(key))
            code = np.searchsorted(self.pairs[-1], key)
        self.first = np.unique(code, return_index=True)[1]  # a row of x for each number

    @staticmethod
    def _key(code: np.ndarray, column: np.ndarray, values: np.ndarray) -> np.ndarray:
        return code * (len(values) + 1) + np.where(np.isnan(column), len(values), np.searchsorted(values, column))

    def of(self, x: np.ndarray) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for column, values, pairs in zip(x.T, self.values, self.pairs, strict=True):
            code = np.searchsorted(pairs, self._key(code, column, values))
        return code


def _predicted(model: tuple, name: str, x: np.ndarray, median: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    if name != "gradient_boosting":
        return np.where(np.isnan(x), median, x) @ model[0] + model[1]
    bins = _filled(coded(x, edges), coded(median[None, :], edges)[0])
    return model[0] + sum((tree_values(bins, t) for t in model[1]), np.zeros(len(x)))


def _deviations(value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, float]:
    """(value less its mean, sum of squares, average rank less its mean, sum of squares) of values that stand for n rows each; 0 where n is 0."""
    total = n.sum()
    off = np.where(n > 0, value - (n @ value) / total, 0.0)
    _, at = np.unique(value, return_inverse=True)
    ties = np.bincount(at, weights=n)
    ranks = np.where(n > 0, (np.cumsum(ties) - ties + (ties + 1) / 2)[at] - (total + 1) / 2, 0.0)
    return off, float(n @ off**2), ranks, float(n @ ranks**2)


def window_metrics(ready: DataFrame, seats: DataFrame, features: list[str], label: str, fitted: list[dict], edges: list[np.ndarray], *, most_numbers: int = 1 << 24, lines_a_range: int = 1 << 18) -> DataFrame:
    """(fold, model_name, role, n_rows, rmse, mae, pearson, spearman) of every model on the windows that evaluate its fold; ready and seats: from ``alike``.

    A prediction follows from the features, so its ranks in a window follow from how often the window holds each combination of them. Lines are dealt out once, by ranges of
    the label; within a range every line's rank in each of its windows is counted, and only sums for each window leave the task. That holds while the predictions and
    ranks of all combinations, for all windows and models, are at most most_numbers; beyond that lines meet a few folds at a time (``predict_folds``).
    """
    spark = ready.sparkSession
    schema = "fold int, model_name string, role string, n_rows bigint, rmse double, mae double, pearson double, spearman double"
    spans = sorted((r.span, [(s.fold, s.role) for s in r.seats if fitted[s.fold]["models"]]) for r in seats.collect())  # some dozen
    windows = sorted({w for _, ws in spans for w in ws})
    number = spark.createDataFrame([(d, k) for k, (d, ws) in enumerate(spans) if ws], "span date, sid int")
    lines = ready.filter(F.col(label).isNotNull()).join(F.broadcast(number), "span").select("sid", F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)], F.col("n_alike").alias("n"))
    held_by = {r.sid: r for r in lines.groupBy("sid").agg(F.count("*").alias("lines"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_y")).alias("total"), F.min("_y").alias("lo"), F.max("_y").alias("hi")).collect()}
    if not held_by:
        return spark.createDataFrame([], schema)
    xs = [f"_x{k}" for k in range(len(features))]
    models = sorted({m for f in fitted for m in f["models"]})
    most = most_numbers // ((len(windows) + len(fitted)) * len(models))
    kinds = lines.select(*xs).distinct().limit(most + 1).toPandas().to_numpy(float).reshape(-1, len(xs))
    if len(kinds) > most:
        return _by_folds(ready, seats, features, label, fitted, edges, {f: sum(held_by[k].n for k, (_, ws) in enumerate(spans) if k in held_by and any(f == g for g, _ in ws)) for f in {f for f, _ in windows}}, schema)
    codes = _Codes(kinds)
    kinds = kinds[codes.first]
    hold = np.zeros((len(spans), len(windows)), bool)
    for k, (_, ws) in enumerate(spans):
        hold[k, [windows.index(w) for w in ws]] = True
    n_lines = sum(r.lines for r in held_by.values())
    ranges = max(1, -(-n_lines // lines_a_range))
    cuts = lines.agg(F.percentile_approx("_y", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), max(10_000, 10 * ranges))).first()[0] if ranges > 1 else []
    cuts = np.unique(np.array(cuts or [], float))  # only the sizes of ranges depend on them

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _matrix(b, ["_y"])[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, y, side="left").astype(np.int32)), b.column("sid"), pa.array(y), pa.array(codes.of(_matrix(b, xs)).astype(np.int32)), b.column("n")], ["range", "sid", "y", "kind", "n"])

    dealt = lines.mapInArrow(deal, "range int, sid int, y double, kind int, n bigint")
    by_kind, by_range = np.zeros((len(spans), len(kinds))), np.zeros((len(spans), len(cuts) + 1))
    for r in dealt.groupBy("sid", "kind").agg(F.sum("n").alias("n")).toLocalIterator():
        by_kind[r.sid, r.kind] = r.n
    for r in dealt.groupBy("sid", "range").agg(F.sum("n").alias("n")).toLocalIterator():
        by_range[r.sid, r.range] = r.n
    in_window = hold.T @ by_range
    size = in_window.sum(axis=1)
    before = np.cumsum(in_window, axis=1) - in_window
    own = [[held_by[k] for k in np.nonzero(hold[:, w])[0] if k in held_by] for w in range(len(windows))]
    mean = np.array([sum(r.total for r in rs) / max(sum(r.n for r in rs), 1) for rs in own])
    asked, about = [], []  # of each window and model: (window, predictions, their deviations and those of their ranks), sums of squares
    for w, (f, _) in enumerate(windows):
        n = hold[:, w] @ by_kind
        for name, model in fitted[f]["models"].items() if size[w] else ():
            p = _predicted(model, name, kinds, fitted[f]["medians"], edges)
            off, pp, ranks, rpp = _deviations(p, n)
            asked.append((w, p, off, ranks))
            about.append((w, name, pp, rpp, np.ptp(p[n > 0]) > 0))
    sent = spark.sparkContext.broadcast(asked)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        y, n, sid, kind = (table.column(c).to_numpy() for c in ("y", "n", "sid", "kind"))
        order = np.argsort(y, kind="stable")
        y, n, sid, kind = y[order], n[order].astype(float), sid[order], kind[order]
        group, at, out = np.cumsum(np.append(0, y[1:] != y[:-1])), key[0].as_py(), []
        last = -1
        for k, (w, p, off, ranks) in enumerate(sent.value):
            if w != last:
                last, lines = w, np.nonzero(hold[:, w][sid])[0]
                if len(lines):
                    c, ys, g, kinds_of = n[lines], y[lines], group[lines], kind[lines]
                    starts = np.nonzero(np.append(True, g[1:] != g[:-1]))[0]
                    ties = np.add.reduceat(c, starts)
                    r = before[w, at] + np.cumsum(ties) - ties + (ties + 1) / 2 - (size[w] + 1) / 2
                    cr, cd = c * np.repeat(r, np.diff(np.append(starts, len(lines)))), c * (ys - mean[w])
                    tt, rtt = cd @ (ys - mean[w]), ties @ r**2
            if len(lines):
                e = ys - p[kinds_of]
                out.append((k, c @ e**2, c @ np.abs(e), tt, cd @ off[kinds_of], rtt, cr @ ranks[kinds_of]))
        return pa.table([pa.array([r[j] for r in out], pa.int32() if j == 0 else pa.float64()) for j in range(7)], names=["k", *sums])

    sums = ["se", "ae", "tt", "tp", "rtt", "rtp"]
    parts = dealt.groupBy("range").applyInArrow(add, f"k int, {', '.join(f'{c} double' for c in sums)}")
    rows = []
    for r in parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in sums]).collect():  # a row for each window and model
        w, name, pp, rpp, varied = about[r.k]
        varied = varied and min(x.lo for x in own[w]) < max(x.hi for x in own[w])
        share = lambda x, a, b: float(x / (a**0.5 * b**0.5)) if varied and a > 0 and b > 0 else None  # noqa: B023, E731
        rows.append((windows[w][0], name, windows[w][1], int(size[w]), (r.se / size[w]) ** 0.5, r.ae / size[w], share(r.tp, r.tt, pp), share(r.rtp, r.rtt, rpp)))
    sent.unpersist()
    return spark.createDataFrame([(a, b, c, n, float(x), float(y), p, q) for a, b, c, n, x, y, p, q in rows], schema)


def _by_folds(ready: DataFrame, seats: DataFrame, features: list[str], label: str, fitted: list[dict], edges: list[np.ndarray], sizes: dict[int, int], schema: str) -> DataFrame:
    """``window_metrics`` by ranks of predictions as they are: so many folds at a time that their rows are about as many as all rows."""
    spark, total, batches, filled = ready.sparkSession, ready.agg(F.sum("n_alike")).first()[0], [], 0
    for f in sorted(sizes):
        if not batches or filled + sizes[f] > total:
            batches.append([])
            filled = 0
        batches[-1].append(f)
        filled += sizes[f]
    rows = []
    for batch in batches:
        some = seats.select("span", F.filter("seats", lambda s: s["fold"].isin(batch)).alias("seats")).filter("size(seats) > 0")  # noqa: B023
        seen = predict_folds(ready.join(F.broadcast(some), "span"), ["n_alike"], features, label, fitted, edges)
        found = market.fold_metrics(seen, ["fold", "model_name", "role"], "y_true", "y_pred", weight="n_alike")
        rows += found.select("fold", "model_name", "role", F.col("n_rows").cast("bigint"), "rmse", "mae", "pearson", "spearman").collect()
        del seen, found
        release(spark)
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def fold_report(rows: DataFrame, keys: list[str], date: str, features: list[str], label: str, windows: DataFrame, *, models: tuple[str, ...] = MODELS, least_train: int = 20, least_eval: int = 1, roles: tuple[str, ...] = ("validation", "test"), **params) -> DataFrame:
    """(fold_id, model_name, role, status, notes, train_rows, n_rows, rmse, mae, pearson, spearman) of every fold, model and role.

    Folds under least_train labelled train rows, and roles under least_eval labelled rows, are ``skipped``, with a note and null errors. Empty tables have no
    windows and so no rows. params go to ``fit_folds``.
    """
    windows = cut(windows)
    named = [r.fold_id for r in windows.orderBy("test_start").select("fold_id").collect()]
    held = Written(rows.sparkSession)
    ready, seats = alike(rows, date, features, label, windows, held=held)
    release(rows.sparkSession)  # the shuffle that wrote them
    fitted, edges = fit_folds(ready, features, label, len(named), models=models, least_train=least_train, weight="n_alike", **params)
    metrics = window_metrics(ready, seats, features, label, fitted, edges)
    counts = ready.filter(F.col(label).isNotNull()).groupBy("span").agg(F.sum("n_alike").alias("n")).join(F.broadcast(seats), "span").select("n", F.explode("seats").alias("s")).groupBy("s.fold", "s.role").agg(F.sum("n").alias("labelled")).collect()  # a row for each window
    held.drop_all()
    spark = rows.sparkSession
    counts = spark.createDataFrame([tuple(r) for r in counts], "fold int, role string, labelled bigint")
    every = spark.createDataFrame([(f, named[f], m, role, fitted[f]["train_rows"]) for f in range(len(named)) for m in models for role in roles], "fold int, fold_id string, model_name string, role string, train_rows bigint")
    joined = every.join(counts, ["fold", "role"], "left").join(metrics, ["fold", "model_name", "role"], "left")
    n = F.coalesce(F.col("labelled"), F.lit(0))
    short, empty = F.col("train_rows") < least_train, n < least_eval
    note = F.when(short, F.concat(F.lit("insufficient_train_rows="), "train_rows", F.lit(f"<min_train_rows={least_train}"))).when(empty, F.concat(F.lit("insufficient_eval_rows="), n, F.lit(f"<min_eval_rows={least_eval}"))).otherwise("")
    value = lambda c: F.when(~short & ~empty, F.col(c)).alias(c)
    return joined.select("fold_id", "model_name", "role", F.when(short | empty, "skipped").otherwise("success").alias("status"), note.alias("notes"), "train_rows", n.alias("n_rows"), *[value(c) for c in ("rmse", "mae", "pearson", "spearman")])
