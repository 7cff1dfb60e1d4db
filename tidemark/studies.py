"""Registered queries of walk-forward models over the given tables; their SQL is in ``sql/``, a file for each query."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds, market, texts
from tidemark.queries import _t

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order lines with a few features, among them one with nulls, and the walk-forward windows over their days."""
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), "l_extendedprice", "l_quantity", "l_discount", F.when(F.col("l_returnflag") != "A", F.col("l_tax")).alias("l_tax"))
    return rows, market.fold_windows(F.col("lo"), F.col("hi"), rows.agg(F.min("day").alias("lo"), F.max("day").alias("hi")))


def fold_models(spark: SparkSession, d: str) -> DataFrame:
    """Ridge, elastic net and gradient boosting of every walk-forward fold, evaluated on validation and test rows; boosting isn't SQL."""
    rows, windows = _lines(spark, d)
    return folds.fold_report(rows, ["l_orderkey", "l_linenumber"], "day", FEATURES, "l_extendedprice", windows)


def fold_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Ridge alone: medians, scaling, fit and evaluation of every fold, which SQL can express."""
    rows, windows = _lines(spark, d)
    found = folds.fold_report(rows, ["l_orderkey", "l_linenumber"], "day", FEATURES, "l_extendedprice", windows, models=("ridge",))
    return found.withColumns({c: F.round(c, 3) for c in ("rmse", "mae")} | {c: F.round(c, 6) for c in ("pearson", "spearman")})


def fold_medians(spark: SparkSession, d: str) -> DataFrame:
    """The exact median of each feature over every fold's train rows."""
    rows, windows = _lines(spark, d)
    names = [r.fold_id for r in windows.orderBy("test_start").select("fold_id").collect()]
    columns = [*FEATURES, "l_extendedprice"]
    found = folds.expanding_medians(rows.join(F.broadcast(folds.fold_days(windows)), "day"), columns, len(names))
    held = [(name, c, None if m != m else float(m)) for name, row in zip(names, found, strict=True) for c, m in zip(columns, row, strict=True)]
    return spark.createDataFrame(held, "fold_id string, feature string, median double").withColumn("median", F.round("median", 6))


def dictionary_features(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon features of every document with a dictionary of all words of the documents, dealt into categories by a digest."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    words = docs.select(F.explode(texts.tokens(F.col("text"))).alias("word")).distinct()
    mark = F.ascii(F.md5("word")) % 9  # of a hexadecimal digit; two of the nine values are no category
    lexicon = words.select("word", F.get(F.array(*[F.lit(k) for k in texts.CATEGORIES]), mark.cast("int")).alias("category")).filter("category is not null")
    found = texts.lexicon_features(docs, "text", lexicon, "", ["doc_id"])
    return found.withColumns({c: F.round(c, 6) for c, t in found.dtypes if t == "double"})


QUERIES = {f.__name__: f for f in (fold_models, fold_ridge, fold_medians, dictionary_features)}
ORACLES = {p.stem: p.read_text() for p in sorted(Path(__file__).with_name("sql").glob("*.sql"))}
