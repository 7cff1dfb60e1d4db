"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only a session on a local master (a test on one machine) may lack that setting; it gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc.getCheckpointDir()


@contextlib.contextmanager
def bucketed(df: DataFrame, column: str) -> Iterator[DataFrame]:
    """df as a table in the shared folder, dealt into buckets by column, so that joins on it leave its rows in place; dropped at the end.

    What is made of it must be written or checkpointed before the end.
    """
    spark = df.sparkSession
    name = f"tidemark_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).option("compression", "zstd").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")
        _remove(spark, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that cuts the lineage of a table like ``checkpoint`` but writes it as compressed columns, a fraction of that size.

    Tables go to the shared folder and are removed at the end, so what is made of them must be written or checkpointed before.
    """
    folder, number = f"{shared_folder(spark)}/tidemark_{uuid.uuid4().hex}", itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(number)}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        _remove(spark, folder)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get so many rows at a time while the context lasts; its jobs must run inside. Rows that hold whole texts or blocks take memory on both sides."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        yield


@contextlib.contextmanager
def arrow_bytes(spark: SparkSession, most: int = 2 << 20) -> Iterator[None]:
    """Python workers get about so many bytes at a time, a row at least, while the context lasts; its jobs must run inside. For rows of unlike sizes."""
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most):
        yield


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df: its rows go to the shared folder, and Spark removes them when nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live plan refers to; long jobs call it between phases."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, most_rows: int = 2_000_000) -> DataFrame:
    """df, marked for a broadcast if it has at most most_rows rows; beyond that Spark shuffles both sides. For tables of a few bytes a row."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= most_rows else df


def whole_text(column: str | Column) -> Column:
    """The text itself, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
