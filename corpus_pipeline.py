"""The corpus pipeline: quality, near copies, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Outputs are
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, quality, secrets, simhash
from tidemark.llm.common import table


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted-text model is within their language's limit."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a similarity of 0.8 or more: SimHash links, checked, then an exact join for the pairs beyond them."""
    return simhash.deduplicate(docs, size=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars counted again."""
    import public_tokenizers

    masked = secrets.redact(docs, _file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its words."""
    coded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), _file("word_bpe_49k.json"), keep_text=False)
    return coded.select("doc_id", "lang", "source", "tokens.n_tokens", "tokens.ids", "tokens.decoded_sha256")


STAGES = [("quality", keep_quality), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("tokens", encode)]
#: The stages need trained models, edit-tolerant groups and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; intermediate tables go to the shared folder of the session, where only the last one stays."""
    from tidemark.llm.common import _remove, shared_folder

    docs, base = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            _remove(spark, f"{base}/{k - 1}")
    return docs
