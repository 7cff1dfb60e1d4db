"""The queries of this subpackage: the operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, decontaminate, hpylm, licenses, mixing, quality, repair, rules, secrets, shards, simhash, sql, substrings
from .common import table, whole_text


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"), held_out=F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated(table(spark, sf_dir, "documents"), keep_bytes=False)
    return found.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "line")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("word_bpe_49k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep_text=False)
    return coded.select("doc_id", F.col("tokens.n_tokens").alias("n_tokens"), F.sha2("tokens.ids", 256).alias("ids_sha256"), F.col("tokens.decoded_sha256").alias("decoded_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary("byte_bpe_50k.tiktoken"), _split_pattern())
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in secrets.ORDER], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = rules.apply(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    s = {k: F.col(f"stats.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    return found.select("doc_id", *[c.alias(k) for k, c in s.items()], failed.alias("base_failed"), (~failed & (F.col("rule") == 0)).alias("kept"), F.col("rule").cast("int").alias("rule"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["item_ids"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with copies (0, 1 or 2), text and role damaged as crc32 of conv_id:turn says; nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(damaged(table(spark, sf_dir, "conversations")), copies=F.col("copies"))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken", "whole", "part")


OP10_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (
  select distinct item_id, least(10, len(w)) as m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as s
  from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(i) where len(w) > 0),
m as (select distinct m from p),
dw as (
  select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as s from d, m, unnest(range(1, len(w) - m + 2)) as t(i) where len(w) >= m),
h as (select dw.doc_id, dw.i, dw.m, p.item_id from dw join p on dw.m = p.m and dw.s = p.s),
hit as (select doc_id, count(distinct j) as n from (select distinct doc_id, unnest(range(i, i + m)) as j from h) group by doc_id),
it as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id, ',' order by item_id) as ids from h group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(it.n, 0) as n_items, sha256(coalesce(it.ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_shards, op2_hpylm, op3_substrings, op4_licenses, op5_bpe, op6_secrets, op7_simhash, op8_quality, op9_rules, op10_decontaminate, op11_audit, op12_repair, op13_mix)}
ORACLES = {"op10_decontaminate": OP10_SQL, "op11_audit": sql.OP11, "op12_repair": sql.OP12, "op13_mix": sql.OP13}
