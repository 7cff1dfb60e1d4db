"""Text of filings as features: counts and parse flags, lexicon features of the whole text and of its sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr as E

#: Sections and the prefixes of their features.
SECTIONS = {"mda": "mda_", "risk_factors": "risk_", "liquidity": "liquidity_"}

#: The categories of a lexicon.
CATEGORIES = ("negative", "positive", "uncertainty", "litigious", "constraining", "strong_modal", "weak_modal")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), 0))


def text_counts(df: DataFrame, raw: str, clean: str, *, min_words: int = 1000) -> DataFrame:
    """df with counts of characters and words, the clean share of the raw text, and a parse flag with notes.

    RED without any word, YELLOW below min_words.
    """
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    out = df.withColumns({"raw_char_count": size(raw), "clean_char_count": size(clean), "clean_word_count": word_count(F.col(clean))})
    none, few = F.col("clean_word_count") == 0, F.col("clean_word_count") < min_words
    return out.withColumns({"clean_raw_ratio": F.round(F.coalesce(F.try_divide(F.col("clean_char_count"), F.col("raw_char_count")), F.lit(0.0)), 12), "parse_quality_flag": E.flag(none, few), "parse_quality_notes": E.notes({"empty_text": none, "few_words": few & ~none})})


def as_lexicon(spark: SparkSession, words: dict[str, tuple[str, ...]]) -> DataFrame:
    """(word, category) of a few words given in code; a real dictionary comes from ``sources.files.lexicon``.

    It is a table of one generated row's parts, whose size Spark knows before it runs, so that it goes to the tokens and tokens aren't dealt out.
    """
    pairs = [F.struct(F.lit(w).alias("word"), F.lit(k).alias("category")) for k, ws in words.items() for w in ws]
    rows = F.array(*pairs) if pairs else F.array().cast("array<struct<word:string,category:string>>")
    return spark.range(1).select(F.inline(rows))


def tokens(text: Column) -> Column:
    """Runs of A-Z once a-z are upper-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("[A-Z]+"), 0)


#: A table of (word, category), or a rule: the category of a word, null for none.
Lexicon = DataFrame | Callable[[Column], Column]


def dictionary_counts(df: DataFrame, text: str, lexicon: Lexicon, keep: list[str], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(keep..., lm_token_count, <category>_count...), one row for each row of df, rows that are alike included.

    lexicon: (word, category); a word may have several categories, and repeats count once. Each token asks a hash table of the
    lexicon, so the cost doesn't grow with its words; Spark sends the table to all tasks while it is under the broadcast limit of the session, and else deals
    tokens and lexicon out by word. A row's tokens are added up in the task that split them. A rule is asked for each token where it stands: no token is joined or dealt out.
    """
    numbered = df.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    each = numbered.select(*keep, "_row", F.explode_outer(tokens(F.col("_text"))).alias("word"))
    if callable(lexicon):
        each = each.withColumn("_mark", lexicon(F.col("word"))).withColumns({f"_{k}": (F.col("_mark") == k).cast("int") for k in categories})
    else:
        members = lexicon.groupBy("word").agg(*[F.max((F.col("category") == k).cast("int")).alias(f"_{k}") for k in categories])
        each = each.join(members, "word", "left")
    counts = [F.coalesce(F.sum(f"_{k}"), F.lit(0)).cast("int").alias(f"{k}_count") for k in categories]
    return each.groupBy("_row", *keep).agg(F.count("word").cast("int").alias("lm_token_count"), *counts).drop("_row")


def lexicon_features(df: DataFrame, text: str, lexicon: Lexicon, prefix: str, keep: list[str], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """keep and the lexicon features of a text: counts, shares, net tone, balance, modal total; an empty or null text gets zeros."""
    counted = dictionary_counts(df, text, lexicon, keep, categories)
    n, count = F.col("lm_token_count"), {k: F.col(f"{k}_count") for k in categories}
    share = lambda c: F.round(F.coalesce(F.try_divide(c, n), F.lit(0.0)), 12)
    out = {"lm_token_count": n}
    out |= {f"lm_{k}_count": c for k, c in count.items()} | {f"lm_{k}_share": share(c) for k, c in count.items()}
    if {"positive", "negative"} <= set(categories):
        up, down = count["positive"], count["negative"]
        out |= {"lm_net_tone_count": up - down, "lm_net_tone_share": share(up - down), "lm_pos_neg_balance": F.round(F.coalesce(F.try_divide(up - down, up + down), F.lit(0.0)), 12)}
    if {"strong_modal", "weak_modal"} <= set(categories):
        out["lm_modal_total_share"] = share(count["strong_modal"] + count["weak_modal"])
    return counted.select(*keep, *[c.alias(f"{prefix}{k}") for k, c in out.items()])


def text_features(full: DataFrame, sections: DataFrame, lexicon: Lexicon, *, key: str = "accession_lineage_key", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """One row of each document: features of the full text and of its three sections; a missing section is RED with zeros.

    full: (key, clean_text, parse_quality_flag, ...); sections: (key, section_name, section_text, section_quality_flag,
    section_word_count), at most one of each name for a document. lexicon: (word, category), or a rule. Sections are counted in one pass.
    """
    keep = [c for c in full.columns if c != "clean_text"]
    out = lexicon_features(full, "clean_text", lexicon, "full_", keep, categories)
    about = {"section_quality_flag": "section_quality_flag", "section_word_count": "section_word_count_source"}
    made = lexicon_features(sections.filter(F.col("section_name").isin(*SECTIONS)), "section_text", lexicon, "", [key, "section_name", *about], categories)
    found = [c for c in made.columns if c.startswith("lm_")]
    of = lambda name: F.first(F.when(F.col("section_name") == name, F.struct(*found, *[F.col(c).alias(n) for c, n in about.items()])), ignorenulls=True)
    wide = made.groupBy(key).agg(*[of(name).alias(f"_{name}") for name in SECTIONS])
    joined = out.join(wide, key, "left")
    columns = list(out.columns)
    for name, prefix in SECTIONS.items():
        s = F.col(f"_{name}")
        columns += [F.coalesce(s["section_quality_flag"], F.lit("RED")).alias(f"{prefix}section_quality_flag"), F.coalesce(s["section_word_count_source"], F.lit(0)).alias(f"{prefix}section_word_count_source")]
        columns += [F.coalesce(s[c], F.lit(0)).alias(f"{prefix}{c}") for c in found] + [s["section_quality_flag"].isNotNull().alias(f"{prefix}section_available")]
    return joined.select(*columns)
