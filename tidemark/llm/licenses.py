"""License scans (operator 4): a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of text. Its words and word pairs are hashed into sparse vectors for a naive Bayes model of licence families and "none".
Training paragraphs are made from the templates (whole, cut and with words left out) and from all paragraphs of the corpus in which no
template's word triple occurs: the model is sums, so one pass takes them all. "None" is modelled in PARTS parts, by hash of the line, and a line of no family
is held out by leaving its own part out. How far a family must be ahead of none comes from all of these held-out lines; what passes is compared
with the family's template before it is reported. A paragraph that passes neither is unknown if it still speaks of a licence, and is no hit otherwise.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, scratch

#: Licence families and the sentences by which works name them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
)
NONE = "none"
#: Words that a paragraph of an unknown licence uses.
SPEAKS = r"(?i)\b(licen[cs]ed?|copyright|all rights reserved)\b"
FEATURES = 1 << 14
PARTS = 4


def _words(text: Column) -> Column:
    """Runs of letters and digits, dots and hyphens within them included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-]+[\p{L}\p{N}]+)*"), F.lit(0))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once for the row: inside lambdas a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _grams(words: Column) -> Column:
    """Hashes of the words and of their pairs."""

    def make(hs: Column) -> Column:
        n = F.greatest(F.size(hs) - 1, F.lit(0))
        return F.concat(hs, F.zip_with(F.slice(hs, 1, n), F.slice(hs, 2, n), lambda x, y: F.xxhash64(x, y)))

    return _once(F.transform(words, lambda w: F.xxhash64(w)), make)


def _computed(frame: DataFrame, *, keep: list[str], **columns: Column) -> DataFrame:
    """keep and columns, which Spark computes once for a row: filters that follow aren't pushed below them, nor their parts copied."""
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return frame.select(*keep, made)


def _triples(words: Column) -> Column:
    return _once(words, lambda ws: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 3, F.lit(0))), lambda i: F.xxhash64(F.slice(ws, i + 1, 3))))


def paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, paragraph number from 0, text): lines that hold a word; a null text has none."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("paragraph", "line"))
    return lines.filter(F.col("line").rlike(r"[\p{L}\p{N}]"))


def _versions(spark: SparkSession) -> DataFrame:
    """(family, words) of the templates' variants."""
    known = spark.createDataFrame(TEMPLATES, "family string, line string").withColumn("words", _words(F.col("line")))
    # what stands before and after the sentence, and words that are missing, differ from work to work
    n = F.size("words")
    versions = known.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(39))))
    kept = F.filter(F.col("words"), lambda w: F.pmod(F.xxhash64(w, F.col("v")), F.lit(100)) >= F.col("v") % 4 * 6)
    return versions.select("family", F.when(F.col("v") == 0, F.col("words")).when(F.col("v") % 5 == 4, F.slice("words", 1, F.greatest(n - 2, F.lit(4)))).otherwise(kept).alias("words")).filter(F.size("words") >= 4)


def _template_triples(spark: SparkSession) -> dict[str, list[list[int]]]:
    """The hashed word triples of each family's templates, a few dozen fixed numbers."""
    found: dict[str, list[list[int]]] = {}
    for r in spark.createDataFrame(TEMPLATES, "family string, t string").select("family", F.array_distinct(_triples(_words(F.col("t")))).alias("ts")).collect():
        found.setdefault(r.family, []).append(list(r.ts))
    return found


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", false_share: float = 0.001, least_similarity: float = 0.6, seed: int = 11) -> DataFrame:
    """(id_col, paragraph, family, probability, similarity, line): one row for each paragraph of a licence.

    family is "unknown" where the paragraph speaks of a licence that neither model nor templates confirm. similarity is the share of
    the best template's word triples that the paragraph holds. Of families that are equally likely the first by name counts. The model is fitted on the templates and on all paragraphs of
    the corpus, its limit is that which false_share of all held-out paragraphs pass, and every paragraph is scored: two passes over the texts. Null and empty texts have no paragraphs; copies
    and repeated rows each give their own rows; other columns of docs aren't returned. The result is checkpointed.
    """
    spark = docs.sparkSession
    families = sorted({f for f, _ in TEMPLATES})
    triples = _template_triples(spark)
    shares = F.array(*[F.lit(x) for ts in triples.values() for t in ts for x in t])
    shared = lambda words: F.arrays_overlap(_triples(words), shares)
    lines = paragraphs(docs, id_col=id_col, text_col=text_col)
    read = _computed(lines, keep=[*lines.columns, F.pmod(F.xxhash64("line", F.lit(seed)), F.lit(PARTS)).cast("int").alias("part")], words=_words(F.col("line")))
    tf = HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True)
    number = F.create_map(*[x for k, f in enumerate(families) for x in (F.lit(f), F.lit(float(PARTS + k)))])[F.col("family")]
    versions = _versions(spark)
    train = versions.select(number.alias("label"), _grams(F.col("words")).alias("grams"))
    empty = spark.range(PARTS).select(F.col("id").cast("double").alias("label"), F.array().cast("array<bigint>").alias("grams"))  # no part lacks a line
    train = train.unionByName(empty).unionByName(read.filter(~shared(F.col("words"))).select(F.col("part").cast("double").alias("label"), _grams(F.col("words")).alias("grams")))
    model = NaiveBayes(smoothing=1.0).fit(tf.transform(train).select("label", "features"))
    log = [float(x) for x in model.pi.toArray()]
    raw = lambda k: F.get(F.col("raw"), F.lit(k)) - log[k]
    total = lambda xs: _once(F.array(*xs), lambda a: _once(F.array_max(a), lambda top: top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))))
    # none and all families together count alike
    parts = [raw(k) for k in range(PARTS)]
    others = [F.when(F.col("part") != k, x).otherwise(F.lit(-1e300)) for k, x in enumerate(parts)]
    with scratch(spark) as keep:
        scored = _computed(read, keep=[*lines.columns, "part"], grams=_grams(F.col("words")))
        scored = model.setPredictionCol("").setProbabilityCol("").transform(tf.transform(scored))
        columns = lines.columns
        scored = _computed(scored, keep=[*columns, "part"], raw=vector_to_array("rawPrediction"))
        scored = _computed(scored, keep=columns, fam=F.array(*[raw(PARTS + k) for k in range(len(families))]), against=total(parts) - math.log(PARTS), held=total(others) - math.log(PARTS - 1))
        best = F.array_max("fam")
        scored = _computed(scored, keep=columns, ahead=best - F.col("against") - math.log(len(families)), ahead_held=best - F.col("held") - math.log(len(families)), guess=F.get(F.array(*[F.lit(f) for f in families]), F.array_position("fam", best).cast("int") - 1), rest=F.aggregate("fam", F.lit(0.0), lambda s, x: s + F.exp(x - best)))
        likely = scored.filter((F.col("ahead") >= 0) | (F.col("ahead_held") >= 0) | F.col("line").rlike(SPEAKS))
        likely = _computed(likely, keep=likely.columns, words=_words(F.col("line")))
        likely = keep(likely.withColumns({"own": F.array_distinct(_triples(F.col("words"))), "none": ~shared(F.col("words"))}).drop("words"))
        # the model's priors are (n + 1) / (all + classes), so they hold how many lines there are for the templates' variants; each part had an empty line more
        share = [math.exp(x) for x in log]
        lines_of_none = round((versions.count() + len(families)) * sum(share[:PARTS]) / sum(share[PARTS:])) - 2 * PARTS
        passing, most = likely.filter("none and ahead_held >= 0"), int(lines_of_none * false_share)
        n = passing.count()
        limit = passing.agg(F.percentile_approx("ahead_held", 1 - most / n, 100_000)).first()[0] if n > most else 0.0
        share_of = lambda t: F.size(F.array_intersect(F.array(*[F.lit(x) for x in t]), F.col("own"))) / len(t)
        like = F.lit(0.0)
        for family, ts in triples.items():
            like = F.when(F.col("guess") == family, F.greatest(*[share_of(t) for t in ts], F.lit(0.0))).otherwise(like)
        p = 1 / (F.col("rest") + F.exp(-F.col("ahead")))
        joined = _computed(likely, keep=[*lines.columns, "ahead", "guess"], similarity=like, p=p)
        sure = (F.col("ahead") >= limit) & (F.col("similarity") >= least_similarity)
        return checkpoint(joined.select(id_col, "paragraph", F.when(sure, F.col("guess")).otherwise("unknown").alias("family"), F.col("p").alias("probability"), "similarity", "line").filter((F.col("family") != "unknown") | F.col("line").rlike(SPEAKS)))
