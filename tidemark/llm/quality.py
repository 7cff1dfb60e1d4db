"""Quality classifier (operator 8): perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts byte n-grams, so it needs no word list and works for any language. Its tables are made with grouped counts and
joins over distinct n-grams; blocks of texts ask for the n-grams they hold and get probabilities back (see blocks). A document's
perplexity is compared with a high quantile of those of trusted documents of its language, each scored by a model without it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import arrow_rows, checkpoint, fresh, release_shuffles, scratch, small_side

ORDER = 4


def _context(n: int):
    return F.shiftright("k", 8)


def _suffix(column, n: int):
    return F.col(column).bitwiseAND(F.lit((1 << (8 * n)) - 1).cast("bigint"))


def kneser_ney(counts: DataFrame, wanted: DataFrame, order: int, symbols: int = 257, keep: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """(k, logp): the natural logarithm of the probability of each wanted n-gram's last byte after its others.

    counts: (k, c), distinct n-grams of the highest order and their counts; wanted: (k), distinct. Lower orders count the distinct
    bytes that stand before an n-gram. Discounts D1, D2, D3+ of each order come from its counts of counts, and are 0.5, 0.75, 0.9 where these are too few.
    keep cuts the lineage of a step's table.
    """
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = keep(levels[n + 1].select(_suffix("k", n).alias("k")).groupBy("k").agg(F.count("*").alias("c")))
    p = wanted.select("k", F.lit(1.0 / symbols).alias("p"))
    for n in range(1, order + 1):
        t = levels[n]
        few = t.agg(*[F.count_if(F.col("c") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (few[j] for j in range(4))
        d = (0.5, 0.75, 0.9)
        if min(n1, n2, n3, n4) > 0:
            y = n1 / (n1 + 2 * n2)
            d = tuple(min(max(x, 0.05), j - 0.05) for j, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = t.groupBy(_context(n).alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("left"))
        term = t.select("k", (F.col("c") - cut).alias("kept"))
        asked = p.select("k", "p", _suffix("k", n).alias("g")).withColumn("h", F.shiftright("g", 8))
        p = asked.join(term.withColumnRenamed("k", "g"), "g", "left").join(context, "h", "left").select("k", F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce("kept", F.lit(0.0)) + F.col("left") * F.col("p")) / F.col("total")).alias("p"))
        p = keep(p) if n in (2, order) else p
    return p.select("k", F.log("p").cast("float").alias("logp"))


def perplexities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), trusted_col: str, order: int = ORDER, prior_bytes: int = 120) -> DataFrame:
    """(id_col, keep..., n_bytes, log_perplexity): natural logarithm for each byte; empty and null texts have null.

    Rows where trusted_col is true train the models: one on each half of the ids, so that a trusted text is scored by the model of
    the other half, without itself; all others get the mean of both. If one half has no text, the other's model scores all. A text
    of n bytes counts with weight n against prior_bytes at the mean of all trusted text, so that a few unusual bytes don't reject a
    very short text. The result is checkpointed.
    """
    half = F.when(F.col(trusted_col), F.pmod(F.xxhash64(id_col), F.lit(2))).otherwise(-1).cast("int")
    keys = [id_col, *keep, trusted_col]
    fold = fresh(docs, "fold")
    grams_of = lambda texts: B.grams_of(texts, order, False)

    @F.arrow_udf("array<struct<k:bigint,c0:bigint,c1:bigint>>")
    def ask(rows: pa.Array, sizes: pa.Array, body: pa.Array) -> pa.Array:
        out = []
        for r, s, b in zip(rows, sizes, body, strict=True):
            folds = r.values.field(fold).to_numpy(zero_copy_only=False)
            out.append(B.counted(B.texts_of(b.as_py(), s.as_py()), grams_of, folds, 2))
        return B.counts_array(out, ["c0", "c1"])

    @F.arrow_udf("array<double>")
    def score(rows: pa.Array, sizes: pa.Array, body: pa.Array, got: pa.Array) -> pa.Array:
        out = []
        for r, s, b, g in zip(rows, sizes, body, got, strict=True):
            texts, scores = B.texts_of(b.as_py(), s.as_py()), []
            if not g.is_valid:  # nothing but empty texts
                out.append([None] * len(texts))
                continue
            folds = r.values.field(fold).to_numpy(zero_copy_only=False)
            known = [g.values.field(c).to_numpy(zero_copy_only=False) for c in ("k", "logp0", "logp1")]
            values_of = [B.Answers(known[0], x.astype(np.float64)) for x in known[1:]]
            B.give_back()
            for a, z in B.runs(texts):
                grams, first = grams_of(texts[a:z])
                by = [B.sums(of(grams), first) for of in values_of]
                total = np.select([folds[a:z] == 0, folds[a:z] == 1], [by[1], by[0]], (by[0] + by[1]) / 2)
                scores += [-(t + mean * prior_bytes) / (m + prior_bytes) if m else None for t, m in zip(total.tolist(), np.diff(first).tolist(), strict=True)]
            out.append(scores)
            del values_of, known
        B.give_back()
        return pa.array(out, pa.list_(pa.float64()))

    with B.packed(docs.withColumn(fold, half), [*keys, fold], text_col=text_col) as packed, scratch(docs.sparkSession) as keep_table, arrow_rows(docs.sparkSession, 1):  # a block at a time
        asked = packed.select("block", F.explode(ask("rows", "sizes", "body")).alias("x")).select("block", "x.*")
        grams = keep_table(asked.groupBy("k").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
        release_shuffles(docs.sparkSession)
        have = grams.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("c0", "c1")]).first()
        model = None
        for j in (0, 1):
            c = f"c{j if have[j] or not have[1 - j] else 1 - j}"
            own = kneser_ney(grams.filter(F.col(c) > 0).select("k", F.col(c).alias("c")), grams.select("k"), order, keep=keep_table).withColumnRenamed("logp", f"logp{j}")
            model = own if model is None else keep_table(model.join(own, "k"))
        held_out = F.col("c0") * F.col("logp1") + F.col("c1") * F.col("logp0")
        mean = grams.join(model, "k").agg(F.try_divide(F.sum(held_out), F.sum(F.col("c0") + F.col("c1")))).first()[0] or 0.0
        answers = asked.select("block", "k").join(model, "k")
        scored = B.with_answers(packed, answers, ["logp0", "logp1"])
        each = scored.select(F.explode(F.arrays_zip("rows", "sizes", score("rows", "sizes", "body", "got").alias("score"))).alias("x"))
        return checkpoint(each.select(*[F.col("x.rows")[c].alias(c) for c in keys], F.col("x.sizes").cast("bigint").alias("n_bytes"), F.round("x.score", 9).alias("log_perplexity")))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] = (), share: float = 0.995, least_trusted: int = 50, order: int = ORDER) -> DataFrame:
    """(id_col, lang_col, keep..., n_bytes, log_perplexity, log_limit, accepted), one row for each row of docs.

    labels: (id_col, quality); documents labelled 1 are the trusted text, all of them. log_limit of a language is the quantile
    ``share`` of the log-perplexities of its trusted documents, each scored without itself; a language with fewer than least_trusted
    of them, null among them, takes the higher of its own quantile and that of all trusted documents. Documents above the limit
    aren't accepted. Empty and null texts are accepted, as they hold nothing to judge; so is everything if nothing is trusted.
    A label of a repeated id counts for all its rows; repeated labels count as trusted if any is 1.
    """
    flag = fresh(docs, "trusted")
    good = small_side(labels.filter("quality = 1").select(F.col(id_col).alias(flag + "_id")).distinct())
    columns = list(dict.fromkeys([id_col, lang_col, *keep, text_col]))
    marked = docs.join(good, F.col(id_col) == F.col(flag + "_id"), "left").select(*columns, F.col(flag + "_id").isNotNull().alias(flag))
    found = perplexities(marked, id_col=id_col, text_col=text_col, keep=[lang_col, *keep], trusted_col=flag, order=order)
    trusted = found.filter(F.col(flag))
    q = F.percentile_approx("log_perplexity", share, 10_000)
    overall = trusted.agg(q.alias("q")).first().q
    limits = checkpoint(trusted.groupBy(lang_col).agg(q.alias("own"), F.count("*").alias("n")).select(F.col(lang_col).alias("of_lang"), F.when(F.col("n") >= least_trusted, F.col("own")).otherwise(F.greatest("own", F.lit(overall).cast("double"))).alias("log_limit")))
    if limits.count() <= 10_000:  # a row for each language; beyond this size Spark chooses the join
        limits = F.broadcast(limits)
    joined = found.join(limits, F.col(lang_col) == F.col("of_lang"), "left").withColumn("log_limit", F.coalesce("log_limit", F.lit(overall).cast("double")))
    return joined.select(id_col, lang_col, *keep, "n_bytes", "log_perplexity", "log_limit", F.coalesce(F.col("log_perplexity") <= F.col("log_limit"), F.lit(True)).alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **params) -> DataFrame:
    """The rows of docs that are accepted, with the columns of docs. Rows of one id are judged each by its own text and language."""
    name, row = fresh(docs, "rejected_id"), fresh(docs, "rejected_row")
    key = F.xxhash64(text_col, lang_col)
    judged = classify(docs.withColumn(row, key), labels, id_col=id_col, text_col=text_col, lang_col=lang_col, keep=[row], **params)
    bad = judged.filter("not accepted").select(F.col(id_col).alias(name), row).distinct()
    return docs.join(small_side(bad), F.col(id_col).eqNullSafe(F.col(name)) & (key == F.col(row)), "left_anti")
