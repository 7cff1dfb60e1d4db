"""Operators 1, 2, 3, 4, 8, 9 and the pipeline against plain versions, invariants and held-out documents."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, common, hpylm, licenses, quality, queries, rules, shards, substrings

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n", "a", "The THE the", "é ü\nß\n\né ü", "x" * 3000, "ab " * 4000]
SCHEMA = "doc_id long, text string, lang string, source string, size string, block string, stats string"


def frame(spark, texts):
    rows = [(k, t, "en", None, "s", "b", "c") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]] if rows else [], SCHEMA)


def plain_repeats(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % substrings.V for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.V))


def test_repeats_against_every_window(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdeé ", k=r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(130) for _ in range(4)]
    texts = [*ODD, *(text(r.randint(0, 200)) + r.choice(passages)[r.randint(0, 60) :] + text(r.randint(0, 90)) for _ in range(40)), passages[0][:399], passages[0]]
    got = sorted(substrings.repeated(frame(spark, texts)).collect(), key=lambda x: x.doc_id)
    want = plain_repeats([*texts, texts[-1]], 400)
    assert len(got) == len(want)
    for row, (spans, kept) in zip(got, want, strict=True):
        assert [(s.start, s.end) for s in row.spans] == spans
        assert bytes(row.kept) == kept and row.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert substrings.repeated(frame(spark, [])).count() == 0


def test_names_of_a_range_meet_in_bounded_memory():
    r = np.random.default_rng(5)
    held = [r.choice(1_500_000, 150_000, replace=False) * 7919 for _ in range(20)]
    wanted = [r.random(len(x)) < 0.5 for x in held]
    sent = [substrings._sent(np.concatenate((x, x[:5])) << 2, 1, np.concatenate((w, w[:5]))) for x, w in zip(held, wanted, strict=True)]
    rows = pa.table({"block": pa.array(range(20, 0, -1), pa.int64()), "names": pa.array([x[0]["names"] for x in sent], pa.binary())})
    places = Counter(np.concatenate(held).tolist() + [v for x in held for v in x[:5].tolist()])
    asked = set(np.concatenate([x[w] for x, w in zip(held, wanted, strict=True)]).tolist())
    for any_asks in (False, True):
        tracemalloc.start()
        got = substrings._meet(rows, any_asks)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 45 * sum(map(len, held))  # bytes: values and where they came from, and what is sent back
        by = dict(zip(got["block"].to_pylist(), got["names"].to_pylist(), strict=True))
        for k, (x, w) in enumerate(zip(held, wanted, strict=True)):
            want = [v for v, a in zip(x.tolist(), w.tolist(), strict=True) if (v in asked if any_asks else a and places[v] > 1)]
            assert (substrings._unpacked(by[20 - k]) >> np.uint64(2)).tolist() == sorted(want)


def test_shards_are_even_gapless_and_split_hot_groups(spark):
    r = random.Random(4)
    texts = [*ODD, *("hot text " * 30 for _ in range(900)), *(str(k) * r.randint(1, 200) for k in range(1800))]
    got = shards.assign(frame(spark, texts), 16).collect()
    assert len(got) == len(texts) + 1
    sizes, slots = Counter(), {}
    for row in got:
        assert row.size == len((row.text or "").encode()) + 1 and row.text_crc32 == zlib.crc32((row.text or "").encode())
        sizes[row.shard] += row.size
        slots.setdefault(row.shard, []).append(row.slot)
    assert set(sizes) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 16
    assert max(abs(s - mean) for s in sizes.values()) < 0.1 * mean + 12_000
    assert shards.assign(frame(spark, []), 16).count() == 0


def test_shards_leave_columns_with_the_names_of_inner_ones_alone(spark):
    inner = {"hi": F.lit(77), "LO": F.lit("l"), "range": F.lit("x"), "cell": F.col("doc_id"), "place": F.lit(None).cast("int"), "from": F.lit(1.5), "n": F.lit(3), "shard_hi": F.lit("y")}
    docs = frame(spark, ["one", "two", None, "two", "x" * 900]).withColumns(inner)
    got = shards.assign(docs, 2)
    assert got.columns == [c for c in docs.columns if c != "size"] + ["size", "text_crc32", "shard", "slot"]
    plain = {(r.doc_id, r.slot, r.shard) for r in shards.assign(docs.select("doc_id", "text"), 2).collect()}
    rows = got.collect()
    assert {(r.doc_id, r.slot, r.shard) for r in rows} == plain and len(rows) == 6
    assert all((r.hi, r["LO"], r["range"], r.cell, r.place, r["from"], r.n, r.shard_hi) == (77, "l", "x", r.doc_id, None, 1.5, 3, "y") for r in rows)


def test_statistics_against_plain_counts(spark):
    r = random.Random(8)
    texts = [*ODD, "one two three four five one two three four five", *("\n".join(" ".join(r.choices(["a", "b", "C|", "dé"], k=r.randint(0, 9))) for _ in range(r.randint(1, 30))) for _ in range(60))]
    for row in rules.statistics(frame(spark, texts)).collect():
        t, s = row.text or "", row.stats
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_rules_find_the_planted_threshold_and_none_without_labels(spark):
    r = random.Random(1)
    rows = [(k, " ".join(["w*"] * r.randint(5, 9) + ["w"] * r.randint(20, 40)) if k % 4 == 0 else " ".join(["w"] * 40 + ["x*"] * r.randint(0, 2))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(300)] + [(None, 0), (5, None)], "doc_id long, quality int")
    found, learned = rules.apply(docs, labels)
    assert learned and all(bool(x.rule) == (x.doc_id % 4 == 0) for x in found.collect())
    found, learned = rules.apply(docs, labels.filter("false"))
    assert not learned and found.filter("rule > 0").count() == 0


def test_rules_are_learned_from_a_small_share_of_many_labelled_rows(spark):
    rows = spark.range(6_000_000).select(F.col("id"), (F.xxhash64("id", F.lit(1)) % 100 / 100.0).alias("x"))
    fold = F.pmod(F.xxhash64("id"), F.lit(rules.FOLDS))
    learned = rules.learn(rows, {"x": F.col("x")}, bad=F.col("x") > 0.5, fold=fold, max_rows=1000)
    assert learned and rows.filter((rules.rejected_by(learned, {"x": F.col("x")}) > 0) & (F.col("x") <= 0.4)).count() == 0


def plain_grams(text, order, end):
    data = b"\xff" * (order - 1) + text + b"\xfe" * end
    return [int.from_bytes(data[i : i + order], "big") for i in range(len(data) - order + 1)]


def test_grams_of_texts():
    texts = [b"", b"abc", b"", b"xyzzy", b"q"]
    for end in (False, True):
        got, first = blocks.grams_of(texts, 4, end)
        assert [got[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [plain_grams(t, 4, end) for t in texts]


def test_kneser_ney_probabilities_sum_to_one(spark):
    counts = Counter(g for t in (b"banana band", b"bandana", b"an ant") for g in plain_grams(t, 3, False))
    table = spark.createDataFrame(list(counts.items()), "k long, c long")
    for context in (b"an", b"zz", b"\xff\xff"):
        h = int.from_bytes(context, "big") << 8
        wanted = spark.createDataFrame([(h | s,) for s in range(256)], "k long")
        total = sum(math.exp(r.logp) for r in quality.kneser_ney(table, wanted, 3, symbols=256).collect())
        assert abs(total - 1) < 1e-4


def test_python_gets_texts_by_bytes(spark):
    rows = spark.range(0, 200, 1, 1).select(F.lit("x" * 1000).alias("text"))
    most = lambda: rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"]) for b in batches), "n long").agg(F.max("n")).first()[0]
    with common.arrow_bytes(spark, 10_000):
        assert most() < 20
    assert most() == 200


def test_small_dishes_are_drawn_in_bounded_memory():
    n = 1 << 12
    full = lambda x, kind: np.full(n, x, kind)
    hpylm._log_stirling(0.4)
    tracemalloc.start()
    hpylm._drawn_small(full(8, np.int64), full(1.0, float), full(-1.0, float), full(0.5, float), 0.4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


@pytest.mark.parametrize("n_distinct", [50, 400_000])
def test_counts_and_answers_of_keys(n_distinct):
    r = np.random.default_rng(3)
    keys = [r.integers(-n_distinct, n_distinct, k) for k in (0, 700_000, 5, 600_000)]
    groups = np.array([0, 1, -1, 0])
    of = lambda texts: (np.concatenate([keys[int(t[:1])] for t in texts]), np.cumsum([0, *(len(keys[int(t[:1])]) for t in texts)]))
    got, counts = blocks.counted([str(k).encode() * (1 << 20) for k in range(4)], of, groups, 2)
    want = {k: [0, 0] for k in np.concatenate(keys).tolist()}
    for ks, g in zip(keys, groups, strict=True):
        for k in ks.tolist() if g >= 0 else []:
            want[k][g] += 1
    assert dict(zip(got.tolist(), counts.tolist(), strict=True)) == want
    asked = r.permutation(np.concatenate(keys))
    assert (blocks.Answers(got[::-1], got[::-1] * 3)(asked) == asked * 3).all()


def test_gibbs_tables_follow_the_exact_posterior():
    # four customers of one dish, all partitions of them weighed by the process itself
    theta, d, rest, p = 1.0, 0.4, 3, 0.3

    def weigh(sizes, left):
        if not left:
            return {len(sizes): 1.0}
        out = Counter()
        for k, n in enumerate(sizes):
            for t, w in weigh([*sizes[:k], n + 1, *sizes[k + 1 :]], left - 1).items():
                out[t] += w * (n - d)
        for t, w in weigh([*sizes, 1], left - 1).items():
            out[t] += w * (theta + d * (rest + len(sizes))) * p
        return out

    exact = weigh([], 4)
    n = 20_000
    full = lambda x, kind: np.full(n, x, kind)
    tables, mean = hpylm.gibbs(full(4, np.int64), full(rest, np.int64), full(p, float), np.arange(n), theta=theta, discount=d, salt=(1,), moves=40)
    share = Counter(tables.tolist())
    for t, w in exact.items():
        assert abs(share[t] / n - w / sum(exact.values())) < 0.015
    again, _ = hpylm.gibbs(full(4, np.int64)[:7], full(rest, np.int64)[:7], full(p, float)[:7], np.arange(7), theta=theta, discount=d, salt=(1,), moves=40)
    assert again.tolist() == tables[:7].tolist()  # whatever stands beside a dish


def test_language_model_beats_the_base_on_held_out_documents(spark):
    rows = queries.op2_hpylm(spark, SMALL.replace("sf0.001", "sf0.01")).filter("held_out and n_tokens > 1").collect()
    assert sum(r.score > r.base_score for r in rows) >= 0.6 * len(rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.985


def test_language_model_sums_to_one_and_base_is_exact(spark):
    counts = Counter(g for t in (b"banana band", b"bandana", b"an ant") for g in plain_grams(t, 3, True))
    table = spark.createDataFrame(list(counts.items()), "k long, c long")
    wanted = spark.createDataFrame([((int.from_bytes(b"an", "big") << 8) | s,) for s in range(256)], "k long")
    assert abs(sum(r.p for r in hpylm.byte_model(table, wanted, 3, symbols=256).collect()) - 1) < 1e-6
    texts = [*ODD, *(f"common words and {k % 7} rare{k}" for k in range(60))]
    got = hpylm.score(frame(spark, texts), held_out=F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect()
    assert len(got) == len(texts) + 1
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    c = Counter()
    for k, t in enumerate([*texts, texts[-1]]):
        k = min(k, len(texts) - 1)
        if zlib.crc32(str(k).encode()) % 10:
            c.update([*cut(t), None])
    n, v = sum(c.values()), len(c)
    for row in got:
        ws = [*cut(texts[row.doc_id]), None]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(row.base_score - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * len(ws)
        assert row.score < 0 and math.isfinite(row.score) and row.perplexity > 1


def test_quality_keeps_clean_and_rejects_junk(spark):
    large = SMALL.replace("sf0.001", "sf0.01")  # trusted texts are scored without themselves, so each language needs some
    found = queries.op8_quality(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert sum(r.accepted for r in good) >= 0.98 * len(good) and sum(not r.accepted for r in bad) >= 0.8 * len(bad)
    none = quality.classify(frame(spark, ODD), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(none) == len(ODD) + 1 and all(r.accepted for r in none)


@pytest.fixture
def licence_texts():
    return [*ODD, *("the red fox and the dog ran over hill number %d\nwith many words of no such thing at all" % k for k in range(60)), "intro\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "All rights reserved by someone", "see the license plate"]


def test_licences_are_confirmed_by_templates(spark, licence_texts):
    found = {(r.doc_id, r.paragraph): r.family for r in licenses.scan(frame(spark, licence_texts)).collect()}
    n = len(licence_texts)
    assert found[(n - 4, 1)] == "MIT" and found[(n - 3, 0)] == "Apache-2.0" and found[(n - 2, 0)] == "unknown" and found[(n - 1, 0)] == "unknown"
    assert all(k >= n - 4 for k, _ in found)


def test_every_line_trains_the_licence_model(spark, monkeypatch):
    seen, fit = [], licenses.NaiveBayes.fit
    monkeypatch.setattr(licenses.NaiveBayes, "fit", lambda self, rows: seen.append(rows.filter(F.col("label") < licenses.PARTS).count()) or fit(self, rows))
    texts = ["\n".join(f"word{k} and line {i} of many" for i in range(500)) for k in range(60)] + ["Released under the MIT License.\nno such thing"]
    found = licenses.scan(frame(spark, texts)).collect()
    assert seen == [60 * 500 + 2 + licenses.PARTS]  # the last text stands twice; an empty line for each part
    assert [(r.doc_id, r.paragraph, r.family) for r in found] == [(60, 0, "MIT")] * 2


def test_pipeline_keeps_columns_and_applies_its_decisions(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in P.STAGES[:2]:
        out = stage(spark, docs, SMALL)
        assert out.schema.names == docs.schema.names and 0 < out.count() < docs.count()
    assert P.run(spark, SMALL).count() > 0


@pytest.mark.parametrize(("customers", "rest", "p", "d"), [(40, 2, 0.3, 0.5), (900, 40, 0.9, 0.6), (3000, 3, 0.2, 0.7)])
def test_all_customers_of_a_dish_are_drawn(customers, rest, p, d):
    theta, n = 1.0, 4000
    logs = np.zeros(1)  # by the recursion of Stirling numbers, t from 1
    for c in range(1, customers):
        t = np.arange(1, c + 1)
        logs = np.logaddexp(np.append(np.log(c - d * t) + logs, -np.inf), np.append(-np.inf, logs))
    t = np.arange(1, customers + 1)
    w = logs + np.cumsum(np.log(theta + d * (rest + t - 1)) + np.log(p))
    w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    want, spread = (w * t).sum(), np.sqrt((w * t * t).sum() - (w * t).sum() ** 2)
    full = lambda x, kind: np.full(n, x, kind)
    tables, mean = hpylm.gibbs(full(customers, np.int64), full(rest, np.int64), full(p, float), np.arange(n), theta=theta, discount=d, salt=(1,))
    assert np.allclose(mean, want, rtol=1e-4)
    assert abs(tables.mean() - want) < 5 * spread / n**0.5 and 0.93 < tables.std() / spread < 1.07


def test_counts_of_a_block_do_not_depend_on_how_runs_are_merged(monkeypatch):
    texts = [(f"text {k} of {k % 7} " * 9).encode() for k in range(40)]
    by = lambda: dict(zip(*(x.tolist() for x in blocks.counted(texts, lambda ts: blocks.grams_of(ts, 4, True), np.arange(40) % 3 - 1, 2)), strict=True))
    once = by()
    monkeypatch.setattr(blocks, "RUN_BYTES", 500)
    monkeypatch.setattr(blocks.runs, "__defaults__", (500,))
    assert by() == once and sum(x for x, _ in once.values()) == sum(len(t) + 1 for k, t in enumerate(texts) if k % 3 == 1)
