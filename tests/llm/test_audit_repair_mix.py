"""Operators 11 to 13 against their SQL and against brute force on small rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, mixing, queries, repair

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, mask string, n bigint"


@pytest.mark.parametrize("name", ["op11_audit", "op12_repair", "op13_mix"])
def test_query_equals_sql(spark, name):
    got, con = queries.QUERIES[name](spark, SMALL), duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert order(got.select(*columns).collect()) == order(want.select(*[f'"{c}"' for c in columns]).fetchall())


def plain_audit(docs, labels):
    """Every order and step on every row."""
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = {}
    for i, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if x)
        rows.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out, removed = {}, {}
    for part, found in rows.items():
        for order in itertools.permutations("ABCDE"):
            left = found
            for k, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in found)
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), failing - len(gone), sum(r[0] == f for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_every_order_on_every_row(spark):
    rng = random.Random(1)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", long, long + " #", "A B C", "a a a a a", long.upper(), " ".join(["same"] * 300), "é" * 40 + " Z", "x y" * 120, long + "\u0085"]
    docs = [(rng.choice([None, k, k // 2]), rng.choice(texts), rng.choice(["en", "", None, "fr"]), "s", "m", 1) for k in range(120)]
    docs += docs[:5]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(None, 1, 1), (4, 1, 1)]
    got = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want) == 3 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_audit_of_empty_tables_and_of_very_long_texts(spark):
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit(*none).count() == 0
    text = b"one two\tthree\n" * 200_000 + b"four" * 400_000  # pieces of a megabyte, and a word longer than one
    assert audit.measure(text) == 2
    assert [w for p in audit._pieces(text) for w in p.split()] == text.split()


def plain_repair(rows):
    """The best of all edit strings, by a search without bounds; rows: (role, text) in order."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\r\x0b\x0c")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [(2 * len(rows), "D" * len(rows), "")]

    def go(k, out, cost, edits, inserted):
        if cost > best[0][0]:
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best[0] = min(best[0], (cost, edits, "\n".join(f"{r}:{t}" for r, t in out)))
        if inserted < 2:
            for name in ("user", "assistant"):
                go(k, [*out, (name, "")], cost + 5, edits + "I", inserted + 1)
        if k < len(rows):
            more = 5 * (faults[k] == "truncated")
            go(k + 1, out, cost + 2, edits + "D", 0)
            if faults[k] not in ("blank", "duplicate"):
                go(k + 1, [*out, rows[k]], cost + more, edits + "K", 0)
                for name in ("user", "assistant"):
                    go(k + 1, [*out, (name, rows[k][1])], cost + 1 + more, edits + "R", 0)

    go(0, [], 0, "", 0)
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (*counts, illegal, best[0][0], best[0][1], hashlib.sha256(best[0][2].encode()).hexdigest())


ROLES, TEXTS = ("system", "user", "assistant", "tool", "", "User"), ("a.", "b!", "c", " ", "d?\n", "e. f", "")


def test_repair_equals_a_plain_search(spark):
    rng, rows, want = random.Random(2), [], {}
    for conv in range(150):
        turns = [(rng.choice(ROLES[:3] if conv % 2 else ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(0, 5))]
        rows += [(conv, k, r, t, "extra") for k, (r, t) in enumerate(turns)]
        if turns:
            want[conv] = (0, *plain_repair(turns))
    rng.shuffle(rows)
    got = repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, audit string")).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_repair_of_nulls_repeats_and_lost_rows(spark):
    rows = [(None, None, None, None, 1), (None, None, None, None, 1), (None, 5, "user", "Hi.", 1), (None, 9, "assistant", "Yes.", 1), ("x", 1, "user", "gone", 0), ("y", 2, "user", "Hi.", 2), ("y", 3, "assistant", "No", 1)]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string, times int")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df, copies=F.col("times")).collect()}
    assert got[None] == (3, *plain_repair([(" ", " "), (" ", " "), ("user", "Hi."), ("assistant", "Yes.")]))
    assert got["x"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got["y"] == (0, *plain_repair([("user", "Hi."), ("user", "Hi."), ("assistant", "No")]))
    assert repair.repair(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_a_conversation_over_many_tasks_and_runs(spark):
    rng = random.Random(3)
    turns = [(k // 2, rng.choice(ROLES[:4]), f"{k // 3} {rng.choice(TEXTS)}") for k in range(6000)]
    turns = sorted(turns, key=lambda r: (r[0], r[1], r[2][:100], hashlib.sha256(r[2].encode()).hexdigest()))
    rows = [("hot", *t) for t in turns] + [(f"c{k}", 0, "user", "Hi.") for k in range(50)]
    rng.shuffle(rows)
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")).collect()}
    assert len(got) == 51 and {(r.cost, r.audit) for c, r in got.items() if c != "hot"} == {(2, "D")}
    # the same by one pass over all states, which needs no bounds
    seen, codes = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\r\x0b\x0c")
        codes.append(repair.code(role[:1], "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
        seen.add((role, text))
    best = {0: (0, ""), 2: (5, "I"), 3: (10, "II")}
    for c in codes:
        after = {}
        for state, (cost, edits) in best.items():
            more = 5 if c.isupper() else 0
            moves = [(state, 2, "D")] + ([] if c == "x" else [(repair.NEXT[state], 1 + more, "R")])
            if c != "x" and (state, c.lower()) in repair.FOLLOWS:
                moves.append((repair.FOLLOWS[state, c.lower()], more, "K"))
            for to, price, e in moves:
                after[to] = min(after.get(to, (10**9, "")), (cost + price, edits + e))
        for state in (0, 1, 3, 2):
            if state in after:
                to = repair.NEXT[state]
                after[to] = min(after.get(to, (10**9, "")), (after[state][0] + 5, after[state][1] + "I"))
        best = after
    hot = got["hot"]
    assert (hot.cost, hot.audit) == min(best[0], best[3])
    edited = repair.Edited(hot.audit)
    for _, role, text in turns:
        edited.row(role, text)
    assert hot.repaired_sha256 == edited.end() and edited.at == len(hot.audit)
    assert hot.gaps == 0 and hot.blank == sum(not t.strip() for _, _, t in turns)


def test_mix_takes_each_target_and_no_row_too_often(spark):
    rng = random.Random(4)
    size = {"a": 5000, "b": 40, "c": 3000, None: 900, "é": 0, "z": 200}
    rows = []
    for source, words in size.items():
        while words > 0:
            n = min(words, rng.choice([1, 7, 30, 700]))
            rows.append((len(rows) % 50 or None, " ".join(["w"] * n), "en", source, "m", 1))
            words -= n
    rows += [(1, "", "en", "é", "m", 1), (1, None, "en", "é", "m", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, carry=("doc_id", "mask", "n")).collect()
    again = mixing.mix(df.repartition(5), carry=("doc_id", "mask", "n")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    order = sorted(size, key=lambda s: (s is None, s))
    weight, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values())
    capped, level = set(), 0
    while True:  # clamp and share out again
        level = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        over = {s for s in size if s not in capped and weight[s] * level > 2 * size[s]}
        if not over:
            break
        capped |= over
    assert capped
    for s in size:
        own = [r for r in got if r.source == s]
        want = 2 * size[s] if s in capped else weight[s] * level
        assert all(r.target == pytest.approx(want) and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want) <= 0.5
        assert sum(0 < r.part < r.size for r in own) <= 1
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.filter("source = 'é'")).collect()} == {0}


def test_mix_when_all_sources_are_clamped_and_by_seed(spark):
    df = spark.createDataFrame([(k, "a b c", "en", "s" if k % 2 else "t", "m", 1) for k in range(40)], DOCS)
    assert {r.taken for r in mixing.mix(df, share=9.0).collect()} == {6}
    one, two = ({r.doc_id for r in mixing.mix(df, share=0.5, seed=s).collect() if r.taken} for s in (0, 1))
    assert one != two
