"""Quality rules (operator 9): decision lists learned from labelled statistics, emitted as Spark conditional expressions.

Sequential covering: a rule is grown one threshold condition at a time on two thirds of the labelled rows that no earlier rule covers,
taking the condition with the best information gain (of equal ones on a feature, the one that holds for more values); it is pruned on the other third by dropping final conditions while that helps;
it is accepted if it is right often enough there. All counts are grouped sums over the labelled statistics; the driver sees a row of
counts for each round, never the rows. What comes out is an ordered list of conditions, so it reads and runs as one CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: A word, for Java's regular expressions; and the symbols that are counted.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Values over which labelled rows are dealt out for sampling, fine enough for any number of rows.
FOLDS = 1 << 40
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def _code_points(c: Column) -> Column:
    return F.length(c).cast("bigint")


def statistics(docs: DataFrame, *, text_col: str = "text", window: int = 5, out: str = "stats") -> DataFrame:
    """docs with a struct column ``out`` of bigint STATISTICS, over whole texts and inside each row only (no shuffle).

    Null and empty texts have zeros. A word belongs to n_repeat_words if it stands in a window of ``window`` words that the text
    holds twice or more. Windows are compared by 64-bit hashes of their words. A column of docs called ``out`` is replaced.
    """
    text, words, lines, wins, marks = (fresh(docs, n) for n in ("_text", "_words", "_lines", "_windows", "_marks"))
    step = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    step = step.withColumns({words: F.filter(F.split(text, SPACES), lambda w: w != ""), lines: F.filter(F.split(text, "\n"), lambda s: F.length(F.regexp_replace(s, SPACES, "")) > 0)})
    n = F.size(words)
    # windows sorted by hash and then position: equal windows become neighbours
    step = step.withColumn(wins, F.when(n >= window + 1, F.sort_array(F.transform(F.sequence(F.lit(0), n - window), lambda i: F.struct(F.xxhash64(*[F.get(F.col(words), i + j) for j in range(window)]).alias("h"), i.alias("i"))))))
    as_at = lambda x, k: F.coalesce(F.get(F.col(wins), k)["h"] == x["h"], F.lit(False))
    twice = F.filter(F.transform(wins, lambda x, k: F.when(as_at(x, k - 1) | as_at(x, k + 1), x["i"])), lambda p: p.isNotNull())
    step = step.withColumn(marks, F.sort_array(F.coalesce(twice, F.array().cast("array<int>"))))
    covered = F.aggregate(F.transform(marks, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(F.col(marks), k + 1) - p, F.lit(window)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    sizes = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    made = F.struct(
        n.cast("bigint").alias("n_words"),
        sizes.alias("word_chars"),
        _code_points(F.regexp_replace(text, SYMBOLS, "")).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        _code_points(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_upper"),
        _code_points(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("n_letters"),
    )
    return step.withColumn(out, made).drop(text, words, lines, wins, marks)


def features(stats: str = "stats") -> dict[str, Column]:
    """The ratios that rules may test; a ratio to nothing is null, and no condition holds for null."""
    c = lambda name: F.col(f"{stats}.{name}").cast("double")
    return {
        "n_words": c("n_words"),
        "chars_per_word": F.try_divide(c("word_chars"), c("n_words")),
        "symbols_per_word": F.try_divide(c("n_symbols"), c("n_words")),
        "dup_line_share": F.try_divide(c("n_dup_lines"), c("n_lines")),
        "repeat_word_share": F.try_divide(c("n_repeat_words"), c("n_words")),
        "upper_share": F.try_divide(c("n_upper"), c("n_letters")),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def on(self, columns: dict[str, Column]) -> Column:
        c = columns[self.feature]
        return F.coalesce(c > self.limit if self.above else c <= self.limit, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.on(columns)
    return out


def rejected_by(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The number of the first rule that holds (from 1), 0 if none does."""
    if not rules:
        return F.lit(0)
    case = F.when(holds(rules[0], columns), 1)
    for k, rule in enumerate(rules[1:], 2):
        case = case.when(holds(rule, columns), k)
    return case.otherwise(0)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else -1.0


def learn(labelled: DataFrame, columns: dict[str, Column], *, bad: Column, fold: Column, max_rows: int = 20_000, cuts: int = 24, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.95, least_covered: int = 5) -> list[Rule]:
    """Rules that find bad rows, most useful first; none without bad and other rows.

    Learning uses at most about max_rows labelled rows (a documented bound for fitting only): those whose fold value, spread evenly
    over 0 to FOLDS - 1, lies under the share that gives max_rows. A third of them, by a hash of its own, prunes rules. Thresholds
    are quantiles of each feature over these rows.
    """
    names = list(columns)
    total = labelled.count()
    share = FOLDS if total <= max_rows else FOLDS * max_rows // total
    rows = checkpoint(labelled.filter(fold < share).select(*[c.alias(k) for k, c in columns.items()], bad.alias("bad"), (F.pmod(F.xxhash64(fold, F.lit("test")), F.lit(3)) == 0).alias("test")))
    own = {k: F.col(k) for k in names}
    steps = [(i + 0.5) / cuts for i in range(cuts)]
    sides = [F.col("bad"), ~F.col("bad")]
    found = rows.agg(*[F.percentile_approx(F.when(side, F.col(k)), [*steps, 0.999], 1000) for k in names for side in sides]).first()
    limits = [sorted({*map(float, found[2 * j] or []), *map(float, found[2 * j + 1] or [])}) for j in range(len(names))]
    # a value's bin is the number of limits below it, so counts for each bin give those of every condition on the feature
    def bin_of(value: Column, cut_at: list[float]) -> Column:
        below = F.filter(F.array(*[F.lit(x) for x in cut_at]).cast("array<double>"), lambda x: x < value)
        return F.when(value.isNull(), -1).otherwise(F.size(below))

    rows = checkpoint(rows.withColumn("bins", F.array(*[bin_of(own[k], limits[j]) for j, k in enumerate(names)])))

    def counts(where: Column) -> tuple[int, int]:
        return tuple(rows.filter(where).agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first())

    def candidates(where: Column) -> list[tuple[int, int, Condition]]:
        got = rows.filter(where).select("bad", F.posexplode("bins").alias("f", "bin")).filter("bin >= 0").groupBy("f", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        out = []
        for j, k in enumerate(names):
            by = [(r.bin, r.p, r.n) for r in got if r.f == j]
            for i, limit in enumerate(limits[j]):
                for above in (True, False):
                    held = [(p, n) for b, p, n in by if (b > i) == above]
                    out.append((sum(p for p, _ in held), sum(n for _, n in held), Condition(k, above, limit)))
        return out

    rules: list[Rule] = []
    while len(rules) < max_rules:
        free = F.lit(True)
        for rule in rules:
            free = free & ~holds(rule, own)
        grow, prune = free & ~F.col("test"), free & F.col("test")
        rule: Rule = ()
        p0, n0 = counts(grow)
        if p0 < least_covered:
            break
        while n0 and len(rule) < max_conditions:
            p, n, best = max(candidates(grow & holds(rule, own)), key=lambda x: (_gain(x[0], x[1], p0, n0), x[2].feature, x[2].above, -x[2].limit if x[2].above else x[2].limit))
            if _gain(p, n, p0, n0) <= 0:
                break
            rule, p0, n0 = (*rule, best), p, n
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        worth = [counts(prune & holds(r, own)) for r in shorter]
        rule = max(zip(worth, shorter, strict=True), key=lambda x: ((x[0][0] - x[0][1]) / (sum(x[0]) or 1), len(x[1])))[1]
        p, n = counts(free & holds(rule, own))
        if p < least_covered or p < least_precision * (p + n):
            break
        rules.append(rule)
    return rules


def apply(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stats: str = "stats", out: str = "rule", **params) -> tuple[DataFrame, list[Rule]]:
    """docs with the columns ``stats`` and ``out`` (number of the rule that rejects the row, 0 if none), and the rules.

    labels: (id_col, quality), quality 0 being bad; null qualities and ids don't teach. Without labels there are no rules.
    """
    measured = statistics(docs, text_col=text_col, out=stats)
    taught = labels.filter("quality is not null").select(F.col(id_col).alias("label_id"), (F.col("quality") == 0).alias("is_bad")).groupBy("label_id").agg(F.max("is_bad").alias("is_bad"))
    labelled = statistics(docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("t")).join(taught, "label_id"), text_col="t", out=stats)
    rules = learn(labelled, features(stats), bad=F.col("is_bad"), fold=F.pmod(F.xxhash64("label_id"), F.lit(FOLDS)), **params)
    return measured.withColumn(out, rejected_by(rules, features(stats))), rules
