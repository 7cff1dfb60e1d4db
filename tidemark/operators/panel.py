"""The spine from features to models: keys, availability lookups, the research panel, the model dataset and its feature list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators.tables import keep_one

#: Names and beginnings of columns that a model must not see.
NOT_FEATURES = ("accepted_at_edgar", "accession_lineage_key", "accession_number", "cik", "cik10", "dataset_split_status", "feature_asof_date", "model_feature_columns", "model_feature_count", "model_row_id", "panel_row_id", "primary_document", "sample_weight", "sector", "ticker")
NOT_FEATURE_STARTS = ("forward_", "lineage_", "target_", "y_")
NOT_FEATURE_PARTS = ("availability", "eligible", "flag", "lineage", "notes", "version")
GOOD = ("GREEN", "YELLOW")


def blank(c: Column) -> Column:
    """True for null and for text without anything but spaces."""
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def lineage_key(*parts: Column) -> Column:
    """cik10:accession[:document]; blank parts at the end are left out."""
    return F.concat_ws(":", *[F.when(~blank(p), p) for p in parts])


def accession_key(key: Column) -> Column:
    """The first two parts of a lineage key."""
    return F.array_join(F.slice(F.split(key, ":"), 1, 2), ":")


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """Every column but the keys gets the prefix, unless it has it."""
    return df.select(*[F.col(c) if c in keys or c.startswith(prefix) else F.col(c).alias(prefix + c) for c in df.columns])


def filled(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Blanks of each column come from the other one."""
    return df.withColumns({a: F.when(blank(F.col(a)), F.col(b)).otherwise(F.col(a)) for a, b in pairs.items()})


def lineage_version(df: DataFrame, column: str) -> DataFrame:
    """One row: the smallest version that isn't blank, as lineage_<column>."""
    return df.agg(F.min(F.when(~blank(F.col(column)), F.col(column))).alias(f"lineage_{column}"))


def quality_rank(flag: Column) -> Column:
    return F.when(flag == "GREEN", 0).when(flag == "YELLOW", 1).when(flag == "RED", 2).otherwise(3)


def best_rows(df: DataFrame, keys: list[str], flag: str, asof: str) -> DataFrame:
    """One row of each key: the best flag, then the earliest date; all other columns break ties, so the choice is fixed."""
    return keep_one(df, keys, best_order(df, keys, flag, asof))


def best_order(df: DataFrame, keys: list[str], flag: str, asof: str) -> list[Column]:
    rest = [F.col(c) for c in df.columns if c not in (*keys, flag, asof)]
    return [quality_rank(F.col(flag)), F.asc_nulls_last(asof), *rest]


def least_rows(df: DataFrame, keys: list[str], flag: str, asof: str) -> DataFrame:
    """``best_rows`` for keys with many rows each: a task keeps one row of a key before rows are shuffled."""
    rest = [c for c in df.columns if c not in (*keys, flag, asof)]
    order = [quality_rank(F.col(flag)).alias("_rank"), F.col(asof).isNull().alias("_none"), F.col(asof).alias(asof), *[F.col(c) for c in rest], F.col(flag)]
    found = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_least"))
    return found.select(*[F.col(c) if c in keys else F.col("_least")[c].alias(c) for c in df.columns])


def with_availability(df: DataFrame, availability: DataFrame, values: list[str], order: list[Column], *, cik: str = "cik10", accession: str = "accession_number", key: str = "accession_lineage_key") -> DataFrame:
    """df with values of its filing's availability: found by cik and accession, else by the first two parts of the lineage key.

    Of several rows of a key the last one in ``order`` counts; a value stays null where neither key is known.
    """
    lookup = keep_one(availability.withColumn("_key", lineage_key(F.col(cik), F.col(accession))), ["_key"], order).select("_key", F.struct(*values).alias("_found"))
    first = df.withColumns({"_a": lineage_key(F.col(cik), F.col(accession)), "_b": accession_key(F.col(key))})
    out = first.join(lookup.select(F.col("_key").alias("_a"), F.col("_found").alias("_x")), "_a", "left").join(lookup.select(F.col("_key").alias("_b"), F.col("_found").alias("_y")), "_b", "left")
    kept = [F.col(c) for c in df.columns if c not in values]
    return out.select(*kept, *[F.when(F.col("_x").isNotNull(), F.col(f"_x.{v}")).otherwise(F.col(f"_y.{v}")).alias(v) for v in values])


def text_accounting(text: DataFrame, accounting: DataFrame, key: str = "accession_lineage_key") -> DataFrame:
    """Each text row with the accounting row of its accession (many documents to one accession); names of both sides get _text, _accounting."""
    mark = lambda df, side: df.select(accession_key(F.col(key)).alias("_key"), *[F.col(c).alias(f"{c}_{side}") for c in df.columns])
    return mark(text, "text").join(mark(accounting, "accounting"), "_key").withColumnRenamed("_key", "accession_key")


def panel_gate(require_date: bool = True, require_mismatch: bool = True, require_timestamp: bool = True) -> tuple[Column, Column]:
    """The notes of a panel row, and its flag."""
    mismatch, stamp = F.upper("mismatch_quality_flag"), F.upper("timestamp_quality_flag")
    fund, text = F.upper("fund_fundamental_quality_flag"), F.upper("text_full_parse_quality_flag")
    good = lambda c: F.coalesce(c.isin(*GOOD), F.lit(False))
    named = lambda what, c: F.concat(F.lit(what + "="), F.when(blank(c), "MISSING").otherwise(c))
    bad = [F.when(F.lit(require_date) & blank(F.col("feature_asof_date")), F.lit("missing_feature_asof_date")), F.when(F.lit(require_mismatch) & ~good(mismatch), named("bad_mismatch_quality", mismatch)), F.when(F.lit(require_timestamp) & ~good(stamp), named("bad_timestamp_quality", stamp)), F.when(fund == "RED", F.lit("fundamental_quality_red")), F.when(text == "RED", F.lit("text_parse_quality_red")), F.when(blank(F.col("dfm_score_simple")), F.lit("missing_dfm_score_simple"))]
    weak = [F.when(blank(fund), F.lit("fundamental_quality_missing")), F.when(blank(text), F.lit("text_parse_quality_missing"))]
    # in the order in which a reader checks a row: date, mismatch, time, accounting, text, score
    order = [*bad[:3], bad[3], weak[0], bad[4], weak[1], bad[5]]
    notes = F.array_join(F.array_compact(F.array(*order)), ";")
    return notes, E.flag(F.coalesce(*bad).isNotNull(), F.coalesce(*weak).isNotNull())


def research_panel(mismatch: DataFrame, fund: DataFrame, text: DataFrame, availability: DataFrame, **gates: bool) -> DataFrame:
    """Mismatch rows with accounting (by accession), text (by document) and availability columns, gated.

    Columns of the other sides are prefixed fund_ and text_; blank as-of dates, times and timestamp flags come from availability.
    mismatch: accession_lineage_key, cik10, accession_number, feature_asof_date, mismatch_quality_flag, dfm_score_simple, ...;
    fund: accession_lineage_key, fundamental_quality_flag, feature_asof_date, ...; text: accession_lineage_key,
    full_parse_quality_flag, feature_asof_date, ...; availability: cik10, accession_number, first_allowed_execution_date,
    accepted_at_edgar, timestamp_quality_flag. Each side gives one row for a key, by quality and date.
    """
    key = "accession_lineage_key"
    # rows are dealt by accession once, where accounting and availability meet them, and once by document for the texts
    # (_own is null where the row's own numbers name the key's accession, as they do as a rule)
    own = lineage_key(F.col("cik10"), F.col("accession_number"))
    rows = mismatch.withColumn("_acc", accession_key(F.col(key))).withColumn("_own", F.when(~own.eqNullSafe(F.col("_acc")), own)).repartition("_acc")
    left = keep_one(rows, ["_acc", key], best_order(mismatch, [key], "mismatch_quality_flag", "feature_asof_date"))
    f = least_rows(fund.withColumn("_acc", accession_key(F.col(key))).drop(key, "cik10", "accession_number"), ["_acc"], "fundamental_quality_flag", "feature_asof_date")
    t = best_rows(text.drop("cik10", "accession_number"), [key], "full_parse_quality_flag", "feature_asof_date")
    found = {"first_allowed_execution_date": "_av_date", "accepted_at_edgar": "_av_time", "timestamp_quality_flag": "_av_flag"}
    av = availability.select(lineage_key(F.col("cik10"), F.col("accession_number")).alias("_acc"), F.struct(*[F.col(a).alias(b) for a, b in found.items()]).alias("_found"))
    av = av.groupBy("_acc").agg(F.max("_found").alias("_found"))
    met = left.join(prefixed(f, "fund_", ["_acc"]), "_acc", "left").join(av, "_acc", "left")
    # the filing's own numbers come before the key's; where both name one accession, they have met
    same = F.col("_own").isNull()
    other = met.filter(~same).join(av.select(F.col("_acc").alias("_own"), F.col("_found").alias("_first")), "_own", "left")
    met = met.filter(same).unionByName(other.withColumn("_found", F.coalesce("_first", "_found")).drop("_first")).drop("_acc", "_own")
    out = met.select("*", "_found.*").drop("_found").join(prefixed(t, "text_", [key]), key, "left")
    for target, source in (("feature_asof_date", "_av_date"), ("accepted_at_edgar", "_av_time"), ("timestamp_quality_flag", "_av_flag")):
        out = filled(out, {target: source}) if target in out.columns else out.withColumn(target, F.col(source))
    notes, flag = panel_gate(**gates)
    out = out.drop(*found.values()).withColumns({"panel_quality_notes": notes, "panel_quality_flag": flag})
    return out.withColumns({"panel_eligible": F.col("panel_quality_flag") != "RED", "panel_row_id": F.col(key)})


def model_dataset(panel: DataFrame, targets: DataFrame, *, label: str = "forward_63d_sector_adjusted_return", allow_yellow_panel: bool = True, allow_yellow_target: bool = True) -> DataFrame:
    """Panel rows with their targets, gate notes, flag, eligibility and weight (1 if eligible, else 0).

    Both sides are joined by panel_row_id, of which each gives one row, by quality and date. ticker and sector of the panel are
    filled from the targets where they are blank. A target that ends no later than it begins is YELLOW and stays eligible.
    """
    key = "panel_row_id"
    t = least_rows(targets, [key], "target_quality_flag", "target_entry_date")
    shared = [c for c in t.columns if c != key and c in panel.columns]
    t = t.select(key, *[F.col(c).alias(f"_{c}" if c in shared else c) for c in t.columns if c != key])
    joined = best_rows(panel, [key], "panel_quality_flag", "feature_asof_date").join(t, key, "left")
    joined = filled(joined, {c: f"_{c}" for c in shared}).drop(*[f"_{c}" for c in shared])
    allowed = lambda c, yellow: F.coalesce(F.upper(c).isin(*(GOOD if yellow else GOOD[:1])), F.lit(False))
    named = lambda what, c: F.concat(F.lit(what + "="), F.when(blank(F.col(c)), "MISSING").otherwise(F.upper(c)))
    asof, entry, end = (F.to_date(c) for c in ("feature_asof_date", "target_entry_date", "target_exit_date"))
    red = [F.when(~F.coalesce(F.col("panel_eligible"), F.lit(False)), F.lit("panel_not_eligible")), F.when(~allowed("panel_quality_flag", allow_yellow_panel), named("bad_panel_quality", "panel_quality_flag")), F.when(~F.coalesce(F.col("target_available"), F.lit(False)), F.lit("target_not_available")), F.when(~allowed("target_quality_flag", allow_yellow_target), named("bad_target_quality", "target_quality_flag")), F.when(E.strict_double(F.col(label)).isNull(), F.lit("missing_primary_label_" + label)), *[F.when(c.isNull(), F.lit("missing_or_invalid_" + n)) for n, c in (("feature_asof_date", asof), ("target_entry_date", entry), ("target_exit_date", end))], F.when(entry < asof, F.lit("target_entry_before_feature_asof"))]
    yellow = F.when(end <= entry, F.lit("target_exit_not_after_entry"))
    out = joined.withColumns({"model_dataset_quality_notes": F.array_join(F.array_compact(F.array(*red, yellow)), ";"), "model_dataset_quality_flag": E.flag(F.coalesce(*red).isNotNull(), yellow.isNotNull())})
    eligible = F.col("model_dataset_quality_flag") != "RED"
    return out.withColumns({"model_dataset_eligible": eligible, "sample_weight": F.when(eligible, 1.0).otherwise(0.0), "model_row_id": F.col(key)})


def feature_candidates(columns: list[str]) -> list[str]:
    """Names that may be features, sorted: no keys, targets, labels, lineage, availability, flags, notes or versions."""
    named = lambda c: c in NOT_FEATURES or c.startswith(NOT_FEATURE_STARTS) or any(p in c for p in NOT_FEATURE_PARTS)
    return sorted(c for c in columns if not named(c.lower()))


def feature_list(df: DataFrame) -> DataFrame:
    """(feature, numeric_rows): candidates with any numeric value, from one aggregation over all of them."""
    names = feature_candidates(df.columns)
    counts = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.count(E.strict_double(F.col(c))).alias("numeric_rows")) for c in names]).alias("xs"))
    return counts.select(F.explode("xs").alias("x")).select("x.*").filter("numeric_rows > 0")
