"""Filings: events from metadata, headers, availability, the choice of documents, sections."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tidemark.functions import expr as E

#: Header fields and the patterns of their values.
HEADER_FIELDS = {
    "accession_number_header": r"ACCESSION NUMBER:\s*([0-9\-]+)",
    "submission_type_header": r"CONFORMED SUBMISSION TYPE:\s*([A-Z0-9/\-]+)",
    "filed_as_of_date_header": r"FILED AS OF DATE:\s*(\d{8})",
    "period_of_report_header": r"CONFORMED PERIOD OF REPORT:\s*(\d{8})",
    "company_conformed_name": r"COMPANY CONFORMED NAME:\s*(.+)",
    "central_index_key": r"CENTRAL INDEX KEY:\s*(\d+)",
    "standard_industrial_classification": r"STANDARD INDUSTRIAL CLASSIFICATION:\s*(.+)",
    "irs_number": r"IRS NUMBER:\s*(\d+)",
    "state_of_incorporation": r"STATE OF INCORPORATION:\s*([A-Z]+)",
    "fiscal_year_end": r"FISCAL YEAR END:\s*(\d{4})",
}
#: The start of a submission that holds its header; that limit is the format's.
HEADER_CHARS = 250_000
FORMS = ("10-K", "10-Q")


def filing_events(raw: DataFrame, *, forms: tuple[str, ...] = FORMS, lowest: str | None = None, highest: str | None = None) -> DataFrame:
    """One row for each filing of the wanted forms and dates, the last one of (cik10, accession), with warnings joined by semicolons."""
    names = {"accessionNumber": "accession", "filingDate": "filing_date", "reportDate": "report_date", "acceptanceDateTime": "accepted", "form": "form", "primaryDocument": "primary_document"}
    cik = E.cik10(F.coalesce(F.nullif("cik", F.lit("")), F.col("file_cik")))
    rows = raw.select("source_file", cik.alias("cik10"), F.posexplode(F.arrays_zip(*[F.col(f"filings.recent.{n}").alias(n) for n in names])).alias("at", "f"))
    flat = rows.select("source_file", "cik10", "at", *[F.nullif(F.trim(f"f.{n}"), F.lit("")).alias(c) for n, c in names.items()]).filter("accession is not null")
    flat = flat.withColumn("repeated", F.row_number().over(Window.partitionBy("source_file", "accession").orderBy("at")) > 1)
    kept = flat.filter(F.upper("form").isin(*forms))
    date = F.expr("try_to_date(filing_date, 'yyyy-MM-dd')")
    for bound, test in ((lowest, lambda d: d >= F.lit(lowest).cast("date")), (highest, lambda d: d <= F.lit(highest).cast("date"))):
        kept = kept.filter(test(date)) if bound else kept
    warned = kept.withColumn("warnings", E.notes({"duplicate_accession_in_source_json": F.col("repeated"), "missing_filing_date": F.col("filing_date").isNull(), "missing_report_date": F.col("report_date").isNull(), "missing_primary_document": F.col("primary_document").isNull(), "missing_acceptance_datetime_in_submissions_metadata": F.col("accepted").isNull()}))
    last = F.row_number().over(Window.partitionBy("cik10", "accession").orderBy(F.desc("source_file"), F.desc("at")))
    return warned.withColumn("_row", last).filter("_row = 1").drop("_row", "repeated", "at")


def header_fields(texts: DataFrame, column: str = "value") -> DataFrame:
    """texts with header fields, first match each, and accepted_raw; absent ones are null. The header ends where the first document starts,
    and is looked for in the first HEADER_CHARS characters."""
    header = F.element_at(F.split(F.element_at(F.split(F.substring(column, 1, HEADER_CHARS), "(?i)</(?:SEC|IMS)-HEADER>", 2), 1), "(?i)<DOCUMENT>", 2), 1)
    got = texts.withColumn("_header", F.substring(header, 1, 200_000))
    first = lambda p: F.nullif(F.trim(F.regexp_extract("_header", f"(?i){p}", 1)), F.lit(""))
    return got.withColumns({k: first(p) for k, p in HEADER_FIELDS.items()} | {"accepted_raw": first(r"<ACCEPTANCE-DATETIME>\s*(\d{14})")}).drop("_header")


def calendar(bounds: DataFrame, holidays: list[str] = ()) -> DataFrame:
    """(date, next_day, second_day) for every date from lo to hi of a one-row table: the next two weekdays that are no holidays. A row a day."""
    days = bounds.select(F.explode(F.sequence("lo", F.date_add("hi", 40))).alias("date"), F.col("hi"))
    open_day = (F.weekday("date") < 5) & ~F.coalesce(F.col("date").isin(*[F.lit(h).cast("date") for h in holidays]), F.lit(False)) if holidays else F.weekday("date") < 5
    after = Window.orderBy("date").rowsBetween(1, Window.unboundedFollowing)  # some thousand days
    step = days.withColumn("next_day", F.first(F.when(open_day, F.col("date")), ignorenulls=True).over(after))
    second = step.select(F.col("date").alias("next_day"), F.col("next_day").alias("second_day"))
    return step.filter("date <= hi").join(F.broadcast(second), "next_day", "left").select("date", "next_day", "second_day")


def trading_calendar(days: DataFrame) -> DataFrame:
    """(date, next_day, second_day) for every date from the first trading day to the one before the last: the next two trading days after it.

    days: (date), any number of rows for a day, such as those of a price table; days without a price are holidays. One row a day meets in a task.
    """
    order = Window.orderBy("date")  # some thousand days
    open_days = days.filter("date is not null").select("date").distinct()
    ahead = open_days.select("date", F.lead("date").over(order).alias("next_day"), F.lead("date", 2).over(order).alias("second_day")).filter("next_day is not null")
    return ahead.select(F.explode(F.sequence("date", F.date_sub("next_day", 1))).alias("date"), "next_day", "second_day")


def acceptance_times(text: Column, zone: str = "America/New_York") -> dict[str, Column]:
    """accepted_local, accepted_utc: an acceptance text (YYYYMMDDHHMMSS) as time in its zone and in UTC, null if it is none.

    The session's zone must be UTC. An hour that the change to winter time repeats is taken as its first; one that the change to summer time skips moves ahead by an hour.
    """
    local = F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))
    return {"accepted_local": local, "accepted_utc": F.to_utc_timestamp(local, zone)}


def execution_dates(rows: DataFrame, accepted: Column, days: DataFrame, close_hour: int = 16) -> DataFrame:
    """rows with accepted_date and execution_date: the next trading day before the close, the second next at or after it."""
    marked = rows.withColumns({"accepted_date": F.to_date(accepted), "_late": F.hour(accepted) >= close_hour})
    joined = marked.join(F.broadcast(days.withColumnRenamed("date", "accepted_date")), "accepted_date", "left")
    return joined.withColumn("execution_date", F.when(F.col("_late"), F.col("second_day")).otherwise(F.col("next_day"))).drop("_late", "next_day", "second_day")


def availability(texts: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """A row for each submission text: header fields, mismatches against path and event, quality flag, execution date."""
    parsed = header_fields(texts).withColumns({"cik10": F.regexp_extract("path", r"(\d{10})/[^/]+$", 1), "path_accession": E.accession_dashed(F.regexp_extract("path", r"([0-9-]{18,20})\.txt(?:\.gz)?$", 1))})
    parsed = parsed.withColumn("accession", F.coalesce(E.accession_dashed(F.col("accession_number_header")), F.col("path_accession")))
    e = events.select("cik10", "accession", F.col("form").alias("_form"), F.translate("filing_date", "-", "").alias("_filed"), F.translate("report_date", "-", "").alias("_report"))
    both = parsed.join(e, ["cik10", "accession"], "left")
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    checks = {
        "missing_acceptance_datetime": F.col("accepted_raw").isNull(),
        "accession_header_filename_mismatch": differ(E.accession_dashed(F.col("accession_number_header")), F.col("path_accession")),
        "cik_header_path_mismatch": differ(E.cik10(F.col("central_index_key")), F.nullif("cik10", F.lit(""))),
        "form_header_event_mismatch": differ(F.upper("submission_type_header"), F.upper("_form")),
        "filing_date_header_event_mismatch": differ(F.col("filed_as_of_date_header"), F.col("_filed")),
        "report_date_header_event_mismatch": differ(F.col("period_of_report_header"), F.col("_report")),
    }
    noted = both.withColumn("timestamp_quality_notes", E.notes(checks)).withColumn("timestamp_quality_flag", E.flag(F.col("accepted_raw").isNull(), F.col("timestamp_quality_notes") != ""))
    return execution_dates(noted.withColumns(acceptance_times(F.col("accepted_raw"))), F.col("accepted_local"), days).drop("_form", "_filed", "_report")


def documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """texts with an array ``index`` of (sequence, type, filename, description), one for each document block."""
    field = lambda block, name: F.nullif(F.trim(F.regexp_extract(block, rf"(?i)<{name}>([^\r\n<]*)", 1)), F.lit(""))
    blocks = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), 1)
    return texts.withColumn("index", F.transform(blocks, lambda b: F.struct(*[field(b, n.upper()).alias(n) for n in ("sequence", "type", "filename", "description")])))


#: How a primary document was found, in order of preference, and the warnings of two of them.
FOUND_BY = ("primary_document_hint_confirmed_in_complete_submission", "primary_document_hint_from_filing_event", "document_type_matches_form", "document_type_allowed_form_fallback", "not_discovered")
FOUND_WARNINGS = {"primary_document_hint_from_filing_event": "primary_document_hint_not_found_in_complete_submission_index", "not_discovered": "primary_document_not_discovered"}


def document_choice(index: Column, hint: Column, form: Column, forms: tuple[str, ...] = FORMS) -> Column:
    """struct(document, method, warning): the hint as the index spells it, else the hint itself, else the first document of the form, else
    of an allowed form. Names and types are compared without case; documents without a name are passed over and a blank hint is none.
    Without any document it is null, and warning is "" where nothing is amiss.
    """
    asked = F.nullif(F.trim(hint), F.lit(""))
    named = lambda test: F.get(F.filter(index, lambda x: x["filename"].isNotNull() & test(x)), 0)["filename"]
    found = (named(lambda x: F.lower(F.trim(x["filename"])) == F.lower(asked)), asked, named(lambda x: F.upper(x["type"]) == F.upper(form)), named(lambda x: F.upper(x["type"]).isin(*forms)))
    row = lambda name, how: F.struct(name.alias("document"), F.lit(how).alias("method"), F.lit(FOUND_WARNINGS.get(how, "")).alias("warning"))
    return F.coalesce(*[F.when(c.isNotNull(), row(c, how)) for c, how in zip(found, FOUND_BY, strict=False)], row(F.lit(None).cast("string"), FOUND_BY[-1]))


def choose_document(index: Column, hint: Column, form: Column, forms: tuple[str, ...] = FORMS) -> Column:
    """The document of document_choice."""
    return document_choice(index, hint, form, forms)["document"]


#: Sections, the headings that open them and what may follow, and the least number of words.
SECTIONS = {"mda": (r"item\s+(?:7|2)\.?\s+management'?s\s+discussion", r"item\s+(?:7a|8|3)\b", 300), "risk_factors": (r"item\s+1a\.?\s+risk\s+factors", r"item\s+(?:1b|2)\b", 150), "liquidity": (r"liquidity\s+and\s+capital\s+resources", r"item\s+(?:7a|8|3)\b|critical\s+accounting", 80)}
_FOUND = ArrayType(StructType().add("section_name", "string").add("section_start", "integer").add("section_end", "integer").add("candidates", "integer").add("closed", "boolean"))


def heading_spans(text: str) -> list[tuple[str, int, int, int, bool]]:
    """(section, start, end, candidates, closed) in characters, for each section that a text opens.

    One scan finds all places where a heading may stand; what stands there opens or closes sections. A section that is open stays so until a closing
    heading or the end of the text, so the lines of a contents list are runs as well: the longest run is the section, the first of equal ones.
    """
    opened: dict[str, int] = {}
    runs: dict[str, list[tuple[int, int, bool]]] = {}
    for m in _ANCHOR.finditer(text):
        at = m.start()
        for name, (start, end) in _HEADINGS.items():
            if name in opened:
                # an opening heading isn't its own end
                if at > opened[name] and end.match(text, at) and not start.match(text, at):
                    runs.setdefault(name, []).append((opened.pop(name), at, True))
            elif start.match(text, at):
                opened[name] = at
    for name, at in opened.items():
        runs.setdefault(name, []).append((at, len(text), False))
    return [(name, *max(found, key=lambda r: (r[1] - r[0], -r[0]))[:2], len(found), max(found, key=lambda r: (r[1] - r[0], -r[0]))[2]) for name in SECTIONS if (found := runs.get(name))]


_ANCHOR = re.compile(r"item\s+\d|liquidity\s+and|critical\s+accounting", re.I)
_HEADINGS = {n: (re.compile(a, re.I), re.compile(b, re.I)) for n, (a, b, _) in SECTIONS.items()}


@F.arrow_udf(_FOUND)
def _spans(texts: pa.Array) -> pa.Array:
    names = ("section_name", "section_start", "section_end", "candidates", "closed")
    kind = pa.list_(pa.struct([("section_name", pa.string()), ("section_start", pa.int32()), ("section_end", pa.int32()), ("candidates", pa.int32()), ("closed", pa.bool_())]))
    return pa.array([[dict(zip(names, x, strict=True)) for x in heading_spans(t.as_py() or "")] for t in texts], kind)


def sections(texts: DataFrame, keys: list[str], column: str = "text", *, min_words: dict[str, int] | None = None) -> DataFrame:
    """(keys..., section_name, section_text, section_start, section_end, n_words, section_flag, section_notes): three rows a text.

    Offsets count characters from 0, the end exclusive. RED if a section isn't found, YELLOW if it has fewer words than min_words says (300, 150 and 80 by default); notes also say
    if it runs to the end of the text and if there were other candidates. Null texts have no section.
    """
    least = {n: (min_words or {}).get(n, spec[2]) for n, spec in SECTIONS.items()}
    held = texts.select(*keys, F.col(column).alias("_text"), _spans(F.col(column)).alias("_found"))
    of = lambda n: F.get(F.filter("_found", lambda x: x["section_name"] == n), 0)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), of(n).alias("span"), F.lit(k).alias("least")) for n, k in least.items()])
    each = held.select(*keys, "_text", F.explode(rows).alias("_s")).select(*keys, "_text", F.col("_s.name").alias("section_name"), "_s.span", "_s.least")
    start, end = F.col("span.section_start"), F.col("span.section_end")
    cutout = each.withColumn("section_text", F.substring("_text", start + 1, end - start))
    n = F.size(F.filter(F.split("section_text", r"\s+"), lambda w: w != ""))
    counted = cutout.withColumn("n_words", F.when(F.col("section_text").isNull(), 0).otherwise(n))
    none, few = F.col("section_text").isNull(), F.col("n_words") < F.col("least")
    notes = E.notes({"section_not_found": none, "section_end_not_found": ~none & ~F.col("span.closed"), "several_section_candidates": ~none & (F.col("span.candidates") > 1), "low_section_word_count": ~none & few})
    return counted.select(*keys, "section_name", "section_text", start.alias("section_start"), end.alias("section_end"), "n_words", E.flag(none, few).alias("section_flag"), notes.alias("section_notes"))
