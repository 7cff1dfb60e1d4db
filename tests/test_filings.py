"""Filing sources and rules on small files and rows; models against plain algebra."""

import datetime as dt
import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import filings, governance, models
from tidemark.sources import files


def test_submissions_become_filtered_events(spark, tmp_path):
    recent = {"accessionNumber": ["0000320193-23-000106", "0000320193-23-000077", "0000320193-23-000050"], "filingDate": ["2023-11-03", "2023-08-04", "2023-05-05"], "reportDate": ["2023-09-30", "", "2023-05-04"], "acceptanceDateTime": ["x", "y"], "form": ["10-K", "10-Q", "8-K"], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}
    (tmp_path / "CIK0000320193.json.gz").write_bytes(gzip.compress(json.dumps({"cik": "320193", "filings": {"recent": recent}}).encode()))
    raw = files.submissions(spark, str(tmp_path))
    rows = {r.form: r for r in filings.filing_events(raw).collect()}
    assert set(rows) == {"10-K", "10-Q"} and rows["10-K"].cik10 == "0000320193" and rows["10-K"].warnings == "" and rows["10-Q"].warnings == "missing_report_date"
    assert filings.filing_events(raw, lowest="2023-09-01").count() == 1


@pytest.mark.parametrize(("accepted", "day"), [("20231103181043", dt.date(2023, 11, 7)), ("20231103150000", dt.date(2023, 11, 6))])
def test_availability_of_a_submission_text(spark, accepted, day):
    text = f"<SEC-HEADER>\n<ACCEPTANCE-DATETIME>{accepted}\nACCESSION NUMBER: 0000320193-23-000106\nCONFORMED SUBMISSION TYPE: 10-K\nFILED AS OF DATE: 20231103\nCENTRAL INDEX KEY: 0000320193\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>1\n<FILENAME>a.htm\n</DOCUMENT>"
    texts = spark.createDataFrame([("x/0000320193/0000320193-23-000106.txt", text)], "path string, value string")
    events = spark.createDataFrame([("0000320193", "0000320193-23-000106", "10-Q", "2023-11-03", None)], "cik10 string, accession string, form string, filing_date string, report_date string")
    days = filings.calendar(spark.sql("select date'2023-11-01' as lo, date'2023-11-30' as hi"))
    row = filings.availability(filings.documents(texts), events, days).first()
    assert row.execution_date == day and row.timestamp_quality_flag == "YELLOW" and row.timestamp_quality_notes == "form_header_event_mismatch"
    chosen = filings.documents(texts).select(filings.choose_document(F.col("index"), F.lit(None).cast("string"), F.lit("10-k")).alias("d")).first().d
    assert chosen == "a.htm"


def test_documents_beyond_the_header_limit_are_indexed(spark, tmp_path):
    part = lambda kind, n, name, size: f"<DOCUMENT>\n<TYPE>{kind}\n<SEQUENCE>{n}\n<FILENAME>{name}\n<TEXT>{'x ' * size}</TEXT>\n</DOCUMENT>\n"
    (tmp_path / "0000320193").mkdir()
    text = "<SEC-HEADER>\nACCESSION NUMBER: 0000320193-23-000106\n</SEC-HEADER>\n" + part("EX-99", 1, "big.htm", 400_000) + part("10-K", 2, "late.htm", 10)
    (tmp_path / "0000320193" / "0000320193-23-000106.txt").write_text(text)
    found = filings.header_fields(filings.documents(files.complete_submissions(spark, str(tmp_path))))
    row = found.select("accession_number_header", filings.choose_document(F.col("index"), F.lit(None).cast("string"), F.lit("10-k")).alias("d"), F.size("index").alias("n")).first()
    assert (row.accession_number_header, row.n, row.d) == ("0000320193-23-000106", 2, "late.htm")


@pytest.mark.parametrize(
    ("hint", "form", "want"),
    [
        (" A.HTM ", "10-K", ("a.htm", "primary_document_hint_confirmed_in_complete_submission", "")),
        ("z.htm", "10-K", ("z.htm", "primary_document_hint_from_filing_event", "primary_document_hint_not_found_in_complete_submission_index")),
        (" ", "ex-99", ("a.htm", "document_type_matches_form", "")),
        (None, "8-K", ("b.htm", "document_type_allowed_form_fallback", "")),
        (None, None, ("b.htm", "document_type_allowed_form_fallback", "")),
    ],
)
def test_choice_of_the_primary_document(spark, hint, form, want):
    index = "array(named_struct('type', '10-K', 'filename', cast(null as string)), named_struct('type', 'EX-99', 'filename', 'a.htm'), named_struct('type', '10-q', 'filename', 'b.htm'))"
    rows = spark.createDataFrame([(hint, form)], "hint string, form string").select("hint", "form", F.expr(index).alias("index"))
    assert tuple(rows.select(filings.document_choice(F.col("index"), F.col("hint"), F.col("form")).alias("d")).first().d) == want
    nothing = rows.select(filings.document_choice(F.filter("index", lambda x: x["filename"] == "a.htm"), F.lit(None).cast("string"), F.lit("8-K")).alias("d")).first().d
    assert tuple(nothing) == (None, "not_discovered", "primary_document_not_discovered")


def test_sections_take_the_longest_run_and_flag_missing_ones(spark):
    text = "Item 1A. Risk Factors Item 1B none. Item 1A. Risk Factors " + "peril " * 200 + "Item 1B. More Item 7. Management's Discussion short Item 7A."
    rows = {r.section_name: r for r in filings.sections(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), ["id"]).filter("id = 1").collect()}
    assert rows["risk_factors"].section_flag == "GREEN" and rows["mda"].section_flag == "YELLOW" and rows["liquidity"].section_flag == "RED"


def test_archives_lexicon_inventory_and_manifest(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "2023q4.zip", "w") as z:
        for m in files.MEMBERS:
            z.writestr(f"{m}.txt", "adsh\tform\na\t10-K\nb\t\n")
    rows = files.accounting_archives(spark, str(tmp_path), "sub", ["adsh", "form", "absent"]).orderBy("adsh").collect()
    assert [(r.adsh, r.form, r.absent) for r in rows] == [("a", "10-K", None), ("b", None, None)]
    (tmp_path / "lex.csv").write_text("Word,Negative,Positive\ngain,0,2009\nloss,2009,0\nmay,N,\n")
    assert {tuple(r) for r in files.lexicon(spark, str(tmp_path / "lex.csv"), ["Negative", "Positive"]).collect()} == {("GAIN", "positive"), ("LOSS", "negative")}
    found = files.inventory(spark, str(tmp_path))
    assert found.count() == 2 and files.new_for_manifest(found.filter("suffix = '.csv'"), found).count() == 1


def test_downstream_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    got = governance.downstream(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r.reached for r in got.collect()} == {"a", "b", "c"} and got.count() == 3


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2)) * [1.0, 5.0] + 3
    y = x @ [2.0, -1.0] + rng.normal(size=60)
    rows = spark.createDataFrame([("f", "train", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "fold_id string, role string, a double, b double, y double")
    got = {r.model_name: r for r in models.linear_models(models.impute(rows, ["a", "b"]), ["a", "b"], "y").collect()}
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(got["ridge"].weights, want) and np.allclose(got["elastic_net"].weights, want, atol=0.2)


def test_archives_are_read_in_ranges_with_types(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for year, quarter in ((2023, 4), (2024, 1)):
        with zipfile.ZipFile(tmp_path / "in" / f"{year}q{quarter}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("sub.txt", "adsh\tcik\tname\tform\tperiod\tfy\tfp\n" + "".join(f"{year}-{k}\t{k}\tNäme\t{'10-K' if k % 2 else '8-K'}\t20231231\t{year}\tFY\n" for k in range(40)))
            z.writestr("num.txt", "adsh\ttag\tversion\tddate\tqtrs\tuom\tvalue\r\n" + "".join(f"{year}-{k % 40}\tT{k}\tv\t20231231\t4\tUSD\t{'' if k % 7 == 0 else k / 4}\r\n" for k in range(400)))
            z.writestr("tag.txt", "tag\tversion\tcustom\n" + "".join(f"T{k}\tv\t0\n" for k in range(400)))
            z.writestr("pre.txt", "adsh\treport\tline\n" + f"{year}-1\t2\tx\n")
    for size in (64, 1 << 20):
        num = files.accounting_archives(spark, str(tmp_path / "in"), "num", range_bytes=size)
        assert dict(num.dtypes)["value"] == "double" and dict(num.dtypes)["qtrs"] == "int"
        rows = num.collect()
        assert sorted((r.fsds_year, r.tag, r.value) for r in rows if r.value is not None) == sorted((y, f"T{k}", k / 4) for y in (2023, 2024) for k in range(400) if k % 7)
        assert len(rows) == 800 and {(r.fsds_year, r.fsds_quarter) for r in rows} == {(2023, 4), (2024, 1)} and rows[0].coreg is None
    from tidemark.operators import accounting

    tables = accounting.quarter_tables(files.archive_tables(spark, str(tmp_path / "in"), years=[2023]))
    assert tables["sub"].count() == 20 and tables["num"].count() == 200 and tables["tag"].count() == 400
    assert tables["pre"].select("report", "line").first() == (2, None)
    with zipfile.ZipFile(tmp_path / "in" / "2024q2.zip", "w") as z:
        z.writestr("sub.txt", "adsh\n")
    with pytest.raises(Exception, match="lacks"):
        files.accounting_archives(spark, str(tmp_path / "in"), "num").count()


def test_lexicon_files_with_aliases_tabs_and_preference(spark, tmp_path):
    (tmp_path / "b.TXT").write_text("Words\tNEG\tStrong Modal\tuncertain\nMay\t0\t2009\t0.0\nloss\t2010\tno\t1\n\t5\t5\t5\n")
    (tmp_path / "z.dat").write_text("x")
    assert {tuple(r) for r in files.lexicon(spark, str(tmp_path)).collect()} == {("MAY", "strong_modal"), ("LOSS", "negative"), ("LOSS", "uncertainty")}
    (tmp_path / "a.csv").write_text("word,pos,Weak-Modal\nGood,-1,false\nmight,,Y\n")
    assert {tuple(r) for r in files.lexicon(spark, str(tmp_path)).collect()} == {("GOOD", "positive"), ("MIGHT", "weak_modal")}
    (tmp_path / "a.csv").write_text("term,pos\nx,1\n")
    with pytest.raises(ValueError, match="word column"):
        files.lexicon(spark, str(tmp_path))


def test_lexicon_features_count_rows_apart_and_words_once(spark):
    from tidemark.operators import texts

    lexicon = spark.createDataFrame([("GAIN", "positive"), ("GAIN", "positive"), ("LOSS", "negative"), ("MAY", "weak_modal"), ("MAY", "uncertainty"), ("MUST", "strong_modal"), ("RESTRICTED", "constraining")], "word string, category string")
    df = spark.createDataFrame([(1, "gain gain loss may litigation restricted must"), (1, "gain gain loss may litigation restricted must"), (2, None), (None, "")], "id int, text string")
    rows = texts.lexicon_features(df, "text", lexicon, "f_", ["id"]).collect()
    assert len(rows) == 4
    for r in rows:
        want = (7, 2, 1, 1, 0, round(1 / 3, 12), round(2 / 7, 12)) if r.id == 1 else (0, 0, 0, 0, 0, 0.0, 0.0)
        assert (r.f_lm_token_count, r.f_lm_positive_count, r.f_lm_negative_count, r.f_lm_uncertainty_count, r.f_lm_litigious_count, r.f_lm_pos_neg_balance, r.f_lm_modal_total_share) == want


def test_sections_have_offsets_notes_and_gates(spark):
    text = "Item 1A. Risk Factors " + "risk disclosure " * 100 + "Item 1B. Unresolved Staff Comments None. Item 7. Management's Discussion and Analysis Results of Operations " + "operating result " * 80 + "Liquidity and Capital Resources " + "cash credit liquidity " * 80 + "Critical Accounting Estimates estimates. Item 7A. Quantitative and Qualitative Disclosures market risk."
    df = spark.createDataFrame([(1, text), (2, "é Item 7. Management's Discussion ends never"), (3, None)], "id int, text string")
    rows = {(r.id, r.section_name): r for r in filings.sections(df, ["id"], min_words={n: 20 for n in filings.SECTIONS}).collect()}
    assert len(rows) == 9
    for name, opening, closing in (("mda", "Item 7. M", "Item 7A"), ("risk_factors", "Item 1A", "Item 1B"), ("liquidity", "Liquidity and", "Critical")):
        r = rows[1, name]
        assert (r.section_start, r.section_end, r.section_flag, r.section_notes) == (text.index(opening), text.index(closing), "GREEN", "") and r.section_text == text[r.section_start : r.section_end]
    late = rows[2, "mda"]
    assert (late.section_start, late.section_end, late.section_notes) == (2, 44, "section_end_not_found;low_section_word_count") and late.section_flag == "YELLOW"
    assert rows[3, "mda"].section_flag == "RED" and rows[3, "mda"].section_notes == "section_not_found" and rows[3, "mda"].section_start is None
    gates = {r.section_name: r.section_flag for r in filings.sections(df.filter("id = 1"), ["id"]).collect()}
    assert gates == {"mda": "GREEN", "risk_factors": "GREEN", "liquidity": "GREEN"}


def test_a_manifest_is_appended_once_and_checked(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    (tmp_path / "d" / "b.txt").write_text("two")
    path, found = str(tmp_path / "manifest"), files.inventory(spark, str(tmp_path / "d"))
    assert [files.append_manifest(spark, path, found) for _ in range(2)] == [2, 0]
    assert files.read_manifest(spark, path).count() == 2 and files.check_manifest(files.read_manifest(spark, path), found).count() == 0
    (tmp_path / "d" / "a.txt").write_text("changed")
    found = files.inventory(spark, str(tmp_path / "d"))
    assert {r.problem for r in files.check_manifest(files.read_manifest(spark, path), found).collect()} == {"checksum_mismatch"}
    assert files.append_manifest(spark, path, found) == 1 and files.append_manifest(spark, path, found) == 0
    (tmp_path / "manifest" / "dead").mkdir()  # a run that died before its commit
    kept = files.read_manifest(spark, path)
    assert kept.count() == 3
    problems = files.check_manifest(kept.unionByName(kept.filter("path like '%b.txt'")), found.filter("path like '%a.txt'")).collect()
    assert sorted(r.problem for r in problems) == ["checksum_mismatch", "duplicate_raw_file_id", "file_missing"]


def test_acceptance_times_around_clock_changes_and_the_close(spark):
    rows = spark.createDataFrame([("20240310013000",), ("20240310033000",), ("20241103003000",), ("20241103013000",), ("20241103023000",), ("20240705155959",), ("20240705160000",), ("x",)], "t string")
    got = {r.t: r for r in rows.select("t", *[c.alias(n) for n, c in filings.acceptance_times(F.col("t")).items()]).collect()}
    utc = {t: r.accepted_utc and r.accepted_utc.strftime("%m%d %H%M") for t, r in got.items()}
    assert utc == {"20240310013000": "0310 0630", "20240310033000": "0310 0730", "20241103003000": "1103 0430", "20241103013000": "1103 0530", "20241103023000": "1103 0730", "20240705155959": "0705 1959", "20240705160000": "0705 2000", "x": None}
    priced = spark.createDataFrame([(dt.date(2024, 7, d),) for d in (3, 5, 8, 9, 5)], "date date")  # the fourth is a holiday, the sixth and seventh a weekend
    days = filings.trading_calendar(priced)
    local = rows.filter("t like '202407%'").withColumn("l", filings.acceptance_times(F.col("t"))["accepted_local"])
    found = {r.t[8:]: r.execution_date for r in filings.execution_dates(local, F.col("l"), days).collect()}
    assert found == {"155959": dt.date(2024, 7, 8), "160000": dt.date(2024, 7, 9)}
    assert {r.date: (r.next_day, r.second_day) for r in days.collect()}[dt.date(2024, 7, 4)] == (dt.date(2024, 7, 5), dt.date(2024, 7, 8))


def test_reference_and_price_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# list\ncik,accession_number\n320193,000032019323000106\n,\n1,bad\n")
    assert [(r.cik10, r.accession) for r in files.filing_references(spark, str(tmp_path / "r.csv")).collect()] == [("0000320193", "0000320193-23-000106")]
    assert [r.cik10 for r in files.cik_list(spark, str(tmp_path / "r.csv")).orderBy("cik10").collect()] == ["0000000001", "0000320193"]
    (tmp_path / "p.csv").write_text("date,ticker,adj_close\n2024-01-02, a ,1.5\n")
    assert files.prices(spark, str(tmp_path / "p.csv")).first().ticker == "a"
    (tmp_path / "p.csv").write_text("date,ticker\n2024-01-02,a\n")
    with pytest.raises(ValueError, match="adj_close"):
        files.prices(spark, str(tmp_path / "p.csv"))
    files.write_table(spark.range(50).selectExpr("(id * 7) % 50 as k"), str(tmp_path / "t"), keys=["k"])
    assert [r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()] == list(range(50))


def test_step_edges_and_forbidden_paths(spark):
    steps = spark.createDataFrame([("r", 2, "b", ["x"], ["y"]), ("r", 1, "a", ["i"], ["x"]), ("s", 1, "c", [], None)], "run string, step_order int, name string, inputs array<string>, outputs array<string>")
    edges = governance.step_edges(steps, "run")
    assert {(r.source, r.relation, r.target) for r in edges.collect()} == {("i", "consumes", "a"), ("a", "produces", "x"), ("x", "consumes", "b"), ("b", "produces", "y"), ("a", "runs_before", "b")}
    assert {r.reached for r in governance.upstream(edges, spark.createDataFrame([("y",)], "node string")).collect()} == {"b", "x", "a", "i"}
    paths = spark.createDataFrame([("src/a.py",), ("logs/x.txt",), ("data\\raw\\b",), ("k.PYC",), ("src/logs/x",), (None,)], "path string")
    assert {r.path: r.path_problem for r in governance.path_scan(paths).collect()} == {"src/a.py": None, "logs/x.txt": "logs/", "data\\raw\\b": "data/raw/", "k.PYC": ".pyc", "src/logs/x": None, None: None}
