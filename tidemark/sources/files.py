"""Files in and out: typed tables, filings metadata, submissions, accounting archives, pages, prices, lexicons, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.plans.lineage import cut
from tidemark.sources import archives

RECENT = "accessionNumber array<string>, filingDate array<string>, reportDate array<string>, acceptanceDateTime array<string>, form array<string>, primaryDocument array<string>, primaryDocDescription array<string>"
FILINGS = f"cik string, entityType string, filings struct<recent: struct<{', '.join(p.replace(' ', ': ', 1) for p in RECENT.split(', '))}>>"
MEMBERS = archives.MEMBERS


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet with its own types; CSV with a header and the schema given (strings without one). Blank CSV values are null."""
    if not path.endswith((".csv", ".csv.gz")):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_table(df: DataFrame, path: str, csv_path: str | None = None, *, keys: list[str] = ()) -> None:
    """Parquet, and CSV if asked for; with keys the rows are in their order, from file to file and within each."""
    df = df.orderBy(*keys) if keys else df
    df.write.mode("overwrite").parquet(path)
    if csv_path:
        df.write.mode("overwrite").option("header", True).csv(csv_path)


def csv_strings(spark: SparkSession, path: str, required: tuple[str, ...] = (), *, comment: str | None = "#") -> DataFrame:
    """A CSV file with a header, as trimmed strings, blanks as null; comment lines and rows without any value are left out. A required column that is missing fails."""
    reader = spark.read.option("header", True)
    raw = (reader.option("comment", comment) if comment else reader).csv(path)
    names = {c: c.strip().lstrip("\ufeff") for c in raw.columns}
    if missing := [c for c in required if c not in names.values()]:
        raise ValueError(f"{path} lacks columns {missing}")
    rows = raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in names.items()])
    return rows.filter(F.coalesce(*[F.col(f"`{n}`") for n in names.values()]).isNotNull())


def prices(spark: SparkSession, path: str) -> DataFrame:
    """A price file as strings, for ``operators.inputs`` to make prices of: date, adj_close and a security (ticker or cik10) are required."""
    rows = csv_strings(spark, path, ("date", "adj_close"))
    if not {"ticker", "cik10"} & set(rows.columns):
        raise ValueError(f"{path} has neither ticker nor cik10")
    return rows


def filing_references(spark: SparkSession, path: str) -> DataFrame:
    """(cik10, accession) and what else a reference file holds; rows without a valid accession number are left out."""
    rows = csv_strings(spark, path, ("cik", "accession_number"))
    return rows.withColumns({"cik10": E.cik10(F.col("cik")), "accession": E.accession_dashed(F.col("accession_number"))}).filter("accession is not null and cik10 is not null")


def cik_list(spark: SparkSession, path: str) -> DataFrame:
    """(cik10), distinct, of a file with a column cik."""
    return csv_strings(spark, path, ("cik",)).select(E.cik10(F.col("cik")).alias("cik10")).filter("cik10 is not null").distinct()


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, file_cik, cik, entityType, filings) of metadata files CIK##########.json[.gz]."""
    raw = spark.read.schema(FILINGS).option("multiLine", True).json(path)
    return raw.select(F.col("_metadata.file_path").alias("source_file"), F.regexp_extract("_metadata.file_path", r"CIK(\d{10})", 1).alias("file_cik"), "*")


def complete_submissions(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each text file as a whole, as documents are indexed over all of it."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), "value")


def primary_documents(spark: SparkSession, path: str) -> DataFrame:
    """(cik10, accession, document, html) from files <cik10>/<accession>/<document>."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    part = lambda k: F.regexp_extract("_metadata.file_path", r"([^/]+)/([^/]+)/([^/]+)$", k)
    return raw.select(part(1).alias("cik10"), part(2).alias("accession"), part(3).alias("document"), F.col("value").alias("html"))


#: The columns of the members and their types.
MEMBER_COLUMNS = {
    "sub": "adsh string, cik string, name string, form string, period string, fy int, fp string, filed string, accepted string, instance string",
    "num": "adsh string, tag string, version string, coreg string, ddate string, qtrs int, uom string, value double, footnote string",
    "tag": "tag string, version string, custom int, abstract int, datatype string, iord string, crdr string, tlabel string, doc string",
    "pre": "adsh string, report int, line int, stmt string, inpth int, rfile string, tag string, version string, plabel string, negating int",
}


def accounting_archives(spark: SparkSession, path: str, member: str, columns: list[str] | None = None, *, years: list[int] | None = None, quarters: list[int] | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """Rows of one member (sub, num, tag, pre) of all quarterly archives <year>q<quarter>.zip below path, with source_file, fsds_year and fsds_quarter.

    columns: names to read as strings; without them the member's own, typed (text that is no number is null). Blank values are null, and an archive lacking a member fails.
    A task reads the lines that start in one range of a member's bytes, as a stream, so no archive is ever whole in memory; range_bytes is before compression. years and
    quarters are looked for in file names.
    """
    spark.dataSource.register(archives.ArchiveSource)
    schema = ", ".join(f"`{c}` string" for c in columns) if columns else MEMBER_COLUMNS[member]
    reader = spark.read.format("quarterly_archive").schema(f"{schema}, source_file string, fsds_year int, fsds_quarter int")
    found = reader.option("path", path).option("member", member).option("range_bytes", str(range_bytes)).option("years", ",".join(map(str, years or []))).option("quarters", ",".join(map(str, quarters or []))).load()
    return found.drop("fsds_year", "fsds_quarter") if columns else found


def archive_tables(spark: SparkSession, path: str, **params) -> dict[str, DataFrame]:
    """sub, num, tag and pre of all archives, as ``operators.accounting.quarter_tables`` takes them."""
    return {m: accounting_archives(spark, path, m, **params).withColumn("source_quarter", F.concat("fsds_year", F.lit("Q"), "fsds_quarter")) for m in MEMBERS}


#: The columns of a lexicon file and what else they are called.
LEXICON_COLUMNS = {
    "word": ("word", "words"),
    "negative": ("negative", "neg"),
    "positive": ("positive", "pos"),
    "uncertainty": ("uncertainty", "uncertain"),
    "litigious": ("litigious", "litigation"),
    "constraining": ("constraining", "constraint"),
    "strong_modal": ("strong_modal", "strongmodal"),
    "weak_modal": ("weak_modal", "weakmodal"),
}


def lexicon_file(spark: SparkSession, path: str) -> str:
    """path itself if it is a file, else the lexicon file in that folder: the first by name of .csv and .txt files."""
    names = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # a folder of a few files; their bodies aren't read
    found = sorted((n for n in names if n.lower().endswith((".csv", ".txt"))), key=lambda n: n.rsplit("/", 1)[-1].lower())
    if not found:
        raise FileNotFoundError(f"no lexicon file in {path}")
    return found[0]


def lexicon(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """(word, category), distinct, words in upper case, of a lexicon file or folder (see ``lexicon_file``).

    A .txt file is cut at tabs if its header holds one, else at commas like a .csv file. Columns are known by aliases, in any case, with blanks and dashes as
    underscores; a category that the file lacks has no words, and a file without a word column fails. A member is any value but blank, a number equal to 0, FALSE, N and NO.
    """
    file = lexicon_file(spark, path)
    head = spark.read.text(file).first()
    if head is None:
        raise ValueError(f"{file} is empty")
    tabs = file.lower().endswith(".txt") and "\t" in head[0]
    raw = spark.read.option("header", True).option("sep", "\t" if tabs else ",").csv(file)
    plain = {re.sub("[- ]", "_", c.strip().lower()): c for c in reversed(raw.columns)}
    have = {k: plain[a] for k, aliases in LEXICON_COLUMNS.items() for a in reversed(aliases) if a in plain}
    if "word" not in have:
        raise ValueError(f"{file} has no word column")

    def member(c: str) -> Column:
        text = F.upper(F.trim(F.col(f"`{c}`")))
        return F.coalesce(~text.isin("", "FALSE", "N", "NO") & (F.coalesce(text.try_cast("double"), F.lit(1.0)) != 0), F.lit(False))

    wanted = [k.lower() for k in categories or list(LEXICON_COLUMNS)[1:]]
    each = F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(member(have[k]), F.lit(k)) for k in wanted if k in have])))
    return raw.select(F.upper(F.trim(F.col(f"`{have['word']}`"))).alias("word"), each.alias("category")).filter("word <> ''").distinct()


def inventory(spark: SparkSession, path: str, skip: str = r"/(\.git|__pycache__|\.pytest_cache|logs)/") -> DataFrame:
    """(path, name, suffix, size, modified, sha256) of the files below path but those whose path matches skip."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(~F.col("path").rlike(skip))
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


MANIFEST = "raw_file_id string, path string, size bigint, sha256 string, status string"


def new_for_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The files that the manifest doesn't hold with the same path and checksum, ready to be appended."""
    return files.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed appends: folders whose name is the digest of what they hold, with Spark's commit marker."""
    done = [str(p) for p in _folders(spark, path) if _exists(spark, f"{p}/_SUCCESS")]
    return spark.read.schema(MANIFEST).parquet(*done) if done else spark.createDataFrame([], MANIFEST)


def append_manifest(spark: SparkSession, path: str, files: DataFrame) -> int:
    """Append the files (path, size, sha256) that aren't there yet and return how many; repeating it appends nothing.

    A file is known by its path and checksum, which also make its raw_file_id, so a changed file gets a new row and none is ever altered. New rows go
    to a folder named by a digest over all of them: a run that died halfway leaves a folder without Spark's commit marker, which no reader sees and
    the same append overwrites, and two runs with the same files write the same folder.
    """
    new = new_for_manifest(read_manifest(spark, path), files.select("path", "size", "sha256").distinct())
    rows = new.select(F.sha2(F.concat_ws(":", "path", "sha256"), 256).alias("raw_file_id"), "path", F.col("size").cast("bigint").alias("size"), "sha256", F.lit("success").alias("status"))
    rows = cut(rows)
    n, *parts = rows.agg(F.count("*"), *[F.coalesce(F.bit_xor(F.xxhash64("raw_file_id", F.lit(k))), F.lit(0)) for k in range(4)]).first()
    if n:
        rows.write.mode("overwrite").parquet(f"{path}/{''.join(f'{p & (2**64 - 1):016x}' for p in parts)}")
    return n


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(raw_file_id, path, problem) of a manifest against an inventory (path, sha256): duplicate_raw_file_id, file_missing, checksum_mismatch.

    Only rows of status success must have their file. A path that was appended again after a change has its old row reported as a mismatch.
    """
    twice = manifest.groupBy("raw_file_id").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1").select("raw_file_id", "path", F.lit("duplicate_raw_file_id").alias("problem"))
    seen = manifest.filter("status = 'success'").join(files.select("path", F.col("sha256").alias("actual")), "path", "left")
    odd = F.when(F.col("actual").isNull(), "file_missing").when(F.col("actual") != F.col("sha256"), "checksum_mismatch")
    return twice.unionByName(seen.select("raw_file_id", "path", odd.alias("problem")).filter("problem is not null").distinct())


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = _hadoop(spark, path)
    return system.exists(place)


def _folders(spark: SparkSession, path: str) -> list[str]:
    system, place = _hadoop(spark, path)
    return [x.getPath().toString() for x in system.listStatus(place) if x.isDirectory()] if system.exists(place) else []
