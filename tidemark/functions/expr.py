"""Scalar rules: strict numbers, safe ratios, changes, clipping, means of what is there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_double(c: Column) -> Column:
    """A number, or null for blanks, text, NaN, infinities and a Java suffix such as 1d."""
    text = F.trim(c.cast("string"))
    number = F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def changes(current: Column, prior: Column) -> dict[str, Column]:
    """Absolute change, change over the absolute prior, and change of signed logarithms, rounded to 12 places."""
    return {"abs": F.round(current - prior, 12), "pct": F.round(F.try_divide(current - prior, F.abs(prior)), 12), "log": F.round(signed_log(current) - signed_log(prior), 12)}


def clipped(c: Column, limit: float = 5.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(limit)), F.lit(-limit)))


def positive(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def mean_of(columns: list[Column]) -> Column:
    """The mean of those that aren't null; null if all are."""
    present = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)), present)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def flag(red: Column, yellow: Column) -> Column:
    return F.when(red, "RED").when(yellow, "YELLOW").otherwise("GREEN")


def notes(found: dict[str, Column]) -> Column:
    """Names whose condition holds, in order, joined by semicolons."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()])), ";")


def cik10(c: Column) -> Column:
    return F.lpad(c.try_cast("bigint").cast("string"), 10, "0")


def accession_dashed(c: Column) -> Column:
    """18 digits with dashes, null if there aren't 18."""
    digits = F.regexp_replace(c, "-", "")
    return F.when(digits.rlike(r"^\d{18}$"), F.regexp_replace(digits, r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3"))
