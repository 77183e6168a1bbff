"""Currency, date and identity normalisation as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.schemas import NO_DESCRIPTION

# Units in the order in which they are looked for, what is cut for each, and the factor.
UNITS = (
    (("lakh", "lac"), r"(?U)\s*(lakhs|lacs|lakh|lac)", 100000),
    (("cr",), r"(?U)\s*(crores|crore|cr)", 10000000),
    (("k",), r"(?U)\s*k", 1000),
)
DATE_PATTERNS = ("d-M-yyyy", "d/M/yyyy", "yyyy-M-d", "d-MMM-yyyy", "d MMM yyyy")
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def amount(c: Column) -> Column:
    """Whole currency units of texts such as "1.5 Cr" or "5,00,000"; null where there is no number."""
    s = F.regexp_replace(strip(F.lower(c)), "[₹$,]", "")
    number, factor = s, F.lit(1.0)
    for words, cut, times in reversed(UNITS):
        holds = reduce(lambda a, b: a | b, (F.contains(s, F.lit(w)) for w in words))
        number = F.when(holds, F.regexp_replace(s, cut, "")).otherwise(number)
        factor = F.when(holds, F.lit(float(times))).otherwise(factor)
    number = F.regexp_replace(strip(number), "(?<=[0-9])_(?=[0-9])", "")
    value = F.when(F.rlike(number, F.lit(NUMBER)), number.try_cast("double"))
    return (value * factor).try_cast("bigint")


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd of a date in one of five layouts, else null."""
    s = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    return F.date_format(F.coalesce(*(F.call_function("try_to_date", s, F.lit(p)) for p in DATE_PATTERNS)), "yyyy-MM-dd")


def dedup_hash(title: Column, location: Column) -> Column:
    """SHA-256 of the lower-cased, stripped title and location."""
    plain = lambda c: strip(F.lower(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat(plain(title), F.lit("|"), plain(location)), 256)


def title_of(summary: Column, title: Column) -> Column:
    return F.coalesce(present(summary), present(title), F.lit(""))


def location_of(country: Column, location: Column) -> Column:
    return F.coalesce(present(country), present(location), F.lit(""))


def description_of(description: Column) -> Column:
    return F.coalesce(present(description), F.lit(NO_DESCRIPTION))
