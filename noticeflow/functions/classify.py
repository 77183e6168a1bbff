"""Procurement type by title keywords, for records whose type is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types to replace, types to guess, and keywords in the order in which groups are tried.
CONSULTANCY = ("Consultancy", "Services")
GUESSED = ("Unknown", "Unclassified", "Other")
KEYWORDS = (
    ("Works", ("work", "construction", "build", "road", "civil")),
    ("Supply", ("supply", "purchase", "delivery", "procurement of", "equipment", "goods")),
    ("Services", ("service", "consult", "manpower", "hiring", "amc", "security", "cleaning")),
)


def _holds(title: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(title, F.lit(w)) for w in words))


def reclassified(kind: Column, title: Column, keywords=KEYWORDS) -> Column:
    """The new type, or null where nothing changes."""
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.when(kind == CONSULTANCY[0], F.lit(CONSULTANCY[1]))
    for name, words in keywords:
        out = out.when(kind.isin(*GUESSED) & _holds(low, words), F.lit(name))
    return out


def change_label(kind: Column, title: Column, keywords=KEYWORDS) -> Column:
    """How a record is counted: old->new, Skipped for a guess that failed, null for others."""
    new = reclassified(kind, title, keywords)
    return F.when(kind == CONSULTANCY[0], F.lit(f"{CONSULTANCY[0]}->{CONSULTANCY[1]}")).when(kind.isin(*GUESSED), F.coalesce(F.concat(F.lit("Unknown->"), new), F.lit("Skipped")))
