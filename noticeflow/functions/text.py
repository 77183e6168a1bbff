"""Text assembly, HTML stripping, keyword containment and model-output parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticeflow.functions.cleaning import present

TITLE_CHARS, DESCRIPTION_CHARS, PURCHASER_CHARS, PAGE_CHARS = 300, 500, 100, 10000
CORRIGENDUM = "corrigendum"


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def embedding_text(signal: Column, tags: Column, keywords: Column) -> Column:
    joined = lambda a: F.coalesce(F.array_join(a, ", "), F.lit(""))
    return F.concat(signal, F.lit(". Tags: "), joined(tags), F.lit(". Keywords: "), joined(keywords))


def any_keyword(text: Column, keywords: Column) -> Column:
    """Whether text holds any element of an array of strings."""
    return F.coalesce(F.exists(keywords, lambda k: F.contains(text, k)), F.lit(False))


def is_corrigendum(title: Column, word: str = CORRIGENDUM) -> Column:
    return F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(word))


# What counts as a script or style, and as a tag.
SCRIPT, TAG = r"(?s)<(script|style)[^>]*>.*?</\1>", r"<[^>]+>"


def html_to_text(html: Column, limit: int = PAGE_CHARS) -> Column:
    """Visible text: scripts and styles go, other tags become spaces, white space collapses."""
    s = F.regexp_replace(html, SCRIPT, "")
    s = F.regexp_replace(s, TAG, " ")
    return prefix(F.btrim(F.regexp_replace(s, r"(?U)\s+", " ")), limit)


def without_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"```(?:json)?", ""))


def parse_model_json(c: Column, schema: StructType) -> Column:
    """A struct from a model's answer, with or without code fences; null where it is no JSON."""
    return F.from_json(without_fences(c), schema, {"mode": "PERMISSIVE"})


def chat_context(title, description, authority, city, state, country, closing, url, document, page) -> Column:
    """What a chat about one notice may use. Its labels and what stands for missing values are fixed values, but for the
    heading PAGE, which is our own."""
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("TITLE: "), known(title)), F.concat(F.lit("DESCRIPTION: "), known(description)), F.concat(F.lit("AUTHORITY: "), known(authority)),
        F.concat(F.lit("LOCATION: "), blank(city), F.lit(", "), blank(state), F.lit(", "), blank(country)), F.concat(F.lit("CLOSING DATE: "), known(closing)), F.concat(F.lit("URL: "), F.coalesce(url, F.lit("None"))),
        F.concat(F.lit("EXTRA DETAILS (Keywords): "), blank(document)), F.lit("PAGE:"), F.coalesce(present(page), F.lit("Could not fetch live content.")),
    )
