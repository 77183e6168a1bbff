"""Reports on search and enrichment: quality of results, scores, response checks, enrichment checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import scoring, text
from noticeflow.operators.search import search
from noticeflow.providers.base import Provider
from noticeflow.schemas import DOMAINS, PROCUREMENT_TYPES

TITLE_SHOWN = 60  # fixed: characters of a title in a report


def quality(hits: DataFrame) -> DataFrame:
    """What there is to judge in a list of results by rank."""
    return hits.select("rank", F.col("original_title").alias("title"), F.round("distance", 4).alias("distance"), "core_domain", F.col("description").alias("summary")).orderBy("rank")


def scores(hits: DataFrame) -> DataFrame:
    """Linear scores (percent) beside distances and the start of titles, by rank."""
    return hits.select("rank", F.round(scoring.linear(F.col("distance")), 1).alias("score"), F.round("distance", 4).alias("distance"), text.prefix(F.coalesce("original_title", F.lit("N/A")), TITLE_SHOWN).alias("title")).orderBy("rank")


def quality_of(table: DataFrame, query: str, provider: Provider, k: int = 5) -> DataFrame:
    return quality(search(table, query, provider, k))


def scores_of(table: DataFrame, query: str, provider: Provider, k: int = 10) -> DataFrame:
    return scores(search(table, query, provider, k))


def response_check(answer: DataFrame) -> DataFrame:
    """Of a response's rows: how many there are, how many are flagged as corrigenda, how many are so by title, and whether
    a response without corrigenda is as it should be."""
    flagged, titled = F.count_if(F.coalesce("is_corrigendum", F.lit(False))), F.count_if(text.is_corrigendum(F.col("title")))
    return answer.agg(F.count("*").alias("results"), flagged.alias("flagged"), titled.alias("titled")).withColumn("passed", (F.col("flagged") == 0) & (F.col("titled") == 0))


def enrichment_check(enriched: DataFrame) -> DataFrame:
    """Each enriched row against the fixed vocabulary: domain and type known, a summary, no error."""
    known = lambda c, words: F.coalesce(F.col(c).isin(*words, "Unclassified", "Unknown"), F.lit(False))
    rules = {"domain_known": known("core_domain", DOMAINS), "type_known": known("procurement_type", PROCUREMENT_TYPES), "has_summary": F.coalesce("signal_summary", F.lit("")) != "", "no_error": F.col("error").isNull()}
    return enriched.withColumns(rules).withColumn("passed", F.col("domain_known") & F.col("type_known") & F.col("has_summary") & F.col("no_error"))
