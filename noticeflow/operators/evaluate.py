"""Relevance of search results against golden cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.operators.ingest import embedded, intents
from noticeflow.operators.search import nearest_many
from noticeflow.plans import predicates
from noticeflow.providers.base import Provider
from noticeflow.storage import written


def judged(hits: DataFrame) -> DataFrame:
    """hits: case_id, rank, core_domain, project_tags, original_title, description and the case's expectations."""
    holds = lambda c, words: F.coalesce(F.exists(words, lambda w: F.contains(c, F.lower(w))), F.lit(False))
    body = F.lower(F.concat(F.coalesce("original_title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    domain: Column = F.coalesce(F.array_contains("must_match_domains", F.col("core_domain")), F.lit(False))
    return hits.withColumns({"domain_hit": domain, "tag_hit": holds(F.lower(F.coalesce("project_tags", F.lit(""))), F.col("required_tags")), "keyword_hit": holds(body, F.col("required_keywords"))}).withColumn(
        "relevant", F.col("domain_hit") | F.col("tag_hit")
    )


def summary(hits: DataFrame) -> DataFrame:
    """A row a case: hits of each kind, relevant results and whether there are enough."""
    out = judged(hits).groupBy("case_id").agg(
        F.count_if("domain_hit").alias("domain_hits"), F.count_if("tag_hit").alias("tag_hits"), F.count_if("keyword_hit").alias("keyword_hits"), F.count_if("relevant").alias("relevant"),
        F.max(F.coalesce("min_relevant_count", F.lit(1))).alias("required"),
    )
    return out.withColumn("passed", F.col("relevant") >= F.col("required"))


def benchmark(table: DataFrame, cases: DataFrame, provider: Provider, metric: str = "squared_l2") -> tuple[DataFrame, DataFrame]:
    """Results by case, and the number of cases passed and in all.

    Cases (id, query, expectations) are rows like others: their intents and vectors are taken in tasks, and one blocked search
    answers them all, each under its own predicate; each case is cut to its own k.
    """
    e = F.col("expectations")
    cases = cases.select(
        F.col("id").alias("case_id"), "query", F.coalesce(F.nullif(e["top_k_to_check"], F.lit(0)), F.lit(10)).alias("k"), e["must_match_domains"].alias("must_match_domains"), e["required_tags"].alias("required_tags"),
        e["required_keywords"].alias("required_keywords"), F.coalesce(F.nullif(e["min_relevant_count"], F.lit(0)), F.lit(1)).alias("min_relevant_count"),
    )
    cases = written(cases, "cases")
    k = cases.agg(F.coalesce(F.max("k"), F.lit(1))).first()[0]
    asked = predicates.asked(intents(cases.select("case_id", "query"), provider))
    vectors = embedded(asked.withColumn("document", F.coalesce(F.nullif("refined_query", F.lit("")), "query", F.lit(""))), provider)
    queries = vectors.select(F.col("case_id").alias("query_id"), F.col("embedding").alias("query_embedding"), *predicates.AMONG.values())
    hits = nearest_many(predicates.searchable(table), queries, k, metric, among=predicates.AMONG)
    shown = hits.join(table.select("id", "core_domain", "project_tags", "original_title", "description"), "id").withColumnRenamed("query_id", "case_id").join(cases, "case_id").where(F.col("rank") <= F.col("k"))
    out = cases.select("case_id", F.col("min_relevant_count").alias("needed")).join(summary(shown), "case_id", "left")
    out = out.select("case_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("domain_hits", "tag_hits", "keyword_hits", "relevant")), F.col("needed").alias("required"), (F.coalesce("relevant", F.lit(0)) >= F.col("needed")).alias("passed"))
    return out, out.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
