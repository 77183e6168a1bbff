"""Repair jobs and reports on the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import classify, text
from noticeflow.operators import ingest
from noticeflow.operators.index import Index, missing, sample
from noticeflow.operators.search import nearest, ranks
from noticeflow.plans import predicates
from noticeflow.plans.predicates import from_intent
from noticeflow.providers.base import Provider
from noticeflow.sources.readers import append_jsonl


def reclassify(table: DataFrame, kind: str = "procurement_type", title: str = "original_title", key: str = "id", keywords=classify.KEYWORDS) -> DataFrame:
    """The records whose type changes: id, old_type, new_type, title (lower-cased, as it was compared)."""
    new = classify.reclassified(F.col(kind), F.col(title), keywords)
    return table.select(F.col(key).alias("id"), F.col(kind).alias("old_type"), new.alias("new_type"), F.lower(title).alias("title")).where("new_type is not null")


def reclassify_counts(table: DataFrame, kind: str = "procurement_type", title: str = "original_title", keywords=classify.KEYWORDS) -> DataFrame:
    label = classify.change_label(F.coalesce(kind, F.lit("Unknown")), F.col(title), keywords)
    return table.select(label.alias("change")).where("change is not null").groupBy("change").agg(F.count("*").alias("n"))


def repair(index: Index, audit_path: str, dry_run: bool = True) -> DataFrame:
    """Counts of the re-classification; without dry_run also logs and writes the changes."""
    table = index.read()
    if not dry_run:
        changes = reclassify(table)
        append_jsonl(changes, audit_path)
        index.update(changes.select("id", F.col("new_type").alias("procurement_type")))
    return reclassify_counts(table)


def distribution(table: DataFrame, column: str = "procurement_type", n: int | None = 2000, key: str = "id") -> DataFrame:
    """Values of a column by frequency, of the first n rows by id."""
    rows = sample(table, n, key) if n else table
    return rows.groupBy(F.coalesce(column, F.lit("Missing")).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def root_cause(ids: DataFrame, table: DataFrame) -> DataFrame:
    """For each asked id whether it is indexed, and the start of its title."""
    known = table.select("id", text.prefix(F.col("original_title"), 40).alias("title"), F.lit(True).alias("indexed"))
    return ids.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("indexed", F.lit(False)).alias("indexed"), "title")


def backfill(index: Index, raw: DataFrame, ids: DataFrame, provider: Provider, keywords: Column) -> int:
    """Ingests the raw rows of those asked ids that the index lacks."""
    wanted = missing(ids.select("id").distinct(), index.read())
    rows = raw.join(wanted, F.coalesce("RefNo", "TOT_ID") == wanted["id"], "left_semi")
    return index.upsert(ingest.embedded(ingest.metadata(ingest.enriched(ingest.cleaned(rows), provider, keywords)), provider))


def explain_miss(table: DataFrame, notice_id: str, query: str, provider: Provider, k: int = 100, include_corrigendum: bool = True) -> dict:
    """Why a search does not show a notice: absent, excluded by a predicate, ranked too low, or shown."""
    intent = provider.intent(query)
    row = table.where(F.col("id") == notice_id)
    if row.isEmpty():
        return {"verdict": "absent", "intent": intent}
    where = from_intent(intent, include_corrigendum)
    if row.where(where).isEmpty():
        return {"verdict": "excluded", "intent": intent}
    vector = provider.embed([intent.get("refined_query") or query])[0]
    hit = nearest(table, vector, k, where).where(F.col("id") == notice_id).first()
    return {"verdict": "shown" if hit else "ranked below", "intent": intent, "rank": hit["rank"] if hit else None, "distance": hit["distance"] if hit else None}


def explain_misses(table: DataFrame, asked: DataFrame, provider: Provider, k: int = 100, include_corrigendum: bool = True, metric: str = "squared_l2") -> DataFrame:
    """The same for a table of questions (query, id): query, id, verdict (absent, excluded, shown, ranked below), rank and
    distance. All of them take one pass over the table."""
    questions = asked.select("query", "id").distinct()
    known = predicates.asked(ingest.intents(questions.select("query").distinct(), provider), include_corrigendum)
    vectors = ingest.embedded(known.withColumn("document", F.coalesce(F.nullif("refined_query", F.lit("")), "query", F.lit(""))), provider)
    rows = questions.join(vectors, questions["query"].eqNullSafe(vectors["query"])).select(questions["query"].alias("query_id"), "id", F.col("embedding").alias("query_embedding"), *predicates.AMONG.values())
    found = ranks(predicates.searchable(table), rows, metric, among=predicates.AMONG)
    verdict = F.when(F.col("verdict") != "ranked", F.col("verdict")).when(F.col("rank") <= k, F.lit("shown")).otherwise(F.lit("ranked below"))
    return found.select(F.col("query_id").alias("query"), "id", verdict.alias("verdict"), "rank", "distance")
