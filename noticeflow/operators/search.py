"""Filtered exact nearest neighbours, guardrail, response rows and chat context."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from noticeflow.functions import scoring, text
from noticeflow.operators.index import get
from noticeflow.plans.predicates import from_intent
from noticeflow.providers.base import Fetcher, Provider, page_of
from noticeflow.storage import written

#: Queries, and bytes of their vectors, that are broadcast and compared with all rows at a time.
MAX_QUERIES, QUERY_BYTES = 10000, 32 << 20


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)).cast("float") for x in values))


def nearest(table: DataFrame, query: list[float], k: int, where: Column | None = None, metric: str = "squared_l2", key: str = "id") -> DataFrame:
    """The k rows nearest to a vector, with distance and rank. Each task keeps k rows; no shuffle but theirs."""
    rows = table.where(where) if where is not None else table
    top = rows.withColumn("distance", scoring.METRICS[metric](F.col("embedding"), vector(query))).orderBy("distance", key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def nearest_many(table: DataFrame, queries: DataFrame, k: int, metric: str = "squared_l2", key: str = "id", cells_of: Callable[[pd.DataFrame, np.ndarray], np.ndarray] | None = None, among: dict[str, str] | None = None) -> DataFrame:
    """The k nearest rows for each query (query_id, query_embedding), with distance and rank; ties go to the smaller key.

    Queries are compared with all rows, a block of at most MAX_QUERIES and QUERY_BYTES at a time: more are dealt by a hash
    of query_id into blocks, each of which is run and written before the next, so one block at a time is broadcast. Rows
    are read as Arrow batches; a task multiplies blocks of them with the block of queries and keeps its k best for each
    query, which alone are shuffled. Exact: near candidates' distances are taken again from the differences.
    cells_of: given queries with all their columns, and their vectors, the cells that each looks at (-1: none); rows then have
    a ``cell`` and meet the queries of theirs. among: a predicate of each query's own: of columns of the rows the query columns
    that list the values allowed (null: any value; a null value of a row is only allowed there).
    """
    queries = written(queries if cells_of is not None else queries.select("query_id", "query_embedding", *(among or {}).values()), "queries")
    by_id = queries.groupBy("query_id").agg(F.count("*").alias("n"))
    n, most = by_id.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    width = queries.agg(F.max(F.size("query_embedding"))).first()[0] or 1
    room = max(1, min(MAX_QUERIES, QUERY_BYTES // (8 * width)))
    if n <= room:
        return _nearest_block(table, queries, k, metric, key, cells_of, among)
    blocks = -(-n // room)
    block = lambda: F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    while by_id.groupBy(block().alias("block")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > max(room, most):
        blocks += max(1, blocks // 8)
    out = [written(_nearest_block(table, queries.where(block() == b), k, metric, key, cells_of, among), "nearest") for b in range(blocks)]
    return reduce(DataFrame.unionByName, out)


def _distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """[queries, rows], by one matrix product: exact but for rounding."""
    dot = queries @ rows.T
    a, b = (rows * rows).sum(1), (queries * queries).sum(1)
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - dot / np.sqrt(b[:, None] * a[None, :])
    return np.maximum(a[None, :] + b[:, None] - 2 * dot, 0)


def _exact(rows: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))
    d = ((rows - query) ** 2).sum(1)
    return np.sqrt(d) if metric == "l2" else d


class Among:
    """Which rows each of some queries may see, by lists of allowed values; None allows all."""

    def __init__(self, allowed: list[list | None]):
        self.every = np.array([a is None for a in allowed])
        self.values = [frozenset(a or ()) for a in allowed]

    def mask(self, column: pa.Array) -> np.ndarray:
        """[queries, rows]"""
        coded = column.dictionary_encode()
        known = coded.dictionary.to_pylist()
        table = np.array([[v in own for v in known] + [False] for own in self.values], bool).reshape(len(self.values), -1) | self.every[:, None]
        return table[:, coded.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)]


def _nearest_block(table: DataFrame, queries: DataFrame, k: int, metric: str, key: str, cells_of: Callable[[pd.DataFrame, np.ndarray], np.ndarray] | None, among: dict[str, str] | None = None) -> DataFrame:
    asked = queries.where("query_embedding is not null").toPandas()
    ids = asked["query_id"].tolist()
    vectors = np.array([np.asarray(v, float) for v in asked["query_embedding"]]) if len(asked) else np.zeros((0, 0))
    of_cell: dict[int, np.ndarray] | None = None
    if cells_of is not None:
        cells = cells_of(asked, vectors) if len(ids) else np.zeros((0, 1), int)
        asker, place = np.nonzero(cells >= 0)
        cell = cells[asker, place]
        order = np.argsort(cell, kind="stable")
        named, first = np.unique(cell[order], return_index=True)
        table = table.where(F.col("cell").isin(named.tolist()))
        of_cell = dict(zip(named.tolist(), np.split(asker[order], first[1:]), strict=True)) if len(named) else {}
    allowed = [Among([None if a is None else list(a) for a in asked[c]]) for c in (among or {}).values()]
    shared = table.sparkSession.sparkContext.broadcast((ids, vectors, of_cell, allowed))

    def meetings(cells: np.ndarray | None, of_cell: dict[int, np.ndarray] | None, n: int) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
        """Which rows of a batch meet which queries."""
        if of_cell is None:
            yield slice(None), np.arange(n)
            return
        for c in np.unique(cells):
            if int(c) in of_cell:
                yield np.flatnonzero(cells == c), of_cell[int(c)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, of_cell, allowed = shared.value
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows or not len(ids):
                continue
            keys, lists = batch.column(0), batch.column(1)
            every = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
            seen = [a.mask(batch.column(batch.num_columns - len(allowed) + i)) for i, a in enumerate(allowed)]
            for here, who, q in ((h, w, q) for h, w in meetings(batch.column(2).to_numpy() if of_cell is not None else None, of_cell, len(ids)) for q in range(0, len(w), 256)):
                rows, at = every[here], np.arange(len(lists))[here]
                asking = who[q : q + 256]
                near = _distances(rows, vectors[asking], metric)
                for mask in seen:
                    near[~mask[asking][:, at]] = np.inf
                more = min(near.shape[1], k + 8)  # rounding may change the order of the nearest few
                first = np.argpartition(near, more - 1, axis=1)[:, :more] if more < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
                cut = np.take_along_axis(near, first, 1).max(1)
                for j, asker in enumerate(asking):
                    limit = cut[j] + 1e-9 * (1 + abs(cut[j])) if np.isfinite(cut[j]) else cut[j]  # ties of the last one are not lost
                    pick = np.flatnonzero((near[j] <= limit) & (near[j] < np.inf))
                    exact = _exact(rows[pick], vectors[asker], metric)
                    own = best[asker]
                    limit = own[-1][0] if len(own) == k else np.inf
                    new = at[pick[exact <= limit]]
                    if len(new):
                        own += zip(exact[exact <= limit].tolist(), keys.take(pa.array(new)).to_pylist(), strict=True)
                        own.sort()
                        del own[k:]
        found = [(i, y, d) for i, own in zip(ids, best, strict=True) for d, y in own]
        for i in range(0, len(found), 10000):
            a, b, d = zip(*found[i : i + 10000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, types[0]), pa.array(b, types[1]), pa.array(d, pa.float64())], ["query_id", key, "distance"])

    rows = table.select(key, F.col("embedding").cast("array<double>").alias("embedding"), *(["cell"] if cells_of is not None else []), *(among or {}))
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField(key, rows.schema[key].dataType), StructField("distance", DoubleType())])
    types = [to_arrow_type(f.dataType) for f in schema]
    top = rows.mapInArrow(run, schema)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))).where(F.col("rank") <= k)


def ranks(table: DataFrame, asked: DataFrame, metric: str = "squared_l2", key: str = "id", among: dict[str, str] | None = None) -> DataFrame:
    """At which place a search would show a given row: query_id, key, verdict, rank and distance of each row of asked
    (query_id, query_embedding, key, and the columns that ``among`` names, as in nearest_many).

    verdict: absent (no such row, or without a vector), excluded (by the query's predicate) or ranked. The rank is one more
    than the rows that are nearer, or as near with a smaller key: counted, not sorted, in one pass over the table for each block of
    questions, of which a task shuffles one number each.
    """
    lists = list((among or {}).values())
    own = table.select(F.col(key).alias("_key"), F.col("embedding").cast("array<double>").alias("_own"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(among or {})))
    asked = asked.select(F.col("query_id"), F.col("query_embedding").cast("array<double>").alias("query_embedding"), F.col(key), *lists)
    met = asked.join(own, asked[key] == own["_key"], "left").drop("_key")
    passes = reduce(lambda a, b: a & b, [F.col(c).isNull() | F.coalesce(F.array_contains(c, F.col(f"_{i}")), F.lit(False)) for i, c in enumerate(lists)], F.lit(True))
    verdict = F.when(F.col("_own").isNull() | F.col("query_embedding").isNull(), F.lit("absent")).when(~passes, F.lit("excluded")).otherwise(F.lit("ranked"))
    met = written(met.withColumn("verdict", verdict).withColumn("_n", F.monotonically_increasing_id()), "asked")
    left = met.where("verdict = 'ranked'")
    n, width = left.agg(F.count("*"), F.max(F.size("query_embedding"))).first()
    blocks = -(-n // max(1, min(MAX_QUERIES, QUERY_BYTES // (16 * (width or 1)))))
    counted = [_ranks_block(table, left.where(F.pmod(F.xxhash64("_n"), F.lit(blocks)) == b), metric, key, among or {}) for b in range(blocks)]
    kind = "_n long, distance double, nearer long"
    counts = reduce(DataFrame.unionByName, counted) if counted else table.sparkSession.createDataFrame([], kind)
    return met.join(counts, "_n", "left").select("query_id", key, "verdict", (F.col("nearer") + 1).alias("rank"), "distance")


def _ranks_block(table: DataFrame, asked: DataFrame, metric: str, key: str, among: dict[str, str]) -> DataFrame:
    asked = asked.toPandas()
    numbers, keys = asked["_n"].tolist(), asked[key].tolist()
    queries, own = (np.array([np.asarray(v, float) for v in asked[c]]) if len(asked) else np.zeros((0, 0)) for c in ("query_embedding", "_own"))
    far = np.array([_exact(v[None], q, metric)[0] for q, v in zip(queries, own, strict=True)])
    allowed = [Among([None if a is None else list(a) for a in asked[c]]) for c in among.values()]
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast((keys, queries, far, allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries, far, allowed = shared.value
        nearer = np.zeros(len(keys), np.int64)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows or not len(keys):
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            masks = [a.mask(batch.column(2 + i)) for i, a in enumerate(allowed)]
            for b in range(0, len(keys), 256):
                part = slice(b, b + 256)
                near = _distances(rows, queries[part], metric)
                seen = reduce(np.logical_and, (m[part] for m in masks), np.ones(near.shape, bool))
                edge = 1e-9 * (1 + np.abs(far[part]))[:, None]
                sure = near < far[part][:, None] - edge
                nearer[part] += (sure & seen).sum(1)
                for j, i in zip(*np.nonzero(~sure & (near <= far[part][:, None] + edge) & seen), strict=True):  # too near to tell by the product
                    d, other = _exact(rows[i : i + 1], queries[b + j], metric)[0], batch.column(0)[int(i)].as_py()
                    nearer[b + j] += d < far[b + j] or (d == far[b + j] and other < keys[b + j])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(nearer)], ["place", "nearer"])

    rows = table.select(key, F.col("embedding").cast("array<double>").alias("embedding"), *among)
    counts = rows.mapInArrow(run, "place long, nearer long").groupBy("place").agg(F.sum("nearer").alias("nearer"))
    places = spark.createDataFrame([(i, int(m), float(d)) for i, (m, d) in enumerate(zip(numbers, far, strict=True))], "place long, _n long, distance double")
    return counts.join(F.broadcast(places), "place").select("_n", "distance", "nearer")


def guarded(hits: DataFrame, k: int, word: str = text.CORRIGENDUM, key: str = "id") -> DataFrame:
    """Hits whose title does not hold the word, cut to k."""
    return hits.where(~text.is_corrigendum(F.col("original_title"), word)).orderBy("distance", key).limit(k)


def search(table: DataFrame, query: str, provider: Provider, k: int = 20, include_corrigendum: bool = True, compat: bool = False, metric: str = "squared_l2") -> DataFrame:
    """Intent, predicate, neighbours and guardrail. With compat the guardrail runs on the first 2 k hits and may
    leave fewer than k; otherwise titles are filtered before the cut."""
    try:
        intent = provider.intent(query)
    except Exception:
        intent = {}
    where = from_intent(intent, include_corrigendum)
    embedding = provider.embed([intent.get("refined_query") or query])[0]
    if include_corrigendum:
        return nearest(table, embedding, k, where, metric)
    if compat:
        return guarded(nearest(table, embedding, 2 * k, where, metric), k)
    return nearest(table, embedding, k, where & ~text.is_corrigendum(F.col("original_title")), metric)


def response(hits: DataFrame) -> DataFrame:
    """The rows that a search answers with: scores, labels and metadata. The defaults of missing values are fixed values."""
    either = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    score = scoring.calibrated(F.col("distance"))
    return hits.select(
        "id", scoring.percent(score).alias("score"), scoring.label(score).alias("match_label"), scoring.colour(score).alias("match_color"), either("original_title", "No Title").alias("title"),
        either("description", "No description available.").alias("description"), either("core_domain", "Unclassified").alias("core_domain"), either("procurement_type", "Unknown").alias("procurement_type"),
        either("authority_name", "Unknown").alias("authority"), either("country", "Unknown").alias("country"), either("location_city", "Unknown").alias("city"), either("location_state", "Unknown").alias("state"),
        either("closing_date", "N/A").alias("closing_date"), either("url", "#").alias("url"), either("ref_no", "N/A").alias("ref_no"), either("tot_id", "N/A").alias("tot_id"), F.coalesce("is_corrigendum", F.lit(False)).alias("is_corrigendum"),
    )


def envelope(query: str, answer: DataFrame, began: float) -> dict:
    """What the API returns for a search; answers are cut to k rows."""
    rows = [r.asDict() for r in answer.collect()]
    return {"query": query, "count": len(rows), "latency_seconds": round(time.time() - began, 3), "results": rows}


# What a chat answers without a notice, and on an error.
NOT_FOUND, CHAT_ERROR = "Tender not found.", "Sorry, I encountered an error analyzing this tender."


def chat(table: DataFrame, notice_id: str, question: str, provider: Provider, pages: DataFrame | None = None, fetcher: Fetcher | None = None) -> str:
    """An answer from one notice and its page: fetched live, or, if at hand, stored (url, html)."""
    try:
        row = get(table, notice_id)
        if fetcher is not None:
            here = row.select("url").first()
            html = page_of(fetcher, here["url"]) if here else None
            row = row.withColumn("page", text.html_to_text(F.lit(html).cast("string")))
        elif pages is not None:
            page = pages.where(F.col("url").startswith("http")).select("url", text.html_to_text(F.col("html")).alias("page"))
            row = row.join(page, "url", "left")
        else:
            row = row.withColumn("page", F.lit(None).cast("string"))
        context = text.chat_context(*(F.col(c) for c in ("original_title", "description", "authority_name", "location_city", "location_state", "country", "closing_date", "url", "document", "page")))
        found = row.select(context.alias("c")).first()
        return provider.chat(found["c"], question) if found else NOT_FOUND
    except Exception:
        return CHAT_ERROR
