"""Approximate nearest neighbours: an inverted file of vectors.

Vectors are dealt to cells by their nearest centre; a table of them is partitioned by cell, so a search reads the few
cells whose centres are nearest to the query and no others. Centres are fitted (k-means) on at most SAMPLE vectors, those
least by a hash of the key; every row is indexed. How many cells a search reads is set when the index is built: as many
as reach RECALL against exact search on PROBE_QUERIES of the sample. ``exact`` and ``exact_many`` read cells until none that is
unread can hold a nearer row, whatever the predicate.

Nulls: rows without a vector are in no cell and no result. Ties go to the smaller key. An empty table has no cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from noticeflow.operators.search import nearest, nearest_many
from noticeflow.storage import written

SAMPLE, PROBE_QUERIES, RECALL, K = 20000, 200, 0.95, 10
MOST_CELLS = 4096


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * rows @ centres.T


def centres_of(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means; a cell that loses all its vectors takes the one farthest from its centre."""
    r = np.random.default_rng(seed)
    centres = sample[r.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        d = squared(sample, centres)
        own = d.argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=cells)
        np.add.at(sums, own, sample)
        far = np.argsort(-d[np.arange(len(sample)), own])
        for n, cell in enumerate(np.flatnonzero(counts == 0)):
            sums[cell], counts[cell] = sample[far[n]], 1
        centres = sums / counts[:, None]
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int = K, recall: float = RECALL) -> int:
    """Cells to read so that a query of the sample finds that share of its k nearest in it."""
    own = squared(sample, centres).argmin(1)
    asked = sample[:PROBE_QUERIES]
    order = np.argsort(np.argsort(squared(asked, centres), 1), 1)  # rank of each cell for each query
    near = np.argsort(squared(asked, sample), 1, kind="stable")[:, :k]
    needed = np.sort(np.take_along_axis(order, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


@dataclass
class InvertedFile:
    spark: SparkSession
    path: str
    centres: np.ndarray
    radius: np.ndarray  # of each cell, the distance of its farthest vector from its centre; -1 for an empty one
    probes: int
    schema: StructType
    key: str = "id"

    def rows(self) -> DataFrame:
        """All rows, each with its cell and its distance (gap) from the cell's centre."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def cells(self, query: list[float], probes: int | None = None) -> list[int]:
        if not len(self.centres):
            return []
        return [int(c) for c in np.argsort(squared(np.asarray([query], float), self.centres)[0], kind="stable")[: probes or self.probes]]

    def nearest(self, query: list[float], k: int, where: Column | None = None, metric: str = "squared_l2", probes: int | None = None) -> DataFrame:
        """The k nearest rows among the cells nearest to the query."""
        return nearest(self.rows().where(F.col("cell").isin(self.cells(query, probes))), query, k, where, metric, self.key)

    def nearest_many(self, queries: DataFrame, k: int, metric: str = "squared_l2", probes: int | None = None, where: Column | None = None) -> DataFrame:
        """The same for each query (query_id, query_embedding): each meets the rows of its own cells, and a task keeps its k
        best for each query."""
        n = probes or self.probes
        rows = self.rows() if where is None else self.rows().where(where)
        return nearest_many(rows, queries, k, metric, self.key, lambda _, v: np.argsort(squared(v, self.centres), 1, kind="stable")[:, :n])

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the cells in the order of how near their rows can be at least, and that distance: by the triangle
        inequality no row of a cell is nearer than its centre's distance less its radius."""
        if not len(self.centres):
            return np.zeros((len(vectors), 0), int), np.zeros((len(vectors), 0))
        from_centre = np.sqrt(np.maximum(squared(vectors, self.centres), 0))
        least = np.where(self.radius >= 0, np.maximum(from_centre - self.radius, 0), np.inf)
        order = np.lexsort((from_centre, least), axis=1)
        least = np.take_along_axis(least, order, 1)
        return order, least - 1e-6 * (1 + np.where(np.isfinite(least), least, 0))  # never too great by rounding

    def exact(self, query: list[float], k: int, where: Column | None = None, metric: str = "squared_l2") -> tuple[DataFrame, int]:
        """The k nearest of all rows, and how many cells were read for them.

        Cells are read in the order of their bounds, twice as many each time, until the k-th hit is nearer than any row of an
        unread cell can be; once there are k hits, only the rows are read whose distance from their centre lets them be nearer.
        However few rows a predicate leaves, none is missed; where fewer than k qualify, all cells are read.
        """
        if metric not in REACH:
            raise ValueError(f"no bounds for {metric}: use search.nearest")
        rows = self.rows() if where is None else self.rows().where(where)
        hits: list[Row] = []
        read, step, reach = 0, self.probes, np.inf
        if len(self.centres):
            vector = np.asarray([query], float)
            order, least = (x[0] for x in self.bounds(vector))
            from_centre = np.sqrt(np.maximum(squared(vector, self.centres)[0], 0))
            at = 0
            while at < len(order) and np.isfinite(least[at]) and least[at] <= reach:
                own = [int(c) for c, b in zip(order[at : at + step], least[at : at + step], strict=True) if b <= reach and np.isfinite(b)]
                part = rows.where(F.col("cell").isin(own))
                if np.isfinite(reach):
                    ring = [(F.col("cell") == c) & F.col("gap").between(float(from_centre[c] - reach) - 1e-6, float(from_centre[c] + reach) + 1e-6) for c in own]
                    part = part.where(reduce(lambda a, b: a | b, ring))
                hits = sorted([*hits, *nearest(part, query, k, metric=metric, key=self.key).drop("rank").collect()], key=lambda r: (r["distance"], r[self.key]))[:k]
                read, at, step = read + len(own), at + step, 2 * step
                if len(hits) == k:
                    reach = REACH[metric](hits[-1]["distance"])
        kind = StructType([*rows.schema, StructField("distance", DoubleType()), StructField("rank", IntegerType())])
        return self.spark.createDataFrame([(*r, i + 1) for i, r in enumerate(hits)], kind), read

    def exact_many(self, queries: DataFrame, k: int, where: Column | None = None, metric: str = "squared_l2") -> tuple[DataFrame, int]:
        """The same for each query (query_id, query_embedding): query_id, key, distance, rank; and the cells read, a cell
        counting once for each query that meets its rows.

        A round reads, for each query that is not done, its next cells, all of them in one job; twice as many each time.
        """
        if metric not in REACH:
            raise ValueError(f"no bounds for {metric}: use search.nearest_many")
        rows = self.rows() if where is None else self.rows().where(where)
        queries = queries.select("query_id", "query_embedding")
        best = Window.partitionBy("query_id").orderBy("distance", self.key)
        asked, hits = queries.withColumn("reach", F.lit(None).cast("double")), None
        at, step, total = 0, max(1, self.probes), 0
        while at < max(1, len(self.centres)):
            here = [0]

            def cells_of(asked, vectors: np.ndarray, here=here, at=at, step=step) -> np.ndarray:
                order, least = (x[:, at : at + step] for x in self.bounds(vectors))
                reach = REACH[metric](asked["reach"].astype(float).to_numpy())
                wanted = np.isfinite(least) & (np.isnan(reach)[:, None] | (least <= reach[:, None]))
                here[0] += int(wanted.sum())
                return np.where(wanted, order, -1)

            found = nearest_many(rows, asked, k, metric, self.key, cells_of).drop("rank")
            both = found if hits is None else hits.drop("rank").unionByName(found)
            if hits is not None and not here[0]:
                break
            hits = written(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "hits")
            reach = hits.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))
            asked = queries.join(reach, "query_id", "left")
            at, step, total = at + step, 2 * step, total + here[0]
        return hits, total


#: The distance that a value of a metric stands for; other metrics have no triangle inequality.
REACH = {"squared_l2": np.sqrt, "l2": lambda d: d}


def with_cell(table: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with a vector, each with the cell nearest to it and its distance from that one's centre."""
    shared = table.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            batch = batch.filter(batch.column(at).is_valid())
            if batch.num_rows and len(shared.value):
                rows = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                cell = squared(rows, shared.value).argmin(1)
                gap = np.sqrt(((rows - shared.value[cell]) ** 2).sum(1))
                yield batch.append_column("gap", pa.array(gap)).append_column("cell", pa.array(cell.astype(np.int32)))

    return table.mapInArrow(run, StructType([*table.schema, StructField("gap", DoubleType()), StructField("cell", IntegerType())]))


def build(table: DataFrame, path: str, key: str = "id", cells: int | None = None) -> InvertedFile:
    """An index of all rows of a table (key, embedding and whatever else a search is to return) at path.

    In a cell, rows are ordered by gap, so that a filter on it skips row groups. Centres and radii are kept beside the rows.
    """
    spark = table.sparkSession
    sample = table.where("embedding is not null").select(key, "embedding").orderBy(F.xxhash64(key), key).limit(SAMPLE).toPandas()
    vectors = np.array([np.asarray(v, float) for v in sample["embedding"]]) if len(sample) else np.zeros((0, 0))
    if cells is None:  # as many as the root of the rows: cells and their sizes grow alike
        cells = min(MOST_CELLS, max(1, int(np.sqrt(table.count()))))
    centres = centres_of(vectors, min(cells, len(vectors))) if len(vectors) else vectors
    rows = with_cell(table, centres)
    rows.repartition("cell", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("cell", "gap").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    probes = probes_for(vectors, centres) if len(vectors) else 0
    built = InvertedFile(spark, path, centres, np.full(len(centres), -1.0), probes, rows.schema, key)
    for r in built.rows().groupBy("cell").agg(F.max("gap").alias("radius")).collect():  # a row a cell
        built.radius[r["cell"]] = r["radius"]
    kept = [(i, [float(x) for x in c], float(built.radius[i]), None, None, None) for i, c in enumerate(centres)]
    spark.createDataFrame([(-1, None, None, probes, key, rows.schema.json()), *kept], CELLS).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return built


#: A row for the whole index, cell -1, and one for each cell.
CELLS = "cell int, centre array<double>, radius double, probes int, key string, schema string"


def load(spark: SparkSession, path: str) -> InvertedFile:
    """An index that was built before."""
    whole, *cells = spark.read.schema(CELLS).parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS rows
    centres = np.array([r["centre"] for r in cells], float) if cells else np.zeros((0, 0))
    return InvertedFile(spark, path, centres, np.array([r["radius"] for r in cells]), whole["probes"], StructType.fromJson(json.loads(whole["schema"])), whole["key"])
