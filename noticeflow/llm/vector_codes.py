"""Vector code compression: product codes of integer vectors, with codebooks fitted by rounds over all rows.

Each component x becomes floor(SCALE * x); a vector is cut into ``parts`` equal consecutive parts. Each part position has a
codebook, which starts as that part of the vectors of the least ids. In a round a kd-tree of every codebook is broadcast (a few
kilobytes, set by the parameters alone); a task finds the nearest entry of each part of its rows by branch and bound and adds up
integer sums and counts, of which parts * entries * (width + 1) numbers a task are shuffled; then each entry becomes the floor of
its parts' mean, and an entry without parts stays. All distances are exact integers. Ties go to the lower index: a node whose
bound equals the best distance so far is still visited, and of equal distances the lower index is taken.

The input is read once a round and once for the final codes; a caller whose vectors are the result of a long plan saves them first.
A round that loses an executor recomputes its tasks: nothing but the entries lives between rounds.

Nulls: rows whose vector is null or holds a null or non-finite component are dropped; a null id ranks above all others and is
returned as null, null labels count as one label. Rows with one id: the one with the lesser vector (by component) comes first among
those that start a codebook; otherwise each row is a row. With fewer vectors than entries, all of them start the codebooks. An empty
table, or one without a usable vector, gives no rows. Extra columns are ignored. Vectors of several lengths, of a length that
the number of parts does not divide, or with |floor(SCALE * x)| >= 2 ** 27 (errors would not fit a long) are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from noticeflow.llm.frames import BROADCAST_BYTES, saved, scoped

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST = 1 << 27
BLOCK_ROWS = 8192


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow list column are usable, and their integer components [rows, width]."""
    lengths = np.diff(column.offsets.to_numpy())
    here = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is a NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    here &= np.bincount(row[~np.isfinite(x)], minlength=len(lengths)) == 0
    widths = np.unique(lengths[here])
    if len(widths) > 1:
        raise ValueError(f"vectors of several lengths: {widths.tolist()}")
    return here, x[here[row]].reshape(int(here.sum()), int(widths[0]) if len(widths) else 0)


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    q = np.floor(x * scale)
    if q.size and np.abs(q).max() >= MOST:
        raise ValueError(f"a component of {np.abs(x).max()} is too large for scale {scale}")
    return q.astype(np.int64)


@dataclass
class Tree:
    """A kd-tree of entries: node k has the children 2 k + 1 and 2 k + 2; leaves hold entries in ascending order of index.

    Each node has the bounding box of its entries, which bounds the distance of a point to any of them from below.
    """

    low: np.ndarray  # [nodes, width]
    high: np.ndarray
    axis: np.ndarray  # -1: a leaf, -2: no node
    cut: np.ndarray
    leaves: dict[int, np.ndarray]
    entries: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, leaf: int = 4) -> Tree:
        depth = max(0, int(np.ceil(np.log2(max(1, len(entries)) / leaf))))
        n = (2 << depth) - 1
        low, high = np.zeros((n, entries.shape[1]), np.int64), np.zeros((n, entries.shape[1]), np.int64)
        axis, cut, leaves = np.full(n, -2), np.zeros(n, np.int64), {}

        def put(k: int, own: np.ndarray, level: int) -> None:
            low[k], high[k] = entries[own].min(0), entries[own].max(0)
            wide = high[k] - low[k]
            if level == depth or len(own) <= leaf or not wide.any():
                axis[k], leaves[k] = -1, np.sort(own)
                return
            axis[k] = int(wide.argmax())
            order = own[np.argsort(entries[own, axis[k]], kind="stable")]
            half = len(order) // 2
            cut[k] = entries[order[half], axis[k]]
            put(2 * k + 1, order[:half], level + 1)
            put(2 * k + 2, order[half:], level + 1)

        if len(entries):
            put(0, np.arange(len(entries)), 0)
        return Tree(low, high, axis, cut, leaves, entries)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance to it, of each point [rows, width].

        All points first go down to the leaf on their side of the cuts; then each node is visited by the points whose distance
        to its box is not above the best that they know.
        """
        rows = len(points)
        best, index = np.full(rows, np.iinfo(np.int64).max), np.full(rows, len(self.entries))
        home = np.zeros(rows, np.int64)
        while (inner := self.axis[home] >= 0).any():
            at, who = home[inner], np.flatnonzero(inner)
            home[who] = 2 * at + 1 + (points[who, self.axis[at]] >= self.cut[at])

        def look(leaf: int, who: np.ndarray) -> None:
            own = self.leaves[leaf]
            d = ((points[who, None, :] - self.entries[own][None, :, :]) ** 2).sum(2)
            j = d.argmin(1)  # the first of equal ones, so the lower index
            d, j = d[np.arange(len(who)), j], own[j]
            better = (d < best[who]) | ((d == best[who]) & (j < index[who]))
            best[who[better]], index[who[better]] = d[better], j[better]

        for leaf in self.leaves:
            look(leaf, np.flatnonzero(home == leaf))
        waiting = [(0, np.arange(rows))]
        while waiting:
            k, who = waiting.pop()
            p = points[who]
            out = np.maximum(self.low[k] - p, 0) + np.maximum(p - self.high[k], 0)
            who = who[(out * out).sum(1) <= best[who]]
            if not len(who):
                continue
            if self.axis[k] >= 0:
                waiting += [(2 * k + 1, who), (2 * k + 2, who)]
            else:
                look(k, who[home[who] != k])
        return index, best


def cut(q: np.ndarray, parts: int) -> np.ndarray:
    """[rows, width] as [parts, rows, width of a part]."""
    if q.shape[1] % parts:
        raise ValueError(f"vectors of length {q.shape[1]} cannot be cut into {parts} equal parts")
    return q.reshape(len(q), parts, q.shape[1] // parts).transpose(1, 0, 2)


def _blocks(batch: pa.RecordBatch, scale: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of usable rows, and their integer vectors, some rows at a time; the vectors are the last column."""
    here, x = integers(batch.column(batch.num_columns - 1))
    if len(x) and x.shape[1] != width:
        raise ValueError(f"vectors of several lengths: {width}, {x.shape[1]}")
    at, q = np.flatnonzero(here), quantised(x, scale)
    for i in range(0, len(q), BLOCK_ROWS):
        yield at[i : i + BLOCK_ROWS], q[i : i + BLOCK_ROWS]


@dataclass
class Codebooks:
    entries: np.ndarray  # [parts, entries, width of a part]
    scale: int = SCALE

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Tree]:
        return [Tree.of(e) for e in self.entries]

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for: the middles of its components' cells."""
        return [(x + 0.5) / self.scale for e, i in zip(self.entries, bytes.fromhex(code), strict=True) for x in e[i].tolist()]


def first_entries(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the usable vectors of least id, [parts, entries, width of a part]."""
    usable = rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    found = [r["vector"] for r in usable.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    if len({len(v) for v in found}) > 1:
        raise ValueError(f"vectors of several lengths: {sorted({len(v) for v in found})}")
    return cut(quantised(np.array(found, float).reshape(len(found), len(found[0]) if found else 0), scale), parts)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of all usable vectors of rows (vec_id, vector)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    spark = rows.sparkSession
    books = Codebooks(first_entries(rows, parts, entries, scale), scale)
    _, n, wide = books.entries.shape
    for _ in range(rounds if n else 0):
        shared = spark.sparkContext.broadcast(books.trees())

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, n, wide + 1), np.int64)  # the last column counts
            for batch in batches:
                for _, q in _blocks(batch, scale, parts * wide):
                    for p, (tree, points) in enumerate(zip(shared.value, cut(q, parts), strict=True)):
                        own = tree.nearest(points)[0]
                        np.add.at(sums[p], own, np.concatenate([points, np.ones((len(points), 1), np.int64)], 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["slot", "total"])

        added = rows.select("vector").mapInArrow(add, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
        sums = np.zeros(parts * n * (wide + 1), np.int64)
        for r in added:
            sums[r["slot"]] = r["total"]
        sums = sums.reshape(parts, n, wide + 1)
        used = sums[:, :, -1:] > 0
        books = Codebooks(np.where(used, sums[:, :, :-1] // np.maximum(sums[:, :, -1:], 1), books.entries), scale)
        shared.destroy()
    return books


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of each usable row of rows (vec_id, label, vector)."""
    parts, n, wide = books.entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, q in _blocks(batch, books.scale, parts * wide) if n else ():
                found = [tree.nearest(points) for tree, points in zip(shared.value, cut(q, parts), strict=True)]
                index = np.stack([i for i, _ in found], 1).astype(np.uint8)
                error = np.sum([d for _, d in found], 0)
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array([row.tobytes().hex() for row in index]), pa.array(error)], ["vec_id", "label", "code", "error"])

    schema = StructType([rows.schema["vec_id"], rows.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    return rows.select("vec_id", "label", "vector").mapInArrow(run, schema)


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes (a saved table) with the errors of all rows of a label added up, nulls together.

    The sums are broadcast if their measured size allows it. Beyond that, the sums of labels that hold more than a thousandth
    of the rows (fewer than a thousand labels) are, and the rows of the others meet theirs by a shuffle.
    """
    sums = saved(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    rows, labels = sums.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    same = F.col("label").eqNullSafe(F.col("_label"))
    add = lambda left, right: left.join(right, same, "inner").drop("_label", "_n")
    if labels * 64 <= BROADCAST_BYTES:
        return add(codes, F.broadcast(sums))
    frequent = F.broadcast(sums.where(F.col("_n") * 1000 > rows))
    rest = codes.join(frequent, same, "left_anti")
    return add(codes, frequent).unionByName(add(rest, sums.where(F.col("_n") * 1000 <= rows).hint("shuffle_merge")))


@scoped
def compressed(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of a table."""
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    books = fit(rows, parts, entries, rounds, scale)
    return with_label_error(saved(coded(rows, books))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
