"""Hard-negative mining by dual-tree search.

Components become floor(scale * x); a score is the integer inner product of two such vectors. Each anchor has positives, its best rows
of the same label but itself, and for each positive negatives: the best rows of other labels whose score is between ``low`` and
``high`` percent of the positive's. Higher scores come first, ties by the smaller id.

Rows are dealt once by label and by the cell of a kd-tree fitted on at most SAMPLE rows (all rows get a cell), and saved in that order:
the upper part of the candidates' tree, whose cells are tasks' rows and stay whole whatever their number, as a cell is cut further
by a hash. Anchors are taken in blocks of at most MAX_ANCHORS rows and BLOCK_BYTES of vectors, neighbours together. A block's tree
is broadcast; a task builds a tree over some rows at a time and searches both at once: labels, and the interval that centres and
radii set for the inner products of two nodes, discard all anchors of one with all rows of the other; leaf pairs are multiplied out.
A task keeps as many rows for an anchor as are asked for, and only these are shuffled. The positives of a block set the score bands
of the second search. Each block's result is appended to one saved table. Nothing is approximate: intervals are widened by more than
their rounding, and rows that tie with the last one kept are looked at.

Nulls: rows with a null label or vector, or a null or non-finite component, take no part; a row with a null id is a candidate that
comes after all others on ties, never an anchor. Rows with one id are rows of their own: each that is an anchor has its own results,
and the others may be its positives. An anchor without positives, or without rows in a band, has no rows. An empty table gives
no rows. Extra columns are ignored. Vectors of several lengths, and products above 2 ** 63, are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.frames import NO_ID, partitions, saved, scoped
from noticeflow.llm.vector_codes import integers
from noticeflow.sources.readers import with_rank
from noticeflow.storage import new_table

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
SAMPLE, CELLS = 20000, 256
MAX_ANCHORS, BLOCK_BYTES = 8192, 32 << 20
CHUNK_ROWS, CHUNK_BYTES = 16384, 16 << 20
ANCHOR_LEAF, ROW_LEAF = 32, 128


@dataclass
class Tree:
    """Nodes over rows that are put in order: each is a run of rows, with the centre and radius of their vectors and the least
    and greatest label. Labels are told apart first; then vectors are halved on the component that varies most."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray  # the first of two children that follow each other; -1 for a leaf
    centre: np.ndarray
    radius: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
        order = np.argsort(labels, kind="stable")
        runs, child = [(0, len(order))], []
        k = 0
        while k < len(runs):
            b, e = runs[k]
            own = labels[order[b:e]]
            turn = np.flatnonzero(own[1:] != own[:-1]) + 1
            if len(turn):
                middle = b + int(turn[np.abs(turn - len(own) / 2).argmin()])
            elif e - b > leaf:
                part = vectors[order[b:e]]
                axis = int((part.max(0) - part.min(0)).argmax()) if part.shape[1] else 0
                middle = b + (e - b) // 2
                if part.shape[1]:
                    order[b:e] = order[b:e][np.argpartition(part[:, axis], middle - b)]
            else:
                child.append(-1)
                k += 1
                continue
            child.append(len(runs))
            runs += [(b, middle), (middle, e)]
            k += 1
        begin, end = np.array([b for b, _ in runs]), np.array([e for _, e in runs])
        centre, radius = np.zeros((len(runs), vectors.shape[1])), np.zeros(len(runs))
        for k, (b, e) in enumerate(runs):
            part = vectors[order[b:e]]
            centre[k] = part.mean(0)
            radius[k] = np.sqrt(((part - centre[k]) ** 2).sum(1).max())
        return Tree(order, begin, end, np.array(child), centre, radius, labels[order[begin]], labels[order[end - 1]])


def intervals(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product that rows of two nodes can have, [nodes of a, nodes of b], wider than rounding."""
    dot = a.centre @ b.centre.T
    size_a, size_b = np.sqrt((a.centre**2).sum(1)), np.sqrt((b.centre**2).sum(1))
    reach = a.radius[:, None] * size_b[None, :] + size_a[:, None] * b.radius[None, :] + a.radius[:, None] * b.radius[None, :]
    reach = reach + 0.5 + 1e-9 * (np.abs(dot) + reach)
    return dot - reach, dot + reach


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as int64; the rows are float64 or int64."""
    most = (float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("inner products do not fit 63 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The k best (score, id) for each of some askers, as rows of two arrays; empty places score the least number."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, askers: int, k: int):
        self.score = np.full((askers, k), self.NONE)
        self.id = np.full((askers, k), NO_ID)

    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, asker: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(asker):
            return
        k = self.score.shape[1]
        who, here = np.unique(asker, return_inverse=True)
        own = np.concatenate([here, np.repeat(np.arange(len(who)), k)])
        s, i = np.concatenate([score, self.score[who].ravel()]), np.concatenate([ids, self.id[who].ravel()])
        order = np.lexsort((i, -s, own))  # an empty place's negative is itself and would be first, so it is moved below
        order = order[np.lexsort((s[order] == self.NONE, own[order]))]
        first = np.searchsorted(own[order], np.arange(len(who)))
        pick = order[first[:, None] + np.arange(k)[None, :]]
        self.score[who], self.id[who] = s[pick], i[pick]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asker, place = np.nonzero(self.score != self.NONE)
        return asker, self.score[asker, place], self.id[asker, place]


@dataclass
class Anchors:
    """A block of anchors in the order of their tree."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    tree: Tree
    positive_id: np.ndarray | None = None  # [anchors, positives]; set once these are known
    positive_score: np.ndarray | None = None
    low: np.ndarray | None = None  # the band of each; empty where there is no such positive
    high: np.ndarray | None = None


def _positive(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    """Meets anchors with rows of their label."""
    a, b = anchors.tree, Tree.of(vectors, labels, ROW_LEAF)
    ids, vectors = ids[b.order], vectors[b.order]
    _, high = intervals(a, b)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        if a.least[i] > b.most[j] or b.least[j] > a.most[i] or high[i, j] < best.last()[a.begin[i] : a.end[i]].min():
            continue
        if a.child[i] < 0 and b.child[j] < 0:
            rows = slice(a.begin[i], a.end[i])
            score = products(anchors.vectors[rows], vectors[b.begin[j] : b.end[j]])
            who, which = np.nonzero(score >= best.last()[rows, None])
            best.add(who + a.begin[i], score[who, which], ids[b.begin[j] + which])
        else:
            todo += sorted(_split(a, b, i, j), key=lambda p: high[p])


def _negative(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    """Meets the bands of anchors with rows of other labels; an asker is an anchor's place times the positives, plus the positive's."""
    a, b = anchors.tree, Tree.of(vectors, labels, ROW_LEAF)
    ids, vectors, labels = ids[b.order], vectors[b.order], labels[b.order]
    low, high = intervals(a, b)
    kinds = anchors.low.shape[1]
    top = anchors.high.max(1)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        same = a.least[i] == a.most[i] == b.least[j] == b.most[j]
        rows = slice(a.begin[i], a.end[i])
        if same or low[i, j] > top[rows].max():
            continue
        floor = np.maximum(anchors.low[rows], best.last().reshape(-1, kinds)[rows])
        if high[i, j] < floor.min():
            continue
        if a.child[i] < 0 and b.child[j] < 0:
            here = slice(b.begin[j], b.end[j])
            score = products(anchors.vectors[rows], vectors[here])
            who, which = np.nonzero((score >= floor.min(1)[:, None]) & (score <= top[rows][:, None]) & (anchors.labels[rows][:, None] != labels[here][None, :]))
            s = score[who, which]
            at, kind = np.nonzero((s[:, None] >= floor[who]) & (s[:, None] <= anchors.high[rows][who]))
            best.add((a.begin[i] + who[at]) * kinds + kind, s[at], ids[b.begin[j] + which[at]])
        else:
            todo += sorted(_split(a, b, i, j), key=lambda p: high[p])


def _split(a: Tree, b: Tree, i: int, j: int) -> list[tuple[int, int]]:
    """Node pairs below a pair: of both children where there are some."""
    left = (i,) if a.child[i] < 0 else (a.child[i], a.child[i] + 1)
    right = (j,) if b.child[j] < 0 else (b.child[j], b.child[j] + 1)
    return [(x, y) for x in left for y in right]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of some rows (_id, label, q) at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = size = 0

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        _, q = integers(batch.column(2))
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), q))
        rows, size = rows + len(q), size + q.nbytes
        if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
            yield whole()
            held, rows, size = [], 0, 0
    if held:
        yield whole()


def _search(rows: DataFrame, anchors: Anchors, meet, askers: int, k: int) -> DataFrame:
    """asker, score, id: the k best for each asker over all rows, k a task."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(askers, k)
        for ids, labels, vectors in _chunks(batches):
            meet(shared.value, ids, labels, vectors, best)
        asker, score, ids = best.rows()
        for i in range(0, len(asker), 10000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 10000]) for x in (asker, score, ids)], ["asker", "score", "id"])

    found = rows.select("_id", "label", "q").mapInArrow(run, "asker long, score long, id long")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _celled(rows: DataFrame) -> DataFrame:
    """rows with a cell: the leaf of a kd-tree that is fitted on a sample, the rows least by a hash."""
    sample = [r["q"] for r in rows.orderBy(F.xxhash64("_id", "q"), "_id").select("q").limit(SAMPLE).collect()]
    if len({len(v) for v in sample}) > 1:
        raise ValueError("vectors of several lengths")
    vectors = np.array(sample, float).reshape(len(sample), len(sample[0]) if sample else 0)
    cuts: list[tuple[int, int, float]] = []  # node, component, value

    def halve(k: int, own: np.ndarray) -> None:
        if 2 * k + 2 >= 2 * CELLS - 1 or len(own) < 2 or not vectors.shape[1]:
            return
        spread = np.ptp(vectors[own], axis=0)
        axis = int(spread.argmax())
        value = float(np.median(vectors[own, axis]))
        below = vectors[own, axis] < value
        if not spread[axis] or not below.any():
            return
        cuts.append((k, axis, value))
        halve(2 * k + 1, own[below])
        halve(2 * k + 2, own[~below])

    halve(0, np.arange(len(vectors)))
    axis, value = np.full(2 * CELLS, -1), np.zeros(2 * CELLS)
    for k, x, v in cuts:
        axis[k], value[k] = x, v
    shared = rows.sparkSession.sparkContext.broadcast((axis, value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axis, value = shared.value
        for batch in batches:
            if batch.num_rows:
                _, q = integers(batch.column(2))
                node = np.zeros(len(q), np.int64)
                while (inner := axis[node] >= 0).any():
                    who, at = np.flatnonzero(inner), node[inner]
                    node[who] = 2 * at + 1 + (q[who, axis[at]] >= value[at])
                yield batch.append_column("cell", pa.array(node))

    return rows.select("_id", "label", "q", "anchor").mapInArrow(run, "_id long, label long, q array<int>, anchor boolean, cell long")


def prepared(table: DataFrame, is_anchor: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """The rows that take part (_id, label, q, anchor, cell), dealt and saved so that near rows of a label lie together."""
    rows = table.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor")
    )
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where(usable).select(F.coalesce("vec_id", F.lit(NO_ID)).alias("_id"), "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"), "anchor")
    keys = ["label", "cell", F.xxhash64("_id")]
    return saved(_celled(whole).repartitionByRange(partitions(table), *keys).sortWithinPartitions(*keys))


def _block(rows: list) -> Anchors:
    labels = np.array([r["label"] for r in rows], np.int64)
    vectors = np.array([r["q"] for r in rows], float).reshape(len(rows), len(rows[0]["q"]))
    tree = Tree.of(vectors, labels, ANCHOR_LEAF)
    return Anchors(np.array([r["_id"] for r in rows], np.int64)[tree.order], labels[tree.order], vectors[tree.order], tree)


def _with_positives(anchors: Anchors, found: list, k: int, low: int, high: int) -> Anchors:
    """found: asker, score, id of the k + 1 best rows of each anchor's label, among which it may be itself."""
    n = len(anchors.ids)
    own = [int(products(v[None], v[None])[0, 0]) for v in anchors.vectors]
    ids, scores = np.full((n, k), NO_ID), np.zeros((n, k), np.int64)
    bottom, top = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.iinfo(np.int64).min)
    here, itself = np.zeros(n, int), np.zeros(n, bool)
    for r in sorted(found, key=lambda r: (r["asker"], r["rank"])):
        i = r["asker"]
        if not itself[i] and r["id"] == anchors.ids[i] and r["score"] == own[i]:
            itself[i] = True  # one such row is the anchor
        elif here[i] < k:
            at, s = here[i], r["score"]
            ids[i, at], scores[i, at] = r["id"], s
            if low * s <= high * s:  # an empty band otherwise
                bottom[i, at], top[i, at] = -(-low * s // 100), high * s // 100
            here[i] += 1
    return Anchors(anchors.ids, anchors.labels, anchors.vectors, anchors.tree, ids, scores, bottom, top)


@scoped
def mined(
    table: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    max_anchors: int = MAX_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors of a table."""
    spark = table.sparkSession
    rows = prepared(table, is_anchor, scale, id_col, vector_col, label_col)
    asked = rows.where("anchor").select("_id", "label", "q", "cell")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    room = max(1, min(max_anchors, BLOCK_BYTES // (8 * max(1, width))))
    if n > room:
        asked = with_rank(asked, "label", "cell", "_id", name="place")
    path = new_table(spark)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    empty.write.parquet(path)
    for begin in range(0, n, room):
        part = asked.where(F.col("place").between(begin, begin + room - 1)) if n > room else asked
        anchors = _block(part.collect())
        near = _search(rows, anchors, _positive, len(anchors.ids), positives + 1).collect()
        anchors = _with_positives(anchors, near, positives, low, high)
        found = _search(rows, anchors, _negative, anchors.low.size, negatives)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(anchors.ids)), np.arange(positives), indexing="ij"))
        named = spark.createDataFrame(pa.table({"asker": np.arange(len(i)), "anchor_id": anchors.ids[i], "positive_id": anchors.positive_id[i, j], "positive_score": anchors.positive_score[i, j]}))
        real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        out = found.withColumnRenamed("id", "negative_id").join(F.broadcast(named), "asker")
        out.select("anchor_id", real("positive_id"), F.col("rank").cast("int").alias("rank"), real("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)
