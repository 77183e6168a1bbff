"""Toxicity by cumulative-link ordinal regression on sparse text features.

Words are runs of letters, A-Z lower-cased; features are whole words and their first 4 to 7 bytes, each also as
"at least 2, 3 and 4 times". Training keeps the features that stand out in toxic texts. Severity grades 0 .. GRADES - 1:
0 is a text not labelled toxic; labelled ones are graded by how much evidence they hold, in equal parts. That evidence is
cross-fitted: labels are dealt to two folds, and a text is weighed by the log odds that the other fold gives its
features, so that no text's grade comes from its own label. One weight vector is shared by all grades: P(grade > j) = sigmoid(w . x - threshold_j), with
ascending thresholds; the expected severity is the sum of these. A text is rejected if P(grade > 0) >= REJECT.

The model is fitted on at most MAX_ROWS labelled rows, those least by a hash of the id. Executors count in how many of
these texts each feature occurs; the driver gets the features that pass and, of each labelled text, its counts of
these. Scoring reads every whole text, without a shuffle.

Nulls: null labels and labels of unknown ids teach nothing; a null or empty text has no evidence and is kept.
Without toxic labels nothing is rejected. Ties: of grades equally likely the least is given; of labels with one hash
those of the smaller id, then of the smaller label, are learnt from. Null ids and repeated rows are scored like others
(a labelled text that is repeated counts each time); an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.frames import packed, saved, small_batches, unpacked
from noticeflow.llm.textkit import BYTE_CODE, LOWER, Rolling, Slice, column, mix, slices, text_buffers, tidy, trimmed

GRADES = 4
MAX_ROWS = 12000
REJECT = 0.5
PREFIXES = (4, 5, 6, 7)
#: What a feature is combined with to say that it occurs at least so many times.
AGAIN = {k: mix(np.array([k], np.uint64))[0] for k in (2, 3, 4)}
#: A feature counts if it is at least so many times as frequent in toxic texts, by so many standard errors, in so many of them.
LEAST_ODDS, LEAST_ERRORS, LEAST_TEXTS = 20, 2.5, 3

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True

SCORE = "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean"


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words of a slice, and the document of each."""
    low = LOWER[s.buf]
    inside = LETTER[low]
    n = len(low)
    cut = np.zeros(n + 1, bool)
    cut[s.bounds] = True
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    starts = np.flatnonzero(inside & (~before[:n] | cut[:n]))
    ends = np.flatnonzero(inside & (~after[:n] | cut[1:])) + 1
    doc = np.searchsorted(s.bounds, starts, "right") - 1
    rolling = Rolling(BYTE_CODE[0][low])
    found, owner = [rolling.ranges(starts, ends)], [doc]
    for k in PREFIXES:
        long = ends - starts >= k
        found.append(mix(rolling.ranges(starts[long], starts[long] + k) + np.uint64(k)))
        owner.append(doc[long])
    return np.concatenate(found), np.concatenate(owner)


def held(s: Slice, keys: np.ndarray | None = None, sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text, the text of each and how often it occurs there, sorted by text; with keys (sorted),
    the places in keys of those among them. That a feature occurs at least 2, 3, .. times is a feature too, which occurs once."""
    f, d = features(s)
    if sieve is not None:
        may = sieve[f & np.uint64(len(sieve) - 1)]
        f, d = f[may], d[may]
    order = np.lexsort((f, d))
    f, d = f[order], d[order]
    new = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (d[1:] != d[:-1])]) if len(f) else np.zeros(0, int)
    times = np.diff(np.r_[new, len(f)])
    f, d = f[new], d[new]
    more = [(f[times >= k] ^ tag, d[times >= k]) for k, tag in AGAIN.items()]
    f, times = np.concatenate([f, *(x for x, _ in more)]), np.concatenate([times, *(np.ones(len(x), int) for x, _ in more)])
    d = np.concatenate([d, *(x for _, x in more)])
    if keys is not None:
        at = np.minimum(np.searchsorted(keys, f), max(0, len(keys) - 1))
        own = np.flatnonzero(keys[at] == f) if len(keys) else np.zeros(0, int)
        f, d, times = at[own], d[own], times[own]
    order = np.argsort(d, kind="stable")
    return f[order], d[order], times[order]


def sieve_of(keys: np.ndarray) -> np.ndarray:
    """Which low bits occur among the features that the keys are made of."""
    sieve = np.zeros(1 << 20, bool)
    for tag in (np.uint64(0), *AGAIN.values()):
        sieve[(keys ^ tag) & np.uint64((1 << 20) - 1)] = True
    return sieve


def spread(texts: DataFrame) -> DataFrame:
    """feature, and in how many texts of each fold and label it occurs (n00: fold 0, not toxic); a null feature counts
    the texts. texts: text, toxic (0 or 1), fold (0 or 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            kind = (column(batch, "fold").to_numpy() * 2 + column(batch, "toxic").to_numpy()).astype(np.int64)
            for s in slices(data, offsets):
                f, d, _ = held(s)
                of = kind[s.i : s.j]
                keys, at = np.unique(f, return_inverse=True)
                counts = np.bincount(at * 4 + of[d], minlength=4 * len(keys)).reshape(-1, 4)
                counts = np.r_[counts, np.bincount(of, minlength=4)[None]]
                yield pa.RecordBatch.from_arrays([pa.array([*keys.view(np.int64).tolist(), None], pa.int64()), *(pa.array(counts[:, k], pa.int64()) for k in range(4))], ["feature", *N])

    return texts.mapInArrow(tidy(run), "feature long, " + ", ".join(f"{x} long" for x in N)).groupBy("feature").agg(*(F.sum(x).alias(x) for x in N))


N = ("n00", "n01", "n10", "n11")


def counted(texts: DataFrame, keys: np.ndarray) -> DataFrame:
    """Of each text its label, fold, the keys it holds (as places in keys) and how often."""
    shared = texts.sparkSession.sparkContext.broadcast((keys, sieve_of(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            for s in slices(data, offsets):
                f, d, times = held(s, *shared.value)
                at = np.searchsorted(d, np.arange(s.n + 1))
                parts = lambda x: pa.array([x[a:b].astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([column(batch, "toxic").slice(s.i, s.n), column(batch, "fold").slice(s.i, s.n), parts(f), parts(times)], ["toxic", "fold", "keys", "times"])

    return texts.mapInArrow(tidy(run), "toxic int, fold int, keys binary, times binary")


class Sparse:
    """A matrix by its cells that are not 0."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value, shape

    @classmethod
    def of(cls, x: np.ndarray) -> Sparse:
        row, col = np.nonzero(x)
        return cls(row, col, x[row, col], x.shape)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def transposed_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], self.shape[1])


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j, from w . x."""
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(x: Sparse, grade: np.ndarray, grades: int, rounds: int = 400, ridge: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (not negative) and ascending thresholds of a cumulative-link model, by Adam on the log likelihood."""
    n, d = x.shape
    w, cuts = np.full(d, 0.5), np.r_[2.0, np.full(grades - 2, -0.5)]  # the first threshold and the logs of the steps
    p = np.concatenate([w, cuts])
    m, v = np.zeros_like(p), np.zeros_like(p)
    share = np.bincount(grade, minlength=grades)
    weight = np.where(grade > 0, 0.5 * n / max(1, share[1:].sum()), 0.5 * n / max(1, share[0]))
    for t in range(1, rounds + 1):
        theta = np.r_[p[d], p[d] + np.cumsum(np.exp(p[d + 1 :]))]
        z = x.dot(p[:d])
        upper = np.r_[theta, np.inf][grade]  # P(grade <= g) has the threshold of g
        lower = np.r_[-np.inf, theta][grade]
        cu, cl = 1 / (1 + np.exp(-np.clip(upper - z, -40, 40))), 1 / (1 + np.exp(-np.clip(lower - z, -40, 40)))
        cu[np.isinf(upper)], cl[np.isinf(lower)] = 1, 0
        like = np.maximum(cu - cl, 1e-9)
        du, dl = cu * (1 - cu) / like * weight, cl * (1 - cl) / like * weight
        g = np.zeros_like(p)
        g[:d] = x.transposed_dot(du - dl) / n + ridge * p[:d]
        on = np.zeros(grades - 1)
        np.add.at(on, np.minimum(grade, grades - 2)[grade < grades - 1], -du[grade < grades - 1])
        np.add.at(on, grade[grade > 0] - 1, dl[grade > 0])
        on /= n
        g[d] = on.sum()
        for k in range(grades - 2):
            g[d + 1 + k] = on[k + 1 :].sum() * np.exp(p[d + 1 + k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p[:d] = np.maximum(p[:d], 0)
    return p[:d], np.r_[p[d], p[d] + np.cumsum(np.exp(p[d + 1 :]))]


def log_odds(toxic: np.ndarray, fine: np.ndarray, n_toxic: int, n_fine: int) -> tuple[np.ndarray, np.ndarray]:
    """How much more frequent features are in toxic texts, and that in standard errors."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((fine + 0.5) / (n_fine + 1))
    return ratio, ratio / np.sqrt(1 / (toxic + 0.5) + 1 / (fine + 0.5))


@trimmed
def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, grades: int = GRADES) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold"))
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, 60.0))
    found = saved(spread(texts))
    n = found.where("feature is null").select(*N).first()
    if n is None or not n.n01 + n.n11 or not n.n00 + n.n10:
        return empty
    n_toxic, n_fine = n.n01 + n.n11, n.n00 + n.n10
    a, b = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
    ratio = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_fine + 1))
    good = (ratio > math.log(LEAST_ODDS)) & (ratio / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > LEAST_ERRORS) & (a >= LEAST_TEXTS)
    table = np.array([tuple(r) for r in found.where(F.col("feature").isNotNull() & good).select("feature", *N).collect()], np.int64).reshape(-1, 5)
    if not len(table):
        return empty
    keys = np.ascontiguousarray(table[:, 0]).view(np.uint64)
    order = np.argsort(keys)
    keys, table = keys[order], table[order, 1:].astype(float)
    rows = sorted(tuple(r) for r in counted(texts, keys).toLocalIterator())  # in an order that partitions don't change
    sizes = np.array([len(k) // 4 for _, _, k, _ in rows])
    col = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).astype(np.int64)
    x = Sparse(np.repeat(np.arange(len(rows)), sizes), col, np.log1p(np.frombuffer(b"".join(r[3] for r in rows), np.uint32).astype(float)), (len(rows), len(keys)))
    y, fold = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    total = np.zeros(len(rows))
    for k, (fine, toxic) in enumerate(((2, 3), (0, 1))):  # the texts of fold k are weighed by the other one
        odds = np.maximum(0, log_odds(table[:, toxic], table[:, fine], int(n[toxic]), int(n[fine]))[0])
        total = np.where(fold == k, x.dot(odds), total)
    steps = np.quantile(total[y == 1], [k / (grades - 1) for k in range(1, grades - 1)])
    grade = np.where(y == 1, 1 + np.searchsorted(steps, total, "left"), 0)
    return Model(keys, *fit_ordinal(x, grade, grades))


def severities(model: Model, sieve: np.ndarray, s: Slice) -> np.ndarray:
    """P(grade > j) of each text of a slice."""
    at, d, times = held(s, model.keys, sieve)
    z = np.bincount(d, model.weights[at] * np.log1p(times), s.n) if len(at) else np.zeros(s.n)
    return model.above(z)


def scored(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """A row a document: expected_severity, p_toxic (P of a grade over 0), the likeliest grade, toxic (rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, sieve_of(model.keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            doc_ids = column(batch, "doc_id")
            for s in slices(data, offsets):
                above = severities(*shared.value, s)
                chance = -np.diff(np.c_[np.ones(s.n), above, np.zeros(s.n)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(s.i, s.n), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(chance.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= reject)],
                    ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCORE)


def accepted(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of docs, all columns, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast((model, sieve_of(model.keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            for s in slices(data, offsets):
                yield batch.slice(s.i, s.n).filter(pa.array(severities(*shared.value, s)[:, 0] < reject))

    rows = packed(docs)
    return unpacked(rows.mapInArrow(tidy(run), rows.schema), docs.columns)
