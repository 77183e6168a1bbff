"""Quality classifier: a byte-level convolutional network in numpy.

Every byte position of a text is an input with two parts: the byte, and whether it repeats the byte at the same
place of the word before. Learned filters of WIDTH positions run over the whole text; after a rectifier their
responses are max-pooled over chunks of 2 * BLOCK bytes that overlap by BLOCK; the means and maxima over a text's
chunks go into one logistic unit. The filters and the unit are trained together by Adam, on the driver, on at
most MAX_ROWS labelled texts (those least by a hash of the id) and MAX_BYTES of them: a text that doesn't fit in what is left of
these is passed over, the others are learnt from whole. Scoring covers every byte of every text, slice by slice and piece by
piece, without a shuffle.

Nulls: a null or empty text has no chunks; its score is that of the unit's bias. Null labels, and labels of unknown
ids, teach nothing; with labels of one kind only, every score is that kind's. Null ids and repeated rows are
scored like others (a labelled text that is repeated teaches each time). Ties: of labels with one hash those of the
smaller id, then of the smaller label, are learnt from; a maximum that several blocks reach is the first one's. Very
long texts: responses are taken for PIECE positions at a time, with the same result; what grows with a text are its bytes and
the places of its words, some 8 bytes a byte. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.frames import small_batches
from noticeflow.llm.textkit import Slice, column, slices, text_buffers, tidy, trimmed

FILTERS, WIDTH, BLOCK = 12, 8, 128
MAX_ROWS, MAX_BYTES = 3000, 64 << 20  # learnt from; the driver holds twice the bytes
NET_SLICE = PIECE = 1 << 18


def repeats(s: Slice, piece: int | None = None) -> np.ndarray:
    """Whether each byte of a word equals the byte at the same place of the word before it in its text."""
    piece = piece or PIECE
    starts, ends, first = s.words()
    out = np.zeros(len(s.buf), np.uint8)
    if len(starts) < 2:
        return out
    has = np.ones(len(starts), bool)
    has[first[:-1][first[:-1] < len(starts)]] = False
    size = ends - starts
    length = np.where(has, np.minimum(size, np.r_[0, size[:-1]]), 0)  # bytes to compare
    done = np.r_[0, np.cumsum(length)]
    for p in range(0, int(done[-1]), piece):  # of these, some at a time
        i, j = np.searchsorted(done, p, "right") - 1, np.searchsorted(done, min(p + piece, done[-1]), "left")
        word = np.repeat(np.arange(i, j), np.minimum(done[i + 1 : j + 1], p + piece) - np.maximum(done[i:j], p))
        at = starts[word] + np.arange(p, p + len(word)) - done[word]
        out[at] = s.buf[at] == s.buf[at - (starts[word] - starts[word - 1])]
    return out


def padded(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and repeats of a slice with WIDTH zeros behind every text, and where the texts begin."""
    n = s.n
    begins = s.bounds[:-1] + np.arange(n) * WIDTH
    buf, rep = np.zeros(len(s.buf) + n * WIDTH, np.uint8), np.zeros(len(s.buf) + n * WIDTH, np.uint8)
    if n == 1:
        buf[: len(s.buf)], rep[: len(s.buf)] = s.buf, repeats(s)
    else:
        at = np.arange(len(s.buf)) + np.repeat(np.arange(n) * WIDTH, s.lengths)
        buf[at], rep[at] = s.buf, repeats(s)
    return buf, rep, begins


@dataclass
class Net:
    of_byte: np.ndarray  # [WIDTH, 256, FILTERS]
    of_repeat: np.ndarray  # [WIDTH, FILTERS]
    bias: np.ndarray  # [FILTERS]
    unit: np.ndarray  # [2 * FILTERS]
    shift: float

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Responses to pairs of bytes and to the repeats of a whole window, for looking up."""
        pairs = [(self.of_byte[k + 1][:, None, :] + self.of_byte[k][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for k in range(0, WIDTH, 2)]
        bits = (np.arange(1 << WIDTH)[:, None] >> np.arange(WIDTH)) & 1
        return pairs, (bits @ self.of_repeat + self.bias).astype(np.float32)


def windows_of_repeats(rep: np.ndarray, n: int) -> np.ndarray:
    code = np.zeros(n, np.uint8)
    for k in range(WIDTH):
        code[: max(0, min(n, len(rep) - k))] |= rep[k : k + n] << k
    return code


def responses(tables: tuple[list[np.ndarray], np.ndarray], buf: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Rectified filter responses at every position of a padded buffer."""
    pairs, of_repeat = tables
    n = len(buf)
    wide = np.zeros(n + WIDTH + 1, np.uint16)
    wide[:n] = buf
    two = wide[:-1] | (wide[1:] << 8)
    out = of_repeat[windows_of_repeats(rep, n)]
    for i, table in enumerate(pairs):
        out += table[two[2 * i : 2 * i + n]]
    return np.maximum(out, 0, out=out)


def pooled(blocks: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Means and maxima over each text's chunks, from maxima of blocks. of: the first block of each text (n + 1 values)."""
    counts = np.diff(of)
    out = np.zeros((n, 2 * FILTERS), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        chunks = blocks.copy()
        follows = np.ones(len(blocks), bool)
        follows[of[some + 1] - 1] = False
        at = np.flatnonzero(follows)
        chunks[at] = np.maximum(blocks[at], blocks[at + 1])
        # the last block of a text with several is part of the chunk before; it is no chunk of its own
        own = np.ones(len(blocks), bool)
        own[(of[some + 1] - 1)[counts[some] > 1]] = False
        sums = np.add.reduceat(np.where(own[:, None], chunks, 0), of[some], axis=0)
        out[some, :FILTERS] = sums / np.maximum(1, counts[some] - 1)[:, None]
        out[some, FILTERS:] = np.maximum.reduceat(blocks, of[some], axis=0)
    return out


def document_features(tables, s: Slice, piece: int | None = None) -> np.ndarray:
    """Means and maxima over the chunks of each text. Responses are taken for about ``piece`` positions at a time, which end
    where a block does; the positions behind a piece that its last windows need are read with it."""
    piece = piece or PIECE
    buf, rep, begins = padded(s)
    counts = -(-s.lengths // BLOCK)
    of = np.r_[0, np.cumsum(counts)]
    text = np.repeat(np.arange(s.n), counts)
    starts = begins[text] + (np.arange(of[-1]) - of[text]) * BLOCK
    if not len(starts):
        return np.zeros((s.n, 2 * FILTERS), np.float32)
    stops = np.minimum(starts + BLOCK, (begins + s.lengths)[text])  # what stands behind a text is none of its positions
    blocks = np.empty((len(starts), FILTERS), np.float32)
    k = 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(stops, starts[k] + piece, "right")))
        a, b = int(starts[k]), int(stops[to - 1])
        r = responses(tables, buf[a : b + WIDTH], rep[a : b + WIDTH])
        last = np.r_[starts[k + 1 : to], b] != stops[k:to]  # of a text that others follow
        behind = (stops[k:to][last] - a)[:, None] + np.arange(WIDTH)
        r[behind[behind < len(r)]] = 0
        blocks[k:to] = np.maximum.reduceat(r[: b - a], starts[k:to] - a, axis=0)
        k = to
    return pooled(blocks, of, s.n)


def training_blocks(docs: DataFrame) -> DataFrame:
    """label, and of each text all blocks with WIDTH more positions: bytes and repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            for s in slices(data, offsets):
                buf, rep, begins = padded(s)
                buf, rep = np.r_[buf, np.zeros(BLOCK, np.uint8)], np.r_[rep, np.zeros(BLOCK, np.uint8)]
                out = []
                for d in range(s.n):
                    n = -(-int(s.lengths[d]) // BLOCK)
                    at = (begins[d] + np.arange(n) * BLOCK)[:, None] + np.arange(BLOCK + WIDTH)
                    inside = at < begins[d] + s.lengths[d]
                    out.append((np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint8).tobytes(), np.where(inside, rep[np.minimum(at, len(rep) - 1)], 0).astype(np.uint8).tobytes(), inside[:, :BLOCK].sum(1).astype(np.int32).tobytes()))
                b, r, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([column(batch, "label").slice(s.i, s.n), pa.array(b, pa.binary()), pa.array(r, pa.binary()), pa.array(n, pa.binary())], ["label", "bytes", "repeats", "sizes"])

    return small_batches(docs).mapInArrow(tidy(run), "label int, bytes binary, repeats binary, sizes binary")


@trimmed
def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 1, steps: int = 240, batch: int = 64, max_bytes: int = MAX_BYTES) -> Net:
    """docs: doc_id, text; labels: doc_id, label (1 good, 0 not)."""
    rng = np.random.default_rng(seed)
    chosen = labels.select("doc_id", F.col("label").cast("int").alias("label")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "label")))), "doc_id")
    sizes = texts.groupBy("place").agg(F.sum(F.octet_length("text")).alias("n"))
    taken, room = [], max_bytes
    for r in sizes.orderBy("place").collect():  # at most max_rows
        if (r["n"] or 0) <= room:
            taken.append(r["place"])
            room -= r["n"] or 0
    rows = training_blocks(texts.where(F.col("place").isin(taken)).select("text", "label"))
    data = []
    for label, b, r, sizes in rows.toLocalIterator():
        k = len(sizes) // 4
        if k:
            data.append((int(label > 0), np.frombuffer(b, np.uint8).reshape(k, -1), np.frombuffer(r, np.uint8).reshape(k, -1), np.frombuffer(sizes, np.int32)))
    data.sort(key=lambda x: (x[0], x[1].tobytes()))
    y = np.array([d[0] for d in data])
    p = {
        "of_byte": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), "of_repeat": rng.normal(0, 0.15, (WIDTH, FILTERS)), "bias": np.full(FILTERS, -0.2),
        "unit": rng.normal(0, 0.1, 2 * FILTERS), "shift": np.zeros(1),
    }
    p["of_repeat"][:, : FILTERS // 4] = 0.25
    if not len(y) or y.min() == y.max():
        p["unit"][:], p["shift"][0] = 0, (4.0 if not len(y) or y.min() == 1 else -4.0)
        return Net(p["of_byte"], p["of_repeat"], p["bias"], p["unit"], float(p["shift"][0]))
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for t in range(1, steps + 1):
        pick = np.r_[rng.choice(good, batch // 2), rng.choice(bad, batch // 2)]
        net = Net(p["of_byte"], p["of_repeat"], p["bias"], p["unit"], 0.0)
        b, r, sizes = (np.concatenate([data[i][k] for i in pick]) for k in (1, 2, 3))
        of = np.r_[0, np.cumsum([len(data[i][3]) for i in pick])]
        resp = responses(net.tables(), b.ravel(), r.ravel()).reshape(len(b), BLOCK + WIDTH, FILTERS)[:, :BLOCK]
        resp[np.arange(BLOCK)[None, :] >= sizes[:, None]] = 0
        where = resp.argmax(1)
        blocks = np.take_along_axis(resp, where[:, None, :], 1)[:, 0]
        x = pooled(blocks, of, len(pick))
        z = x @ p["unit"] + p["shift"][0]
        dz = (1 / (1 + np.exp(-z)) - y[pick]) / len(pick)
        dx = dz[:, None] * p["unit"][None, :]
        # back through the pools: each chunk's mean and the text's maximum belong to one block each
        dblocks = np.zeros_like(blocks, dtype=np.float64)
        doc = np.repeat(np.arange(len(pick)), np.diff(of))
        n = np.diff(of)
        last = np.zeros(len(blocks), bool)
        last[of[1:] - 1] = True
        cols = np.arange(FILTERS)
        nxt = np.minimum(np.arange(len(blocks)) + 1, len(blocks) - 1)
        right = (blocks[nxt] > blocks) & ~last[:, None]
        share = np.where((~last | (n[doc] == 1))[:, None], dx[doc, :FILTERS] / np.maximum(1, n[doc] - 1)[:, None], 0)
        np.add.at(dblocks, (np.where(right, nxt[:, None], np.arange(len(blocks))[:, None]), cols[None, :]), share)
        for i in range(len(pick)):
            dblocks[of[i] + blocks[of[i] : of[i + 1]].argmax(0), cols] += dx[i, FILTERS:]
        on = blocks > 0
        row, f = np.nonzero(on)
        grad, pos = dblocks[row, f], where[row, f]
        g = {"of_byte": np.zeros_like(p["of_byte"]), "of_repeat": np.zeros_like(p["of_repeat"]), "bias": np.bincount(f, grad, FILTERS), "unit": x.T.astype(float) @ dz + 1e-4 * p["unit"], "shift": np.array([dz.sum()])}
        for k in range(WIDTH):
            g["of_byte"][k] = np.bincount(b[row, pos + k].astype(int) * FILTERS + f, grad, 256 * FILTERS).reshape(256, FILTERS)
            g["of_repeat"][k] = np.bincount(f, grad * r[row, pos + k], FILTERS)
        for key in p:
            m[key] = 0.9 * m[key] + 0.1 * g[key]
            v[key] = 0.999 * v[key] + 0.001 * g[key] ** 2
            p[key] = p[key] - (0.03 if key in ("unit", "shift") else 0.01) * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.999**t)) + 1e-9)
    return Net(p["of_byte"], p["of_repeat"], p["bias"], p["unit"], float(p["shift"][0]))


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score: the probability that a text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            doc_ids = column(batch, "doc_id")
            for s in slices(data, offsets, NET_SLICE):
                z = document_features(tables, s).astype(np.float64) @ shared.value.unit + shared.value.shift
                yield pa.RecordBatch.from_arrays([doc_ids.slice(s.i, s.n), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
