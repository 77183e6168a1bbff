"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: A-Z lower-cased, every run of ASCII bytes other than letters and digits one
space, and a space in front and behind. An item of m bytes may differ from a passage by k = m * ERROR_PERCENT // 100
edits (of bytes), the spaces around it included, so it stands between word ends but for edits. Split into k + 1
pieces, at least one piece of it stands unchanged in such a passage. All places of a text are looked up in an index of
pieces by rolling hash, hits are compared exactly, and around each hit Myers' bit-parallel distance between the whole
item and the text is taken; a document with an item within its budget is contaminated.

The items are a stated query set. They are read in blocks of at most ITEM_BYTES, each indexed once, sent to the
executors as arrays and run over all documents, so memory does not grow with the number of items. Documents are judged one by
one: there is no shuffle and no skew.

Nulls: a null text is clean; a null or empty item matches nothing. Null ids and repeated rows are judged like others;
repeated items are found each. Ties: of passages as close to an item the first one is given. Empty tables give no rows,
or all rows clean. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.frames import small_batches
from noticeflow.llm.textkit import BYTE_CODE, LOWER, Rolling, column, slices, text_buffers, tidy

ERROR_PERCENT = 5
GRAM = 16  # bytes of a piece that the index holds; shorter pieces are indexed whole
ITEM_BYTES = 8 << 20
MATCH = "array<struct<item_id: bigint, distance: int, begin: int, end: int>>"

KEEP = np.zeros(256, bool)
KEEP[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def normal(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, bounds and, for each byte, where it stood. Every text begins and ends with a space."""
    low = LOWER[buf]
    kept = KEEP[low]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.r_[True, ~kept[:-1]] if n else np.zeros(0, bool)
    take = kept | ~(before & ~kept)  # of a run of other bytes the first
    take |= edge[:n] & ~kept
    parts = np.flatnonzero(take)
    doc_start = np.searchsorted(parts, bounds)
    out = np.where(kept[parts], low[parts], np.uint8(32))
    # a space in front of and behind every text
    gaps = np.repeat(doc_start, [1, *[2] * (len(bounds) - 2), 1]) if len(bounds) > 1 else np.zeros(0, int)
    where = np.repeat(bounds, [1, *[2] * (len(bounds) - 2), 1]) if len(bounds) > 1 else np.zeros(0, int)
    return np.insert(out, gaps, 32), doc_start + 2 * np.arange(len(bounds)), np.insert(parts, gaps, where)


def normal_item(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normal(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edits between the pattern and any part of the text, and where the first such part ends."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


class Index:
    """Pieces of items by the hash of their first GRAM bytes (or all, if shorter), as arrays."""

    def __init__(self, items: list[tuple[int | None, bytes]], error_percent: int):
        self.items = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            if not text:
                continue
            k = len(text) * error_percent // 100
            text = b" " + text + b" "
            m, at = len(text), len(self.items)
            self.items.append((item_id, text, k))
            cuts = [m * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found.setdefault(min(GRAM, b - a), []).append((at, a, b))
        self.grams = []
        data = np.frombuffer(b"".join(t for _, t, _ in self.items), np.uint8)
        start = np.r_[0, np.cumsum([len(t) for _, t, _ in self.items])].astype(np.int64)
        rolling = Rolling(BYTE_CODE[0][data])
        for q, rows in sorted(found.items()):
            pieces = np.array(rows, np.int64)
            code = rolling.ranges(start[pieces[:, 0]] + pieces[:, 1], start[pieces[:, 0]] + pieces[:, 1] + q)
            order = np.argsort(code, kind="stable")
            keys, first = np.unique(code[order], return_index=True)
            sieve = np.zeros(1 << 20, bool)
            sieve[keys & np.uint64((1 << 20) - 1)] = True
            self.grams.append((q, keys, sieve, np.r_[first, len(order)], pieces[order]))

    def hits(self, buf: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(place, item, begin and end of the piece) of every piece that stands in buf."""
        rolling = Rolling(BYTE_CODE[0][buf])
        view = buf.tobytes()
        for q, keys, sieve, first, pieces in self.grams:
            h = rolling.windows(q)
            may = np.flatnonzero(sieve[h & np.uint64((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(keys, h[may]), len(keys) - 1)
            real = keys[at] == h[may]
            for p, k in zip(may[real].tolist(), at[real].tolist(), strict=True):
                for item, a, b in pieces[first[k] : first[k + 1]].tolist():
                    if view[p : p + b - a] == self.items[item][1][a:b]:
                        yield p, item, a, b


def matches(index: Index, buf: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each (document, item) within budget: edits, begin and end in buf."""
    spots: dict[tuple[int, int], list[int]] = {}
    for p, item, a, _ in index.hits(buf):
        d = int(np.searchsorted(bounds, p, "right")) - 1
        spots.setdefault((d, item), []).append(p - a)
    view = buf.tobytes()
    out = {}
    for (d, item), begins in spots.items():
        _, text, k = index.items[item]
        m, done, best = len(text), None, None
        for begin in sorted(set(begins)):
            if done is not None and begin <= done:
                continue  # this alignment was covered by the window before
            lo, hi = max(begin - k, int(bounds[d])), min(begin + m + 2 * k, int(bounds[d + 1]))
            done = begin + k
            if begin >= lo and view[begin : begin + m] == text and begin + m <= hi:
                best = (0, begin, begin + m)
                break
            edits, end = myers(text, view[lo:hi])
            if edits <= k and (best is None or edits < best[0]):
                best = (edits, max(lo, lo + end - m - (k - edits)), lo + end)
        if best is not None:
            out[d, item] = best
    return out


def checked(docs: DataFrame, items: DataFrame, error_percent: int = ERROR_PERCENT, text_col: str = "text") -> DataFrame:
    """docs with matches: the items found, each with its edits and its span in bytes of the text. items: item_id, text."""
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = 1 + int(size) // ITEM_BYTES
    kept = [c for c in docs.columns if c.lower() != "matches"]
    types = dict(docs.dtypes)
    out = small_batches(docs).select(*kept).withColumn("matches", F.expr(f"cast(array() as {MATCH})"))
    schema = out.schema
    types = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        pieces = [(r[0], normal_item(r[1])) for r in part.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(Index(pieces, error_percent))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                data, offsets = text_buffers(column(batch, text_col))
                old = column(batch, "matches")
                for s in slices(data, offsets):
                    buf, bounds, where = normal(s.buf, s.bounds)
                    where = np.r_[where, len(s.buf)]
                    found: list[list] = [x or [] for x in old.slice(s.i, s.n).to_pylist()]
                    for (d, item), (edits, begin, end) in matches(index, buf, bounds).items() if index.grams else ():
                        lo, hi = int(where[begin] - s.bounds[d]), int(where[end] - s.bounds[d])
                        found[d].append({"item_id": index.items[item][0], "distance": edits, "begin": lo, "end": min(hi, int(s.lengths[d]))})
                    for x in found:
                        x.sort(key=lambda y: (y["item_id"] is None, y["item_id"], y["begin"]))
                    part = batch.slice(s.i, s.n)
                    yield part.set_column(part.schema.get_field_index("matches"), "matches", pa.array(found, types))

        out = out.mapInArrow(tidy(run), schema)
    return out


def judged(docs: DataFrame, items: DataFrame, error_percent: int = ERROR_PERCENT) -> DataFrame:
    """doc_id, contaminated, item_ids (of the items found), least_distance."""
    found = checked(docs.select("doc_id", F.col("text").cast("string").alias("text")), items, error_percent)
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.transform("matches", lambda x: x["item_id"]).alias("item_ids"), F.array_min(F.transform("matches", lambda x: x["distance"])).alias("least_distance"))
