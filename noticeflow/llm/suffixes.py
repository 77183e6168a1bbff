"""Repeated byte strings by merging the Burrows-Wheeler transforms of shards.

A string of ``length`` bytes that starts at two places of the corpus is found at each of them:

1. Segments. Of the hashes of the ``length // 2``-byte grams of a string the least, leftmost one is its anchor, so
   equal strings have equal anchors at equal offsets. The strings of a text fall into runs that share an
   anchor; a run and its bytes make a segment (up to 1.5 * length bytes). Segments are dealt by anchor hash (see
   exchange.py); a group is the segments of one anchor. Equal segments of a group are one text with a weight, how
   often it occurs. A group of one text of weight 1 has no repeats; nor has its bytes anywhere else.
2. The texts of all other groups, the first occurrence of each by slice and place, are merged. Within a panel of groups, texts are
   packed into shards; each shard gets its suffix order to depth ``length`` and its transform over letters of
   ``step`` bytes: for each suffix, the letter before it. The transforms are merged by interleave refinement: an
   interleave that is right to j letters, sorted stably by the letter before each suffix and moved to the
   suffixes that begin with it, is right to j + 1. No suffixes of different shards are compared. The round
   in which a boundary between neighbours appears gives their common prefix; suffixes between which none appears in
   length / step rounds share ``length`` bytes and are an interval. An interval whose texts weigh more than 1 together is
   a repeated string. Common prefixes are known to a letter (a fourth of ``length``), which is all that the rule needs.
   A text that weighs more than 1 needs no answer for itself: all of its strings repeat, as the equality of its segments tells,
   and each of them is cut whole. It is merged, once, for the sake of other texts that share strings with it. On the 0.1 tables
   that equality tells of 90 % of the bytes that are cut, the merge of 60 %: 10 % by the merge alone, 40 % by equality alone.
   A group of more than HOT texts is split first: its strings by their offset from the anchor, CLASS offsets each,
   and by the bytes that all strings of such a class hold; equal parts are one text a task with the sum of their weights.
3. The bytes that repeated strings cover are cut.

Texts end with letters that occur once, so that no match crosses documents.

Nulls: a null text is empty; null ids are documents like others; repeated rows are occurrences of their own,
so that all of their strings repeat. Texts shorter than ``length`` bytes are kept. Very long texts: a task cuts one text into
segments, some 50 bytes a byte (measured: 1.0 GB for 20 MB). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.exchange import Places, as_uint64, deal, decide, resolve
from noticeflow.llm.frames import attached, keyed, packed, partitions, saved, scoped, unpacked
from noticeflow.llm.substrings import ranges
from noticeflow.llm.textkit import BYTE_CODE, Rolling, Slice, column, merged, mix, runs, slices, text_buffers, tidy

LENGTH = 400
PANEL, SHARD = 1 << 19, 1 << 17
HOT, CLASS = 512, 25
CHUNK = 1 << 23
ROUNDS = 4  # of a merge: letters hold a fourth of a string, or the largest divisor of its length below that
PLACE = ("ids", "ths", "at", "weights")  # of the places that a text to be merged stands at
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, begins array<int>, ends array<int>"
#: Kinds of answers: a segment whose text weighs more than 1; the first occurrence of a text that is to be merged, by whether
#: it weighs more than 1 and whether its group has more than HOT texts.
HEAVY, FIRST, FIRST_HEAVY, HOT_FIRST, HOT_FIRST_HEAVY = range(5)


def minimizers(g: np.ndarray, w: int) -> np.ndarray:
    """For every window of w values the position of the least of their upper 40 bits, the leftmost of equal ones."""
    out = []
    low = np.uint64((1 << 24) - 1)
    for a in range(0, max(0, len(g) - w + 1), CHUNK):
        part = g[a : a + CHUNK + w - 1]
        n = len(part)
        rows = -(-n // w)
        v = np.full(rows * w, ~np.uint64(0))
        v[:n] = (part & ~low) | np.arange(n, dtype=np.uint64)
        v = v.reshape(rows, w)
        ahead = np.minimum.accumulate(v, 1).ravel()
        behind = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
        out.append((np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64) + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def segments(s: Slice, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string of each segment, its anchor's hash and a hash of its text and shape, and its anchor."""
    rolling = Rolling(s.byte_codes())
    k = length // 2
    g = rolling.windows(k)
    a = minimizers(g, length - k + 1)
    ok = np.ones(len(a), bool)
    for x in s.bounds[1:-1]:
        ok[max(0, x - length + 1) : x] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64), at
    anchor = a[at]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)])
    begin, end, anchor = at[new], at[np.r_[new[1:] - 1, len(at) - 1]], anchor[new]
    shape = ((anchor - begin) * length + (end - begin)).astype(np.uint64)
    return begin, end, g[anchor], mix(rolling.ranges(begin, end + length) ^ mix(shape + np.uint64(1))), anchor


def groups(docs: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Step 1: runs of strings of both kinds by document."""

    def places(s: Slice, _: pa.RecordBatch, __: np.ndarray) -> tuple[Places, np.ndarray]:
        begin, end, h, text, _ = segments(s, length)
        return Places(begin, h >> np.uint64(32), [h, text, (end - begin).astype(np.uint16)]), s.bounds

    def choose(fields: list[np.ndarray]) -> dict[int, np.ndarray]:
        h, text = as_uint64(fields[0]), as_uint64(fields[1])
        order = np.lexsort((text, h))
        new_h = np.r_[True, h[order][1:] != h[order][:-1]]
        new_text = new_h | np.r_[True, text[order][1:] != text[order][:-1]]
        group, one = np.cumsum(new_h) - 1, np.cumsum(new_text) - 1
        weight, texts = np.bincount(one), np.bincount(group[new_text])
        heavy, first, hot = (np.zeros(len(h), bool) for _ in range(3))
        heavy[order] = weight[one] > 1
        first[order] = new_text & ((texts[group] > 1) | (weight[one] > 1))
        hot[order] = texts[group] > HOT
        return {HEAVY: heavy, FIRST: first & ~heavy & ~hot, FIRST_HEAVY: first & heavy & ~hot, HOT_FIRST: first & ~heavy & hot, HOT_FIRST_HEAVY: first & heavy & hot}

    if length > 1 << 16:
        raise ValueError("length is 65536 at most: the number of strings of a segment takes two bytes")
    return resolve(decide(deal(docs.select("_id", "_th", "text"), places, n_buckets), choose, n_buckets, extent=2), n_buckets)


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order of integers that are not negative: place and value are sorted as one number where they fit."""
    bits = len(x).bit_length()
    if len(x) and int(x.max()).bit_length() + bits > 62:
        return np.argsort(x, kind="stable")
    both = np.sort((x.astype(np.int64) << np.int64(bits)) | np.arange(len(x)))
    return both & np.int64((1 << bits) - 1)


def suffix_order(letters: np.ndarray, step: int, rounds: int) -> np.ndarray:
    """Suffixes sorted by their first ``rounds`` letters, by doubling; letters[i] stands for bytes i .. i + step."""
    n = len(letters)
    rank = letters.astype(np.int64)
    have = 1
    while have < rounds:
        move = min(have, rounds - have)
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - move * step)] = rank[move * step :] + 1
        key = rank * (int(ahead.max()) + 1) + ahead
        order = stable_order(key)
        k = key[order]
        dense = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = dense
        have += move
    return stable_order(rank)


class Transform:
    """A shard's transform: for each suffix, in order, the letter before it and the rank of the suffix there."""

    def __init__(self, letters: np.ndarray, step: int, rounds: int):
        n = len(letters)
        self.order = suffix_order(letters, step, rounds)
        rank = np.empty(n, np.int64)
        rank[self.order] = np.arange(n)
        before = (self.order - step) % n  # the shard is read as a ring: what stands before its begin is its end
        self.letter = letters[before]
        self.moves_to = rank[before]


def merge(shards: list[Transform], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interleave after that many rounds: shard and rank of each suffix, and the round in which a boundary
    before it appeared (0: none, it shares ``rounds`` letters with its neighbour)."""
    base = np.cumsum([0, *(len(t.order) for t in shards)])
    letter = np.concatenate([t.letter for t in shards]).astype(np.uint32)
    moves_to = np.concatenate([t.moves_to + b for t, b in zip(shards, base[:-1], strict=True)]).astype(np.int32)
    now = np.arange(base[-1], dtype=np.int32)  # shard after shard: right to 0 letters
    block = np.zeros(base[-1], np.int32)
    boundary = np.zeros(base[-1], np.int32)
    for j in range(1, rounds + 1):
        x = letter[now]
        order = stable_order(x)
        x, b = x[order], block[order]
        now = moves_to[now[order]]
        new = np.r_[True, (x[1:] != x[:-1]) | (b[1:] != b[:-1])]
        boundary[new & (boundary == 0)] = j
        block = np.cumsum(new, dtype=np.int32)
    shard = np.searchsorted(base, now, "right") - 1
    return shard, now - base[shard], boundary


def repeated(texts: list[np.ndarray], weights: list[int], length: int, step: int, shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For each text, the starts of its strings of length bytes that start elsewhere in the texts too, a text of weight w
    standing for w equal ones."""
    rounds = length // step
    sizes = np.array([len(t) for t in texts]) + 1  # a place after each text for its end
    bounds = np.r_[0, np.cumsum(sizes)]
    n = int(bounds[-1])
    buf = np.zeros(n, np.uint8)
    for t, x in zip(texts, bounds[:-1], strict=True):
        buf[x : x + len(t)] = t
    h = np.zeros(n, np.uint64)
    h[: max(0, n - step + 1)] = Rolling(BYTE_CODE[1][buf]).windows(step)
    order = np.argsort(h)
    letters = np.empty(n, np.uint32)
    letters[order] = np.cumsum(np.r_[0, h[order][1:] != h[order][:-1]])
    tail = np.arange(n) >= np.repeat(bounds[1:], sizes) - step  # these letters hold a text's end: each is unlike all others
    letters[tail] = n + np.arange(int(tail.sum()), dtype=np.uint32)
    cuts = [0]
    for i in range(len(texts)):
        if bounds[i + 1] - bounds[cuts[-1]] >= shard_bytes or i == len(texts) - 1:
            cuts.append(i + 1)
    shards = [Transform(letters[bounds[i] : bounds[j]], step, rounds) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    shard, rank, boundary = merge(shards, rounds)
    where = np.empty(n, np.int64)
    for k, t in enumerate(shards):
        own = shard == k
        where[own] = t.order[rank[own]] + bounds[cuts[k]]
    interval = np.cumsum(boundary > 0) - 1
    inside = np.repeat(bounds[1:], sizes) - 1 - np.arange(n) >= length  # whole strings; others share with none
    weigh = np.where(inside, np.repeat(np.asarray(weights, np.int64), sizes), 0)
    where = np.sort(where[(np.bincount(interval, weigh[where])[interval] > 1) & inside[where]])
    at = np.searchsorted(where, bounds)
    return [where[at[i] : at[i + 1]] - bounds[i] for i in range(len(texts))]


def merged_groups(docs: DataFrame, found: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Step 2: runs of repeated strings by document, a row for each segment that has any."""
    step = next(k for k in range(max(1, length // ROUNDS), 0, -1) if length % k == 0)

    def chosen_segments(s: Slice, batch: pa.RecordBatch):
        """The segments of a slice in the runs that the batch names, with the document of each."""
        begin, end, h, _, anchor = segments(s, length)
        doc = np.searchsorted(s.bounds, begin, "right") - 1
        of = np.searchsorted(doc, np.arange(s.n + 1))
        keep = [np.zeros(0, np.int64)]
        for d, (b, e) in enumerate(zip(column(batch, "begins").slice(s.i, s.n).to_pylist(), column(batch, "ends").slice(s.i, s.n).to_pylist(), strict=True)):
            b, e = ranges(b, e)
            own = np.arange(of[d], of[d + 1])
            at = begin[own] - s.bounds[d]
            run = np.searchsorted(b, at, "right") - 1
            keep.append(own[(run >= 0) & (at < e[run])])
        keep = np.concatenate(keep)
        return begin[keep], end[keep], h[keep], anchor[keep], doc[keep]

    def parts(begin: np.ndarray, end: np.ndarray, h: np.ndarray, anchor: np.ndarray, doc: np.ndarray, s: Slice):
        """The segments split by classes of offsets, keyed by the bytes that all strings of a class hold."""
        low, high = (anchor - end) // CLASS, (anchor - begin) // CLASS
        times = high - low + 1
        own = np.repeat(np.arange(len(begin)), times)
        j = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
        first, last = np.maximum(begin[own], anchor[own] - j * CLASS - CLASS + 1), np.minimum(end[own], anchor[own] - j * CLASS)
        core = Rolling(s.byte_codes()).ranges(anchor[own] - j * CLASS, anchor[own] - j * CLASS - CLASS + 1 + length)
        return first, last, mix(h[own] ^ mix(core + j.astype(np.uint64))), doc[own]

    def cut(split: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffers(column(batch, "text"))
                who, th = column(batch, "_id").to_numpy(), column(batch, "_th").to_numpy()
                weight = 1 + np.isin(column(batch, "kind").to_numpy(), (FIRST_HEAVY, HOT_FIRST_HEAVY))
                texts: dict[tuple[int, bytes], list[tuple[int, int, int, int]]] = {}  # equal texts of a group: one row a batch
                for s in slices(data, offsets):
                    begin, end, h, anchor, doc = chosen_segments(s, batch)
                    if split and len(begin):
                        begin, end, h, doc = parts(begin, end, h, anchor, doc, s)
                    for x, y, key, d in zip(begin.tolist(), end.tolist(), h.view(np.int64).tolist(), doc.tolist(), strict=True):
                        texts.setdefault((key, s.buf[x : y + length].tobytes()), []).append((who[s.i + d], th[s.i + d], x - s.bounds[d], weight[s.i + d]))
                rows = [(key, text, [np.array(c, np.int64).tobytes() for c in zip(*places, strict=True)]) for (key, text), places in texts.items()]
                for i in range(0, len(rows), 2000):
                    key, text, places = zip(*rows[i : i + 2000], strict=True)
                    route = (np.array(key).view(np.uint64) >> np.uint64(32)) % np.uint64(n_buckets)
                    yield pa.RecordBatch.from_arrays([pa.array(route.astype(np.int32)), pa.array(key, pa.int64()), pa.array(text, pa.binary()), *(pa.array([p[k] for p in places], pa.binary()) for k in range(4))], ["bucket", "h", "bytes", *PLACE])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in ("h", "bytes", *PLACE)), strict=True):
                if size >= PANEL and row[0] != held[-1][0]:  # rows come by group: a panel holds whole groups
                    yield from panel(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield from panel(held)

    def panel(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        same: dict[tuple[int, bytes], list[tuple[int, int, int, int]]] = {}
        for h, text, *places in rows:
            same.setdefault((h, text), []).extend(zip(*(np.frombuffer(p, np.int64).tolist() for p in places), strict=True))
        starts = repeated([np.frombuffer(text, np.uint8) for _, text in same], [sum(w for *_, w in places) for places in same.values()], length, step)
        out = []
        for places, found in zip(same.values(), starts, strict=True):
            if len(found):
                begin, end = runs(found)
                out += [(a, b, (begin + c).astype(np.uint32).tobytes(), (end + c).astype(np.uint32).tobytes()) for a, b, c, _ in places]
        if out:
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], ["_id", "_th", "begins", "ends"])

    def dealt(kinds: tuple[int, int]) -> DataFrame:
        chosen = attached(docs, found.where(F.col("kind").isin(*kinds)).select("_id", "_th", "kind", "begins", "ends"), F.length("begins") * 2, "inner")
        return chosen.select("_id", "_th", "kind", "text", "begins", "ends").mapInArrow(tidy(cut(HOT_FIRST in kinds)), "bucket int, h long, bytes binary, " + ", ".join(f"{x} binary" for x in PLACE))

    texts = dealt((FIRST, FIRST_HEAVY))
    if not found.where(F.col("kind") >= HOT_FIRST).isEmpty():
        texts = texts.unionByName(dealt((HOT_FIRST, HOT_FIRST_HEAVY)))
    rows = texts.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("h").select("h", "bytes", *PLACE)
    return rows.mapInArrow(tidy(run), "_id long, _th long, begins binary, ends binary")


def spans(found: DataFrame, more: DataFrame, length: int) -> DataFrame:
    """Begins and ends of the bytes to cut, a row a document; a document's lists are bounded by its length."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, e = [], []
            for x, y in zip(column(batch, "b").to_pylist(), column(batch, "e").to_pylist(), strict=True):
                lo, hi = ranges(b"".join(x), b"".join(y))
                lo, hi = merged(lo, hi + (length - 1))
                b.append(lo.astype(np.uint32).tobytes())
                e.append(hi.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), column(batch, "_th"), pa.array(b, pa.binary()), pa.array(e, pa.binary())], ["_id", "_th", "begins", "ends"])

    rows = found.where(F.col("kind") == HEAVY).select("_id", "_th", "begins", "ends").unionByName(more)
    by_doc = rows.groupBy("_id", "_th").agg(F.collect_list("begins").alias("b"), F.collect_list("ends").alias("e"))
    return by_doc.mapInArrow(tidy(join), "_id long, _th long, begins binary, ends binary")


@scoped
def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """What to cut from each text that has repeats, for docs with _id and _th; saved."""
    n = partitions(docs)
    found = saved(groups(docs, length, n))
    return spans(found, merged_groups(docs, found, length, n), length)


def left_over(s: Slice, d: int, begins: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes of a slice's document outside the spans."""
    left, right = np.r_[0, ends] + s.bounds[d], np.r_[begins, s.lengths[d]] + s.bounds[d]
    return b"".join(s.buf[x:y].tobytes() for x, y in zip(left, right, strict=True))


def cut_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, all columns, with repeated strings cut from text; of a character that a cut splits nothing stays."""
    rows = packed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = column(batch, "text")
            data, offsets = text_buffers(col)
            for s in slices(data, offsets):
                texts = col.slice(s.i, s.n).to_pylist()
                for d, (b, e) in enumerate(zip(column(batch, "begins").slice(s.i, s.n).to_pylist(), column(batch, "ends").slice(s.i, s.n).to_pylist(), strict=True)):
                    if b is not None:
                        texts[d] = left_over(s, d, *ranges(b, e)).decode("utf-8", "ignore")
                part = batch.slice(s.i, s.n).select(["rest", "text"])
                yield part.set_column(1, "text", pa.array(texts, pa.string()))

    gone = repeated_spans(rows, length)
    joined = attached(rows, gone, F.length("begins") * 2, "left").select("rest", "text", "begins", "ends")
    return unpacked(joined.mapInArrow(tidy(cut), rows.select("rest", "text").schema), docs.columns)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and the spans cut."""
    docs = keyed(docs)
    gone = repeated_spans(docs, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            doc_ids = column(batch, "doc_id")
            for s in slices(data, offsets):
                b, e = zip(*(ranges(x, y) for x, y in zip(column(batch, "begins").slice(s.i, s.n).to_pylist(), column(batch, "ends").slice(s.i, s.n).to_pylist(), strict=True)), strict=True)
                kept = [left_over(s, d, b[d], e[d]) for d in range(s.n)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(s.i, s.n), pa.array(s.lengths), pa.array([int((y - x).sum()) for x, y in zip(b, e, strict=True)], pa.int64()), pa.array([len(x) for x in b], pa.int64()), pa.array(kept, pa.binary()),
                     pa.array([x.astype(np.int32) for x in b], pa.list_(pa.int32())), pa.array([x.astype(np.int32) for x in e], pa.list_(pa.int32()))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "begins", "ends"],
                )

    return attached(docs, gone, F.length("begins") * 2, "left").select("doc_id", "text", "begins", "ends").mapInArrow(tidy(cut), RESULT)
