"""Substring de-duplication with fixed-block anchors.

A window of ``window`` words that occurs in two documents holds a whole block of ``block`` words at a multiple
of ``block`` in each of them, if window >= 2 * block - 1. So:

1. Index: the hash of every such non-overlapping block of every document. Probe: the hash of every rolling
   window of ``block`` words. A place is a hit if its hash is indexed and probed at two places or more.
2. Extension: hits are extended to the windows of ``window`` words that hold them, and these are compared by
   128-bit hashes; a window is removed if it starts in a document with a smaller id too. Adjacent windows join
   into maximal exact repeats.
3. The words that removed windows cover are cut from the texts.

All three steps are linear in the places (see exchange.py): a passage shared by many documents makes an entry or two
a slice of documents and no pairs. What the second step deals out is bounded by the hits' neighbourhoods.

Nulls: a null text has no words; a null id is above all others, so such a row is never the one that stays, and
two such rows do not remove each other's words. Rows with the same id are one document for the comparison of
ids and keep their own texts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.exchange import Combined, Places, as_uint64, deal, decide, groups_of, low_bytes, resolve
from noticeflow.llm.frames import attached, keyed, partitions, saved, scoped
from noticeflow.llm.textkit import Rolling, Slice, column, slices, text_buffers, tidy, valid_windows

WINDOW = 50
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, begins array<int>, ends array<int>"


def ranges(begins: bytes | None, ends: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if begins is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.frombuffer(begins, np.uint32).astype(np.int64), np.frombuffer(ends, np.uint32).astype(np.int64)


def anchors(docs: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Step 1: runs of hits by document."""
    block = (window + 1) // 2

    def places(s: Slice, _: pa.RecordBatch, __: np.ndarray) -> tuple[Places, np.ndarray]:
        first = s.words()[2]
        at = valid_windows(first, block)
        h = Rolling(s.word_hashes(), 1).windows(block)[at] if len(at) else np.zeros(0, np.uint64)
        aligned = (at - first[s.doc_of_word()[at]]) % block == 0
        # 39 bits of the hash and the index flag: a chance hit costs a comparison in step 2, not a wrong result
        return Places(at, h >> np.uint64(40), [low_bytes((h << np.uint64(1)) | aligned.astype(np.uint64), 5)]), first

    def choose(fields: list[np.ndarray]) -> dict[int, np.ndarray]:
        packed, bucket = as_uint64(fields[0]), fields[1]
        key = (packed >> np.uint64(1)) | (bucket << np.uint64(39))
        index = np.unique(key[(packed & np.uint64(1)) == 1])
        if not len(index):
            return {}
        sieve = np.zeros(1 << 22, bool)
        fold = lambda k: (k ^ (k >> np.uint64(39)) * np.uint64(0x9E3779B1)) & np.uint64((1 << 22) - 1)
        sieve[fold(index)] = True
        may = np.flatnonzero(sieve[fold(key)])
        at = np.minimum(np.searchsorted(index, key[may]), len(index) - 1)
        real = index[at] == key[may]
        may, at = may[real], at[real]
        hit = np.zeros(len(key), bool)
        hit[may[np.bincount(at, minlength=len(index))[at] >= 2]] = True
        return {0: hit}

    return resolve(decide(deal(docs.select("_id", "_th", "text"), places, n_buckets), choose, n_buckets), n_buckets)


def repeats(docs: DataFrame, hits: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Step 2: runs of the starts of removed windows by document."""
    reach = window - (window + 1) // 2

    def places(s: Slice, batch: pa.RecordBatch, doc_ids: np.ndarray) -> tuple[Places, np.ndarray]:
        first = s.words()[2]
        edge = np.zeros(int(first[-1]) + 1, np.int32)
        begins, ends = column(batch, "begins").slice(s.i, s.n).to_pylist(), column(batch, "ends").slice(s.i, s.n).to_pylist()
        for d in range(s.n):
            b, e = ranges(begins[d], ends[d])
            np.add.at(edge, first[d] + np.maximum(b - reach, 0), 1)
            np.add.at(edge, first[d] + e, -1)
        at = valid_windows(first, window)
        at = at[np.cumsum(edge)[at] > 0]
        if not len(at):
            return Places(at, np.zeros(0, np.uint64), []), first
        one = Rolling(s.word_hashes(), 1).windows(window)[at]
        two = Rolling(s.word_hashes(kind=1), 2).windows(window)[at]
        return Places(at, two >> np.uint64(32), [one, low_bytes(two, 4), doc_ids[s.doc_of_word()[at]]]), first

    def choose(fields: list[np.ndarray]) -> dict[int, np.ndarray]:
        one, two = as_uint64(fields[0]), as_uint64(fields[1]) | (fields[3] << np.uint64(32))
        who = np.ascontiguousarray(fields[2]).view(np.int64).ravel()
        order = np.lexsort((two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        least = np.minimum.reduceat(who[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = np.zeros(len(one), bool)
        gone[order] = least < who[order]
        return {0: gone}

    def least_of_each(p: Places) -> Combined:
        """Of equal windows of a slice the first one of the least id is dealt; those of that id follow it, others go."""
        if not len(p.at):
            return Combined(p.at, p.at, p.at, p.at)
        one, two, who = p.fields[0], as_uint64(p.fields[1]), p.fields[2]
        order, _ = groups_of(p.at, who, one, two)
        changed = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        begin = np.flatnonzero(changed)
        head = order[begin[np.cumsum(changed) - 1]]
        same = who[order] == who[head]
        later = ~changed
        return Combined(np.sort(order[changed]), p.at[order[later & same]], p.at[head[later & same]], p.at[order[later & ~same]])

    chosen = attached(docs, hits.select("_id", "_th", "begins", "ends"), F.length("begins") * 2, "inner")
    return resolve(decide(deal(chosen, places, n_buckets, least_of_each), choose, n_buckets), n_buckets)


@scoped
def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """Both steps, for docs with _id and _th; saved."""
    n = partitions(docs)
    hits = saved(anchors(docs, window, n))
    return repeats(docs, hits, window, n)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by one space) and the removed runs of words."""
    docs = keyed(docs)
    removed = repeated_windows(docs, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            doc_ids = column(batch, "doc_id")
            for s in slices(data, offsets):
                starts, ends, first = s.words()
                edge = np.zeros(len(starts) + 1, bool)
                spans = []
                for d, (b, e) in enumerate(zip(column(batch, "begins").slice(s.i, s.n).to_pylist(), column(batch, "ends").slice(s.i, s.n).to_pylist(), strict=True)):
                    b, e = ranges(b, e)
                    spans.append((b, e + (window - 1)))
                    for x, y in zip(b, e, strict=True):
                        edge[first[d] + x : first[d] + y + window - 1] = True
                gone = edge[:-1]
                kept = np.flatnonzero(~gone)
                # kept words and the byte after each, then a space in the place of that byte
                length = ends[kept] - starts[kept] + 1
                out_at = np.r_[0, np.cumsum(length)]
                source = np.repeat(starts[kept] - out_at[:-1], length) + np.arange(out_at[-1])
                text = np.r_[s.buf, np.uint8(32)][source] if len(kept) else np.zeros(0, np.uint8)
                text[out_at[1:] - 1] = 32
                lines = text.tobytes()
                bounds = out_at[np.searchsorted(kept, first)]
                texts = [lines[bounds[d] : max(bounds[d], bounds[d + 1] - 1)] for d in range(s.n)]
                n_removed = np.diff(np.r_[0, np.cumsum(gone)][first])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(s.i, s.n), pa.array(np.diff(first).astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()),
                     pa.array([b.astype(np.int32) for b, _ in spans], pa.list_(pa.int32())), pa.array([e.astype(np.int32) for _, e in spans], pa.list_(pa.int32()))],
                    ["doc_id", "n_words", "n_removed", "kept_text", "begins", "ends"],
                )

    return attached(docs, removed.select("_id", "_th", "begins", "ends"), F.length("begins") * 2, "left").select("doc_id", "text", "begins", "ends").mapInArrow(tidy(cut), RESULT)


def kept_digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
