"""Comparing places of all texts with each other by their hashes, as arrays.

A *place* is a position (of a word or byte) in a slice of documents. Places are dealt to buckets by a hash, as
one row a slice and bucket that holds arrays, so a row costs no more than its bytes. Each partition of buckets
decides about its places from their fields alone and answers in the same addresses; the answers are then
brought back to the slice and split by document::

    deal -> rows by bucket -> decide -> answers by slice -> resolve -> (_id, _th, kind, runs)

Equal places of a slice are combined before they are dealt: at most two of them go to a bucket, and the others get
their answer when it comes back to the slice. So a hash that a third of all documents share adds two entries a
slice (up to POOL places) to one bucket, not one a document; only array operations run over a bucket, and no
pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.textkit import Slice, column, ids, merged, mix, runs, slices, text_buffers, tidy

FIELDS = 4
DEALT = "bucket int, uid long, n int, place binary, " + ", ".join(f"f{i} binary" for i in range(FIELDS))
ANSWER = "uid long, kind int, place binary, extent binary"
RUNS = "_id long, _th long, kind int, begins binary, ends binary"
#: Slices are pooled until a row holds so many places on average, or there are POOL in all: with many buckets, rows of
#: a few places each would cost more than the places.
ROW_PLACES, POOL = 32, 1 << 22
TABLE = -1  # as n or kind: the row holds a slice's documents


@dataclass
class Places:
    """Places of a slice, ascending, with their bucket hash and fields ([n, width] or [n] arrays)."""

    at: np.ndarray
    route: np.ndarray
    fields: list[np.ndarray]


def raw(x: np.ndarray) -> np.ndarray:
    width = x.dtype.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), width)


def low_bytes(x: np.ndarray, k: int) -> np.ndarray:
    return raw(x)[:, :k]


def as_uint64(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view(np.uint64).ravel()


def _pooled(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, Places]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Places]:
    """Several slices as one: places count on from slice to slice."""
    if len(held) == 1:
        return held[0]
    base = np.cumsum([0, *(int(first[-1]) for _, _, first, _ in held)])
    first = np.concatenate([*(f[:-1] + b for (_, _, f, _), b in zip(held, base[:-1], strict=True)), base[-1:]])
    at = np.concatenate([p.at + b for (*_, p), b in zip(held, base[:-1], strict=True)])
    fields = [np.concatenate(f) for f in zip(*(p.fields for *_, p in held), strict=True)]
    return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), first, Places(at, np.concatenate([h[3].route for h in held]), fields)


@dataclass
class Combined:
    """Which places of a slice are dealt, which others follow one of these (its place), and which are decided already."""

    dealt: np.ndarray
    twin: np.ndarray
    follows: np.ndarray
    decided: np.ndarray


def groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys that keeps equal ones as they come, and in it where a group begins."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def two_of_each(p: Places) -> Combined:
    """Places that agree in hash and fields: the first two are dealt, the others follow the second."""
    keys = [as_uint64(raw(f)) for f in p.fields]
    if len(p.fields) == 1 and raw(p.fields[0]).shape[1] <= 5 and not (p.route >> np.uint64(24)).any():
        keys = [keys[0] | p.route << np.uint64(40)]  # one key sorts faster than two
    else:
        keys.append(p.route)
    order, new = groups_of(*keys)
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.arange(len(order)) - begin[group]
    later = rank >= 2
    return Combined(np.sort(order[~later]), p.at[order[later]], p.at[order[begin[group[later]] + 1]], np.zeros(0, np.int64))


def _rows(doc_ids: np.ndarray, ths: np.ndarray, first: np.ndarray, p: Places, n_buckets: int, combine: Callable[[Places], Combined]) -> pa.RecordBatch:
    uid = int(mix(np.array([np.bitwise_xor.reduce(mix(doc_ids.view(np.uint64) ^ mix(ths.view(np.uint64) + np.arange(len(doc_ids), dtype=np.uint64))))], np.uint64)).view(np.int64)[0])
    c = combine(p)
    p = Places(p.at[c.dealt], p.route[c.dealt], [f[c.dealt] for f in p.fields])
    bucket = (p.route % np.uint64(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    stops = np.cumsum(sizes)
    used = np.flatnonzero(sizes)
    at = p.at[order]
    fields = [raw(f)[order] for f in p.fields]
    cols: list[list] = [[] for _ in range(2 + FIELDS)]
    for b in used:
        i, j = stops[b] - sizes[b], stops[b]
        steps = np.diff(at[i:j], prepend=0)
        cols[0].append(j - i)
        cols[1].append(steps.astype(np.uint16 if steps.max() < 1 << 16 else np.uint32).tobytes())
        for k in range(FIELDS):
            cols[2 + k].append(fields[k][i:j].tobytes() if k < len(fields) else None)
    used = np.r_[used, uid % n_buckets]
    cols[0].append(TABLE)
    places = [np.array([len(c.twin)], np.int64).tobytes() + c.twin.astype(np.uint32).tobytes() + c.follows.astype(np.uint32).tobytes(), c.decided.astype(np.uint32).tobytes()]
    for k, x in enumerate((doc_ids.tobytes(), ths.tobytes(), first.astype(np.int64).tobytes(), *places)):
        cols[1 + k].append(x)
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(np.full(len(used), uid, np.int64)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
        ["bucket", "uid", "n", "place", *(f"f{i}" for i in range(FIELDS))],
    )


def deal(docs: DataFrame, places: Callable[[Slice, pa.RecordBatch, np.ndarray], tuple[Places, np.ndarray]], n_buckets: int, combine: Callable[[Places], Combined] = two_of_each) -> DataFrame:
    """Rows by bucket. docs: _id, _th, text and what places() needs; places() gives those of a slice and, for each
    document, the place where it begins (n + 1 values)."""

    enough = min(POOL, ROW_PLACES * n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, Places]] = []
        count = 0
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            doc_ids, ths = ids(column(batch, "_id"), 0), ids(column(batch, "_th"), 0)
            for s in slices(data, offsets):
                found, first = places(s, batch, doc_ids[s.i : s.j])
                if len(found.at):
                    held.append((doc_ids[s.i : s.j], ths[s.i : s.j], first, found))
                    count += len(found.at)
                if count >= enough:
                    yield _rows(*_pooled(held), n_buckets, combine)
                    held, count = [], 0
        if held:
            yield _rows(*_pooled(held), n_buckets, combine)

    return docs.mapInArrow(tidy(run), DEALT)


def decide(dealt: DataFrame, choose: Callable[[list[np.ndarray]], dict[int, np.ndarray]], n_buckets: int, extent: int | None = None) -> DataFrame:
    """Answers by slice. choose() gets the fields of all places of a partition, with the bucket last, and gives
    for each kind of answer which places get it. Places of a bucket come by slice (uid) and place, in whatever order
    their rows arrive, so a choice of the first one is the same in each run. extent: the field (two bytes) that tells
    how many places after a place belong to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, counts, buckets = [], [], []
        place: list[np.ndarray] = []
        fields: list[list[bytes]] = [[] for _ in range(FIELDS)]
        tables: list[tuple[int, bytes]] = []
        for batch in batches:
            rows = [column(batch, c).to_pylist() for c in ("bucket", "uid", "n", "place", *(f"f{i}" for i in range(FIELDS)))]
            for bucket, uid, n, at, *fs in zip(*rows, strict=True):
                if n == TABLE:
                    tables.append((uid, np.array([len(at) // 8, len(fs[3]) // 4]).tobytes() + at + fs[0] + fs[1] + fs[2] + fs[3]))
                    continue
                uids.append(uid)
                counts.append(n)
                buckets.append(bucket)
                place.append(np.cumsum(np.frombuffer(at, np.uint16 if len(at) == 2 * n else np.uint32), dtype=np.uint32))
                for k, f in enumerate(fs):
                    if f is not None:
                        fields[k].append(f)
        out: list[tuple[int, int, bytes, bytes | None]] = [(uid, TABLE, t, None) for uid, t in tables]
        if uids:
            total = sum(counts)
            fixed = sorted(range(len(uids)), key=lambda r: (buckets[r], uids[r]))
            uids, counts, buckets, place = ([x[r] for r in fixed] for x in (uids, counts, buckets, place))
            arrays = [np.frombuffer(b"".join(f[r] for r in fixed), np.uint8).reshape(total, -1) for f in fields if f]
            fields.clear()
            arrays.append(np.repeat(np.array(buckets, np.uint64), counts))
            at = np.concatenate(place)
            row = np.repeat(np.arange(len(uids)), counts)
            for kind, mask in choose(arrays).items():
                hit = np.flatnonzero(mask)
                cuts = np.searchsorted(row[hit], np.arange(len(uids) + 1))
                for r in np.flatnonzero(np.diff(cuts)):
                    own = hit[cuts[r] : cuts[r + 1]]
                    out.append((uids[r], kind, at[own].tobytes(), None if extent is None else arrays[extent][own].tobytes()))
        for i in range(0, len(out), 5000):
            u, k, p, e = zip(*out[i : i + 5000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(k, pa.int32()), pa.array(p, pa.binary()), pa.array(e, pa.binary())], ["uid", "kind", "place", "extent"])

    return dealt.repartitionById(n_buckets, F.col("bucket")).mapInArrow(tidy(run), ANSWER)


class Table:
    """What a slice's row of kind TABLE holds: its documents, the places that follow others, and those decided."""

    def __init__(self, data: bytes):
        n, decided = np.frombuffer(data, np.int64, 2)
        self.doc_ids, self.ths = np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, np.int64, n, 16 + 8 * n)
        at = 16 + 16 * int(n)
        self.first = np.frombuffer(data, np.int64, n + 1, at)
        at += 8 * (int(n) + 1)
        twins = int(np.frombuffer(data, np.int64, 1, at)[0])
        self.twin, self.follows = (np.frombuffer(data, np.uint32, twins, at + 8 + 4 * twins * k).astype(np.int64) for k in range(2))
        self.decided = np.frombuffer(data, np.uint32, decided, at + 8 + 8 * twins)


def resolve(answers: DataFrame, n_partitions: int) -> DataFrame:
    """Runs of consecutive places by document and kind; a row for each that has any. Rows that agree in id and text may
    have got different answers in different slices: theirs are united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, bytes] = {}
        found: dict[tuple[int, int], list[tuple[bytes, bytes | None]]] = {}
        for batch in batches:
            for uid, kind, place, extent in zip(*(column(batch, c).to_pylist() for c in ("uid", "kind", "place", "extent")), strict=True):
                if kind == TABLE:
                    tables[uid] = place
                else:
                    found.setdefault((uid, kind), []).append((place, extent))
        out: list[tuple] = []
        parsed = {uid: Table(t) for uid, t in tables.items()}
        for uid, t in parsed.items():
            if len(t.decided):
                found.setdefault((uid, 0), []).append((t.decided.tobytes(), None))
        for (uid, kind), parts in found.items():
            t = parsed[uid]
            doc_ids, ths, first = t.doc_ids, t.ths, t.first
            at = np.frombuffer(b"".join(p for p, _ in parts), np.uint32).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at = at[order]
            where = np.minimum(np.searchsorted(at, t.follows), max(0, len(at) - 1))
            with_it = np.flatnonzero(at[where] == t.follows) if len(at) else np.zeros(0, int)
            if parts[0][1] is None:
                lo, hi = runs(np.unique(np.r_[at, t.twin[with_it]]))
            else:
                reach = np.frombuffer(b"".join(e for _, e in parts), np.uint16)[order].astype(np.int64) + 1
                lo, hi = np.r_[at, t.twin[with_it]], np.r_[at + reach, t.twin[with_it] + reach[where[with_it]]]
            cut = first[np.searchsorted(first, lo, "right")]  # a run of places ends with its document
            while (over := hi > cut).any():
                lo, hi = np.r_[lo, cut[over]], np.r_[np.minimum(hi, cut), hi[over]]
                cut = first[np.searchsorted(first, lo, "right")]
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], hi[order]
            cuts = np.searchsorted(lo, first)
            for d in np.flatnonzero(np.diff(cuts)):
                begin, end = merged(lo[cuts[d] : cuts[d + 1]] - first[d], hi[cuts[d] : cuts[d + 1]] - first[d])
                out.append((int(doc_ids[d]), int(ths[d]), kind, begin.astype(np.uint32).tobytes(), end.astype(np.uint32).tobytes()))
        for i in range(0, len(out), 5000):
            c = list(zip(*out[i : i + 5000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary())], ["_id", "_th", "kind", "begins", "ends"])

    rows = answers.repartition(n_partitions, "uid").mapInArrow(tidy(run), RUNS)
    return united(rows.groupBy("_id", "_th", "kind").agg(F.collect_set(F.struct("begins", "ends")).alias("runs")))


def united(rows: DataFrame) -> DataFrame:
    """RUNS from rows with a list of runs each (_id, _th, kind, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, e = [], []
            for found in column(batch, "runs").to_pylist():
                begin, end = found[0]["begins"], found[0]["ends"]
                if len(found) > 1:
                    lo, hi = (np.frombuffer(b"".join(f[k] for f in found), np.uint32) for k in ("begins", "ends"))
                    begin, end = (x.tobytes() for x in merged(lo, hi))
                b.append(begin)
                e.append(end)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("_id", "_th", "kind")), pa.array(b, pa.binary()), pa.array(e, pa.binary())], ["_id", "_th", "kind", "begins", "ends"])

    return rows.mapInArrow(tidy(run), RUNS)
