"""Vector codes and hard negatives against plain versions, with nulls, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(n=300, width=16, seed=1, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width)) * 0.3
    rows = [(int(i), [float(x) for x in np.float32(centres[r.integers(6)] + r.normal(size=width) * 0.1)], int(r.integers(labels))) for i in r.permutation(n)]
    rows += [(1000, None, 1), (1001, [None] * width, 1), (1002, [float("nan")] * width, 1), (1003, [float("inf")] * width, 2), (1004, rows[3][1], None), (None, rows[5][1], 1), (None, None, None)]
    rows += [rows[7], rows[7], (rows[8][0], rows[9][1], 2)] + [(2000 + i, rows[11][1], 3) for i in range(40)]  # repeated rows, one id twice, many equal vectors
    r.shuffle(rows)
    return rows


def table(spark, rows):
    extra = {"code": F.lit("x"), "vector": F.lit(1), "q": F.lit(2), "anchor": F.lit(3), "cell": F.lit(4), "error": F.lit(5), "_label": F.lit(6), "_id": F.lit(7)}
    return spark.createDataFrame([(a, b, c) for a, b, c in rows], SCHEMA).withColumns(extra).repartition(5)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if good(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return Counter()
    wide = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * wide : (p + 1) * wide]) for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v, _ in kept[:entries]), strict=True)]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        own = [[near(x, b)[1] for x, b in zip(cut(v), books, strict=True)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), o in zip(kept, own, strict=True) if o[p] == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    out, errors = [], Counter()
    for i, v, label in kept:
        found = [near(x, b) for x, b in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        errors[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, e, errors[label], sha) for i, code, e, label in out)


@pytest.mark.parametrize("entries", [16, 3, 256])
def test_codes(spark, entries):
    rows = made()
    got = vector_codes.compressed(table(spark, rows), entries=entries, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == codes(rows, entries=entries, rounds=3)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(5, [0.5] * 8, None)], [(2, [], 1), (1, [], None)], [(i, [0.1] * 8, 0) for i in range(30)]])
def test_codes_of_small_tables(spark, rows):
    assert Counter(tuple(r) for r in vector_codes.compressed(table(spark, rows)).collect()) == codes(rows)


def test_label_errors_by_shuffle(spark, monkeypatch):
    rows = [(i, v, label if i is None or i % 3 else 10 + i) for i, v, label in made(1500)]
    monkeypatch.setattr(vector_codes, "BROADCAST_BYTES", 0)
    assert Counter(tuple(r) for r in vector_codes.compressed(table(spark, rows), rounds=1).collect()) == codes(rows, rounds=1)


@pytest.mark.parametrize("rows", [[(1, [0.1] * 8, 1), (2, [0.1] * 16, 1)], [(1, [0.1] * 9, 1)], [(1, [1e9] * 8, 1)]])
def test_what_cannot_be_coded_is_an_error(spark, rows):
    with pytest.raises(Exception, match="several lengths|cannot be cut|too large"):
        vector_codes.compressed(table(spark, rows)).collect()


def test_tree_finds_the_lowest_of_equal_entries():
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 16, 200):
        entries, points = r.integers(-3, 4, (n, 2)), r.integers(-4, 5, (500, 2))  # many ties and equal entries
        d = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        index, best = vector_codes.Tree.of(entries).nearest(points)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_decoded_vectors_are_near(spark):
    rows = made()
    df = table(spark, rows).selectExpr("vec_id", "label", "cast(embedding as array<double>) vector")
    books = vector_codes.fit(df)
    one = next(r for r in vector_codes.coded(df, books).collect() if r.vec_id == 3)
    vector = next(v for i, v, _ in rows if i == 3)
    error = sum((math.floor(4096 * x) - math.floor(4096 * y)) ** 2 for x, y in zip(vector, books.decoded(one.code), strict=True))
    assert error == one.error


def mined(rows, positives=5, negatives=10):
    usable = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if good(v) and label is not None]
    far = (1 << 63) - 1
    ranked = lambda xs: sorted(xs, key=lambda x: (-x[0], far if x[1] is None else x[1]))
    out = Counter()
    for a, (i, v, label) in enumerate(usable):
        if i is None or i % 10:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other == label, b) for b, (j, w, other) in enumerate(usable)]
        for score, j, *_ in ranked([s for s in scores if s[2] and s[3] != a])[:positives]:
            fit = ranked([s for s in scores if not s[2] and 30 * score <= 100 * s[0] <= 90 * score])[:negatives]
            out.update((i, j, n + 1, k, score, s) for n, (s, k, *_) in enumerate(fit))
    return out


@pytest.mark.parametrize(("seed", "labels", "block"), [(1, 4, 8192), (2, 3, 7), (3, 60, 8192), (4, 1, 5)])
def test_hard_negatives(spark, monkeypatch, seed, labels, block):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "ROW_LEAF", 8)
    monkeypatch.setattr(hard_negatives, "ANCHOR_LEAF", 4)
    rows = made(seed=seed, labels=labels)
    got = hard_negatives.mined(table(spark, rows), F.col("vec_id") % 10 == 0, max_anchors=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found, wanted = Counter(tuple(r) for r in got.collect()), mined(rows)
    assert len(wanted) > 50 and found == wanted


@pytest.mark.parametrize("rows", [[], [(10, None, 1)], [(10, [0.5, 0.5], 1)], [(10, [0.5, 0.5], 1), (20, [0.4, 0.5], 1)], [(10, [0.5], 1), (20, [0.5], 1), (10, [0.5], 1), (3, [0.2], 2), (3, [0.2], 2)]])
def test_hard_negatives_of_small_tables(spark, rows):
    got = hard_negatives.mined(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert Counter(tuple(r) for r in got.collect()) == mined(rows)


def test_node_intervals_hold_every_product():
    r = np.random.default_rng(5)
    a, b = r.integers(-40, 40, (60, 8)), r.integers(-40, 40, (90, 8))
    s, t = (hard_negatives.Tree.of(x.astype(float), r.integers(0, 3, len(x)), 7) for x in (a, b))
    low, high = hard_negatives.intervals(s, t)
    for i in range(len(s.begin)):
        for j in range(len(t.begin)):
            inside = a[s.order[s.begin[i] : s.end[i]]] @ b[t.order[t.begin[j] : t.end[j]]].T
            assert low[i, j] < inside.min() and inside.max() < high[i, j]


def test_products_are_exact_or_refused():
    big = np.array([[1 << 27, 3]])
    assert hard_negatives.products(big, big)[0, 0] == (1 << 54) + 9
    with pytest.raises(ValueError, match="63 bits"):
        hard_negatives.products(np.array([[1 << 32]]), np.array([[1 << 32]]))
