"""Fingerprints against a plain version; the pruned join against all pairs."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import corpus as c
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import spot_sigs


def signatures(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    content = [(i, x) for i, x in enumerate(w) if x not in spot_sigs.COMMON]
    found = []
    for i, x in enumerate(w):
        after = [y for j, y in content if j > i][:3]
        if x in spot_sigs.COMMON and after:
            found.append(" ".join([x, *after]))
    if not found and w:
        found = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    return sorted({hashlib.md5(s.encode()).hexdigest()[:12] for s in found})


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else float(a == b)


def expected(rows, hashes):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1] or ""]))
    out = []
    for i, (d, t, *_) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + following[:k]
        own, edited = signatures(t), signatures(e)
        out.append((d, len(t), c.sha(e), "".join(own), "".join(edited), round(jaccard(own, edited), 9), round(jaccard(own, signatures(following)), 9)))
    return Counter(out)


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprints(spark, corpus):
    rows, df = corpus
    prose = [(100 + i, t, "en", "a", 1) for i, t in enumerate(("The cat sat on the mat, and the dog was with it in the old house by a river.", "die Katze ist auf dem Dach und der Hund nicht", "the and of", "The cat sat on the mat, and the dog was with it in the old house by a lake.", "of the x", "É à Ñu 12_3"))]
    rows = [*rows, *prose, prose[0], prose[0]]
    df = spark.createDataFrame(rows, c.SCHEMA).withColumns({"codes": F.lit("x"), "rank": F.lit(1), "edited": F.lit(2), "copies": F.lit(3)}).repartition(4)
    hashes = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = spot_sigs.compared(df).collect()
    assert Counter(tuple(round(r[x], 9) if x.startswith("near") else r[x] for x in COLUMNS) for r in got) == expected(rows, hashes)


@pytest.mark.parametrize("rows", [[], [(1, "the only text of all")], [(None, None), (None, None), (1, "")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    assert Counter(tuple(round(r[x], 9) if x.startswith("near") else r[x] for x in COLUMNS) for r in spot_sigs.compared(df).collect()) == expected(rows, hashes)


def test_chains_by_hand(spark):
    df = spark.createDataFrame([("The cat of the house sat, on it.",), ("cats dogs mice birds",), ("Cats dogs",), ("the",), ("",)], "t string")
    got = [r.s for r in df.selectExpr(f"{spot_sigs.chains('t')} as s").collect()]
    assert got == [["the cat house sat", "of house sat", "the house sat"], ["cats dogs mice", "dogs mice birds"], ["cats dogs"], ["the"], []]


def test_no_long_text_is_slow(spark):
    text = "the old house of a " * 200000  # 3.8 MB; quadratic work would take hours
    got = spark.createDataFrame([(1, text), (2, "x" * 3000000), (3, "é")], "doc_id long, text string")
    assert {r.doc_id: r.n_codes for r in spot_sigs.compared(got).collect()} == {1: len(signatures("the old house of a " * 20)), 2: 1, 3: 1}


def test_near_pairs(spark):
    rows = c.made(3, 150)
    docs = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(rows)], "doc_id long, text string").repartition(3)
    prints = spot_sigs.fingerprinted(docs)
    sets = {r.set_id: frozenset(r.codes) for r in prints.collect()}
    wanted = {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.75}
    got = spot_sigs.near_pairs(prints).collect()
    assert len(wanted) > 10 and Counter((min(r.a, r.b), max(r.a, r.b)) for r in got) == Counter(wanted)
    assert all(abs(r.similarity - jaccard(sets[r.a], sets[r.b])) < 1e-9 for r in got)
