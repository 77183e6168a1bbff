"""The exact operators against brute force: near-duplicates, substrings, suffixes."""

from __future__ import annotations

from collections import Counter

import corpus as c
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeflow.llm import near_dups, substrings, suffixes, textkit


def test_near_dups(spark, corpus):
    rows, df = corpus
    comp, sizes = c.components(rows)
    got = near_dups.clustered(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((row[0], n, k) for row, n, k in zip(rows, sizes, comp, strict=True))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("propose", [near_dups.PROPOSE, 2.0])
def test_near_dups_of_dense_regions(spark, corpus, monkeypatch, propose):
    """Every region is joined by prefixes; with nothing proposed before, that join alone finds all links."""
    monkeypatch.setattr(near_dups, "DENSE", 0)
    monkeypatch.setattr(near_dups, "PROPOSE", propose)
    rows, df = corpus
    comp, sizes = c.components(rows)
    got = near_dups.clustered(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((row[0], n, k) for row, n, k in zip(rows, sizes, comp, strict=True))


def alike_texts(n, seed=1, own=36, shared=150):
    """Texts of one template, each with words of its own: about 0.62 similar. Some are near copies of the one before."""
    r = np.random.default_rng(seed)
    template = [f"t{i}" for i in range(shared)]
    texts = []
    for i in range(n):
        if i % 100 == 99:
            w = texts[-1].split(" ")
            w[int(r.integers(len(w)))] = f"changed{i}"
        else:
            w = template + [f"own{i}x{j}" for j in range(own)]
        texts.append(" ".join(w))
    return texts


def test_alike_texts_make_no_pairs(spark, monkeypatch):
    """Of a thousand texts that are alike but not linked only near copies are confirmed."""
    monkeypatch.setattr(near_dups, "DENSE", 1)
    asked = []
    plain = near_dups.confirmed
    monkeypatch.setattr(near_dups, "confirmed", lambda pairs, *more: plain(pairs if asked.append(pairs.count()) is None else pairs, *more))
    df = spark.createDataFrame(list(enumerate(alike_texts(1000))), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dups.clustered(df).collect()}
    assert got == {i: i - 1 if i % 100 == 99 else i for i in range(1000)} and sum(asked[1:]) < 100


def test_one_of_each(spark, corpus):
    rows, df = corpus
    comp, sizes = c.components(rows)
    got = near_dups.one_of_each(df)
    assert got.columns == df.columns
    left = got.collect()
    assert len(left) == len({k for k, n in zip(comp, sizes, strict=True) if n}) + sum(n == 0 for n in sizes)


def test_one_of_each_component_whatever_its_ids(spark):
    """Unrelated texts with null ids or with one id stay; of near copies among them one does."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " end"), (None, text("c")), (None, text("c")), (5, text("d")), (5, text("e")), (5, text("e") + " end"), (9, text("e")), (5, text("f")), (3, text("f"))]
    left = near_dups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.text[0]) for r in left) == Counter([(None, "a"), (None, "b"), (None, "c"), (5, "d"), (5, "e"), (3, "f")])


def chain(rows=1500):
    """A long chain: each text shares enough with the next, the ends share nothing."""
    step = [f"t{i}" for i in range(rows * 3 + 60)]
    return [(i, " ".join(step[i * 3 : i * 3 + 60])) for i in range(rows)]


def test_dense_and_chained_groups(spark, monkeypatch):
    """A chain of links, and a dense group read by two neighbours and closed in small blocks."""
    import random

    monkeypatch.setattr(near_dups, "WIDTH", 2)
    monkeypatch.setattr(near_dups, "BLOCK", 6)
    r = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    dense = []
    for i in range(90):
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(80)] = f"z{r.randint(0, 9999)}"
        dense.append((10000 + i, " ".join(t)))
    rows = chain(150) + dense
    comp, _ = c.components(rows)
    got = {x.doc_id: x.component_id for x in near_dups.clustered(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: k for (d, _), k in zip(rows, comp, strict=True)}


def test_substrings(spark, corpus):
    rows, df = corpus
    got = substrings.deduplicated(df).collect()
    want = Counter((row[0], *x) for row, x in zip(rows, c.without_repeated_words(rows), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert any(r.n_removed for r in got)


@pytest.mark.parametrize("window", [1, 2, 7, 12])
def test_substrings_short_windows(spark, corpus, window):
    rows, df = corpus
    got = substrings.deduplicated(df, window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter((row[0], *x) for row, x in zip(rows, c.without_repeated_words(rows, window), strict=True))


def test_suffixes(spark, corpus):
    rows, df = corpus
    got = suffixes.deduplicated(df).collect()
    want = Counter((row[0], *x) for row, x in zip(rows, c.without_repeated_bytes(rows), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert any(r.n_removed and r.n_removed < r.n_bytes for r in got)


@pytest.mark.parametrize("length", [2, 9, 40])
def test_suffixes_short(spark, corpus, length):
    rows, df = corpus
    got = suffixes.deduplicated(df, length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((row[0], *x) for row, x in zip(rows, c.without_repeated_bytes(rows, length), strict=True))


def test_cut_texts(spark, corpus):
    rows, df = corpus
    out = suffixes.cut_texts(df)
    assert out.columns == df.columns
    want = Counter((row[0], None if row[1] is None else x[3].decode("utf-8", "ignore"), row[3]) for row, x in zip(rows, c.without_repeated_bytes(rows), strict=True))
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == want


def test_empty_tables(spark, empty):
    assert near_dups.clustered(empty).count() == 0
    assert near_dups.one_of_each(empty).count() == 0
    assert substrings.deduplicated(empty).count() == 0
    assert suffixes.deduplicated(empty).count() == 0
    assert suffixes.cut_texts(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), st.sampled_from([1, 1, 1, 2, 5])), min_size=1, max_size=7), st.sampled_from([(4, 1), (4, 2), (6, 3), (8, 4), (5, 5)]), st.sampled_from([1, 16, 1000]))
def test_merge_of_transforms(texts, shape, shard):
    length, step = shape
    seen = Counter()
    for t, w in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += w
    want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t, _ in texts]
    got = suffixes.repeated([np.frombuffer(t, np.uint8) for t, _ in texts], [w for _, w in texts], length, step, shard)
    assert [x.tolist() for x in got] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 9), st.sampled_from([3, 8, 1 << 23]))
def test_minimizers(values, w, chunk):
    old, suffixes.CHUNK = suffixes.CHUNK, chunk
    try:
        g = np.array(values, np.uint64)
        got = suffixes.minimizers(g, w).tolist()
    finally:
        suffixes.CHUNK = old
    assert got == [min(range(i, i + w), key=lambda j: (values[j] >> 24, j)) for i in range(len(values) - w + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t", max_size=30), min_size=1, max_size=6), st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got, hashes = [], {}
    for s in textkit.slices(data, offsets, limit):
        starts, ends, first = s.words()
        h = s.word_hashes()
        for d in range(s.n):
            own = [s.buf[starts[i] : ends[i]].tobytes() for i in range(first[d], first[d + 1])]
            got.append(own)
            for i, w in enumerate(own):
                assert hashes.setdefault(w, h[first[d] + i]) == h[first[d] + i]
    assert got == [[w.encode() for w in c.words(t)] for t in texts] and len(set(hashes.values())) == len(hashes)


def test_pooled_slices(spark, corpus, monkeypatch):
    """Answers come back to the right documents when a row's places come from several slices."""
    from noticeflow.llm import exchange

    rows, df = corpus
    monkeypatch.setattr(exchange, "slices", lambda data, offsets: textkit.slices(data, offsets, 700))
    monkeypatch.setattr(exchange, "ROW_PLACES", 500)
    got = substrings.deduplicated(df, 7).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter((row[0], *x) for row, x in zip(rows, c.without_repeated_words(rows, 7), strict=True))
    got = suffixes.deduplicated(df, 40).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((row[0], *x) for row, x in zip(rows, c.without_repeated_bytes(rows, 40), strict=True))


def test_hot_groups(spark, corpus, monkeypatch):
    """Groups split by offset class give the same spans."""
    rows, df = corpus
    monkeypatch.setattr(suffixes, "HOT", 1)
    monkeypatch.setattr(suffixes, "CLASS", 7)
    for length in (40, 400):
        got = suffixes.deduplicated(df, length).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((row[0], *x) for row, x in zip(rows, c.without_repeated_bytes(rows, length), strict=True))


def test_answers_of_rows_alike_in_several_slices(spark):
    """A row that two slices hold, with different segments marked in each: the runs of both count."""
    from noticeflow.llm import exchange

    table = np.array([1, 0, 7, 70, 0, 100, 0]).tobytes()  # n, none decided, id, hash of the text, begin and end, no twins
    byte = lambda x: np.array([x], np.uint16).tobytes()
    place = lambda x: np.array([x], np.uint32).tobytes()
    rows = [(1, exchange.TABLE, table, None), (2, exchange.TABLE, table, None), (1, 1, place(0), byte(9)), (2, 1, place(50), byte(9)), (1, 0, place(20), byte(0)), (2, 0, place(20), byte(0))]
    got = exchange.resolve(spark.createDataFrame(rows, exchange.ANSWER), 2).collect()
    runs = {r.kind: (r["_id"], r["_th"], *(np.frombuffer(x, np.uint32).tolist() for x in (r.begins, r.ends))) for r in got}
    assert len(got) == 2 and runs == {1: (7, 70, [0, 50], [10, 60]), 0: (7, 70, [20], [21])}


def test_equal_places_of_a_slice():
    """Two of each are dealt; the others follow the second, or, for windows, go if their id is not the least."""
    from noticeflow.llm import exchange

    route, field = np.array([5, 5, 6, 5, 5, 6], np.uint64), np.array([1, 1, 1, 1, 2, 1], np.uint64)
    c = exchange.two_of_each(exchange.Places(np.arange(10, 16), route, [field]))
    assert c.dealt.tolist() == [0, 1, 2, 4, 5] and (c.twin.tolist(), c.follows.tolist()) == ([13], [11])
    none = exchange.two_of_each(exchange.Places(np.zeros(0, np.int64), np.zeros(0, np.uint64), [np.zeros(0, np.uint64)]))
    assert not len(none.dealt) and not len(none.twin)


@pytest.mark.parametrize("length", [600, 1200])
def test_suffixes_long(spark, length):
    text = "".join(chr(97 + (i * i + i // 7) % 23) for i in range(3000))
    rows = [(1, text + "x" * 40), (2, "y" * 90 + text[200:2000]), (3, text[:length]), (4, text[: length - 1])]
    got = suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((row[0], *x) for row, x in zip(rows, c.without_repeated_bytes(rows, length), strict=True))


def test_first_place_whatever_arrives_first(spark):
    """Of places with one hash the one of the least slice is chosen, in whatever order rows arrive."""
    from noticeflow.llm import exchange

    def choose(fields):
        first = np.zeros(len(fields[0]), bool)
        first[np.unique(fields[0], return_index=True)[1]] = True
        return {1: first}

    row = lambda uid: (0, uid, 1, np.array([uid], np.uint16).tobytes(), b"h", None, None, None)
    for order in ([1, 2, 3], [3, 1, 2], [2, 3, 1]):
        got = exchange.decide(spark.createDataFrame([row(u) for u in order], exchange.DEALT).coalesce(1), choose, 2).collect()
        assert [(r.uid, bytes(r.place)) for r in got] == [(1, np.array([1], np.uint32).tobytes())]
