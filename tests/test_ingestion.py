"""Batches and streams into an index: counters, tables that go, orders of upserts, concurrent calls, kept answers, keywords; and
searches of an inverted file that miss nothing."""

from __future__ import annotations

import asyncio
import sys
import threading
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from noticeflow import storage
from noticeflow.functions import keywords, text
from noticeflow.operators import ann, index, ingest, search, taxonomy
from noticeflow.operators.answers import Answers
from noticeflow.providers.concurrent import Concurrent
from noticeflow.providers.local import LocalProvider
from noticeflow.schemas import RAW, RAW_COLUMNS
from noticeflow.sources import readers
from noticeflow.streaming import ingest as streaming
from noticeflow.streaming.seen import Seen


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def raw(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in RAW_COLUMNS) for r in rows], RAW)


def notices(spark, n, text="Supply of thing {}", first=0):
    return raw(spark, [{"RefNo": f"N{i}", "Summary": text.format(i), "Description": "x" * 120} for i in range(first, first + n)])


def test_run_file_tells_the_rows_of_its_batch(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text(",".join(RAW_COLUMNS) + "\n" + "".join(f"Supply of thing {i},,{'x' * 120},,,,,N{i},,,,\n" for i in range(10)))
    rows, idx, words = readers.read_csv(spark, str(path)), index.Index(spark, str(tmp_path / "i")), taxonomy.as_array([])
    assert streaming.run_file(rows, idx, LocalProvider(), words, 0, 5) == 5
    assert streaming.run_file(rows, idx, LocalProvider(), words, 5, 7) == 2 and idx.count() == 7
    assert streaming.run_file(rows, idx, LocalProvider(), words, 4, 7) == 3 and idx.count() == 7  # overwrites count
    assert streaming.run_file(rows, idx, LocalProvider(), words, 7, 7) == 0


class Unsteady(LocalProvider):
    def enrich(self, title, description):
        if title.endswith("3"):
            raise RuntimeError("no answer")
        return super().enrich(title, description) | ({"signal_summary": ""} if title.endswith("4") else {})


def test_counters_and_tables_of_a_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    for f in range(10):
        lines = [f"Supply of thing {f}{i},,{'x' * 120 if i else ''},,,,,N{f}{i},,,,\n" for i in range(6)]
        (landing / f"{f}.csv").write_text(",".join(RAW_COLUMNS) + "\n" + "".join(lines) + ("too,few\n" if f == 2 else "") + lines[5])
    idx, counters, spent = index.Index(spark, str(tmp_path / "i")), streaming.Counters(), set(Path(storage.shared_folder(spark)).iterdir())
    for _ in range(2):  # the second start finds nothing
        streaming.run(streaming.landing(spark, str(landing), 1), idx, str(tmp_path / "c"), Unsteady(), taxonomy.as_array([]), dead_letter=str(tmp_path / "lost"), counters=counters).awaitTermination()
    assert counters == streaming.Counters(rows=60, stubbed=10, failed=10, empty=10, indexed=40, malformed=1)
    assert idx.count() == 40 and set(Path(storage.shared_folder(spark)).iterdir()) <= spent  # ten batches left no table


def test_copies_that_land_later_are_dropped(spark, tmp_path):
    landing, words = tmp_path / "in", taxonomy.as_array([])
    landing.mkdir()
    idx, seen = index.Index(spark, str(tmp_path / "i")), Seen(spark, str(tmp_path / "seen"))

    def land(name, rows, provider=None, seen=seen, checkpoint="c"):
        (landing / f"{name}.csv").write_text(",".join(RAW_COLUMNS) + "\n" + "".join(f"{t},,{'x' * 120},,,,,{k},,,,\n" for k, t in rows))
        counters = streaming.Counters()
        streaming.run(streaming.landing(spark, str(landing), 1), idx, str(tmp_path / checkpoint), provider or LocalProvider(), words, counters=counters, seen=seen).awaitTermination()
        return counters.rows

    assert land("a", [("A1", "Supply of thing 1"), ("A2", "Supply of thing 2"), ("A3", "Supply of thing 2")]) == 2
    assert land("b", [("B1", "SUPPLY OF THING 1 "), ("B4", "Supply of thing 4")]) == 1  # a restart: the state is read again
    assert {r.id for r in idx.read().collect()} == {"A1", "A2", "B4"}
    batch = {r.batch for r in seen.alive().collect()}
    assert len(batch) == 2 and land("c", [("C13", "Supply of thing 13")], Unsteady()) == 1 and land("d", [("D13", "Supply of thing 13")]) == 1  # a failure comes again
    # a repeat of the first batch sees what the others brought, not itself
    rows = ingest.cleaned(raw(spark, [{"RefNo": k, "Summary": t, "Country": None} for k, t in (("A1", "Supply of thing 1"), ("B4", "Supply of thing 4"), ("Z", "Supply of thing 9"))]))
    assert {r.RefNo for r in seen.unseen(rows, str(tmp_path / "c"), 0).collect()} == {"A1", "Z"}
    assert {r.RefNo for r in seen.unseen(rows, "another stream", 0).collect()} == {"Z"}
    short = Seen(spark, seen.path, keep=0.0)
    assert short.alive().isEmpty() and land("e", [("E1", "Supply of thing 1")], seen=short) == 1  # too old to count
    assert seen.forget() == 1 and short.forget() > 0  # first the batch that left no hash and seen.alive().isEmpty() and Seen(spark, str(tmp_path / "none")).forget() == 0


def test_counters_cost_no_job(spark, tmp_path):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    counts = []
    for k, counters in enumerate((None, streaming.Counters())):
        spark.sparkContext.setJobGroup("counted", "")
        before = jobs()
        streaming.run_file(notices(spark, 20), index.Index(spark, str(tmp_path / str(k))), LocalProvider(), taxonomy.as_array([]), counters=counters)
        counts.append(jobs() - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] > 0


def test_temporary_tables_are_those_of_their_thread(spark):
    kept, made = [], threading.Event()
    done = threading.Event()

    def other():
        kept.append(storage.written(spark.range(7), "other"))
        made.set()
        done.wait(30)

    t = threading.Thread(target=other)
    with storage.temporary(spark):
        t.start()
        assert made.wait(30)
        mine = storage.written(spark.range(5), "mine")
        with storage.temporary(spark):
            inner = storage.written(spark.range(3), "inner")
        assert mine.count() == 5
        with pytest.raises(Exception, match="inner"):
            spark.read.parquet(inner.inputFiles()[0]) if inner.inputFiles() else spark.read.parquet("inner")
    done.set()
    t.join()
    assert kept[0].count() == 7
    with pytest.raises(Exception, match="mine|exist"):
        mine.count()


def test_upserts_without_an_order_choose_alike(spark, tmp_path):
    rows = raw(spark, [{"RefNo": "same", "Summary": f"Supply of thing {i}", "Description": "q" * 110} for i in range(50)])
    said = set()
    for k, n in enumerate((1, 3, 8)):
        idx = index.Index(spark, str(tmp_path / str(k)))
        idx.upsert(ingest.embedded(ingest.metadata(ingest.enriched(rows.repartition(n), LocalProvider(), taxonomy.as_array([]))), LocalProvider()))
        said.add(tuple(r.original_title for r in idx.read().collect()))
    assert len(said) == 1


class Slow(LocalProvider):
    """Waits before each answer; the first try about every seventh notice fails, some never answer."""

    def __init__(self, wait=0.05, asynchronous=False):
        super().__init__()
        self.wait, self.tried, self.at_once, self.most, self.lock = wait, Counter(), 0, 0, threading.Lock()
        if asynchronous:
            self.enrich_async = self._enrich_async

    def __getstate__(self):
        return {"wait": self.wait, "dimension": self.dimension, "tags": self.tags}

    def __setstate__(self, state):
        self.__init__(state["wait"])

    def _begin(self, title):
        with self.lock:
            self.tried[title] += 1
            self.at_once += 1
            self.most = max(self.most, self.at_once)

    def _end(self, title, description):
        with self.lock:
            self.at_once -= 1
        number = int(title.split()[-1])
        if number % 11 == 5 or (number % 7 == 3 and self.tried[title] == 1):
            raise RuntimeError(f"busy {number}")
        return super().enrich(title, description) | {"signal_summary": title}

    def enrich(self, title, description):
        self._begin(title)
        time.sleep(5 if title.endswith(" 42") else self.wait)
        return self._end(title, description)

    async def _enrich_async(self, title, description):
        self._begin(title)
        try:
            await asyncio.sleep(5 if title.endswith(" 42") else self.wait)
        except asyncio.CancelledError:
            self.at_once -= 1
            raise
        return self._end(title, description)


@pytest.mark.parametrize("asynchronous", [False, True])
def test_calls_at_once_keep_order_and_failures(asynchronous):
    slow = Slow(asynchronous=asynchronous)
    asked = [(f"Supply of thing {i}", "") for i in range(50)]
    began = time.time()
    got = Concurrent(slow, in_flight=10, timeout=0.5, attempts=2, pause=0.01).enrich_many(asked)
    assert time.time() - began < 2.2  # one after the other: 50 * 0.05 s and twice 5 s; 42 costs twice the time-out
    assert 5 <= slow.most <= 11
    for i, a in enumerate(got):
        if i == 42:
            assert isinstance(a, TimeoutError)
        elif i % 11 == 5:
            assert str(a) == f"busy {i}" and slow.tried[f"Supply of thing {i}"] == 2
        else:
            assert a["signal_summary"] == f"Supply of thing {i}"
    with pytest.raises(ValueError, match="at least 1"):
        Concurrent(slow, in_flight=0)


def test_calls_that_answer_at_once_share_threads(monkeypatch):
    began, start = [], threading.Thread.start
    monkeypatch.setattr(threading.Thread, "start", lambda self: (began.append(self), start(self))[1])
    busy = Concurrent(Slow(0), in_flight=10, attempts=2, pause=0.0001)
    for k in range(40):
        got = busy.enrich_many([(f"Supply of thing {i}", "") for i in range(50 * k, 50 * k + 41)])
        assert [str(a) if isinstance(a, Exception) else a["signal_summary"] for a in got] == [f"busy {i}" if i % 11 == 5 else f"Supply of thing {i}" for i in range(50 * k, 50 * k + 41)]
    assert len(began) <= 10  # not one a call
    assert busy.enrich_many([]) == []


def test_late_calls_keep_no_place():
    class Stuck(LocalProvider):
        def enrich(self, title, description):
            if title == "stuck":
                time.sleep(3)
            return super().enrich(title, description)

    stuck = Concurrent(Stuck(), in_flight=2, timeout=0.2, attempts=1)
    got = stuck.enrich_many([("stuck", "")] * 4 + [("solar", "")] * 3)
    assert [isinstance(a, TimeoutError) for a in got] == [True] * 4 + [False] * 3
    assert stuck.enrich_many([("solar", "")])[0]["core_domain"] == "Energy"


def test_concurrent_enrichment_is_the_same(spark):
    rows = notices(spark, 60).repartition(2)
    plain = lambda p: {(r.RefNo, r.signal_summary, r.error) for r in ingest.enriched(rows, p, taxonomy.as_array([])).collect()}
    got = plain(Concurrent(Slow(0.01), timeout=1, attempts=2, pause=0.01))
    assert {(n, e) for n, _, e in got if e} == {("N42", "no answer within 1 s")} | {(f"N{i}", f"busy {i}") for i in range(5, 60, 11)} and len(got) == 60


class Paid(LocalProvider):
    """Writes a file for each call."""

    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    def enrich(self, title, description):
        import uuid

        (Path(self.folder) / uuid.uuid4().hex).write_text(title)
        if "thing 3" in title:
            raise RuntimeError("no answer")
        return super().enrich(title, description)


def test_answers_are_paid_for_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    provider, words = Paid(str(tmp_path / "calls")), taxonomy.as_array([])
    calls = lambda: len(list((tmp_path / "calls").iterdir()))
    hot = raw(spark, [{"RefNo": f"H{i}", "Summary": "Supply of much", "Description": "y" * 120} for i in range(40)])
    short = raw(spark, [{"RefNo": "S", "Summary": "short", "Description": None}])
    rows = notices(spark, 8).unionByName(hot).unionByName(short).repartition(4)
    plain = {r.RefNo: r.asDict() for r in ingest.enriched(rows, LocalProvider(), words).collect()}
    kept = Answers(spark, str(tmp_path / "answers"))
    first = {r.RefNo: r.asDict() for r in ingest.enriched(rows, provider, words, kept).collect()}
    assert calls() == 9 and {k for k in first if first[k]["error"]} == {"N3"}  # 8 and one for the 40 copies; the short one is a stub
    assert all(first[k] == plain[k] for k in plain if k != "N3") and len(first) == 49
    again = {r.RefNo: r.asDict() for r in ingest.enriched(rows, provider, words, kept).collect()}
    assert calls() == 10 and again == first  # only the failure is tried again
    more = ingest.enriched(notices(spark, 9), provider, words, kept)
    assert more.count() == 9 and calls() == 12  # N8 is new, N3 failed
    assert ingest.enriched(rows, provider, words, Answers(spark, kept.path, version="2")).count() == 49 and calls() == 21
    old = Answers(spark, kept.path, ttl=0.0)
    assert old.known().isEmpty() and ingest.enriched(notices(spark, 2), provider, words, old).count() == 2 and calls() == 23
    assert kept.compact(str(tmp_path / "fewer")).known().count() == kept.known().count() == len({r.key for r in kept.known().collect()})
    none = ingest.enriched(notices(spark, 0), provider, words, Answers(spark, str(tmp_path / "none")))
    assert none.isEmpty() and none.columns == more.columns


def test_texts_of_known_notices_are_written_once(spark, tmp_path):
    """A second run writes the rows, and beside them no more than hashes and answers."""
    r = np.random.default_rng(3)
    rows = raw(spark, [{"RefNo": f"N{i}", "Summary": f"Supply of thing {i}", "Description": r.bytes(20000).hex()} for i in range(40)]).repartition(4)
    kept, words = Answers(spark, str(tmp_path / "answers")), taxonomy.as_array([])
    first = ingest.enriched(rows, LocalProvider(), words, kept)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*.parquet"))
    before = size()
    again = ingest.enriched(rows, LocalProvider(), words, kept)
    assert size() - before < 1.6 * 40 * 40000  # the texts' bytes
    (tmp_path / "answers").rename(tmp_path / "gone")  # what was answered stays answered
    assert sorted(again.collect()) == sorted(first.collect()) == sorted(ingest.enriched(rows, LocalProvider(), words).collect())


def test_keywords_as_contains_has_them(spark):
    texts = ["a road to the sea", "ROAD", "", None, "été à la plage", "ab" * 50, "xaby", "the"]
    words = ["road", "the", "té", "abab", "b", "", "à la", "zz", "the", None, "ro"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    for chosen in (words, [w for w in words if w], [], ["zz"], [""]):
        scan, plain = keywords.Keywords(chosen, few=0), keywords.Keywords(chosen, few=99)
        got = df.select("t", scan.any_in(F.col("t")).alias("a"), plain.any_in(F.col("t")).alias("b"), scan.all_in(F.col("t")).alias("c"), plain.all_in(F.col("t")).alias("d")).collect()
        for r in got:
            want = sorted({w for w in chosen if w is not None and r.t is not None and w in r.t})
            assert bool(r.a) == bool(r.b) == bool(want) and r.c == r.d == want


def test_time_does_not_grow_with_keywords(spark):
    r = np.random.default_rng(1)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 9))
    df = spark.createDataFrame([(" ".join(word() for _ in range(300)),) for _ in range(600)], "t string").repartition(4).cache()
    df.count()
    took = {}
    for n in (40, 40, 10000, 10000):  # the second run of each counts
        few = keywords.Keywords([word() for _ in range(n)])
        began = time.time()
        df.select(few.any_in(F.col("t")).alias("hit")).agg(F.count_if("hit")).collect()
        took[n] = time.time() - began
    assert took[10000] < 4 * took[40] + 1


def test_the_prefilter_with_many_keywords(spark):
    rows = [("supply", "x"), ("supply of solar parts", "x" * 10), ("anything at all here", None), ("t", "y" * 200), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(F.col("a"), F.coalesce("b", F.lit("")).alias("b"))
    words = ["solar", *(f"word{i}" for i in range(50))]
    one, other = ingest.worth_enriching(F.col("a"), F.col("b"), taxonomy.as_array(words)), ingest.worth_enriching(F.col("a"), F.col("b"), keywords.Keywords(words))
    got = df.select(one.alias("x"), other.alias("y")).collect()
    assert [r.x for r in got] == [bool(r.y) for r in got] and [r.x for r in got] == [False, True, False, True, False]
    assert text.any_keyword is not None


def vectors(n=2000, d=16, seed=1):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(30, d)) * 2
    return middles[r.integers(0, 30, n)] + r.normal(size=(n, d)) * 0.5


@pytest.mark.parametrize("metric", ["squared_l2", "l2"])
def test_filtered_search_misses_nothing(spark, tmp_path, metric):
    v = np.r_[vectors(), vectors()[:30]]  # some vectors twice: ties
    rows = spark.createDataFrame([(i, [float(x) for x in row], i % 3, i % 97 == 5) for i, row in enumerate(v)] + [(9999, None, 0, True)], "id long, embedding array<double>, label int, rare boolean").repartition(4)
    built = ann.build(rows, str(tmp_path / "ivf"))
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    for where, k in ((F.col("rare"), 10), (None, 5), (F.col("label") == 1, 3), (F.col("id") < 4, 10), (F.lit(False), 2)):
        wanted = {(r.query_id, r.id): (round(r.distance, 6), r["rank"]) for r in search.nearest_many(rows if where is None else rows.where(where), queries, k, metric).collect()}
        hits, read = built.exact_many(queries, k, where, metric)
        assert {(r.query_id, r.id): (round(r.distance, 6), r["rank"]) for r in hits.collect()} == wanted
        assert read <= queries.count() * len(built.centres)
        one, cells = built.exact([float(x) for x in v[50]], k, where, metric)
        assert {(r.id, r["rank"]) for r in one.collect()} == {(i, n) for (q, i), (_, n) in wanted.items() if q == 50} and one.columns[:4] == ["id", "embedding", "label", "rare"]
        if where is None:
            assert read < queries.count() * len(built.centres) / 3 and cells < len(built.centres) / 3
    again = ann.load(spark, built.path)
    assert again.probes == built.probes and np.array_equal(again.centres, built.centres) and np.allclose(again.radius, built.radius)
    with pytest.raises(ValueError, match="no bounds"):
        built.exact([0.0] * 16, 2, metric="cosine")


def test_an_inverted_file_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, embedding array<double>")
    built = ann.build(rows, str(tmp_path / "none"))
    queries = spark.createDataFrame([(1, [0.5, 0.5])], "query_id long, query_embedding array<double>")
    assert built.exact([0.5, 0.5], 3)[0].isEmpty() and built.exact_many(queries, 3)[0].isEmpty() and len(ann.load(spark, built.path).centres) == 0
