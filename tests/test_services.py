"""Providers, dead letters, pages, listeners, collections, reports and the inverted file."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.operators import ann, index, ingest, reports, search, taxonomy
from noticeflow.providers.base import enrich_batch, page_of
from noticeflow.providers.local import LocalProvider
from noticeflow.providers.pages import StoredPages
from noticeflow.schemas import RAW, RAW_COLUMNS
from noticeflow.sources import readers
from noticeflow.streaming import ingest as streaming


def raw(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in RAW_COLUMNS) for r in rows], RAW)


def counted():
    """A provider that says in its answers which opening and which batch they are from."""

    class Counted(LocalProvider):
        opening, batch = 0, 0

        def open(self):
            import uuid

            other = type(self)()
            other.opening, other.batch = uuid.uuid4().hex, 0
            return other

        def enrich_many(self, notices):
            self.batch += 1
            return [self.enrich(t, d) | {"signal_summary": f"{self.opening} {self.batch} {len(notices)}"} for t, d in notices]

    return Counted()


def test_a_provider_is_opened_once_a_partition(spark):
    rows = raw(spark, [{"RefNo": str(i), "Summary": f"Supply {i}", "Description": "x" * 120} for i in range(330)]).repartition(3)
    said = [r.signal_summary.split() for r in ingest.enriched(rows, counted(), taxonomy.as_array([])).collect()]
    assert len({o for o, *_ in said}) == rows.rdd.getNumPartitions() == 3
    assert max(int(n) for *_, n in said) == ingest.MODEL_ROWS and len({(o, b) for o, b, _ in said}) >= 7


def test_answers_of_a_batch():
    class Short(LocalProvider):
        def enrich_many(self, notices):
            return [{}] * (len(notices) - 1)

    assert all(isinstance(x, ValueError) for x in enrich_batch(Short(), [("a", "b"), ("c", "d")]))
    assert [x["core_domain"] for x in enrich_batch(LocalProvider(), [("solar", ""), ("drone", "")])] == ["Energy", "Technology"]


# The notices and stated answers of a walk through the whole path.
NOTICES = [("Construction of 50-bed Maternity Ward", "Delhi", "5 Cr", "12-01-2024"), ("Supply of MRI Machines", "Mumbai", "20 Lakhs", "15/01/2024"), ("Repair of Highway near Hospital", "Pune", "10 K", "2024-02-01")]
ANSWERS = {
    "Construction of 50-bed Maternity Ward": ("Infrastructure", "Works", ["Clinic", "Healthcare", "Building"], "PWD", "Construction of Maternity Ward"),
    "Supply of MRI Machines": ("Healthcare", "Supply", ["Medical Equipment", "Scan"], "AIIMS", "Supply of MRI Machine"),
    "Repair of Highway near Hospital": ("Infrastructure", "Works", ["Road", "Tarmac"], "NHAI", "Highway Repair"),
}


def test_the_whole_path_with_stated_answers(spark):
    answers = ANSWERS

    class Stated(LocalProvider):
        def enrich(self, title, description):
            domain, kind, words, authority, summary = answers[title]
            return {"core_domain": domain, "procurement_type": kind, "search_keywords": words, "entities": {"authority_name": authority}, "signal_summary": summary}

    rows = raw(spark, [{"Title": t, "Location": p, "Amount": a, "Date": d} for t, p, a, d in NOTICES])
    clean = {r.Title: r for r in ingest.cleaned(rows).collect()}
    assert [clean[t].AmountInt for t, *_ in NOTICES] == [50_000_000, 2_000_000, 10_000] and [clean[t].DateISO for t, *_ in NOTICES] == ["2024-01-12", "2024-01-15", "2024-02-01"]
    table = ingest.index_rows(readers.with_row_index(rows), Stated(), taxonomy.as_array(["maternity", "mri", "highway"]))
    got = {r.original_title: r for r in table.collect()}
    for t, (domain, kind, words, authority, summary) in ANSWERS.items():
        assert (got[t].core_domain, got[t].procurement_type, got[t].authority_name) == (domain, kind, authority)
        assert got[t].document == f"{summary}. Tags: . Keywords: {', '.join(words)}"
    stubs = ingest.enriched(ingest.cleaned(rows), Stated(), taxonomy.as_array([])).collect()
    assert {r.core_domain for r in stubs} == {"Unclassified"} and all(r.note for r in stubs)


def test_dead_letters_of_a_stream(spark, tmp_path):
    class Partly(LocalProvider):
        def enrich(self, title, description):
            if "item 3" in title:
                raise RuntimeError("no answer")
            return super().enrich(title, description)

    landing = tmp_path / "in"
    landing.mkdir()
    line = lambda k: f"Supply of item {k} {'x' * 90},,,,,,,R{k},,,,\n"
    (landing / "a.csv").write_text(",".join(RAW_COLUMNS) + "\n" + line(1) + "too,few\n" + line(3))
    (landing / "b.csv").write_text(",".join(RAW_COLUMNS) + "\n" + line(5).replace("R5", "R1") + line(6))
    idx, lost = index.Index(spark, str(tmp_path / "index")), str(tmp_path / "lost")
    seen = []
    listener = streaming.Progress(lambda done, total: seen.append((done, total)), 5)
    spark.streams.addListener(listener)
    try:
        for _ in range(2):
            q = streaming.run(streaming.landing(spark, str(landing), 1), idx, str(tmp_path / "ckpt"), Partly(), taxonomy.as_array([]), dead_letter=lost)
            q.awaitTermination()
        import time

        for _ in range(50):
            if listener.rows >= 5:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {r.id for r in idx.read().collect()} == {"R1", "R6"} and "item 5" in idx.read().where("id = 'R1'").first().original_title
    assert {(r.ref_no, r.error) for r in spark.read.schema("ref_no string, title string, error string").json(lost).collect()} == {("R3", "no answer"), (None, "malformed line")}
    assert listener.batches >= 2 and listener.rows == 5 and seen[-1] == (5, 5) and listener.error is None


def test_pages(spark, tmp_path):
    pages = StoredPages({"http://a/1": (200, "<p>Opening   hours nine</p><script>x</script>"), "http://a/2": (404, "gone"), "http://a/3": RuntimeError("late")})
    assert page_of(pages, "http://a/1").startswith("<p>") and all(page_of(pages, u) is None for u in ("http://a/2", "http://a/3", "http://a/4", "ftp://a/1", "#", None))
    rows = raw(spark, [{"RefNo": f"N{k}", "Summary": f"Supply of thing {k}", "Description": "y" * 110, "Tender_Notice_Document": f"http://a/{k}"} for k in (1, 2)])
    table = ingest.index_rows(readers.with_row_index(rows), LocalProvider(), taxonomy.as_array([]))
    assert search.chat(table, "N1", "which opening hours?", LocalProvider(), fetcher=pages) == "Opening hours nine"
    assert "Opening" not in search.chat(table, "N2", "which opening hours?", LocalProvider(), fetcher=pages)
    assert search.chat(table, "none", "?", LocalProvider(), fetcher=pages) == search.NOT_FOUND


def test_collections_by_name(spark, tmp_path):
    one = index.collection(spark, "c", str(tmp_path))
    assert one.count() == 0 and one.version() == 0
    one.upsert(ingest.index_rows(readers.with_row_index(raw(spark, [{"RefNo": "a", "Summary": "Supply of a", "Description": "z" * 100}])), LocalProvider(), taxonomy.as_array([])))
    assert index.collection(spark, "c", str(tmp_path)).count() == 1 and index.collection(spark, "other", str(tmp_path)).count() == 0


def test_the_last_row_of_an_id_wins(spark, tmp_path):
    rows = [{"RefNo": "same", "Summary": f"Supply of thing {i}", "Description": "q" * 110} for i in range(40)]
    for n in (1, 7):
        idx = index.Index(spark, str(tmp_path / f"i{n}"))
        path = tmp_path / f"{n}.csv"
        path.write_text(",".join(RAW_COLUMNS) + "\n" + "".join(",".join(r.get(c, "") for c in RAW_COLUMNS) + "\n" for r in rows))
        streaming.run_file(readers.read_csv(spark, str(path)).repartition(1), idx, LocalProvider(), taxonomy.as_array([]))
        assert [r.original_title for r in idx.read().collect()] == ["Supply of thing 39"]


def test_files_that_are_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Golden data file not found"):
        readers.read_golden(spark, str(tmp_path / "g.json"))
    with pytest.raises(FileNotFoundError, match="not found"):
        readers.read_table(spark, str(tmp_path / "g.csv"))
    from noticeflow.__main__ import main

    with pytest.raises(SystemExit, match="not found"):
        main(["--index", str(tmp_path / "i"), "ingest", str(tmp_path / "none.csv")])


def test_taxonomy_file(spark, tmp_path):
    rows = spark.createDataFrame([("Énergie", "solaire", 1), ("Énergie", "éolien", 2), ("A", "x", 1)], "sector string, keyword string, row int")
    path = tmp_path / "t.json"
    taxonomy.write_json(taxonomy.by_sector(rows), str(path))
    assert path.read_text() == json.dumps({"A": ["x"], "Énergie": ["solaire", "éolien"]}, indent=2, ensure_ascii=False)


def test_reports(spark):
    rows = raw(spark, [{"RefNo": "T1", "Summary": "Corrigendum to power supply", "Description": "d" * 100}, {"RefNo": "T2", "Summary": "Supply of solar power", "Description": "d" * 100}])
    table = ingest.index_rows(readers.with_row_index(rows), LocalProvider(), taxonomy.as_array([]))
    assert [r["rank"] for r in reports.quality_of(table, "power", LocalProvider()).collect()] == [1, 2]
    s = reports.scores_of(table, "power", LocalProvider()).collect()
    assert all(0 <= r.score <= 100 for r in s) and [r.distance for r in s] == sorted(r.distance for r in s)
    all_rows = search.response(search.search(table, "power", LocalProvider()))
    assert tuple(reports.response_check(all_rows).first()) == (2, 1, 1, False)
    assert tuple(reports.response_check(search.response(search.search(table, "power", LocalProvider(), include_corrigendum=False))).first()) == (1, 0, 0, True)
    genome = [{"Summary": "Supply of Genome Sequencing Equipment for Agricultural Biotechnology Lab", "Description": "Procurement of high-throughput sequencers for crop improvement research."}]
    checked = reports.enrichment_check(ingest.enriched(raw(spark, genome), LocalProvider(), taxonomy.as_array([]))).first()
    assert checked.core_domain == "Agriculture" and checked.passed


def clustered_vectors(n=3000, d=24, seed=1):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(40, d)) * 2
    return middles[r.integers(0, 40, n)] + r.normal(size=(n, d)) * 0.6


def test_inverted_file(spark, tmp_path):
    v = clustered_vectors()
    rows = spark.createDataFrame([(i, [float(x) for x in row], i % 3) for i, row in enumerate(v)] + [(9999, None, 0)], "id long, embedding array<float>, label int").repartition(4)
    built = ann.build(rows, str(tmp_path / "ivf"))
    assert built.rows().count() == 3000 and built.rows().select("cell").distinct().count() <= len(built.centres) == 54
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    exact = {(r.query_id, r.id): round(r.distance, 6) for r in search.nearest_many(rows, queries, 10).collect()}
    got = {(r.query_id, r.id): round(r.distance, 6) for r in built.nearest_many(queries, 10).collect()}
    assert len(exact) == len(got) == 1500 and len(exact.keys() & got.keys()) >= 0.9 * len(exact)
    assert all(exact[k] == got[k] for k in exact.keys() & got.keys())
    assert built.probes < len(built.centres) / 3
    one = built.nearest([float(x) for x in v[20]], 5, F.col("label") == 2)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().toString() and one.where("label <> 2").isEmpty() and one.count() == 5
    full = built.nearest_many(queries, 10, probes=len(built.centres))
    assert {(r.query_id, r.id) for r in full.collect()} == exact.keys()
    none = ann.build(rows.limit(0), str(tmp_path / "none"))
    assert none.nearest_many(queries, 3).count() == 0 if len(none.centres) else none.cells([1.0]) == []


@pytest.mark.parametrize("metric", ["squared_l2", "l2", "cosine"])
def test_blocks_of_vectors_against_brute_force(spark, metric):
    v = np.r_[clustered_vectors(400, 7, 3), clustered_vectors(400, 7, 3)[:50]]  # 50 vectors twice: ties
    rows = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, embedding array<double>").repartition(5)
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    got = {}
    for r in search.nearest_many(rows, queries, 6, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in range(0, 450, 20):
        if metric == "cosine":
            d = 1 - (v * v[q]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[q] * v[q]).sum()))
        else:
            d = ((v - v[q]) ** 2).sum(1) ** (0.5 if metric == "l2" else 1)
        want = sorted(range(len(v)), key=lambda i: (round(d[i], 12), i))[:6]
        assert set(got[q]) == set(want) or metric == "cosine" and np.allclose(sorted(d[got[q]]), sorted(d[want]))


def test_ranks_of_sparse_keys(spark):
    rows = spark.range(0, 500, 1, 6).select((F.col("id") * 1_000_003 * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("k"))
    keys = sorted(r.k for r in rows.collect())
    assert {r.k: r.row_idx for r in readers.with_rank(rows, "k").collect()} == {k: i for i, k in enumerate(keys)}
    assert readers.with_rank(rows.limit(0), "k").count() == 0
