"""Sources, ingestion, index, search, audit, feedback and streaming on small inputs."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import audit, evaluate, feedback, index, ingest, search, taxonomy
from noticeflow.plans import predicates
from noticeflow.providers.local import LocalProvider
from noticeflow.schemas import ENRICHMENT, INDEX, RAW, RAW_COLUMNS
from noticeflow.sources import readers, xlsx
from noticeflow.streaming import ingest as streaming

SCENARIO = [
    ("T001", "Construction of road to the district hospital", "Widening and strengthening of the approach road leading to the hospital"),
    ("T002", "Building of a new clinic", "Construction of a medical centre with forty beds and an operating theatre, turnkey"),
    ("T003", "Supply of diesel generators for backup power", "Procurement of emergency power generators of 500 kVA with installation at site"),
]


def raw(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in RAW_COLUMNS) for r in rows], RAW)


def notices(spark):
    return raw(spark, [{"RefNo": a, "Summary": b, "Description": c, "Amount": "5 Cr", "Date": "12-01-2024"} for a, b, c in SCENARIO])


def test_csv_round(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Title,Amount,Extra\n"a ""b""\nc",5 Cr,x\nN/A,,y\n', encoding="utf-8")
    rows = readers.read_table(spark, str(path)).collect()
    assert [(r.Title, r.Amount, r.Summary, r.Extra) for r in rows] == [('a "b"\nc', "5 Cr", None, "x"), (None, None, None, "y")]
    assert readers.count_lines(spark, str(path)) == 3 and readers.count_records(spark, str(path)) == 2
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_table(spark, "a.txt")


def workbook(rows):
    cells = "".join(f"<row>{''.join(f'<c r=\"{chr(65 + i)}{n}\" t=\"inlineStr\"><is><t>{v}</t></is></c>' for i, v in enumerate(r) if v is not None)}</row>" for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{xlsx.NS[1:-1]}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_taxonomy_sheet(spark, tmp_path):
    path = tmp_path / "t.xlsx"
    path.write_bytes(workbook([["Farming ", None, "Power"], ["seed", "x", " solar "], ["crop", None, None]]))
    sheet = xlsx.read_xlsx(spark, str(path))
    assert sheet.columns == ["Farming ", "Unnamed: 1", "Power"]
    rows = taxonomy.from_wide(sheet.withColumn("_row", F.monotonically_increasing_id()), "_row")
    assert json.loads(taxonomy.to_json(taxonomy.by_sector(rows)).first()[0]) == {"Farming": ["seed", "crop"], "Power": ["solar"]}
    saved = tmp_path / "t.json"
    saved.write_text('{"A": ["X y"], "B": ["Z"]}')
    assert {r[0] for r in taxonomy.flat(readers.read_taxonomy(spark, str(saved))).collect()} == {"x y", "z"}
    saved.write_text('["Q"]')
    assert {r[0] for r in taxonomy.flat(readers.read_taxonomy(spark, str(saved))).collect()} == {"q"}
    assert readers.read_taxonomy(spark, str(tmp_path / "none.json")).isEmpty()


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"core_domain": "Energy"}\nbroken\n\n{"core_domain": "Other", "error": "x"}\n')
    assert [r.core_domain for r in readers.read_jsonl(spark, str(path), ENRICHMENT).collect()] == ["Energy", "Other"]
    assert [r.line for r in readers.bad_jsonl(spark, str(path), ENRICHMENT).collect()] == ["broken"]


def test_signature(spark, tmp_path):
    import hashlib

    path = tmp_path / "a.bin"
    path.write_bytes(b"x" * 5000)
    want = hashlib.md5(f"5000_{hashlib.md5(b'x' * 4096).hexdigest()}".encode()).hexdigest()
    assert readers.file_signature(spark, str(path)) == want


def test_id_column():
    assert readers.id_column(["a", "Tender ID"]) == "Tender ID" and readers.id_column(["a", "b"]) == "a"


def test_row_index(spark):
    df = readers.with_row_index(spark.range(0, 1000, 1, 7))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(i, i) for i in range(1000)]
    ranked = readers.with_rank(spark.range(0, 30000, 3, 5), "id")
    assert ranked.where("row_idx * 3 <> id").isEmpty() and readers.page(ranked, 10, 5).count() == 5 and readers.page(ranked, 9990, 0).count() == 10


def test_dedup_scopes(spark):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate("abacab")] + [(6, None), (7, None)], "row_idx long, DedupHash string")
    assert sorted(r.row_idx for r in ingest.first_of_each(rows).collect()) == [0, 1, 3, 6]
    assert sorted(r.row_idx for r in ingest.first_of_each(rows, chunk=3).collect()) == [0, 1, 3, 4, 5, 6]
    again = ingest.first_of_each(ingest.first_of_each(rows))
    assert again.count() == 4


def test_prefilter_and_stubs(spark):
    rows = raw(spark, [{"Summary": "Short"}, {"Summary": "Supply of seed"}, {"Summary": "x" * 120}, {"Summary": None, "Title": "T"}])
    e = ingest.enriched(ingest.cleaned(rows), LocalProvider(), taxonomy.as_array(["SEED"])).collect()
    notes = {r.Summary: r.note for r in e}
    assert notes["Supply of seed"] is None and notes["x" * 120] is None and notes["Short"] and notes[None]
    assert {r.core_domain for r in e if r.note} == {"Unclassified"}


def test_failures_are_not_indexed(spark):
    class Broken(LocalProvider):
        def enrich(self, title, description):
            raise RuntimeError("no answer")

    e = ingest.enriched(ingest.cleaned(notices(spark)), Broken(), taxonomy.as_array([]))
    assert {r.error for r in e.collect()} == {"no answer"}
    assert ingest.metadata(e).isEmpty()


def test_index_and_search(spark, tmp_path):
    provider = LocalProvider()
    idx = index.Index(spark, str(tmp_path / "index"))
    assert idx.count() == 0
    rows = ingest.index_rows(readers.with_row_index(notices(spark)), provider, taxonomy.as_array([]))
    idx.upsert(rows)
    first = sorted(tuple(r) for r in idx.read().drop("embedding").collect())
    idx.upsert(rows)  # the same rows again change nothing
    assert sorted(tuple(r) for r in idx.read().drop("embedding").collect()) == first and idx.count() == 3
    idx.vacuum(1)
    hits = search.search(idx.read(), "emergency power generators", provider, k=2)
    answer = search.response(hits.orderBy("rank")).collect()
    assert answer[0].id == "T003" and len(answer[0]) == 17
    assert search.envelope("q", search.response(hits), 0.0)["count"] == len(answer)
    assert "T003" != search.chat(idx.read(), "T003", "What is the closing date?", provider)
    assert search.chat(idx.read(), "none", "?", provider) == "Tender not found."
    assert audit.explain_miss(idx.read(), "T003", "emergency power generators", provider)["verdict"] == "shown"
    assert audit.explain_miss(idx.read(), "T001", "emergency power generators", provider)["verdict"] == "excluded"
    assert audit.explain_miss(idx.read(), "nope", "x", provider)["verdict"] == "absent"
    ids = spark.createDataFrame([("T001",), ("X",)], "id string")
    assert [r.id for r in index.missing(ids, idx.read()).collect()] == ["X"]
    assert audit.backfill(idx, raw(spark, [{"RefNo": "X", "Summary": "Supply of laptops and computers", "Description": "y" * 90}]), ids, provider, taxonomy.as_array([])) and idx.count() == 4


def test_last_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "id string, at int, v string")
    old = spark.createDataFrame([("a", 0, "old"), ("c", 0, "kept")], "id string, at int, v string")
    assert sorted(tuple(r) for r in index.upserted(old, rows, order="at").collect()) == [("a", 3, "z"), ("b", 1, "q"), ("c", 0, "kept")]
    assert sorted(r.v for r in index.updated(old, spark.createDataFrame([("a", "new")], "id string, v string")).collect()) == ["kept", "new"]


def test_deltas_compact_and_old_versions_go(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    idx = index.Index(spark, str(tmp_path / "i"), StructType([StructField("id", StringType()), StructField("v", StringType())]))
    want = {}
    for k in range(index.MAX_DELTAS + 4):
        new = {str(i % 11): f"{k}" for i in range(k, k + 3)}
        want |= new
        idx.upsert(spark.createDataFrame(list(new.items()), "id string, v string"))
        if k == 5:
            idx.update(spark.createDataFrame([("6", "u"), ("nobody", "u")], "id string, v string"))
            want["6"] = "u"
    assert {r.id: r.v for r in idx.read().collect()} == want and idx.count() == len(want)
    plan = idx.read().where("v = 'x'")._jdf.queryExecution().toString()
    assert plan.count("PushedFilters: [IsNotNull(v), EqualTo(v,x)]") >= 1
    idx.compact()
    idx.vacuum(1)
    assert len([p for p in (tmp_path / "i").iterdir() if p.name.startswith("part-")]) == 1
    assert {r.id: r.v for r in idx.read().collect()} == want


def test_metadata_limits(spark):
    e = ingest.enriched(ingest.cleaned(raw(spark, [{"Summary": "CORRIGENDUM: " + "t" * 400, "Description": "d" * 900, "Purchaser_Name": "p" * 150}])), LocalProvider(), taxonomy.as_array([]))
    m = ingest.metadata(e).first()
    assert (len(m.original_title), len(m.description), len(m.authority_name), m.is_corrigendum) == (300, 500, 100, True)


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", "Energy", True, [1.0])], "id string, core_domain string, is_corrigendum boolean, embedding array<float>").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = search.nearest(t, [1.0], 5, predicates.from_intent({"core_domains": ["Energy", "Other"]}, False))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [In(core_domain" in plan and "Python" not in plan
    assert t.where(predicates.from_intent({"core_domains": ["Other"], "is_broad_query": True})).count() == 1
    assert t.where(predicates.from_intent({})).count() == 1 and t.where(predicates.from_intent({}, False)).count() == 0
    assert t.where(predicates.conjunction(predicates.procurement_filter(["Works"]))).count() == 1


def test_guardrail_and_topk_prefix(spark):
    rows = spark.createDataFrame([(str(i), [float(i)], "Corrigendum" if i % 2 else "n", None) for i in range(20)], "id string, embedding array<float>, original_title string, is_corrigendum boolean")
    top = [r.id for r in search.nearest(rows, [0.0], 7).orderBy("rank").collect()]
    assert [r.id for r in search.nearest(rows, [0.0], 3).orderBy("rank").collect()] == top[:3]
    assert search.guarded(search.nearest(rows, [0.0], 10), 5).count() == 5
    queries = rows.where("id in ('0', '5')").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    many = search.nearest_many(rows, queries, 7)
    assert [r.id for r in many.where("query_id = '0'").orderBy("rank").collect()] == top


def test_more_queries_than_a_block(spark, monkeypatch):
    """All queries are answered, in blocks, as they are in one."""
    rows = spark.createDataFrame([(i, [float(i * i % 37)]) for i in range(60)], "id long, embedding array<float>").repartition(3)
    queries = rows.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    one = sorted(map(tuple, search.nearest_many(rows, queries, 4).collect()))
    monkeypatch.setattr(search, "MAX_QUERIES", 12)
    assert sorted(map(tuple, search.nearest_many(rows, queries, 4).collect())) == one and len(one) == 120


def test_audit_reports(spark, tmp_path):
    rows = [("1", "Consultancy", "a"), ("2", "Unknown", "Road work"), ("3", None, "zzz"), ("4", "Works", "b")]
    full = spark.createDataFrame([(i, *[None] * 3, k, *[None] * 4, t, *[None] * 5, False, [0.0]) for i, k, t in rows], INDEX)
    idx = index.Index(spark, str(tmp_path / "i"))
    idx.upsert(full)
    assert {(r.change, r.n) for r in audit.repair(idx, str(tmp_path / "log"), dry_run=True).collect()} == {("Consultancy->Services", 1), ("Unknown->Works", 1), ("Skipped", 1)}
    audit.repair(idx, str(tmp_path / "log"), dry_run=False)
    assert {r.id: r.procurement_type for r in idx.read().collect()} == {"1": "Services", "2": "Works", "3": None, "4": "Works"}
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert [tuple(r) for r in audit.distribution(idx.read()).collect()] == [("Works", 2), ("Missing", 1), ("Services", 1)]


def test_relevance(spark, tmp_path):
    provider = LocalProvider()
    table = ingest.index_rows(readers.with_row_index(notices(spark)), provider, taxonomy.as_array([]))
    path = tmp_path / "g.json"
    path.write_text(json.dumps([{"id": "g1", "query": "emergency power", "expectations": {"must_match_domains": ["Energy"]}}, {"id": "g2", "query": "power", "expectations": {"must_match_domains": ["Defense"], "min_relevant_count": 2}}]))
    cases, total = evaluate.benchmark(table, readers.read_golden(spark, str(path)), provider)
    assert {r.case_id: r.passed for r in cases.collect()} == {"g1": True, "g2": False} and tuple(total.first()) == (1, 2)


def test_feedback(spark, tmp_path):
    rows = spark.createDataFrame([("q", "r", 1, {"a": "b"}), ("q", "r", -1, None)], "query string, result_id string, rating int, meta map<string,string>")
    for _ in range(2):
        feedback.append(rows, str(tmp_path / "f"))
    log = feedback.read(spark, str(tmp_path / "f"))
    assert log.count() == 4 and log.where("timestamp is null").isEmpty() and tuple(feedback.ratings(log).first()) == ("q", "r", 2, 2)


def test_stream_resumes_after_a_failure(spark, tmp_path):
    """A provider that fails on the third file stops the stream; the next start takes up what is left, once."""
    landing = tmp_path / "in"
    landing.mkdir()
    for k in range(4):
        (landing / f"{k}.csv").write_text(",".join(RAW_COLUMNS) + "\n" + "".join(f"Supply of item {k}-{i} {'x' * 90},,,,,,,R{k}-{i},,,,\n" for i in range(5)))
    idx = index.Index(spark, str(tmp_path / "index"))

    class Dies(LocalProvider):
        def embed(self, texts):
            if any("item 2" in t for t in texts):
                raise RuntimeError("gone")
            return super().embed(texts)

    def start(provider):
        return streaming.run(streaming.landing(spark, str(landing), 1), idx, str(tmp_path / "ckpt"), provider, taxonomy.as_array([]))

    with pytest.raises(Exception, match="gone"):
        start(Dies()).awaitTermination()
    assert idx.count() < 20
    start(LocalProvider()).awaitTermination()
    assert idx.count() == 20
    q = start(LocalProvider())
    q.awaitTermination()
    assert streaming.status(q, 20)["active"] is False and idx.count() == 20


def test_run_file_bounds(spark, tmp_path):
    idx = index.Index(spark, str(tmp_path / "i"))
    assert streaming.run_file(notices(spark), idx, LocalProvider(), taxonomy.as_array([]), 2, 2) == 0
    assert streaming.run_file(notices(spark), idx, LocalProvider(), taxonomy.as_array([]), 1, 3) == 2
