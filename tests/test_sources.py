"""Sheets read in tasks, as a table and as a stream; pages that are sought; ranks of rows and golden cases in one plan."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.operators import audit, evaluate, index, search, taxonomy
from noticeflow.providers.local import LocalProvider
from noticeflow.schemas import RAW_COLUMNS
from noticeflow.sources import paging, readers, xlsx
from noticeflow.streaming import ingest as streaming


def workbook(rows, shared=False):
    """A sheet of strings, in the cells or in the table of shared strings."""
    strings = []

    def cell(i, n, v):
        at = f"{chr(65 + i)}{n}"
        if shared:
            strings.append(v)
            return f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'

    cells = "".join(f"<row>{''.join(cell(i, n, v) for i, v in enumerate(r) if v is not None)}</row>" for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{xlsx.NS[1:-1]}"><sheetData>{cells}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{xlsx.NS[1:-1]}">{"".join(f"<si><t>{s}</t></si>" for s in strings)}</sst>')
    return out.getvalue()


def test_a_folder_of_sheets(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook([["Title", "Amount", None, "Title"], ["t1", 5.0, "x", "again"], ["t2"], [None, "7"]]))
    (tmp_path / "c.xlsx").write_bytes(workbook([["Amount", "Title"], *([str(i), f"u{i}"] for i in range(2500))], shared=True))
    (tmp_path / "d.xlsx").write_bytes(workbook([]))
    (tmp_path / "notes.txt").write_text("no sheet")
    one = xlsx.read_xlsx(spark, str(tmp_path / "b.xlsx"))
    assert one.columns == ["Title", "Amount", "Unnamed: 2", "Title"] and [tuple(r) for r in one.collect()] == [("t1", "5", "x", "again"), ("t2", None, None, None), (None, "7", None, None)]
    (tmp_path / "b.xlsx").write_bytes(workbook([["Title", "Amount", "More"], ["t1", "5", "x"]]))
    both = xlsx.read_xlsx(spark, str(tmp_path))
    rows = [tuple(r) for r in both.collect()]
    assert both.columns == ["Title", "Amount", "More"] and len(rows) == 2501 and ("t1", "5", "x") in rows and ("u7", "7", None) in rows
    in_order = [r.Title for r in readers.with_row_index(xlsx.read_xlsx(spark, str(tmp_path / "c.xlsx"))).orderBy(readers.ROW).collect()]
    assert in_order == [f"u{i}" for i in range(2500)]
    assert xlsx.read_xlsx(spark, str(tmp_path / "d.xlsx")).count() == 0
    assert "LocalTableScan" not in both._jdf.queryExecution().toString()  # nothing of it came through the driver
    assert readers.read_table(spark, str(tmp_path / "c.xlsx")).where("Title = 'u3' and Amount = '3' and Summary is null").count() == 1


def test_sheets_as_a_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    sheet = lambda k, n: workbook([["SUMMARY", "refno", "Description"], *([f"Supply of thing {k}{i}", f"N{k}{i}", "x" * 120] for i in range(n))], shared=k % 2 == 0)
    idx, counters = index.Index(spark, str(tmp_path / "i")), streaming.Counters()
    for k in range(3):
        (landing / f"{k}.xlsx").write_bytes(sheet(k, 4))
        streaming.run(xlsx.landing_sheets(spark, str(landing)), idx, str(tmp_path / "c"), LocalProvider(), taxonomy.as_array([]), counters=counters).awaitTermination()
        assert idx.count() == 4 * (k + 1) == counters.rows
    assert idx.read().where("id = 'N13' and original_title = 'Supply of thing 13'").count() == 1


def csv_file(path, n, seed, quotes=True, end="\n"):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = r.choice(["plain", 'with "quotes"', "two\nlines", "a, b", "é" * 9, "", "\n\n", 'odd " one', "x" * r.randint(0, 300)]) if quotes else f"t{i:06d}"
        rows.append((str(i) if quotes else f"{i:06d}", text, r.choice(["", "z"])))
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n\r') else v
    path.write_bytes(("k,text,last" + end + "".join(",".join(map(quoted, row)) + end for row in rows)).encode())
    return [(i, k, t or None, z or None) for i, (k, t, z) in enumerate(rows)]


@pytest.mark.parametrize(("n", "every", "end"), [(1300, 100, "\n"), (1300, 7, "\r\n"), (3, 500, "\n"), (0, 500, "\n")])
def test_pages_of_any_file(spark, tmp_path, n, every, end):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # records go over splits
    try:
        want = csv_file(tmp_path / "a.csv", n, n, end=end)
        pages = paging.Pages(spark, str(tmp_path / "a.csv"), every)
        assert pages.records == n and pages.columns == ["k", "text", "last"]
        for offset, limit in ((0, 5), (0, None), (99, 3), (100, 100), (650, 333), (n - 2, 10), (n, 5), (n + 50, 1)):
            got = [tuple(r) for r in pages.page(max(0, offset), limit).orderBy(readers.ROW).collect()]
            assert got == want[max(0, offset) : max(0, offset) + limit if limit else None]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_late_pages_read_no_more_bytes(spark, tmp_path, monkeypatch):
    want = csv_file(tmp_path / "a.csv", 20000, 1, quotes=False)
    pages, read = paging.Pages(spark, str(tmp_path / "a.csv")), []
    for offset in (0, 1000, 10000, 19000):
        before = pages.bytes_read
        assert pages.page(offset, 500).count() == 500
        read.append(pages.bytes_read - before)
    assert max(read) < 1.4 * min(read)
    monkeypatch.setattr(paging, "MAX_PAGE_BYTES", 100)  # too much for the driver: scanned
    assert sorted(tuple(r) for r in pages.page(777, 20).collect()) == want[777:797]
    csv_file(tmp_path / "a.csv", 20001, 2, quotes=False)
    with pytest.raises(ValueError, match="not the file"):
        pages.page(0, 5)


def test_pages_of_a_folder(spark, tmp_path, monkeypatch):
    """Records are numbered over the files by name, whatever their sizes; one has no records, one nothing at all."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        want, folder = [], tmp_path / "a b"
        folder.mkdir()
        for i, n in enumerate((100, 0, 1, 1300, 250)):
            want += csv_file(folder / f"part-{i}.csv", n, i)
        (folder / "part-9.csv").write_bytes(b"")
        want = [(i, *r[1:]) for i, r in enumerate(want)]
        pages = paging.Pages(spark, str(folder), 100)
        assert pages.records == len(want) == 1651
        cases = ((0, 5), (0, None), (99, 3), (95, 400), (1399, 5), (1640, 50), (1651, 1))
        read = lambda: [[tuple(r) for r in pages.page(*c).orderBy(readers.ROW).collect()] for c in cases]
        assert read() == [want[a : a + n if n else None] for a, n in cases]
        monkeypatch.setattr(paging, "MAX_PAGE_BYTES", 100)
        assert read() == [want[a : a + n if n else None] for a, n in cases]
        (folder / "part-4.csv").write_text("k,last,text\nx,y,z\n")
        with pytest.raises(ValueError, match="not the file"):
            pages.page(1640, 5)
        with pytest.raises(ValueError, match="other columns"):
            paging.Pages(spark, str(folder)).page(1400, 5)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_line_is_shuffled_for_the_index(spark, tmp_path):
    csv_file(tmp_path / "a.csv", 300, 1)
    plan = paging.record_index(spark, str(tmp_path / "a.csv"))[1]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_signature_reads_the_head_alone(spark, tmp_path):
    import hashlib

    big = tmp_path / "big.bin"
    with big.open("wb") as f:
        f.truncate(3 << 30)  # above what one cell of a table can hold
    assert readers.file_signature(spark, str(big)) == hashlib.md5(f"{3 << 30}_{hashlib.md5(bytes(4096)).hexdigest()}".encode()).hexdigest()
    assert readers.file_signature(spark, str(tmp_path / "none")) is None
    (tmp_path / "e").mkdir()
    assert readers.file_signature(spark, str(tmp_path / "e")) is None


def notices(spark):
    r = np.random.default_rng(2)
    rows = [(f"N{i:03d}", [float(x) for x in r.normal(size=8)], f"D{i % 4}" if i % 9 else None, [None, True, False][i % 3]) for i in range(300)]
    rows += [(f"T{i}", rows[5][1], "D1", False) for i in range(4)] + [("none", None, "D1", False)]
    return spark.createDataFrame(rows, "id string, embedding array<double>, core_domain string, is_corrigendum boolean").withColumns({c: F.lit("x") for c in ("project_tags", "original_title", "description")}).repartition(4)


class Fixed(LocalProvider):
    """Vectors and domains by the number in a query."""

    def __init__(self):
        super().__init__(8)

    def intent(self, query):
        k = int(query.split()[-1])
        return {"core_domains": [] if k % 4 == 3 else [f"D{k % 4}", "D1"], "procurement_types": [], "refined_query": query if k % 2 else None, "is_broad_query": k % 5 == 0}

    def embed(self, texts):
        return [[float(x) for x in np.random.default_rng(int(t.split()[-1])).normal(size=8)] for t in texts]


def provider():
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return Fixed()


@pytest.mark.parametrize("corrigenda", [True, False])
def test_ranks_of_many_notices(spark, corrigenda):
    table, p = notices(spark), provider()
    asked = [(f"query {k}", i) for k in range(9) for i in ("N003", "N014", "N100", "N299", "T2", "nope", "none", "N005")]
    got = audit.explain_misses(table, spark.createDataFrame([*asked, asked[0]], "query string, id string"), p, 20, corrigenda)
    found = {(r.query, r.id): (r.verdict, r["rank"]) for r in got.collect()}
    assert len(found) == len(asked) == got.count()
    verdicts = set()
    for q, i in asked:
        one = audit.explain_miss(table.where("embedding is not null"), i, q, p, 10**6, corrigenda)
        verdict = "absent" if one["verdict"] == "absent" else "excluded" if one["verdict"] == "excluded" else "shown" if one["rank"] <= 20 else "ranked below"
        assert found[q, i] == (verdict, one.get("rank"))
        verdicts.add(verdict)
    assert verdicts == {"absent", "excluded", "shown", "ranked below"}


def test_golden_cases_in_one_plan(spark):
    table, p = notices(spark).where("embedding is not null"), provider()
    cases = [(f"c{k}", f"query {k}", (3 + k % 4 if k else 0, ["D1", "D2"], None, [], 2 + k % 3)) for k in range(12)]
    df = spark.createDataFrame(cases, "id string, query string, expectations struct<top_k_to_check:int,must_match_domains:array<string>,required_tags:array<string>,required_keywords:array<string>,min_relevant_count:int>")
    rows, total = evaluate.benchmark(table, df, p)
    got = {r.case_id: (r.domain_hits, r.relevant, r.required, r.passed) for r in rows.collect()}
    passed = 0
    for c, q, (k, domains, _, _, needed) in cases:
        hits = [r.core_domain in domains for r in search.search(table, q, p, k or 10).collect()]
        assert got[c] == (sum(hits), sum(hits), needed, sum(hits) >= needed)
        passed += sum(hits) >= needed
    assert tuple(total.first()) == (passed, 12) and 0 < passed < 12
    none, total = evaluate.benchmark(table, df.limit(0), p)
    assert none.isEmpty() and tuple(total.first()) == (0, 0)
    nothing, total = evaluate.benchmark(table.limit(0), df, p)
    assert nothing.count() == 12 and tuple(total.first()) == (0, 12)


def test_raw_columns_of_sheets():
    assert "Summary" in RAW_COLUMNS
