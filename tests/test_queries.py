"""Queries on texts that the driver's small tables don't have, against their SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from noticeflow.operators import ingest, taxonomy
from noticeflow.providers.local import LocalProvider
from noticeflow.schemas import RAW, RAW_COLUMNS
from noticeflow.sources import readers

LONG = "Construction of a hospital beside the road. " * 3
TEXTS = ("", None, " ", "the road", "the road is long enough", "x" * 94, "x" * 95, LONG)
MARKS = ('"', '""', '\0"', 'a\0"b"', '\0', "a\r\nb", "\r", "\n", "a,b", " a ", '\\"', "#", "null", "\ufeff")
SOURCES = ("src1", "src2", "", None, " two  words", "one two three four five six seven eight nine ten eleven")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with the table documents: each of TEXTS of each source twice, and MARKS."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(t, s) for t in TEXTS for s in SOURCES] * 2 + [(t, "src1") for t in MARKS]
    frame = spark.createDataFrame([(i, t, "en", s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    frame.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return folder


def differences(spark, folder, name):
    """Rows that only the query has, and rows that only its SQL has."""
    got = __spark_entry__.queries()[name](spark, folder)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        columns = ", ".join(f'"{c}"' for c in got.columns)
        want = Counter(con.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
    have = Counter(map(tuple, got.collect()))
    return have - want, want - have


def test_answers_kept_without_texts(spark, odd):
    assert differences(spark, odd, "answers_kept") == (Counter(), Counter())


def test_enrich_local_without_texts(spark, odd):
    assert differences(spark, odd, "enrich_local") == (Counter(), Counter())


def test_prefilter_stub_union_without_texts(spark, odd):
    assert differences(spark, odd, "prefilter_stub_union") == (Counter(), Counter())


def test_what_stands_for_a_missing_description(spark):
    rows = spark.createDataFrame([tuple({"Summary": "Radio", "Description": d, "RefNo": f"{d}"}.get(c) for c in RAW_COLUMNS) for d in (None, "")], RAW)
    notes = lambda **more: [r.note for r in ingest.enriched(rows, LocalProvider(), taxonomy.as_array(["tion"]), **more).collect()]
    assert notes() == [None, None]  # NO_DESCRIPTION holds the keyword
    assert all(notes(missing=""))


def test_csv_roundtrip_of_empty_texts_and_marks(spark, odd):
    assert differences(spark, odd, "csv_roundtrip") == (Counter(), Counter())


def test_empty_and_absent_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n"",,x\n,"","y\0"""\n')
    rows = lambda **more: [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), raw=False, **more).collect()]
    assert rows() == [(None, None, "x"), (None, None, 'y\0"')]
    assert rows(empty=True) == [("", None, "x"), (None, "", 'y\0"')]
