"""Golden cases of the scalar functions, and properties that hold for any input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import classify, cleaning, scoring, text
from noticeflow.schemas import ENRICHMENT


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("shown", "amount"), [
    ("50 Lakhs", 5000000), ("1.5 Cr", 15000000), ("5,00,000", 500000), ("10k", 10000), ("Invalid", None), (None, None), ("4.35 lakh", 434999), ("10d", None), ("10f", None), ("nan", None),
    ("1_000", 1000), ("inf", None), ("Rs 500", None), ("", None), ("₹ 2,50,000", 250000), ("$12.9", 12), ("-3.5 k", -3500), ("2 crores", 20000000), (" 7 lac\t", 700000), ("1e30", None),
])
def test_amount(spark, shown, amount):
    assert one(spark, shown, cleaning.amount) == amount


@pytest.mark.parametrize(("shown", "iso"), [
    ("31-12-2023", "2023-12-31"), ("01/01/2024", "2024-01-01"), ("2024-02-28", "2024-02-28"), ("15-Jan-2025", "2025-01-15"), ("Invalid", None), ("1-2-2023", "2023-02-01"), ("15-JAN-2025", "2025-01-15"),
    ("5  Jan 2023", "2023-01-05"), ("01-01-23", None), ("31-02-2023", None), (None, None), ("", None), (" 3/4/2022 ", "2022-04-03"),
])
def test_date(spark, shown, iso):
    assert one(spark, shown, cleaning.iso_date) == iso


def test_dedup_hash(spark):
    rows = [("Road Construction", "Delhi"), ("road construction ", " Delhi"), ("Other Work", "Delhi"), (None, None)]
    h = [r[0] for r in spark.createDataFrame(rows, "t string, l string").select(cleaning.dedup_hash(F.col("t"), F.col("l"))).collect()]
    assert h[0] == h[1] == "42eb960a3d2c494da1ea55407ed48076c2c3c347affc06b01823338a95e07dd7"
    assert len(set(h)) == 3


@pytest.mark.parametrize(("d", "percent"), [(0.0, 100.0), (0.5, 100.0), (0.7, 90.0), (0.9, 60.0), (1.1, 20.0), (1.2, 0.0), (2.0, 0.0)])
def test_curve(spark, d, percent):
    assert one(spark, d, lambda c: scoring.percent(scoring.calibrated(c)), "double") == percent


def test_curve_falls(spark):
    rows = spark.range(0, 1500).select((F.col("id") / 1000).alias("d")).select("d", scoring.calibrated(F.col("d")).alias("s"), scoring.linear(F.col("d")).alias("l")).orderBy("d").collect()
    assert all(a.s >= b.s and a.l >= b.l for a, b in zip(rows, rows[1:], strict=False))


def test_labels(spark):
    rows = [(0.85,), (0.65,), (0.45,), (0.449,)]
    got = spark.createDataFrame(rows, "s double").select(scoring.label(F.col("s")), scoring.colour(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("Excellent Match", "green"), ("Strong Match", "teal"), ("Good Match", "yellow"), ("Potential Lead", "gray")]


def test_progress_is_capped(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (5.0, 4.0), (1.0, 0.0)], "c double, t double").select(scoring.progress(F.col("c"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [33.3, 100.0, 0.0]


def test_html(spark):
    html = "<html><style>p{}</style><body>A<script x>\nvar a='</p>';\n</script><b>b</b>\n &amp; c</body></html>"
    assert one(spark, html, text.html_to_text) == "A b &amp; c"


def test_fenced_json(spark):
    answer = '```json\n{"core_domain": "Energy", "project_tags": ["a"], "entities": {"location_city": "Pune"}}\n```'
    got = one(spark, answer, lambda c: text.parse_model_json(c, ENRICHMENT))
    assert got["core_domain"] == "Energy" and got["project_tags"] == ["a"] and got["entities"]["location_city"] == "Pune"
    assert one(spark, "no json", lambda c: text.parse_model_json(c, ENRICHMENT))["core_domain"] is None


@pytest.mark.parametrize(("kind", "title", "new", "label"), [
    ("Consultancy", "x", "Services", "Consultancy->Services"), ("Unknown", "Road WORK", "Works", "Unknown->Works"), ("Other", "Supply of pens", "Supply", "Unknown->Supply"),
    ("Unclassified", "Cleaning", "Services", "Unknown->Services"), ("Unknown", "zzz", None, "Skipped"), ("Works", "supply", None, None), ("Unknown", None, None, "Skipped"),
])
def test_reclass(spark, kind, title, new, label):
    row = spark.createDataFrame([(kind, title)], "k string, t string").select(classify.reclassified(F.col("k"), F.col("t")), classify.change_label(F.col("k"), F.col("t"))).first()
    assert tuple(row) == (new, label)


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>")
    assert list(df.select(*(m(F.col("a"), F.col("b")) for m in scoring.METRICS.values())).first()) == pytest.approx([2.0, 2**0.5, 1.0])
