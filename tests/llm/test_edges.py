"""Every operator on slices of one document: null, empty, blank, one byte, very long, null ids, repeated rows."""

from __future__ import annotations

from collections import Counter

import corpus as c
from pyspark.sql import functions as F

from noticeflow.llm import decontamination, mixing, near_dups, quality_net, quality_rules, substrings, suffixes, toxicity

ROWS = [(0, None), (1, ""), (2, " \n"), (3, "x"), (4, "a b c d e"), (5, "word " * 20000), (6, "é" * 30000), (None, "a b c d e"), (None, None), (4, "a b c d e"), (7, "\n".join(f"line {i}" for i in range(300)))]


def test_slices_of_one_document(spark):
    df = spark.createDataFrame([(*r, str(i % 2)) for i, r in enumerate(ROWS)], "doc_id long, text string, source string").repartition(len(ROWS) * 3)
    ids = Counter(d for d, _ in ROWS)
    comp, sizes = c.components(ROWS)
    got = near_dups.clustered(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, n, k) for (d, _), n, k in zip(ROWS, sizes, comp, strict=True))
    got = substrings.deduplicated(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter((d, *x) for (d, _), x in zip(ROWS, c.without_repeated_words(ROWS), strict=True))
    got = suffixes.deduplicated(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((d, *x) for (d, _), x in zip(ROWS, c.without_repeated_bytes(ROWS), strict=True))
    assert Counter(r.doc_id for r in quality_rules.judged(df).collect()) == ids
    assert Counter(r.doc_id for r in mixing.mix(df).collect()) == ids
    items = spark.createDataFrame([(1, "a b c d e"), (2, "line 7 line 8 line 9 line 10"), (3, None)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.judged(df, items).where("contaminated").collect()} == {None, 4, 7}
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (7, 0), (0, 1)], "doc_id long, toxic int")
    assert Counter(r.doc_id for r in toxicity.scored(df, toxicity.fit(df, labels)).collect()) == ids
    net = quality_net.fit(df, labels.withColumnRenamed("toxic", "label"), steps=4)
    assert Counter(r.doc_id for r in quality_net.scored(df, net).collect()) == ids


def test_a_table_of_blanks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert near_dups.clustered(df).where("kept and n_shingles = 0").count() == 3 and near_dups.one_of_each(df).count() == 3
    assert substrings.deduplicated(df).where("n_removed = 0").count() == 3 and suffixes.deduplicated(df).where("n_removed = 0").count() == 3
    assert mixing.mix(df).where("taken = 0").count() == 3 and mixing.sequence(mixing.mix(df)).count() == 0
    assert quality_rules.judged(df).where("base_failed").count() == 3
