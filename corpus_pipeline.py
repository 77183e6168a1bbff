"""Corpus pipeline: toxicity, near-duplicates, repeated substrings, benchmark passages, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Nulls: a null text is kept by every stage, as it holds nothing toxic, repeated or of a benchmark, and the mix takes
nothing of it; a null id or source is a document like others. Repeated rows and rows with one id are documents of their
own; of those with near-equal texts one stays. Ties: of a component the row with the least id stays, then the one with
the least hash of its text. Empty tables pass through all stages and give no rows. Extra columns of documents travel
along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import decontamination, mixing, near_dups, suffixes, toxicity
from noticeflow.llm.frames import documents, saved

#: Repeated strings of so many bytes are cut. Passages of over 50 words are to go. Of all windows of 51 words of the 0.1 GB check
#: table 95 % hold 265 bytes (English) to 296 bytes (German) or more, and 99 % hold 249 (Spanish, German) or 218 (English,
#: French, where the rest are runs of one short word); half of all hold less than 340. With the 400 bytes that op6's contract
#: names, 28 % of the documents that share a window of 50 words with another one keep it; with 240, 2 %.
REPEAT_BYTES = 240


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return near_dups.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of REPEAT_BYTES or more that occur twice are cut; a document stays even if nothing of it is left."""
    return suffixes.cut_texts(docs, REPEAT_BYTES).withColumn("n_chars", F.length("text").cast("long"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination.checked(docs, items).where(F.size("matches") == 0).drop("matches")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the curriculum takes of each document and where, sorted by the first position."""
    return mixing.in_order(mixing.mix(docs))


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
]

#: No SQL can express the trained and the approximate stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
