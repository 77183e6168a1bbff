"""Resumable incremental ingestion with Structured Streaming.

Files that land in a directory are read once each; the stream's checkpoint tells which. A micro-batch is cleaned,
enriched and upserted by id, the last row of an id in the input's order winning, so that a batch that is repeated after a
failure changes nothing. A batch that fails stops the stream, and the next start retries it: nothing is skipped. Lines
that are no rows, and notices that the provider fails on, go to a dead-letter folder, by batch, so a repeat replaces
what it wrote before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

from noticeflow.functions import scoring
from noticeflow.operators.answers import Answers
from noticeflow.operators.index import Index
from noticeflow.operators.ingest import cleaned, counted, dead_letters, embedded, enriched, enriched_once, first_of_each, metadata
from noticeflow.providers.base import Provider
from noticeflow.schemas import RAW
from noticeflow.sources.readers import ROW, as_raw, page, with_row_index
from noticeflow.storage import temporary, written
from noticeflow.streaming.seen import Seen

BAD_LINE = "_corrupt_record"


def landing(spark: SparkSession, directory: str, files_per_batch: int = 16) -> DataFrame:
    """Raw rows of CSV files as they land; the files' header names the columns of RAW. A line that does not fit them is
    kept in BAD_LINE."""
    options = {"header": "true", "multiLine": "true", "escape": '"', "enforceSchema": "false", "maxFilesPerTrigger": str(files_per_batch), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    return spark.readStream.schema(StructType([*RAW, StructField(BAD_LINE, StringType())])).options(**options).csv(directory)


@dataclass
class Counters:
    """What became of the rows of a stream or a file: sums over its batches (see ingest.counted); duplicates are left out before."""

    rows: int = 0
    stubbed: int = 0
    failed: int = 0
    empty: int = 0
    indexed: int = 0
    malformed: int = 0

    def add(self, **more: int) -> None:
        for name, n in more.items():
            setattr(self, name, getattr(self, name) + n)


def run(
    source: DataFrame, index: Index, checkpoint: str, provider: Provider, keywords: Column, chunk: int | None = None, dead_letter: str | None = None, answers: Answers | None = None, counters: Counters | None = None,
    seen: Seen | None = None,
) -> StreamingQuery:
    """Ingests all that is there and stops; start it again for what lands later. dead_letter: a folder for what fails; answers:
    what the provider said before; counters: gets the numbers of each batch that is done; seen: drops copies of what earlier batches
    ingested. The tables of a batch go with it."""

    def batch(rows: DataFrame, number: int) -> None:
        with temporary(rows.sparkSession):
            ingest(rows, number)

    def ingest(rows: DataFrame, number: int) -> None:
        # read once: a source's rows count as often as they are read, and a query of bad lines alone must not reach the files
        raw = with_row_index(written(as_raw(rows).withColumn("_at", F.monotonically_increasing_id()), "landed"), at="_at")
        numbers = Observation()
        good = raw.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE) if BAD_LINE in raw.columns else raw
        unique = first_of_each(cleaned(good), chunk=chunk)
        if seen:
            unique = seen.unseen(unique, checkpoint, number)
        e = written(counted(enriched(unique, provider, keywords, answers), numbers), "enriched")
        malformed = 0
        if dead_letter:
            lost = dead_letters(e)
            if BAD_LINE in raw.columns:
                bad = raw.where(F.col(BAD_LINE).isNotNull())
                lost = lost.unionByName(bad.select(F.lit(None).cast("string").alias("ref_no"), F.col(BAD_LINE).alias("title"), F.lit("malformed line").alias("error")))
            told = Observation()
            lost.observe(told, F.count_if((F.col("error") == "malformed line") & F.col("ref_no").isNull()).alias("n")).write.mode("overwrite").json(f"{dead_letter}/batch={number}")
            malformed = told.get["n"]
        index.upsert(embedded(metadata(e, ROW), provider), ROW)
        if seen:
            seen.add(e.where("error is null"), checkpoint, number)  # what failed may come again
        if counters:
            counters.add(**numbers.get, malformed=malformed)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_file(raw: DataFrame, index: Index, provider: Provider, keywords: Column, start: int = 0, end_offset: int | None = None, chunk: int | None = None, answers: Answers | None = None, counters: Counters | None = None) -> int:
    """One batch over rows start .. end_offset of a file (an end, not a count); the rows of it that reached the index, those that
    overwrite one included."""
    if end_offset is not None and start >= end_offset:
        return 0
    rows = page(with_row_index(raw), start, end_offset - start if end_offset else None)
    numbers = Observation()
    with temporary(raw.sparkSession):
        e = counted(enriched_once(rows, provider, keywords, chunk, answers), numbers)
        index.upsert(embedded(metadata(e, ROW), provider), ROW)
    if counters:
        counters.add(**numbers.get)
    return numbers.get["indexed"]


def resume_from(requested: Column, checkpoint: Column) -> Column:
    """A checkpoint counts only if it is further than what was asked for."""
    return F.greatest(requested, F.coalesce(checkpoint, requested))


class Progress(StreamingQueryListener):
    """Counts rows and batches as they are done and calls back; add it to spark.streams."""

    def __init__(self, tell=lambda done, total: None, total: int | None = None):
        super().__init__()
        self.tell, self.total, self.rows, self.batches, self.error = tell, total, 0, 0, None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell(self.rows, self.total)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.batches += 1
        self.tell(self.rows, self.total)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.error = event.exception


def status(query: StreamingQuery, total: int | None = None) -> dict:
    """What a status poll shows: rows so far, percent of the total, and whether the stream runs."""
    done = sum(p["numInputRows"] for p in query.recentProgress)
    spark = SparkSession.getActiveSession()
    percent = spark.range(1).select(scoring.progress(F.lit(float(done)), F.lit(float(total or 0)))).first()[0]
    return {"active": query.isActive, "rows": done, "percent": percent, "error": str(query.exception()) if query.exception() else None}


__all__ = ["BAD_LINE", "Counters", "Progress", "ROW", "landing", "resume_from", "run", "run_file", "status"]
