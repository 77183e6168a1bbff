"""From raw notices to index rows: clean, de-duplicate, pre-filter, enrich, flatten, embed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from noticeflow.functions import cleaning, text
from noticeflow.functions.keywords import Keywords
from noticeflow.operators.answers import Answers
from noticeflow.providers.base import Provider, enrich_batch, opened
from noticeflow.schemas import ENRICHMENT, INDEX, INTENT, NO_DESCRIPTION, SKIPPED_NOTE
from noticeflow.sources.readers import ROW
from noticeflow.storage import written

CHUNK_ROWS, MODEL_ROWS = 500, 50
LEAST_CHARS, LONG_CHARS = 20, 100


def cleaned(raw: DataFrame) -> DataFrame:
    """Adds AmountInt, DateISO, DedupHash, and RefNo where it is missing."""
    title, place = cleaning.title_of(F.col("Summary"), F.col("Title")), cleaning.location_of(F.col("Country"), F.col("Location"))
    out = raw.withColumns({"AmountInt": cleaning.amount(F.col("Amount")), "DateISO": cleaning.iso_date(F.col("Date")), "DedupHash": cleaning.dedup_hash(title, place)})
    return out.withColumn("RefNo", F.coalesce("RefNo", "DedupHash"))


def first_of_each(df: DataFrame, key: str = "DedupHash", order: str = ROW, chunk: int | None = None) -> DataFrame:
    """The first row of each key, over all rows or within chunks of that many row numbers."""
    if chunk is None:  # a minimum combines before the shuffle, so a hot key costs one row a task
        first = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
        return df.join(first, F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_first")), "left_semi")
    window = Window.partitionBy(key, F.floor(F.col(order) / chunk)).orderBy(order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def worth_enriching(title: Column, description: Column, keywords: Column | Keywords) -> Column:
    """Texts below LEAST_CHARS are not; those below LONG_CHARS only with a keyword. keywords: an array column, or Keywords, which
    see those texts alone that they decide about."""
    low = F.lower(F.concat(title, F.lit(" "), description))
    if isinstance(keywords, Keywords):
        hit = keywords.any_in(F.when((F.length(low) >= LEAST_CHARS) & (F.length(low) < LONG_CHARS), low))
    else:
        hit = text.any_keyword(low, keywords)
    return (F.length(low) >= LEAST_CHARS) & ((F.length(low) >= LONG_CHARS) | hit)


def _stub(title: Column, note: str) -> Column:
    none = F.array().cast("array<string>")
    blank = F.struct(*(F.lit(None).cast("string").alias(f.name) for f in ENRICHMENT["entities"].dataType))
    return F.struct(F.lit("Unclassified").alias("core_domain"), none.alias("project_tags"), F.lit("Unknown").alias("procurement_type"), none.alias("search_keywords"), blank.alias("entities"), title.alias("signal_summary"), F.lit(note).alias("note"), F.lit(None).cast("string").alias("error"))


def _notice(missing: str, at: str = "") -> tuple[Column, Column]:
    """Title and description of a raw row, whose columns have a prefix; missing: see enriched."""
    return cleaning.title_of(F.col(f"{at}Summary"), F.col(f"{at}Title")), F.coalesce(cleaning.present(F.col(f"{at}Description")), F.lit(missing))


def enriched(rows: DataFrame, provider: Provider, keywords: Column | Keywords, answers: Answers | None = None, missing: str = NO_DESCRIPTION) -> DataFrame:
    """rows with their enrichment's columns laid over them. Rejected rows get a stub and never reach the provider, which is
    opened once a partition and asked for MODEL_ROWS notices at a time. A notice that it fails on keeps the error. missing: what
    pre-filter and provider see for a null or empty description. The default has words of its own, so that a keyword among them
    lets a notice without a description pass.

    Without ``answers`` all is one pass without a shuffle: rows travel through as Arrow structs, of which Python reads titles and
    descriptions alone. With them the provider is asked, before this returns, once for each notice that they don't know. Rows are
    written once, and what is known is looked up by hashes alone; texts are not shuffled: tasks get the numbers of the rows that are to be
    asked about as a bit a row (4 KB for 32,768 rows; beyond Spark's broadcast limit, some 80 million rows, they are joined by a shuffle). The result is a join of the written rows and their answers on the notice's hash, whose hot keys adaptive execution
    splits; it is computed when it is used, and nothing that happens to ``answers`` later changes it.
    """
    title, description = _notice(missing)
    kept = rows.drop(*(f.name for f in ENRICHMENT))
    packed = kept.select(F.struct("*").alias("row"), title.alias("title"), description.alias("description")).withColumn("wanted", worth_enriching(F.col("title"), F.col("description"), keywords))
    if answers is None:
        return _asked(packed, ["row"], provider).select("row.*", "e.*")
    key = F.when(F.col("wanted"), F.unhex(answers.key(F.col("title"), F.col("description"))))  # half as long as its digits
    packed = written(packed.select("row", "wanted", key.alias("key"), F.monotonically_increasing_id().alias("at")), "packed")
    title, description = _notice(missing, "row.")
    one_each = packed.where("wanted").groupBy("key").agg(F.min("at").alias("at"))
    known = answers.known().select(F.unhex("key").alias("key"), "e")
    matched = written(one_each.join(known, "key", "left"), "matched")
    bucket, bit = F.bitmap_bucket_number("at"), F.bitmap_bit_position("at")
    chosen = matched.where("e is null").groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    chosen = written(chosen, "chosen")  # a table of its own, so that its size is known
    byte = F.conv(F.hex(F.substr("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    unknown = packed.join(chosen, bucket == F.col("bucket")).where(F.getbit(byte, (bit % 8).cast("int")) == 1).select("key", title.alias("title"), description.alias("description"), F.lit(True).alias("wanted"))
    new = written(_asked(unknown, ["key"], provider), "answers")
    answers.add(new.withColumn("key", F.lower(F.hex("key"))))
    met = packed.join(new.unionByName(matched.where("e is not null").select("key", "e")), "key", "left")
    return met.select("row.*", F.when(F.col("wanted"), F.col("e")).otherwise(_stub(title, SKIPPED_NOTE)).alias("e")).select(*(f"`{c}`" for c in kept.columns), "e.*")


def _asked(notices: DataFrame, through: list[str], provider: Provider) -> DataFrame:
    """The columns of ``through`` as they are, and the answer e to title and description where wanted; elsewhere a stub."""
    kind = to_arrow_type(ENRICHMENT)
    blank = {f.name: None for f in ENRICHMENT["entities"].dataType}

    def answer(title: str, got: dict | Exception | None) -> dict:
        stub = {"core_domain": "Unclassified", "project_tags": [], "procurement_type": "Unknown", "search_keywords": [], "signal_summary": title, "note": None, "error": None, "entities": blank}
        if got is None:
            return stub | {"note": SKIPPED_NOTE}
        if isinstance(got, Exception):
            return stub | {"error": str(got) or type(got).__name__}
        entities = got.get("entities") or {}
        return {f.name: got.get(f.name) for f in ENRICHMENT} | {"entities": {n: entities.get(n) for n in blank}, "note": None, "error": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(provider)
        for batch in batches:
            titles, descriptions, wanted = (batch.column(batch.num_columns - 3 + k).to_pylist() for k in range(3))
            asked = [i for i, w in enumerate(wanted) if w]
            got: list[dict | Exception | None] = [None] * len(titles)
            for i in range(0, len(asked), MODEL_ROWS):
                part = asked[i : i + MODEL_ROWS]
                for j, a in zip(part, enrich_batch(model, [(titles[j], descriptions[j]) for j in part]), strict=True):
                    got[j] = a
            e = pa.array([answer(t, g) for t, g in zip(titles, got, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(through)], e], [*through, "e"])

    schema = StructType([*(StructField(c, nullable(notices.schema[c].dataType)) for c in through), StructField("e", ENRICHMENT)])
    return notices.select(*through, "title", "description", "wanted").mapInArrow(run, schema)


def counted(e: DataFrame, observation: Observation) -> DataFrame:
    """Enriched rows, whose numbers the observation has as soon as an action on them is done: rows, stubbed (not sent to the
    provider), failed (the provider gave an error), empty (no signal) and indexed. They cost no pass of their own."""
    failed = F.col("error").isNotNull()
    empty = ~failed & (F.coalesce("signal_summary", F.lit("")) == "")
    return e.observe(
        observation, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("note").isNotNull()).alias("stubbed"), F.count_if(failed).alias("failed"), F.count_if(empty).alias("empty"), F.count_if(~failed & ~empty).alias("indexed")
    )


def nullable(kind: DataType) -> DataType:
    """The type with every field nullable, as rows come back from Python."""
    return StructType([StructField(f.name, nullable(f.dataType)) for f in kind.fields]) if isinstance(kind, StructType) else kind


def embedded(df: DataFrame, provider: Provider, column: str = "document") -> DataFrame:
    """df with an embedding of a text column."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = opened(provider)
        for texts in batches:
            out = []
            for i in range(0, len(texts), MODEL_ROWS):
                out += model.embed(texts.iloc[i : i + MODEL_ROWS].fillna("").tolist())
            if any(len(v) != provider.dimension for v in out):
                raise ValueError(f"the provider gave vectors that are not of its dimension {provider.dimension}")
            yield pd.Series(out)

    return df.withColumn("embedding", embed(F.col(column)))


def dead_letters(e: DataFrame) -> DataFrame:
    """What enriched rows don't reach the index, and why: the provider's error, or an empty signal."""
    title = cleaning.title_of(F.col("Summary"), F.col("Title"))
    empty = F.when(F.coalesce("signal_summary", F.lit("")) == "", F.lit("empty signal"))
    return e.select(F.coalesce("RefNo", "TOT_ID").alias("ref_no"), title.alias("title"), F.coalesce("error", empty).alias("error")).where("error is not null")


def intents(queries: DataFrame, provider: Provider, column: str = "query") -> DataFrame:
    """queries with the intent of each (INTENT); a query that the provider fails on has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = opened(provider)
        for batch in batches:
            out = []
            for q in batch[column]:
                try:
                    out.append(model.intent(q or ""))
                except Exception:
                    out.append({})
            yield batch.assign(**{f.name: [x.get(f.name) for x in out] for f in INTENT})

    return queries.mapInPandas(run, StructType([*(f for f in queries.schema if f.name not in INTENT.names), *INTENT]))


def metadata(e: DataFrame, *more: str) -> DataFrame:
    """Index rows without embeddings of enriched rows, with more of their columns; failures and empty signals are left out
    (dead_letters has them)."""
    unknown = lambda c, d="Unknown": F.coalesce(F.col(c), F.lit(d))
    good = e.where(F.col("error").isNull() & (F.coalesce("signal_summary", F.lit("")) != ""))
    title = cleaning.title_of(F.col("Summary"), F.col("Title"))
    authority = unknown("entities.authority_name")
    own_id = doc_id(F.col("RefNo"), F.col("TOT_ID"), F.col("signal_summary"))
    return good.select(
        own_id.alias("id"), text.embedding_text(F.col("signal_summary"), F.col("project_tags"), F.col("search_keywords")).alias("document"),
        unknown("core_domain", "Unclassified").alias("core_domain"), F.coalesce(F.array_join("project_tags", ", "), F.lit("")).alias("project_tags"), unknown("procurement_type").alias("procurement_type"),
        authority_name(authority, F.col("Purchaser_Name")).alias("authority_name"), unknown("entities.location_city").alias("location_city"), unknown("entities.location_state").alias("location_state"),
        unknown("Country").alias("country"), text.prefix(title, text.TITLE_CHARS).alias("original_title"),
        text.prefix(F.coalesce(cleaning.present(F.col("Description")), cleaning.present(F.col("signal_summary")), F.lit("")), text.DESCRIPTION_CHARS).alias("description"),
        unknown("Closing_Date", "N/A").alias("closing_date"), unknown("Tender_Notice_Document", "#").alias("url"), own_id.alias("ref_no"), unknown("TOT_ID", "N/A").alias("tot_id"),
        text.is_corrigendum(title).alias("is_corrigendum"), *more,
    )


def doc_id(ref_no: Column, tot_id: Column, signal: Column) -> Column:
    """The reference number, else the other id, else a stable hash of the summary."""
    return F.coalesce(ref_no, tot_id, F.concat(F.lit("hash_"), F.sha2(signal, 256)))


def authority_name(authority: Column, purchaser: Column) -> Column:
    """The purchaser, cut, where no authority is known."""
    return F.when(authority.isin("Unknown", "N/A") & (F.coalesce(purchaser, F.lit("")) != ""), text.prefix(purchaser, text.PURCHASER_CHARS)).otherwise(authority)


def enriched_once(raw: DataFrame, provider: Provider, keywords: Column | Keywords, chunk: int | None = None, answers: Answers | None = None) -> DataFrame:
    """Indexed raw rows, cleaned, de-duplicated and enriched; they keep their row number."""
    return enriched(first_of_each(cleaned(raw), chunk=chunk), provider, keywords, answers)


def index_rows(raw: DataFrame, provider: Provider, keywords: Column | Keywords, chunk: int | None = None, *more: str) -> DataFrame:
    """The whole path from indexed raw rows to index rows; more: columns that travel along (the row number, say)."""
    e = enriched_once(raw, provider, keywords, chunk)
    return embedded(metadata(e, *more), provider).select(*(f.name for f in INDEX), *more)
