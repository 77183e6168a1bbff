"""Schemas of raw notices, enrichment output, the index and the logs, and the fixed words in them."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, MapType, StringType, StructField, StructType


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


#: Raw columns that the engine reads; all strings, all optional.
RAW_COLUMNS = ("Summary", "Title", "Description", "Country", "Location", "Amount", "Date", "RefNo", "TOT_ID", "Closing_Date", "Tender_Notice_Document", "Purchaser_Name")
RAW = StructType(_strings(*RAW_COLUMNS))

ENTITIES = StructType(_strings("authority_name", "location_city", "location_state"))
ENRICHMENT = StructType([
    *_strings("core_domain"), StructField("project_tags", ArrayType(StringType())), *_strings("procurement_type"), StructField("search_keywords", ArrayType(StringType())),
    StructField("entities", ENTITIES), *_strings("signal_summary", "note", "error"),
])

INTENT = StructType([
    StructField("core_domains", ArrayType(StringType())), StructField("procurement_types", ArrayType(StringType())), *_strings("refined_query"), StructField("is_broad_query", BooleanType()),
])

METADATA_COLUMNS = ("core_domain", "project_tags", "procurement_type", "authority_name", "location_city", "location_state", "country", "original_title", "description", "closing_date", "url", "ref_no", "tot_id")
INDEX = StructType([*_strings("id", "document", *METADATA_COLUMNS), StructField("is_corrigendum", BooleanType()), StructField("embedding", ArrayType(FloatType()))])

FEEDBACK = StructType([
    *_strings("timestamp", "query", "result_id"), StructField("rating", IntegerType()), StructField("position", IntegerType()), *_strings("session_id"),
    StructField("result_metadata_snapshot", MapType(StringType(), StringType())), *_strings("comment"),
])

# Fixed values.
DOMAINS = ("Agriculture", "Healthcare", "Infrastructure", "Energy", "Defense", "Technology", "Transport", "Other")
PROCUREMENT_TYPES = ("Works", "Supply", "Services")
NO_DESCRIPTION = "No description provided."
SKIPPED_NOTE = "Skipped by Cost Optimizer (Pre-Filter)"
#: pandas' tokens for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
