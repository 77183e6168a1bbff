"""Sector taxonomies: from a wide sheet to rows, keyword lists and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_wide(sheet: DataFrame, order: str | None = None) -> DataFrame:
    """(sector, keyword, row) of a sheet with a column for each sector; unnamed columns and blanks are left out."""
    sectors = [c for c in sheet.columns if not c.startswith("Unnamed") and c != order]
    row = F.col(order) if order else F.monotonically_increasing_id()
    long = sheet.select(row.alias("row"), F.explode(F.array(*(F.struct(F.lit(c.strip()).alias("sector"), F.trim(F.col(f"`{c}`").cast("string")).alias("keyword")) for c in sectors))).alias("x"))
    return long.select("x.sector", "x.keyword", "row").where("keyword <> ''")


def by_sector(rows: DataFrame) -> DataFrame:
    """sector and its keywords in row order; sectors are the sheet's columns, so lists are bounded by its rows."""
    return rows.groupBy("sector").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "keyword"))), lambda x: x["keyword"]).alias("keywords"))


def to_json(sectors: DataFrame) -> DataFrame:
    """One row with the taxonomy as a JSON object."""
    whole = F.map_from_entries(F.sort_array(F.collect_list(F.struct("sector", "keywords"))))
    return sectors.agg(F.to_json(whole).alias("taxonomy"))


def write_json(sectors: DataFrame, path: str) -> None:
    """The taxonomy as a JSON file, indented by 2, other letters than ASCII kept; a taxonomy has a few thousand words."""
    found = {r["sector"]: r["keywords"] for r in sectors.orderBy("sector").collect()}
    spark = sectors.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(json.dumps(found, indent=2, ensure_ascii=False).encode()))
    finally:
        stream.close()


def flat(rows: DataFrame) -> DataFrame:
    """Distinct lower-cased keywords."""
    return rows.select(F.lower("keyword").alias("keyword")).distinct()


def as_array(keywords: list[str]) -> Column:
    """Keywords as an array literal; a taxonomy is a parameter of a few thousand words."""
    return F.array(*(F.lit(k.lower()) for k in keywords)) if keywords else F.array().cast("array<string>")
