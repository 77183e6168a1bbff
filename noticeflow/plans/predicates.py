"""Metadata predicates from a query's intent, as column expressions that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunction(conditions: list[Column]) -> Column:
    """All of the conditions; true for none."""
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def one_of(column: str, values: list[str]) -> Column:
    return F.col(column) == values[0] if len(values) == 1 else F.col(column).isin(values)


def domain_wall(domains: list[str], broad: bool, column: str = "core_domain") -> list[Column]:
    """Keeps the query's domains, unless it is broad or has none."""
    return [one_of(column, domains)] if domains and not broad else []


def procurement_filter(types: list[str], enabled: bool = False, column: str = "procurement_type") -> list[Column]:
    return [one_of(column, types)] if types and enabled else []


def without_corrigenda(include: bool, column: str = "is_corrigendum") -> list[Column]:
    """Null counts as no corrigendum."""
    return [] if include else [~F.col(column).eqNullSafe(True)]


def from_intent(intent: dict, include_corrigendum: bool = True, by_type: bool = False) -> Column:
    return conjunction([
        *domain_wall(intent.get("core_domains") or [], bool(intent.get("is_broad_query"))),
        *procurement_filter(intent.get("procurement_types") or [], by_type),
        *without_corrigenda(include_corrigendum),
    ])


#: Columns of the index, and the columns of asked() that list what a query may see of them.
AMONG = {"core_domain": "domains", "is_corrigendum": "corrigenda"}


def asked(intents: DataFrame, include_corrigendum: bool = True) -> DataFrame:
    """from_intent for many queries at once: their rows with ``domains`` and ``corrigenda``, the values that each may see, null for
    any. The rows searched must have no null corrigendum flag (see searchable)."""
    wall = (F.size("core_domains") > 0) & ~F.coalesce("is_broad_query", F.lit(False))
    allowed = F.lit(None).cast("array<boolean>") if include_corrigendum else F.array(F.lit(False))
    return intents.withColumns({"domains": F.when(wall, F.col("core_domains")), "corrigenda": allowed})


def searchable(table: DataFrame) -> DataFrame:
    """Null counts as no corrigendum."""
    return table.withColumn("is_corrigendum", F.coalesce("is_corrigendum", F.lit(False)))
