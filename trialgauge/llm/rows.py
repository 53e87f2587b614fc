"""Rows of a documents table under names of the operators' own, whatever columns it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id, after every other.
LAST_ID = (1 << 63) - 1


def order_id(column: str = "doc_id") -> Column:
    """The id as a number, null as the last one."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def wrapped(docs: DataFrame) -> DataFrame:
    """``_row`` (all columns), ``_id``, ``_hash`` (of the text; rows equal in both are alike), ``text``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(whole, order_id().alias("_id"), F.xxhash64("text").alias("_hash"), "text")


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("_row")[c].alias(c) for c in columns])
