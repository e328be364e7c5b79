"""Key preference: first and last wins, preferring merge, keep-first upsert. Order is always an explicit column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes last in ``order``; an aggregate with map-side combining, no sort."""
    return _one(rows, key, order, F.max_by)


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    return _one(rows, key, order, F.min_by)


def _one(rows: DataFrame, key: Sequence[str], order: Sequence[str], by) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def prefer_merge(base: DataFrame, other: DataFrame, key: Sequence[str], order: Sequence[str], usable: Column, taken: Sequence[str], source: str = "source") -> DataFrame:
    """Every row of ``base`` (copies too), with the columns ``taken`` from the last row of ``other`` with its key if that
    row is ``usable``; then the first row of ``other`` for each key that base has not. ``source`` tells which it was."""
    rest = [c for c in base.columns if c not in key]
    by, row = F.struct(*order), F.struct(*(c for c in other.columns if c not in key))
    ends = other.groupBy(*key).agg(F.max_by(row, by).alias("_last"), F.min_by(row, by).alias("_first"), F.max_by(usable, by).alias("_usable"))
    merged = base.select(*key, F.struct(*rest).alias("_base")).join(ends, list(key), "full")
    held, hit = F.col("_base").isNotNull(), F.coalesce("_usable", F.lit(False))
    value = lambda c: F.when(held, F.when(hit, F.col(f"_last.{c}")).otherwise(F.col(f"_base.{c}")) if c in taken else F.col(f"_base.{c}")).otherwise(F.col(f"_first.{c}"))
    told = F.when(held, F.when(hit, "override").otherwise("base")).otherwise("added")
    return merged.select(*(F.col(c) if c in key else value(c).alias(c) for c in base.columns), told.alias(source))


def keep_first_upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What to append: the first new row of each key that the table does not hold yet."""
    return first_wins(new.join(existing.select(*key).distinct(), list(key), "left_anti"), key, order)


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts each task's rows to n per group before the shuffle."""
    numbered = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.where(F.col(rank) <= n)
