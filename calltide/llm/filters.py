"""Filters by a list of keys that may be small or large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast, at most.
BROADCAST = 500_000


def sized(keys: DataFrame) -> DataFrame:
    """keys, marked for broadcast if they are few, which is counted first."""
    return F.broadcast(keys) if keys.limit(BROADCAST + 1).count() <= BROADCAST else keys


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows whose key is not in ``keys``, all of whose columns are the key."""
    return rows.join(sized(keys), keys.columns, "left_anti").select(*rows.columns)
