"""Arrow batches of whole documents are large at Spark's default of 10,000 rows; both sides hold a batch at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound(spark: SparkSession) -> None:
    """Let this session's Arrow batches have ``ROWS`` rows at most. It stays so: plans made now are run after the call."""
    now = int(spark.conf.get(_KEY, "10000"))
    if now <= 0 or now > ROWS:
        spark.conf.set(_KEY, str(ROWS))
