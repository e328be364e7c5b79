"""Session and table helpers shared by every subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out to as many tasks as the session shuffles with: for rows that are small to move, and of which much is made."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; set a temporary one only for an unset local session."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


class Scratch:
    """Tables of one run, written to and read again from the shared folder, which cuts lineage and survives lost executors.

    ``drop`` deletes the tables that no result reads any more. ``release`` lets Spark delete the shuffle files of steps
    that are over: it does so when the driver's garbage is collected, which may be long after.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table."""
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths[path] = self.spark.read.schema(df.schema).parquet(path)
        return self.paths[path]

    def drop(self, *but: DataFrame) -> None:
        """Delete every table except those in ``but``, whose results are still to be read."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path, df in list(self.paths.items()):
            if df is not None and not any(df is b for b in but):
                there = jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(conf).delete(there, True)
                self.paths[path] = None

    def release(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
