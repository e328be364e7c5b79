"""Compare registered queries with their SQL: ``python tests/oracle.py DIR [NAME...]``."""

import os
import sys

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def difference(spark, c, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows, types aside."""
    got, want = query(spark, sf_dir).toPandas(), c.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    cols = sorted(got.columns)
    text = lambda x: "" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    rows = lambda d: sorted(tuple(text(x) for x in r) for r in d[cols].itertuples(index=False, name=None))
    got, want = rows(got), rows(want)
    if got == want:
        return ""
    odd = next((p for p in zip(got, want, strict=False) if p[0] != p[1]), None)
    return f"{len(got)} and {len(want)} rows; {odd}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from calltide.plans import registry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    c, bad = connect(sys.argv[1]), 0
    for name in sys.argv[2:] or registry.oracle_sql():
        try:
            found = difference(spark, c, registry.queries()[name], registry.oracle_sql()[name], sys.argv[1])
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(found)
        print(name, found or "ok", flush=True)
    print("bad", bad)
