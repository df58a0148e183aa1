"""Helpers of the tests."""

import os

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")


def rows(df, *order):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def values(spark, items, build, kind="string"):
    """Results of a column expression over literal inputs, in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i INT, v {kind}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]
