"""Run registered queries next to their SQL and compare rows exactly."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(path: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = Counter(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())
    return [columns[i] for i in order], rows


def differences(spark, name, path, con):
    """Empty text when the query and its SQL agree."""
    import __spark_entry__ as entry

    names, left = rows_of_spark(entry.queries()[name](spark, path))
    sql_names, right = rows_of_sql(con, entry.oracle_sql()[name])
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"{sum(left.values())} vs {sum(right.values())} rows; {sum(only_left.values())} only in "
            f"Spark, e.g. {list(only_left)[:3]}; {sum(only_right.values())} only in SQL, e.g. "
            f"{list(only_right)[:3]}"
        )
    return ""


def main(path: str, chosen: list[str]) -> None:
    import __spark_entry__ as entry
    from tenderloom.session import build_session

    spark = build_session(
        master="local[8]",
        shuffle_partitions=8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    if "HOT_ROWS" in os.environ:  # make ordinary keys count as hot
        spark.conf.set("spark.tenderloom.rowsInTask", os.environ["HOT_ROWS"])
        spark.conf.set("spark.tenderloom.rowsPerSplit", os.environ["HOT_ROWS"])
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    oracle = entry.oracle_sql()
    for name in chosen or entry.queries():
        start = time.time()
        try:
            if name in oracle:
                result = differences(spark, name, path, con) or "ok"
            else:
                result = f"rows only: {entry.queries()[name](spark, path).count()}"
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
