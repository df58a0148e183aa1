"""Small tables with the awkward rows that every corpus operator must define."""

import random

import duckdb

WORDS = (
    "river stone window garden paper bottle candle market winter summer yellow silver copper planet "
    "engine mirror basket camera doctor farmer hunter island jacket kettle ladder magnet needle orange"
).split()


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def awkward_documents():
    """(doc_id, text, lang, source, n_chars): nulls, empties, ties, copies, a long text, odd spaces."""
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    rows = [
        (0, base, "en", "s0", None),
        (1, base, "en", "s1", 5),
        (2, " ".join(near), "en", "s0", None),
        (3, None, "en", "s0", None),
        (4, "", None, None, 0),
        (5, " \t\n\x0b\x0c\r ", "en", "s0", 6),
        (6, "one two three", "en", "s2", 13),
        (7, "One\x0bTWO\x0cthree", "en", "s2", 13),
        (8, prose(2, 6000), "en", "s0", None),
        (9, "a b É ß 😀 #$%\n\nx y\nx y\nx y\n", "de", None, None),
        (10, "same same same same same same", "en", "s3", None),
        (11, "\n".join([prose(3, 20)] * 40), "en", "s0", None),
        (12, base, "en", "s0", None),
        (13, prose(4, 80), "en", "s4", None),
        (13, prose(4, 80), "en", "s4", None),
    ]
    return rows + [(100 + k, prose(10 + k, 60 + k), "en", f"s{k % 3}", None) for k in range(40)]


DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
#: Names that operators use inside; they must not clash.
EXTRA = ("key", "count", "_row", "component", "a.b", "kept", "_host")


def documents(spark, rows=None, extra=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_documents() if rows is None else rows, DOCUMENTS)
    return df.withColumns({name: F.lit(7) for name in EXTRA}) if extra else df


def save(df, folder, name):
    path = f"{folder}/{name}.parquet"
    df.coalesce(2).write.mode("overwrite").parquet(path)
    return path


def sql_rows(folder, sql, tables=("documents",)):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted([tuple(r[names.index(n)] for n in sorted(names)) for r in cursor.fetchall()], key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)
