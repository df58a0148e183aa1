"""The hot-key paths give exactly what the plain operators give."""

from support import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tenderloom.operators import skew


def hot_table(spark, n=3000):
    """One key holds a third of the rows; one key is NULL."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 7 == 0, None).otherwise(F.concat(F.lit("k"), (i % 11).cast("string")))
    return spark.range(n).select(key.alias("key"), (i * 7919 % 1009 - 200).alias("v"), i.alias("id"))


def test_numbered_rows_match_a_plain_window(spark):
    df = hot_table(spark)
    order = [F.col("v"), F.col("id")]
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("bigint"))
    for limit in (10, 900, 10**6):
        got = skew.numbered_rows(df, ["key"], [F.col("v"), F.shiftright("id", 6)], order, "n", limit=limit)
        assert rows(got) == rows(expected)


def test_percentiles_match_the_builtin(spark):
    df = hot_table(spark)
    wanted = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    expected = df.groupBy("key").agg(*[F.percentile("v", p).alias(n) for n, p in wanted.items()])
    assert rows(skew.percentiles(df, ["key"], "v", wanted)) == rows(expected)


def test_a_group_without_values_stays(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", None), (None, None)], "key STRING, v BIGINT")
    got = skew.percentiles(df, ["key"], "v", {"p": 0.5}, {"n": F.lit(1)})
    assert rows(got) == [("a", 2, 2.0), ("b", 1, None), (None, 1, None)]


def test_percentiles_read_their_source_twice_at_most(spark, tmp_path):
    hot_table(spark).write.parquet(f"{tmp_path}/t")
    got = skew.percentiles(spark.read.parquet(f"{tmp_path}/t"), ["key"], "v", {"a": 0.5, "b": 0.9}, {"n": F.lit(1)})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("FileScan") <= 2


def test_percentiles_carry_other_aggregates(spark):
    df = hot_table(spark).withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v")))
    expected = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.percentile("v", 0.75).alias("p"))
    sums = {"n": F.lit(1), "ids": F.col("id")}
    assert rows(skew.percentiles(df, ["key"], "v", {"p": 0.75}, sums)) == rows(expected)


def test_value_buckets_are_monotone(spark):
    df = spark.range(-5000, 5000, 7).select("id", skew.value_bucket(F.col("id")).alias("b")).orderBy("id")
    buckets = [r.b for r in df.collect()]
    assert buckets == sorted(buckets)


def test_spread_join_keeps_every_pair(spark):
    many = hot_table(spark).filter("key IS NOT NULL")
    few = many.select("key").distinct().withColumn("name", F.upper("key"))
    expected = rows(many.join(few, "key").select("key", "id", "name"))
    for limit in (10, 500, 10**6):
        cut, repeated = skew.spread_hot_keys(many, few, ["key"], ["id"], limit)
        got = cut.join(repeated, ["key", skew.SPLIT]).select("key", "id", "name")
        assert rows(got) == expected
    cut, _ = skew.spread_hot_keys(many, few, ["key"], ["id"], 100)
    assert cut.filter("key = 'hot'").select(skew.SPLIT).distinct().count() == 10


def test_first_rows_limit_before_the_shuffle(spark):
    df = hot_table(spark)
    top = skew.first_rows(df, ["key"], [F.col("v"), F.col("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.filter("key = 'hot'").count() == 2


def test_hot_cells_of_a_cheaper_count(spark):
    many = spark.range(300).select((F.col("id") % 3).alias("k")).filter("k > 0")
    few = spark.range(30).select((F.col("id") % 2).alias("k"))
    counted = many.unionByName(few)
    cells = skew.hot_cells(many, few, ["k"], 20, None, counted)
    assert [(r.k, r._across > 1) for r in cells.orderBy("k").collect()] == [(1, True), (2, True)]
    assert "Union" not in skew.hot_cells(many, few, ["k"], 20, None, few)._jdf.queryExecution().analyzed().toString()
