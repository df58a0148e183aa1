"""Global ranks and pages equal a plain sort, over many ranges and with hot groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from support import rows

from tenderloom.operators import ranking


@pytest.fixture(scope="module")
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def table(spark, n=2000):
    """Half of the rows belong to one group, some to none; values tie."""
    i = F.col("id")
    group = F.when(i % 2 == 0, "hot").when(i % 7 == 0, None).otherwise(F.concat(F.lit("g"), (i % 5).cast("string")))
    return spark.range(n).select(group.alias("g"), (i * 7919 % 97).alias("v"), i)


def in_order():
    return [F.desc("v"), F.col("id")]


def test_ranks_per_group_with_its_size(spark, many_ranges):
    df = table(spark)
    one = Window.partitionBy("g")
    want = df.withColumn("r", F.row_number().over(one.orderBy(*in_order())).cast("bigint")).withColumn("n", F.count("*").over(one))
    ordered = ranking.globally_ordered(df, in_order(), ["g"])
    assert rows(ordered.ranked("r", of="n")) == rows(want)
    hot = ordered.rows.filter("g = 'hot'").select("_part").distinct().count()
    assert hot > 1 and ordered.count() == 2000


def test_ranks_of_the_whole_table(spark, many_ranges):
    df = table(spark)
    got = ranking.globally_ranked(df, in_order())
    assert [r.id for r in got.orderBy("rank_no").collect()] == [r.id for r in df.orderBy(*in_order()).collect()]
    assert [r.rank_no for r in got.orderBy("rank_no").select("rank_no").collect()] == list(range(1, 2001))
    assert ranking.globally_ranked(df.limit(0), in_order()).count() == 0


def test_pages_from_first_to_last(spark, many_ranges):
    df = table(spark, 250)
    ordered = ranking.globally_ordered(df, in_order())
    want = [r.id for r in df.orderBy(*in_order()).collect()]
    for page in (1, 2, 3, 4):
        got = ranking.page_in_order(ordered, page, 100).orderBy("rank_no").collect()
        assert [r.id for r in got] == want[page * 100 - 100 : page * 100]
        assert all(r.total_count == 250 and r.has_more == (page < 3) for r in got)
    with pytest.raises(ValueError):
        ranking.globally_ordered(df, in_order(), ["g"]).slice(1, 2)


@pytest.mark.parametrize("descending", [True, False])
def test_pages_by_key_walk_through_all_rows(spark, descending):
    df = table(spark, 60).withColumn("v", F.when(F.col("id") % 6 != 0, F.col("v") % 5))
    order = [("v", descending), ("id", False)]
    by = [F.desc("v") if descending else F.asc("v"), F.col("id")]
    want = [r.id for r in df.orderBy(*by).collect()]
    first = df.orderBy(*by).first()
    seen, last = [first.id], {"v": first.v, "id": first.id}
    while page := ranking.rows_after(df, order, last, 17).collect():
        seen += [r.id for r in page]
        last = {"v": page[-1].v, "id": page[-1].id}
    assert seen == want
