import datetime as dt

import pytest
from support import rows
from pyspark.sql import functions as F

from tenderloom.operators import telemetry as T

NOON = dt.datetime(2024, 1, 10, 12, 0, 0)


@pytest.fixture(scope="module")
def events(spark):
    data = [(i, NOON - dt.timedelta(minutes=10 * i), f"s{i % 3}", float(i)) for i in range(40)]
    return spark.createDataFrame(data, "id INT, ts TIMESTAMP_NTZ, service STRING, value DOUBLE")


@pytest.mark.parametrize(
    "start, end, ids",
    [
        ("now-1h", "now", range(0, 7)),
        ("now-30m", "now-10m", range(1, 4)),
        (1200, 0, range(0, 3)),
        ("2024-01-10T11:00:00", "2024-01-10 11:30:00", range(3, 7)),
        ("now-1d", "now", range(0, 40)),
    ],
)
def test_time_windows(events, start, end, ids):
    got = T.time_window(events, "ts", start, end, "2024-01-10 12:00:00")
    assert sorted(r.id for r in got.collect()) == list(ids)


def test_search_sorts_and_limits(events):
    got = T.search_records(events, where="value >= 3", as_of="2024-01-10 12:00:00", limit=2)
    assert [r.id for r in got.collect()] == [3, 4]
    got = T.search_records(events, sort="value", descending=False, limit=3)
    assert [r.id for r in got.collect()] == [0, 1, 2]
    assert T.search_records(events).count() == 40
    with pytest.raises(ValueError):
        T.search_records(events, limit=-1)


def test_search_filters_reach_the_scan(inputs):
    df = T.search_records(inputs.events, where=F.col("value") > 20, as_of="2024-01-31 00:00:00", limit=25)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(value), GreaterThanOrEqual(ts,2024-01-30T23:00)" in plan
    assert "TakeOrderedAndProject" in plan


def test_pages(events):
    page = T.page_of(events, [F.col("id")], page=2, page_size=25).collect()
    assert [r.id for r in page] == list(range(25, 40))
    assert {(r.total_count, r.has_more) for r in page} == {(40, False)}
    first = T.page_of(events, [F.col("id")], page=1, page_size=39).first()
    assert first.has_more


def test_titles(spark):
    df = spark.createDataFrame([("My DASH",), (None,), ("x",)], "title STRING")
    assert rows(T.title_contains(df, "dash")) == [("My DASH",)]
    assert T.title_contains(df, "").count() == 3


def test_counts(spark):
    df = spark.createDataFrame([("ok",), ("error",), ("error",), ("ok",), ("error",)], "status STRING")
    counts = T.count_by(df, "status")
    assert rows(counts) == [("error", 3), ("ok", 2)]
    assert T.counts_text(counts, "status").first().counts == "error: 3, ok: 2"
    blanks = spark.createDataFrame([(None,), ("",)], "status STRING")
    assert rows(T.count_by(blanks, "status")) == [("unknown", 2)]
    numbers = spark.createDataFrame([(0, False), (7, True), (None, None)], "n INT, b BOOLEAN")
    assert rows(T.count_by(numbers, "n")) == [("7", 1), ("unknown", 2)]
    assert rows(T.count_by(numbers, "b")) == [("true", 1), ("unknown", 2)]


def test_facets_keep_the_largest_values(spark):
    data = [(f"a{a}", f"b{b}", a * b) for a in range(30) for b in range(a + 1)]
    df = spark.createDataFrame(data, "a STRING, b STRING, v INT")
    top = T.facet_aggregate(df, ["a", "b"], "v", "total", values_per_facet=2, max_buckets=3)
    assert [tuple(r) for r in top.collect()] == [("a29", "b29", 841), ("a29", "b28", 812), ("a28", "b28", 784)]
    assert T.facet_aggregate(df, ["a"]).count() == 30
    assert T.facet_aggregate(df, ["a", "b"]).count() == 465
    with pytest.raises(ValueError):
        T.facet_aggregate(df, ["a"] * 5)


@pytest.mark.parametrize(
    "fn, expected", [("count", 5), ("avg", 3.0), ("min", 1), ("max", 5), ("total", 15), ("cardinality", 5), ("pc75", 4.0), ("pc90", 4.6)]
)
def test_facet_functions(spark, fn, expected):
    df = spark.createDataFrame([("x", v) for v in (1, 2, 3, 4, 5)], "k STRING, v BIGINT")
    assert T.facet_aggregate(df, ["k"], "v", fn).first().value == pytest.approx(expected)


def test_series(spark):
    df = spark.createDataFrame(
        [("cpu", [[1.0, 10.0], [2.0, None], [3.0, 20.0]]), ("idle", [[1.0, None]])],
        "metric STRING, pointlist ARRAY<ARRAY<DOUBLE>>",
    )
    points = T.explode_points(df)
    assert rows(T.summarize_series(points, ["metric"])) == [("cpu", 3, 15.0), ("idle", 1, 0.0)]
    many = spark.range(100).select(F.lit("m").alias("metric"), F.col("id").alias("ts"))
    assert T.first_points(many, ["metric"], [F.col("ts")]).agg(F.max("ts"), F.count("ts")).first() == (19, 20)


def test_metric_names_and_tags(spark):
    df = spark.createDataFrame(
        [(f"system.m{i:03d}", ["env:prod", f"host:h{i}"]) for i in range(150)] + [("app.x", ["plain"])],
        "metric STRING, tags ARRAY<STRING>",
    )
    names = [r.metric for r in T.list_metrics(df, "system.").collect()]
    assert names == [f"system.m{i:03d}" for i in range(150)]
    assert T.list_metrics(df, "system.", limit=3).count() == 3
    tags = T.tag_keys(df.withColumn("all", F.lit(1)), ["all"])
    assert rows(tags.select("tag_key", "tag_values")) == [("env", 1), ("host", 150), ("plain", 1)]
    hosts = spark.createDataFrame([("h", {"agent": ["a:1", "b"], "user": ["c"]})], "name STRING, tags_by_source MAP<STRING, ARRAY<STRING>>")
    assert rows(T.host_tags(hosts)) == [("h", "agent", "a:1"), ("h", "agent", "b"), ("h", "user", "c")]


def test_service_health(spark):
    spans = spark.createDataFrame(
        [("api", "prod", i * 1_000_000, i > 90) for i in range(1, 101)] + [("db", "prod", None, False)],
        "service STRING, env STRING, duration_ns BIGINT, is_error BOOLEAN",
    )
    api, db = T.service_health(spans, 50).orderBy("service").collect()
    assert (api.p50_ms, api.p95_ms, api.p99_ms) == (50.5, 95.05, 99.01)
    assert (api.requests_per_second, api.total_requests, api.error_rate_percent, api.total_errors) == (2.0, 100, 10.0, 10)
    assert (db.p50_ms, db.total_requests, db.error_rate_percent) == (None, 1, 0.0)


def test_slo(spark):
    df = spark.createDataFrame([("api", 9995, 10000), ("web", 0, 0)], "service STRING, good BIGINT, total BIGINT")
    api, web = T.slo_report(df, ["service"]).orderBy("service").collect()
    assert api.sli_percent == pytest.approx(99.95)
    assert api.error_budget_remaining_percent == pytest.approx(50.0)
    assert web.sli_percent is None


def test_rollups(spark):
    hosts = spark.createDataFrame([(True,), (False,), (None,)], "up BOOLEAN")
    assert T.host_status(hosts).first() == (1, 2, 3)
    results = spark.createDataFrame([("t", 0), ("t", 1), ("t", None)], "test STRING, status INT")
    assert rows(T.synthetic_pass_rate(results, ["test"])) == [("t", 3, 1, 2)]
    usage = spark.createDataFrame(
        [("logs", NOON, [("a", 1), ("b", 2)]), ("logs", NOON + dt.timedelta(minutes=5), [("a", 4)]), (None, NOON, [])],
        "product_family STRING, timestamp TIMESTAMP_NTZ, measurements ARRAY<STRUCT<usage_type: STRING, value: INT>>",
    )
    assert rows(T.usage_rollup(usage).select("product_family", "usage_type", "value")) == [("logs", "a", 5), ("logs", "b", 2)]
    assert rows(T.product_families(usage)) == [("logs", 2)]
    cost = spark.createDataFrame(
        [("o", dt.date(2024, 1, 1), [("logs", "total", 5), ("logs", "total", 6)])],
        "org_name STRING, date DATE, charges ARRAY<STRUCT<product_name: STRING, charge_type: STRING, cost_cents: INT>>",
    )
    assert rows(T.cost_rollup(cost).select("product_name", "cost_cents")) == [("logs", 11)]


def test_first_row_per_key_and_fallback(spark):
    df = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a"), ("", 0, "x"), (None, 0, "y"), ("2", 5, "c")], "ean STRING, pos INT, name STRING")
    assert rows(T.dedup_first(df, ["ean"], [F.col("pos")])) == [("1", 1, "a"), ("2", 5, "c")]
    other = spark.createDataFrame([("1", 9, "no"), ("3", 9, "yes")], "ean STRING, pos INT, name STRING")
    assert rows(T.with_fallback(df, other, ["ean"]).filter("pos = 9")) == [("3", 9, "yes")]


def test_broker_resources(spark):
    df = spark.createDataFrame(
        [("full", 95, 100, 0, 1), ("deep", 1, 100, 5000, 0), ("idle", 1, 100, 0, 0), ("fine", 1, 100, 0, 2), ("new", None, None, None, 1)],
        "queueName STRING, msgSpoolUsage INT, maxMsgSpoolUsage INT, spooledMsgCount INT, consumerCount INT",
    ).withColumn("links", F.lit("x"))
    assert rows(T.health_rollup(df, 90, 1000)) == [
        ("healthy", 2),
        ("high_queue_depth", 1),
        ("resource_exhaustion", 1),
        ("zero_consumers", 1),
    ]
    bad = T.anomalies(df, 90, 1000).orderBy("severity_rank").collect()
    assert [r.queueName for r in bad] == ["full", "deep", "idle"]
    assert "links" not in T.keep_fields(df, "queue").columns
    products = spark.createDataFrame([("1", "  ", "n")], "ean STRING, title STRING, noise STRING")
    assert T.keep_fields(products, "product").first().asDict() == {"ean": "1", "title": None}


LEVELS = {"n": ("count", None), "sum": ("total", "v"), "mean": ("avg", "v"), "low": ("min", "v"), "high": ("max", "v"), "given": ("count", "v")}


def test_facet_levels_equal_one_aggregation_each(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"),
        F.when(F.col("id") % 4 != 0, F.col("id") * 37 % 101).alias("v"),
    )
    got = T.facet_levels(df, ["a", "b"], LEVELS)
    known = df.withColumns({"a": F.coalesce(F.col("a").cast("string"), F.lit("unknown")), "b": F.col("b").cast("string")})
    want = []
    for level, keys in enumerate(([], ["a"], ["a", "b"])):
        part = known.groupBy(*keys).agg(F.count("*"), F.sum("v"), F.avg("v"), F.min("v"), F.max("v"), F.count("v"))
        for row in part.collect():
            want.append((level, *row[: len(keys)], *[None] * (2 - len(keys)), *row[len(keys) :]))
    assert sorted(rows(got), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        T.facet_levels(df, ["a"], {"x": ("avg", None)})


def test_facet_levels_read_their_source_once(spark, tmp_path):
    spark.range(10).select((F.col("id") % 2).alias("a"), "id").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = T.facet_levels(df, ["a"], {"n": ("count", None), "d": ("cardinality", "id"), "p": ("pc95", "id")})
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert rows(got) == [(0, None, 10, 10, 9.0), (1, "0", 5, 5, 8.0), (1, "1", 5, 5, 9.0)]


def test_sketches_of_facet_levels_stay_within_the_stated_error(spark):
    n = 50_000
    df = spark.range(n).select((F.col("id") % 4).alias("a"), (F.col("id") * 7919 % n).alias("v"))
    got = T.facet_levels(df, ["a"], {"d": ("cardinality", "v"), "p75": ("pc75", "v"), "p99": ("pc99", "v")})
    for row in got.collect():
        size = n if row.level == 0 else n / 4
        assert abs(row.d / size - 1) < 0.03
        assert abs(row.p75 / n - 0.75) < 0.006 and abs(row.p99 / n - 0.99) < 0.006


def test_distinct_counts_of_facet_levels_are_exact(spark):
    n = 60_000
    value = F.when(F.col("id") % 7 != 0, F.col("id") * 7919 % n)
    df = spark.range(2 * n).select((F.col("id") % 4).alias("a"), value.alias("v"), (F.col("id") % 3).alias("w"))
    got = T.facet_levels(df, ["a"], {"d": ("cardinality", "v"), "e": ("cardinality", "w"), "s": ("total", "v")})
    exact = [F.count_distinct("v"), F.count_distinct("w"), F.sum("v")]
    want = [(0, None, *df.agg(*exact).first())]
    want += [(1, str(r[0]), *r[1:]) for r in df.groupBy("a").agg(*exact).collect()]
    assert rows(got) == sorted(want, key=lambda r: [(v is None, str(v)) for v in r])


def test_slo_windows_add_up_days(spark):
    days = [(d, g) for d in (0, 0, 3, 6, 7, 29, 30, 100) for g in (1, d % 2)]
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", start + dt.timedelta(days=d, hours=5), g, 1) for d, g in days], "s STRING, ts TIMESTAMP_NTZ, good INT, total INT")
    got = {(r.day - start.date()).days: r for r in T.slo_windows(df, ["s"], 95.0).collect()}
    assert sorted(got) == sorted({d for d, _ in days})
    for day, row in got.items():
        for n in (7, 30, 90):
            inside = [g for d, g in days if day - n < d <= day]
            assert row[f"total_{n}d"] == len(inside)
            assert abs(row[f"sli_percent_{n}d"] - 100 * sum(inside) / len(inside)) < 1e-9
            assert abs(row[f"error_budget_percent_{n}d"] - 100 * (1 - (100 - row[f"sli_percent_{n}d"]) / 5)) < 1e-9
