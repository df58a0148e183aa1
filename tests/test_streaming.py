import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F
from support import rows

from tenderloom.streaming import streams

START = dt.datetime(2024, 1, 1)
START_SECONDS = 1_704_067_200


def stream_of(spark, df, path, files=1):
    df.coalesce(1).write.mode("overwrite").option("maxRecordsPerFile", max(1, -(-df.count() // files))).parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def spans(spark, minutes):
    data = [(START + dt.timedelta(minutes=m), "api", "prod", m * 10, m % 5 == 0) for m in minutes]
    return spark.createDataFrame(data, "ts TIMESTAMP_NTZ, service STRING, env STRING, duration_ns BIGINT, is_error BOOLEAN")


WINDOW = ["window_start", "window_end", "service", "env"]


def health(stream, folder=None):
    found = streams.drain_windows(streams.stream_service_health(stream), "health", WINDOW, folder=folder)
    return streams.latency_percentiles(found)


def test_all_windows_equal_the_batch_result(spark, tmp_path):
    df = spans(spark, range(0, 120))
    got = health(stream_of(spark, df, f"{tmp_path}/in", files=4))
    batch = streams.latency_percentiles(streams.stream_service_health(df))
    assert rows(got.drop("is_open")) == rows(batch)
    # Closed: ended ten minutes before the newest span.
    closed = F.lit(START + dt.timedelta(minutes=119 - 10))
    assert got.filter(~F.col("is_open")).count() == batch.filter(F.col("window_end") <= closed).count() == 7
    first = got.orderBy("window_start").first()
    assert (first.p50_ns, first.p95_ns, first.p99_ns) == (70, 140, 140)


def test_percentiles_of_a_large_window_stay_within_the_stated_error(spark):
    n = 60_000
    df = spark.range(n, numPartitions=8).select(
        F.lit(START).cast("timestamp_ntz").alias("ts"), F.lit("api").alias("service"), F.lit("prod").alias("env"),
        ((F.col("id") * 7919) % n).alias("duration_ns"), F.lit(False).alias("is_error"),
    )
    quarter = streams.stream_service_health(df)
    for found in (quarter, streams.merge_health(quarter.unionByName(quarter), "1 day")):
        row = streams.latency_percentiles(found).first()
        for name, share in streams.LATENCIES.items():
            assert abs(row[name] / n - share) < 0.006


def test_merged_windows_equal_windows_of_the_same_length(spark):
    df = spans(spark, range(0, 300)).unionByName(spans(spark, [3, 3, 290]).withColumn("duration_ns", F.lit(None).cast("bigint")))
    merged = streams.merge_health(streams.stream_service_health(df), "1 hour")
    direct = streams.stream_service_health(df, window="1 hour")
    assert rows(streams.latency_percentiles(merged)) == rows(streams.latency_percentiles(direct))
    empty = streams.latency_percentiles(streams.stream_service_health(spans(spark, []).limit(0)))
    assert empty.count() == 0


REQUEST = "ts TIMESTAMP_NTZ, source STRING, method STRING, query STRING, max_results INT"


def requests(spark, items):
    return spark.createDataFrame([(START + dt.timedelta(seconds=s), src, "name", q, n) for s, src, q, n in items], REQUEST)


def entries(df):
    seconds = (F.unix_micros("opened_at") / 1e6 - START_SECONDS).alias("at")
    return rows(df.select("source", "query", "max_results", seconds, "requests", "is_open"))


def test_an_entry_answers_for_its_time_to_live(spark, tmp_path):
    items = [(0, "idealo", " Drill ", 5), (100, "idealo", "drill", 5), (120, "idealo", "drill", 3), (130, "geizhals", "drill", 5),
             (300, "idealo", "DRILL", 5), (300.5, "idealo", "drill", 5), (600, "idealo", "drill", 5), (700, "idealo", None, 5),
             (5000, "idealo", "saw", 5), (5001, "idealo", "saw", 5)]
    stream = stream_of(spark, requests(spark, items), f"{tmp_path}/in")
    assert entries(streams.drain_requests(streams.stream_latest_offers(stream))) == rows(
        spark.createDataFrame(
            [("geizhals", "drill", 5, 130.0, 1, False), ("idealo", "drill", 3, 120.0, 1, False),
             ("idealo", "drill", 5, 0.0, 3, False), ("idealo", "drill", 5, 300.5, 2, False),
             ("idealo", None, 5, 700.0, 1, False), ("idealo", "saw", 5, 5000.0, 2, True)],
            "a STRING, b STRING, c INT, d DOUBLE, e BIGINT, f BOOLEAN",
        )
    )


def expected_entries(items, ttl=300):
    """Requests in order of time, one after the other."""
    opened, found = {}, {}
    for second, source, text, n in sorted(items, key=lambda r: r[0]):
        key = (source, text.strip().lower(), n)
        if key not in opened or second > opened[key] + ttl:
            opened[key] = second
        found[(*key, opened[key])] = found.get((*key, opened[key]), 0) + 1
    return found


def test_entries_do_not_depend_on_batches_or_arrival(spark, tmp_path):
    rng = random.Random(4)
    items = [(rng.randrange(20_000) / 4 + k * 0.001, "idealo", rng.choice(["a", "B ", "b", "c"]), 5) for k in range(400)]
    items.sort()
    # Arrival differs from the order of time by less than the watermark's delay.
    arrived = sorted(items, key=lambda r: r[0] + rng.randrange(400))
    want = expected_entries(items)
    folder, part = f"{tmp_path}/kept", f"{tmp_path}/parts"
    for step in range(4):
        requests(spark, arrived[step * 100 : step * 100 + 100]).coalesce(1).write.mode("append").parquet(part)
        stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(part)
        got = streams.drain_requests(streams.stream_latest_offers(stream), folder=folder)
    micros = F.unix_micros("opened_at").alias("us")
    found = {(r.source, r.query, r.max_results, r.us): r.requests for r in got.select("*", micros).collect()}
    assert found == {(s, q, n, round((START_SECONDS + t) * 1e6)): c for (s, q, n, t), c in want.items()}
    assert got.filter("is_open").count() <= 12 and sum(found.values()) == 400


def test_a_stream_without_input_has_no_rows(spark, tmp_path):
    stream = stream_of(spark, requests(spark, []), f"{tmp_path}/in")
    assert streams.drain_requests(streams.stream_latest_offers(stream)).count() == 0
    assert health(stream_of(spark, spans(spark, []), f"{tmp_path}/spans")).count() == 0


def test_replay_jumps_from_entry_to_entry():
    times = np.array([0, 1, 300, 301, 302, 601, 602], np.int64)
    assert streams.replay(None, times, 300, 601) == ([(0, 3), (301, 3)], (602, 1))
    assert streams.replay((0, 3), times[3:], 300, 300) == ([(0, 3)][:1] + [(301, 3)], (602, 1))
    assert streams.replay((5, 1), times[:0], 300, 305) == ([(5, 1)], None)


def test_two_runs_over_parts_equal_one_run(spark, tmp_path):
    whole = spans(spark, range(0, 120))
    once = health(stream_of(spark, whole, f"{tmp_path}/all"))
    folder = f"{tmp_path}/kept"
    for part in (range(0, 50), range(50, 120)):
        spans(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
        stream = spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/parts")
        twice = health(stream, folder)
    assert rows(twice) == rows(once)


def test_arriving_offers_meet_contracts(spark, tmp_path):
    offers = spark.createDataFrame([("a", 800), ("b", 5), ("a", 1200)], "ean STRING, total_cents BIGINT")
    contracts = spark.createDataFrame([("a", 1, 1000)], "ean STRING, contract_id INT, contract_price_cents BIGINT")
    checked = streams.stream_contract_check(stream_of(spark, offers, f"{tmp_path}/in"), contracts)
    got = streams.drain(checked, "check").select("total_cents", "verdict")
    assert rows(got) == [(1200, "below_market"), (800, "urgent_renegotiation")]


def test_merged_counts_give_exact_percentiles(spark):
    """More latencies a day than a sketch of 800 holds, one window without any."""
    day = 86_400
    spans = spark.range(20_000).select(
        F.timestamp_seconds(F.col("id") * 7 % (2 * day)).alias("ts"),
        F.lit("s").alias("service"),
        F.when(F.col("id") % 10 == 0, "dev").otherwise("prod").alias("env"),
        F.when(F.col("id") % 10 != 0, 2**40 + F.col("id") * 7919 % 19_997).alias("duration_ns"),
        (F.col("id") % 9 == 0).alias("is_error"),
    )
    got = streams.merge_counts(streams.latency_counts(spans), "1 day").collect()
    want = {}
    for row in spans.collect():
        want.setdefault((row.ts.date(), row.env), []).append(row)
    assert len(got) == len(want) == 4
    for row in got:
        members = want[row.window_start.date(), row.env]
        values = sorted(m.duration_ns for m in members if m.duration_ns is not None)
        assert (row.total_requests, row.total_errors) == (len(members), sum(m.is_error for m in members))
        assert row.duration_max_ns == max(values, default=None)
        for name, share in (("p50_ns", 50), ("p95_ns", 95), ("p99_ns", 99)):
            assert row[name] == (values[-(-share * len(values) // 100) - 1] if values else None)
