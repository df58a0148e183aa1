"""Structured Streaming: windowed service health, a request cache with a time to live, contract checks.

Streams write what they find to a folder that all executors reach, and keep progress and state beside
it, so a later call with the same folder goes on from the last committed batch. Results say which rows
are still open: nothing that has arrived is left out of a result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from tenderloom.operators import skew
from tenderloom.operators.offers import compare_with_market, market_verdict
from tenderloom.session import scratch_dir

__all__ = [
    "compare_with_market",
    "drain",
    "drain_requests",
    "drain_windows",
    "latency_counts",
    "latency_percentiles",
    "merge_counts",
    "merge_health",
    "stream_contract_check",
    "stream_latest_offers",
    "stream_service_health",
]

#: Size of a latency sketch. A window of fewer values is exact; beyond that the rank of a
#: percentile is off by less than 0.6 % of the window's rows (twice the sketch's normal error).
SKETCH_SIZE = 800

LATENCIES = {"p50_ns": 0.50, "p95_ns": 0.95, "p99_ns": 0.99}

#: What identifies a request; texts are compared without case and outer spaces.
REQUEST_KEYS = ("source", "method", "query", "max_results")

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# -- service health -----------------------------------------------------------


def stream_service_health(
    spans: DataFrame, window: str = "15 minutes", late: str = "10 minutes", ts: str = "ts", k: int = SKETCH_SIZE
) -> DataFrame:
    """Per service, environment and tumbling window: requests, errors, latencies, the last request.

    Every aggregate is mergeable, so state is one small row per group and window, and tasks combine
    before the shuffle. Latencies are a quantile sketch of fixed size (``latency_sketch``; see
    ``latency_percentiles`` and ``merge_health``). Works on a stream, where rows that come later
    than ``late`` are dropped, and on a batch table.
    """
    timed = spans.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return (
        timed.groupBy(F.window(ts, window).alias("window"), "service", "env")
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if("is_error").alias("total_errors"),
            F.sum("duration_ns").alias("duration_sum_ns"),
            F.max("duration_ns").alias("duration_max_ns"),
            F.expr(f"kll_sketch_agg_bigint(duration_ns, {int(k)})").alias("latency_sketch"),
            F.max(ts).alias("last_seen"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "service",
            "env",
            "total_requests",
            "total_errors",
            "duration_sum_ns",
            "duration_max_ns",
            "latency_sketch",
            "last_seen",
        )
    )


def latency_percentiles(health: DataFrame) -> DataFrame:
    """The 50th, 95th and 99th percentile of each row's sketch in its place, NULL without values.

    A percentile is the smallest value whose rank reaches the wanted share (nearest rank).
    """
    wanted = ", ".join(f"{p}D" for p in LATENCIES.values())
    has_values = F.expr("kll_sketch_get_n_bigint(latency_sketch) > 0")
    found = F.when(has_values, F.expr(f"kll_sketch_get_quantile_bigint(latency_sketch, array({wanted}))"))
    places = {name: F.get("_found", F.lit(i)) for i, name in enumerate(LATENCIES)}
    return health.withColumn("_found", found).withColumns(places).drop("_found", "latency_sketch")


def merge_health(health: DataFrame, window: str, k: int = SKETCH_SIZE) -> DataFrame:
    """Longer windows from shorter ones: counts add up and sketches merge; no request is read again."""
    return (
        health.groupBy(F.window("window_start", window).alias("window"), "service", "env")
        .agg(
            F.sum("total_requests").alias("total_requests"),
            F.sum("total_errors").alias("total_errors"),
            F.sum("duration_sum_ns").alias("duration_sum_ns"),
            F.max("duration_max_ns").alias("duration_max_ns"),
            F.expr(f"kll_merge_agg_bigint(latency_sketch, {int(k)})").alias("latency_sketch"),
            F.max("last_seen").alias("last_seen"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *[c for c in health.columns if c not in ("window_start", "window_end", "is_open")],
        )
    )


def latency_counts(spans: DataFrame, window: str = "15 minutes", ts: str = "ts") -> DataFrame:
    """Requests and errors per service, environment, tumbling window and latency.

    Where a sketch is not exact enough: windows of these rows merge exactly (``merge_counts``).
    """
    timed = spans.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        timed.groupBy(F.window(ts, window).alias("window"), "service", "env", "duration_ns")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"))
        .select(F.col("window.start").alias("window_start"), "service", "env", "duration_ns", "requests", "errors")
    )


def merge_counts(counts: DataFrame, window: str) -> DataFrame:
    """Health of longer windows from ``latency_counts``, with exact percentiles (nearest rank)."""
    longer = counts.withColumn("_w", F.window("window_start", window)).withColumns(
        {"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}
    )
    sums = {
        "total_requests": F.col("requests"),
        "total_errors": F.col("errors"),
        "duration_sum_ns": F.col("duration_ns") * F.col("requests"),
    }
    keys = ["window_start", "window_end", "service", "env"]
    shares = {"duration_max_ns": 1.0, **LATENCIES}
    return skew.percentiles(longer, keys, "duration_ns", shares, sums, weight="requests", nearest=True)


def drain_windows(
    stream: DataFrame, name: str, keys: Sequence[str], late: str = "10 minutes", folder: str | None = None
) -> DataFrame:
    """Run a windowed aggregation over the input available now; the last state of every window.

    Each batch writes the windows that it changed to a folder of its own, which a repeated batch
    overwrites. A window whose end the watermark has not passed is marked ``is_open``: further
    rows may change it in a later run with the same ``folder``. ``keys`` identify a window, its
    ``window_end`` and ``last_seen`` tell how far it and the stream have come.
    """
    spark = stream.sparkSession
    base = folder or scratch_dir(spark, name)
    _empty(spark, stream.schema, f"{base}/data/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(schema).parquet(f"{base}/data")
    values = [c for c in stream.columns if c not in keys]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    found = latest.select(*keys, "_last.*").select(*stream.columns)
    newest = written.agg(F.date_trunc("millisecond", F.max("last_seen"))).scalar()
    return found.withColumn("is_open", F.col("window_end") > newest - F.expr(f"INTERVAL {late}"))


# -- request cache ------------------------------------------------------------


def replay(
    opened: tuple[int, int] | None, times: np.ndarray, ttl: int, until: int
) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Answer requests in order of time: (entries that ended by ``until``, the entry still open).

    An entry is (time of the request that opened it, requests that it answered, that one included);
    it answers requests up to ``ttl`` after its opening, the very moment included.
    """
    ended: list[tuple[int, int]] = []
    at = 0
    while at < len(times):
        if opened is None or times[at] > opened[0] + ttl:
            if opened:
                ended.append(opened)
            opened = (int(times[at]), 0)
        stop = int(np.searchsorted(times, opened[0] + ttl, "right"))
        opened = (opened[0], opened[1] + stop - at)
        at = stop
    if opened and opened[0] + ttl <= until:
        ended.append(opened)
        opened = None
    return ended, opened


_ENTRY = T.StructType().add("opened_us", T.LongType()).add("requests", T.LongType())
_TIMES = T.StructType().add("times", T.BinaryType())


class RequestCache(StatefulProcessor):
    """Keyed cache entries with event-time timers.

    Requests wait in state until the watermark has passed them and are then answered in order of
    time. So the entries depend on the requests alone, not on how they arrive or are cut into
    batches. What waits for a key is bounded by the watermark's delay; each batch adds one value.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _TIMES)
        self.opened = handle.getValueState("opened", _ENTRY)

    def handleInputRows(  # noqa: N802
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        times = np.concatenate([part["us"].to_numpy(np.int64) for part in rows])
        self.waiting.appendValue((times.tobytes(),))
        self._wake(int(times.min()))
        return iter(())

    def handleExpiredTimer(  # noqa: N802
        self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        times = _times(value[0] for value in self.waiting.get())
        ready = int(np.searchsorted(times, until, "right"))
        before = tuple(self.opened.get()) if self.opened.exists() else None
        ended, opened = replay(before, times[:ready], self.ttl, until)
        if opened:
            self.opened.update(opened)
            self._wake(opened[0] + self.ttl)
        else:
            self.opened.clear()
        if ready < len(times):
            self.waiting.put([(times[ready:].tobytes(),)])
            self._wake(int(times[ready]))
        elif len(times):
            self.waiting.clear()
        if ended:
            yield _entries(key[0], ended)

    def _wake(self, micros: int) -> None:
        """Run when the watermark has reached a time."""
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


def _times(parts: Iterator[bytes]) -> np.ndarray:
    found = [np.frombuffer(part, np.int64) for part in parts]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _entries(request: str, entries: list[tuple[int, int]]) -> pd.DataFrame:
    found = pd.DataFrame(entries, columns=["opened_us", "requests"])
    found.insert(0, "request", request)
    return found


def stream_latest_offers(
    requests: DataFrame, ts: str = "ts", ttl_seconds: int = 300, delay: str = "10 minutes"
) -> DataFrame:
    """A request cache: the first request of a key opens an entry that answers it for ``ttl_seconds``.

    ``requests`` has REQUEST_KEYS, any of them NULL, and a time. Entries come out once the watermark,
    ``delay`` behind the newest request, has passed their end; ``drain_requests`` also returns those
    still open.
    """
    keyed = requests.withColumns({"query": F.lower(F.trim("query")), ts: F.col(ts).cast("timestamp")})
    whole = F.struct(*REQUEST_KEYS)
    # One text without NULL as the key: it means the same to Spark, to pandas and to the state.
    keyed = keyed.withWatermark(ts, delay).select(
        F.to_json(whole, {"ignoreNullFields": "false"}).alias("request"), ts, F.unix_micros(ts).alias("us")
    )
    schema = T.StructType([keyed.schema["request"], *_ENTRY.fields])
    entries = keyed.groupBy("request").transformWithStateInPandas(
        RequestCache(ttl_seconds * 1_000_000), schema, "append", "eventTime"
    )
    kinds = T.StructType([f for f in requests.select(*REQUEST_KEYS).schema.fields])
    return entries.select(F.from_json("request", kinds).alias("k"), *_ENTRY.names).select("k.*", *_ENTRY.names)


def drain_requests(
    stream: DataFrame, name: str = "requests", ttl_seconds: int = 300, folder: str | None = None
) -> DataFrame:
    """Run ``stream_latest_offers`` over the input available now; ended and open entries.

    Ended entries are read from the stream's output, open ones from its state, where requests that
    the watermark has not passed are waiting: they are answered in order here, without touching
    the state, so a later run with the same ``folder`` goes on as if nothing had been read.
    """
    spark = stream.sparkSession
    base = folder or scratch_dir(spark, name)
    with _keyed_state(spark):
        ended = drain(stream, name, folder=base)
    keys = list(REQUEST_KEYS)
    found = ended.withColumn("is_open", F.lit(False))
    if _exists(spark, f"{base}/progress/state"):
        found = found.unionByName(_open_requests(spark, f"{base}/progress", stream.select(*keys).schema, ttl_seconds))
    opened = F.timestamp_micros("opened_us").alias("opened_at")
    return found.select(*keys, opened, "requests", "is_open")


def _open_requests(spark: SparkSession, progress: str, kinds: T.StructType, ttl_seconds: int) -> DataFrame:
    def state(variable: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", variable).load(progress)

    request, none = F.col("key.request").alias("request"), F.lit(None)
    waiting = state("waiting").select(
        request, F.col("list_element.times").alias("times"), *[none.cast("bigint").alias(n) for n in _ENTRY.names]
    )
    opened = state("opened").select(request, none.cast("binary").alias("times"), "value.*")
    ttl = ttl_seconds * 1_000_000

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = _times(t for t in rows["times"] if t is not None)
        entry = rows.dropna(subset=["opened_us"])[_ENTRY.names].astype("int64")
        before = tuple(entry.iloc[0].tolist()) if len(entry) else None
        ended, last = replay(before, times, ttl, -(2**63))
        return _entries(key[0], [*ended, *([last] if last else [])])

    schema = T.StructType([waiting.schema["request"], *_ENTRY.fields])
    found = waiting.unionByName(opened).groupBy("request").applyInPandas(answer, schema)
    found = found.select(F.from_json("request", kinds).alias("k"), *_ENTRY.names, F.lit(True).alias("is_open"))
    return found.select("k.*", *_ENTRY.names, "is_open")


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the store on disk; the session's own setting comes back after the run."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


# -- contract check -----------------------------------------------------------


def stream_contract_check(offers: DataFrame, contracts: DataFrame, key: str = "ean") -> DataFrame:
    """Arriving offers against static contract prices of the same article (stateless)."""
    joined = offers.join(contracts, key)
    contract, market = F.col("contract_price_cents"), F.col("total_cents")
    return joined.withColumn("price_difference_cents", contract - market).withColumn(
        "verdict", market_verdict(contract, market)
    )


# -- running ------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _empty(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """A table without rows, so that a stream without input has a result."""
    if not _exists(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def drain(stream: DataFrame, name: str, partition_by: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """Run a stream over the input available now and return all that it has written.

    Output and progress go to ``folder``, which must be shared by all executors: a later call with
    the same folder resumes from the last committed batch, with its state and open windows.
    Without one, a fresh folder below ``spark.checkpoint.dir`` serves this call alone.
    """
    spark: SparkSession = stream.sparkSession
    base = folder or scratch_dir(spark, name)
    _empty(spark, stream.schema, f"{base}/data")
    writer = stream.writeStream.outputMode("append").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = (
        writer.option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")
