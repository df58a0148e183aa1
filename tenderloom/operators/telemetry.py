"""Telemetry: search, facets, counts, series summaries, service health, SLOs, usage."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions.money import div_half_up
from tenderloom.operators import skew

# Most facets of one aggregation, length of the lists whose feature is a top-n.
MAX_FACETS = 4
TOP_VALUES = 25
SAMPLE_POINTS = 20

PERCENTILES = {"pc75": 0.75, "pc90": 0.90, "pc95": 0.95, "pc99": 0.99}

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


# -- search -------------------------------------------------------------------


def time_point(when: str | int, as_of: Column) -> Column:
    """``now``, ``now-15m``, seconds before ``as_of`` or an ISO timestamp -> timestamp column."""
    if isinstance(when, int):
        return as_of - F.expr(f"INTERVAL {when} SECONDS")
    relative = re.fullmatch(r"now(?:-(\d+)([smhdw]))?", when)
    if not relative:
        return F.lit(when).cast("timestamp_ntz")
    amount, unit = relative.groups()
    return as_of - F.expr(f"INTERVAL {amount} {_UNITS[unit]}") if amount else as_of


def time_window(
    df: DataFrame,
    ts: str,
    from_time: str | int,
    to_time: str | int,
    as_of: str,
) -> DataFrame:
    """Rows with ``from_time <= ts <= to_time``; ``as_of`` stands for the current time."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return df.filter(F.col(ts).between(time_point(from_time, now), time_point(to_time, now)))


def search_records(
    df: DataFrame,
    where: Column | str | None = None,
    from_time: str | int = "now-1h",
    to_time: str | int = "now",
    as_of: str | None = None,
    ts: str = "ts",
    sort: str | None = None,
    descending: bool = True,
    tie_break: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Predicate and time range, sorted; exactly the first ``limit`` rows if one is given.

    Filters reach the scan; sort and limit run as a distributed top-k.
    """
    found = df if as_of is None else time_window(df, ts, from_time, to_time, as_of)
    if where is not None:
        found = found.filter(where)
    key = F.col(sort or ts)
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return at_most(found.orderBy(order, *tie_break), limit)


def at_most(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows; all without a limit."""
    if limit is not None and limit < 0:
        raise ValueError(f"a limit of {limit} rows")
    return df if limit is None else df.limit(limit)


def title_contains(df: DataFrame, text: str, column: str = "title") -> DataFrame:
    """Case-insensitive substring filter; a missing title never matches a non-empty text."""
    return df.filter(
        F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(text.lower()))
    )


def page_of(
    df: DataFrame, order_by: Sequence[Column], page: int = 1, page_size: int = 25
) -> DataFrame:
    """One page (counted from 1) with ``total_count`` and ``has_more``.

    The total is a scalar subquery over the unsorted rows.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order_by).offset((page - 1) * page_size).limit(page_size)
    return rows.select("*", total.alias("total_count")).withColumn(
        "has_more", F.lit(page * page_size) < F.col("total_count")
    )


# -- counting and facets ------------------------------------------------------


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per key value; missing keys, empty texts, 0 and false count as ``unknown``."""
    field = df.schema[key].dataType
    value = F.nullif(F.col(key).cast("string"), F.lit(""))
    if isinstance(field, (T.NumericType, T.BooleanType)):
        value = F.when(F.col(key).cast("double") != 0, value)
    value = F.coalesce(value, F.lit("unknown"))
    return df.groupBy(value.alias(key)).agg(F.count(F.lit(1)).alias("count"))


def counts_text(counts: DataFrame, key: str) -> DataFrame:
    """Counts as one line ``key: n, key: n`` in key order (meant for few distinct keys)."""
    entry = F.concat_ws(": ", F.col(key), F.col("count").cast("string"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), entry.alias("e"))))
    return counts.agg(F.array_join(F.transform(entries, lambda x: x["e"]), ", ").alias("counts"))


def _facet_values(
    rows: DataFrame, keys: list[str], metric: str | None, fn: str
) -> DataFrame:
    if fn in PERCENTILES:
        found = skew.percentiles(rows, keys, metric, {"value": PERCENTILES[fn]})
        # Without the noise of interpolation equal values tie and fall back to facet order.
        return found.withColumn("value", F.round("value", 6))
    counted = F.lit(1) if metric is None else F.col(metric)
    functions = {
        "total": F.count(counted) if metric is None else F.sum(counted),
        "count": F.count(counted),
        "avg": F.avg(counted),
        "min": F.min(counted),
        "max": F.max(counted),
        "cardinality": F.countDistinct(counted),
    }
    return rows.groupBy(*keys).agg(functions[fn].alias("value"))


def facet_aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    metric: str | None = None,
    fn: str = "count",
    values_per_facet: int | None = None,
    max_buckets: int | None = None,
) -> DataFrame:
    """Aggregate by up to four facets; all buckets unless limits are given.

    With ``values_per_facet`` the first facet keeps its largest values, each of these the
    largest values of the second facet, and so on, and the values kept at one level filter the
    rows of the next one before they are aggregated. ``max_buckets`` keeps the largest buckets.
    """
    facets = list(group_by)
    if not 1 <= len(facets) <= MAX_FACETS:
        raise ValueError(f"between 1 and {MAX_FACETS} facets")
    rows = df.withColumns(
        {
            facet: F.coalesce(F.nullif(F.col(facet).cast("string"), F.lit("")), F.lit("unknown"))
            for facet in facets
        }
    ).select(*facets, *([metric] if metric else []))
    kept = None
    for depth in range(len(facets) if values_per_facet is None else 1, len(facets) + 1):
        keys = facets[:depth]
        if values_per_facet is None:
            kept = _facet_values(rows, keys, metric, fn)
            break
        if kept is not None:
            rows = rows.join(kept.select(*keys[:-1]), keys[:-1], "left_semi")
        order = [F.desc_nulls_last("value"), F.col(keys[-1])]
        valued = _facet_values(rows, keys, metric, fn)
        if depth == 1:
            kept = valued.orderBy(*order).limit(values_per_facet)
        else:
            kept = skew.first_rows(valued, keys[:-1], order, values_per_facet).drop("row_no")
    return at_most(kept.orderBy(F.desc_nulls_last("value"), *facets), max_buckets)


#: Size of the sketches of ``facet_levels``: ranks within 0.6 %.
RANK_SIZE = 800


def facet_levels(df: DataFrame, group_by: Sequence[str], measures: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Aggregates at every level of up to four facets, read from the source once.

    ``measures`` names results: ``(function, column)`` with the functions of ``facet_aggregate``
    (``("count", None)`` counts rows). Rows combine per finest group first, in the map task and
    after one shuffle; the upper levels are grouping sets over those partial results. ``level`` is
    the number of facets that a row keeps, further facets are NULL (a missing value is ``unknown``).
    Sums, counts, means, extremes and distinct counts are exact: with a distinct count, the finest
    groups keep its values apart, and each level counts them spread by value. Percentiles come from
    mergeable sketches: exact for small groups, else within the stated error.
    """
    facets = list(group_by)
    if not 1 <= len(facets) <= MAX_FACETS:
        raise ValueError(f"between 1 and {MAX_FACETS} facets")
    known = {
        facet: F.coalesce(F.nullif(F.col(facet).cast("string"), F.lit("")), F.lit("unknown")) for facet in facets
    }
    columns = list(dict.fromkeys(c for _, c in measures.values() if c is not None))
    values = {f"_c_{k}": F.col(c) for k, c in enumerate(columns)}
    rows = df.select(*[c.alias(f"_f_{k}") for k, c in enumerate(known.values())], *[c.alias(n) for n, c in values.items()])
    names = [f"_f_{k}" for k in range(len(facets))]
    partial: dict[str, Column] = {}
    merged: dict[str, Column] = {}
    apart: list[str] = []

    def part(name: str, first: Column, again: Column) -> Column:
        partial[name], merged[name] = first, again
        return F.col(name)

    def added(name: str, first: Column) -> Column:
        return part(name, first, F.sum(name))

    results = {}
    for name, (fn, column) in measures.items():
        if column is None:
            if fn not in ("count", "total"):
                raise ValueError(f"{fn} needs a column")
            results[name] = added("_rows", F.count(F.lit(1)))
            continue
        c = f"_c_{columns.index(column)}"
        if fn == "count":
            results[name] = added(f"_n{c}", F.count(c))
        elif fn == "total":
            results[name] = added(f"_s{c}", F.sum(c))
        elif fn == "avg":
            results[name] = F.try_divide(added(f"_s{c}", F.sum(c)), added(f"_n{c}", F.count(c)))
        elif fn in ("min", "max"):
            extreme = getattr(F, fn)
            results[name] = part(f"_{fn}{c}", extreme(c), extreme(f"_{fn}{c}"))
        elif fn == "cardinality":
            if c not in apart:
                apart.append(c)
            merged[f"_d{c}"] = F.count_distinct(c)
            results[name] = F.col(f"_d{c}")
        elif fn in PERCENTILES:
            first = F.expr(f"kll_sketch_agg_double(cast({c} AS DOUBLE), {RANK_SIZE})")
            part(f"_q{c}", first, F.expr(f"kll_merge_agg_double(_q{c}, {RANK_SIZE})"))
            has_values = F.expr(f"kll_sketch_get_n_double(_q{c}) > 0")
            results[name] = F.when(has_values, F.expr(f"kll_sketch_get_quantile_double(_q{c}, {PERCENTILES[fn]}D)"))
        else:
            raise ValueError(f"unknown function {fn}")
    # Counting rows in any case, because an aggregation needs a result.
    partial.setdefault("_rows", F.count(F.lit(1)))
    finest = rows.groupBy(*names, *apart).agg(*[c.alias(n) for n, c in partial.items()])
    levels = finest.rollup(*names).agg(
        F.grouping_id().alias("_gone"), *[c.alias(f"_all{n}") for n, c in merged.items()]
    ).withColumnsRenamed({f"_all{n}": n for n in merged})
    # The rollup of n facets drops them from the right: 2**k - 1 says that k are gone.
    level = F.lit(len(facets)) - F.bit_count("_gone")
    shown = [F.col(n).alias(facet) for n, facet in zip(names, facets, strict=True)]
    return levels.select(level.alias("level"), *shown, *[c.alias(n) for n, c in results.items()])


def top_facets(
    counts: DataFrame, facet: Sequence[str], value: str, tie_break: str, n: int = TOP_VALUES
) -> DataFrame:
    """The ``n`` largest rows of each facet."""
    order = [F.desc_nulls_last(value), F.col(tie_break)]
    return skew.first_rows(counts, facet, order, n).withColumnRenamed("row_no", "facet_rank")


def dedup_first(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], drop_empty: bool = True
) -> DataFrame:
    """First row per key in the given order; rows with an empty key are dropped."""
    kept = df
    if drop_empty:
        given = [F.coalesce(F.col(key).cast("string"), F.lit("")) != "" for key in keys]
        kept = kept.filter(reduce(lambda a, b: a & b, given))
    return skew.first_rows(kept, keys, order_by, 1).drop("row_no")


def with_fallback(primary: DataFrame, secondary: DataFrame, key: Sequence[str]) -> DataFrame:
    """Primary rows, plus secondary rows for the keys primary has nothing for."""
    known = primary.select(*key).distinct()
    return primary.unionByName(
        secondary.join(known, list(key), "left_anti"), allowMissingColumns=True
    )


# -- metric series ------------------------------------------------------------


def explode_points(series: DataFrame, points: str = "pointlist") -> DataFrame:
    """``array<array<double>>`` point lists -> one row ``(…, point_no, ts, value)`` per point."""
    others = [c for c in series.columns if c != points]
    return series.select(*others, F.posexplode(points).alias("point_no", "_point")).select(
        *others,
        "point_no",
        F.get("_point", F.lit(0)).cast("bigint").alias("ts"),
        F.get("_point", F.lit(1)).alias("value"),
    )


def first_points(points: DataFrame, series: Sequence[str], order_by: Sequence[Column], n: int = SAMPLE_POINTS) -> DataFrame:
    """The first ``n`` points of each series."""
    return skew.first_rows(points, series, order_by, n).withColumnRenamed("row_no", "point_rank")


def summarize_series(points: DataFrame, series: Sequence[str]) -> DataFrame:
    """Per series: number of points (NULL values included) and mean of the given values, else 0.

    Decimal values are summed exactly and divided once.
    """
    mean = F.try_divide(F.sum("value").cast("double"), F.count("value"))
    return points.groupBy(*series).agg(
        F.count(F.lit(1)).alias("point_count"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_value"),
    )


def list_metrics(series: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """The metric names with a prefix, in name order; exactly the first ``limit`` if one is given."""
    names = series.filter(F.startswith("metric", F.lit(prefix))).select("metric").distinct()
    return at_most(names.orderBy("metric"), limit)


def tag_keys(df: DataFrame, by: Sequence[str], tags: str = "tags") -> DataFrame:
    """Tag keys in use, one row per key with its number of distinct values."""
    tag = df.select(*by, F.explode(tags).alias("_tag"))
    return (
        tag.select(*by, F.substring_index("_tag", ":", 1).alias("tag_key"), "_tag")
        .groupBy(*by, "tag_key")
        .agg(F.countDistinct("_tag").alias("tag_values"))
    )


def host_tags(hosts: DataFrame) -> DataFrame:
    """Tags of every host, flattened from ``tags_by_source``."""
    by_source = hosts.select("name", F.explode("tags_by_source").alias("source", "_tags"))
    return by_source.select("name", "source", F.explode("_tags").alias("tag"))


# -- service health and SLOs --------------------------------------------------


def service_health(
    spans: DataFrame,
    window_seconds: int = 900,
    as_of: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Golden signals per service and environment.

    Latency percentiles in milliseconds (exact), request rate, number of requests and
    error rate over the window before ``as_of`` (or over all rows given). Counts are true
    sums over spans.
    """
    recent = spans if as_of is None else time_window(spans, ts, window_seconds, "now", as_of)
    keys = ["service", "env"]
    counts = {"total_requests": F.lit(1), "total_errors": F.coalesce(F.col("is_error").cast("int"), F.lit(0))}
    signals = skew.percentiles(
        recent, keys, "duration_ns", {"p50": 0.50, "p95": 0.95, "p99": 0.99}, counts
    )
    requests, errors = F.col("total_requests"), F.col("total_errors")
    return signals.select(
        *keys,
        *[
            (div_half_up(F.round(F.col(p)).cast("bigint"), F.lit(10_000)) / F.lit(100.0)).alias(
                f"{p}_ms"
            )
            for p in ("p50", "p95", "p99")
        ],
        (div_half_up(requests * 100, F.lit(window_seconds)) / F.lit(100.0)).alias(
            "requests_per_second"
        ),
        "total_requests",
        (div_half_up(errors * 10000, requests) / F.lit(100.0)).alias("error_rate_percent"),
        "total_errors",
    )


def slo_report(
    events: DataFrame, by: Sequence[str], target: float = 99.9, as_of: str | None = None,
    window_days: int = 30, ts: str = "ts",
) -> DataFrame:
    """SLI and remaining error budget per group from ``good`` and ``total`` counts.

    ``sli = 100 * good / total``; the budget left is ``100 * (1 - (100 - sli) / (100 - target))``,
    the usual definition (the remote service behind the original computes it).
    """
    rows = events
    if as_of is not None:
        rows = time_window(rows, ts, f"now-{int(window_days)}d", "now", as_of)
    sums = rows.groupBy(*by).agg(F.sum("good").alias("good"), F.sum("total").alias("total"))
    sli = F.try_divide(F.lit(100.0) * F.col("good"), F.col("total"))
    return sums.withColumn("sli_percent", sli).withColumn(
        "error_budget_remaining_percent",
        F.lit(100.0) * (F.lit(1.0) - (F.lit(100.0) - F.col("sli_percent")) / F.lit(100.0 - target)),
    )


def slo_windows(
    events: DataFrame,
    by: Sequence[str],
    target: float = 99.9,
    windows: Sequence[int] = (7, 30, 90),
    ts: str = "ts",
) -> DataFrame:
    """SLI and remaining error budget of several trailing windows, per group and day.

    The events are read once: ``good`` and ``total`` are summed per group and day before the shuffle,
    and every window is a running sum over those days, so a group of any size takes one row per day.
    A window of n days ends with its day; days without events neither have a row nor add to a window.
    """
    day = F.to_date(ts)
    daily = events.groupBy(*by, day.alias("day")).agg(F.sum("good").alias("good"), F.sum("total").alias("total"))
    number = F.unix_date("day")
    columns = {}
    for days in windows:
        trailing = Window.partitionBy(*by).orderBy(number).rangeBetween(1 - int(days), 0)
        good, total = F.sum("good").over(trailing), F.sum("total").over(trailing)
        sli = F.try_divide(F.lit(100.0) * good, total)
        columns |= {
            f"total_{days}d": total,
            f"sli_percent_{days}d": sli,
            f"error_budget_percent_{days}d": F.lit(100.0) * (F.lit(1.0) - (F.lit(100.0) - sli) / F.lit(100.0 - target)),
        }
    return daily.select("*", *[c.alias(name) for name, c in columns.items()])


# -- hosts, tests, usage, cost ------------------------------------------------


def host_status(hosts: DataFrame) -> DataFrame:
    up = F.coalesce(F.col("up"), F.lit(False))
    return hosts.agg(
        F.count_if(up).alias("up"),
        F.count_if(~up).alias("down"),
        F.count(F.lit(1)).alias("total"),
    )


def synthetic_pass_rate(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Passed (status 0) and failed results per test."""
    passed = F.count_if(F.coalesce(F.col("status") == 0, F.lit(False)))
    return (
        results.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("results"), passed.alias("passed"))
        .withColumn("failed", F.col("results") - F.col("passed"))
    )


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Measurements summed by product family, usage type and hour."""
    rows = usage.select("product_family", "timestamp", F.explode("measurements").alias("m"))
    return rows.groupBy(
        "product_family",
        F.col("m.usage_type").alias("usage_type"),
        F.date_trunc("hour", "timestamp").alias("hour"),
    ).agg(F.sum("m.value").alias("value"))


def product_families(usage: DataFrame) -> DataFrame:
    """Distinct product families and their number of records."""
    given = usage.filter(F.coalesce("product_family", F.lit("")) != "")
    return given.groupBy("product_family").agg(F.count(F.lit(1)).alias("records"))


def cost_rollup(cost: DataFrame) -> DataFrame:
    """Charges summed by organisation, date, product and charge type."""
    rows = cost.select("org_name", "date", F.explode("charges").alias("c"))
    return rows.groupBy(
        "org_name",
        "date",
        F.col("c.product_name").alias("product_name"),
        F.col("c.charge_type").alias("charge_type"),
    ).agg(F.sum("c.cost_cents").alias("cost_cents"))


# -- broker resources ---------------------------------------------------------

SEVERITIES = ("resource_exhaustion", "high_queue_depth", "zero_consumers", "healthy")


def resource_severity(
    resources: DataFrame, spool_percent: float, depth: int
) -> DataFrame:
    """Add ``severity`` to queue rows; thresholds are the caller's."""
    spool, limit = F.col("msgSpoolUsage"), F.col("maxMsgSpoolUsage")
    exhausted = F.coalesce(spool * 100 >= limit * F.lit(spool_percent), F.lit(False)) & (limit > 0)
    deep = F.coalesce(F.col("spooledMsgCount") >= depth, F.lit(False))
    idle = F.coalesce(F.col("consumerCount"), F.lit(0)) == 0
    return resources.withColumn(
        "severity",
        F.when(exhausted, SEVERITIES[0])
        .when(deep, SEVERITIES[1])
        .when(idle, SEVERITIES[2])
        .otherwise(SEVERITIES[3]),
    )


def severity_rank(severity: Column) -> Column:
    return reduce(
        lambda rank, item: F.when(severity == item[1], F.lit(item[0])).otherwise(rank),
        enumerate(SEVERITIES),
        F.lit(len(SEVERITIES)),
    )


def health_rollup(resources: DataFrame, spool_percent: float, depth: int) -> DataFrame:
    """Number of resources per severity."""
    rated = resource_severity(resources, spool_percent, depth)
    return rated.groupBy("severity").agg(F.count(F.lit(1)).alias("resources"))


def anomalies(resources: DataFrame, spool_percent: float, depth: int) -> DataFrame:
    """Only the rows that are not healthy; sort by ``severity_rank`` at the sink."""
    rated = resource_severity(resources, spool_percent, depth)
    return rated.filter(F.col("severity") != SEVERITIES[-1]).withColumn(
        "severity_rank", severity_rank(F.col("severity"))
    )


# Columns kept per record category.
KEPT_FIELDS: Mapping[str, tuple[str, ...]] = {
    "queue": (
        "queueName",
        "msgVpnName",
        "accessType",
        "durable",
        "ingressEnabled",
        "egressEnabled",
        "spooledMsgCount",
        "msgSpoolUsage",
        "msgSpoolPeakUsage",
        "maxMsgSpoolUsage",
        "maxMsgSize",
        "maxBindCount",
        "bindCount",
        "consumerCount",
        "averageRxMsgRate",
        "averageTxMsgRate",
        "lowPriorityMsgCongestionState",
        "deadMsgQueue",
        "deletedMsgCount",
    ),
    "client": (
        "clientName",
        "msgVpnName",
        "clientAddress",
        "clientUsername",
        "clientProfileName",
        "aclProfileName",
        "platform",
        "uptime",
        "slowSubscriber",
        "averageRxMsgRate",
        "averageTxMsgRate",
        "dataRxMsgCount",
        "dataTxMsgCount",
    ),
    "vpn": (
        "msgVpnName",
        "enabled",
        "state",
        "failureReason",
        "maxConnectionCount",
        "maxMsgSpoolUsage",
        "msgSpoolUsage",
        "msgSpoolMsgCount",
        "connectionCount",
        "subscriptionCount",
        "averageRxMsgRate",
        "averageTxMsgRate",
        "rxMsgRate",
        "txMsgRate",
        "maxEndpointCount",
        "maxSubscriptionCount",
        "dmrEnabled",
        "replicationEnabled",
        "replicationRole",
    ),
    "flow": (
        "flowId",
        "queueName",
        "clientName",
        "msgVpnName",
        "activityState",
        "ackedMsgCount",
        "unackedMsgCount",
        "bindTime",
        "windowSize",
    ),
    "conn": (
        "clientName",
        "clientAddress",
        "msgVpnName",
        "uptime",
        "state",
        "ssl",
    ),
    "product": (
        "ean",
        "title",
        "brand",
        "category",
        "description",
        "model",
        "color",
        "size",
        "weight",
        "lowest_recorded_price",
        "highest_recorded_price",
        "upc",
        "asin",
        "elid",
    ),
}


def keep_fields(df: DataFrame, category: str) -> DataFrame:
    """Only the known columns of a category; product texts that are empty become NULL."""
    kept = [c for c in df.columns if c in KEPT_FIELDS[category]]
    if category != "product":
        return df.select(*kept)
    texts = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(
        *[
            F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if c in texts else F.col(c)
            for c in kept
        ]
    )
