"""Building blocks that keep a hot key from landing in one task.

A key may hold a large share of all rows. Plain ``row_number`` or ``percentile`` sorts or
collects the whole group in one task. ``percentiles`` always works on value frequencies.
The other helpers count rows per key first (one partially aggregated pass over the key
columns); ordinary keys take the plain Spark operator, keys beyond the limit are cut by value
and put together exactly, with equal results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions.money import int_div

# Rows of one key that one join task should meet at most (session setting, default).
ROWS_PER_SPLIT = ("spark.tenderloom.rowsPerSplit", 2_000_000)

# Rows of one key that one task may sort or collect (session setting, default).
ROWS_IN_TASK = ("spark.tenderloom.rowsInTask", 1_000_000)

# Pairs that one join task should meet at most (session setting, default).
PAIRS_PER_SPLIT = ("spark.tenderloom.pairsPerSplit", 2**32)

SPLIT = "_split"
SPLIT_FEW = "_split_few"


def _limit(df: DataFrame, given: int | None, setting: tuple[str, int]) -> int:
    key, default = setting
    return given or int(df.sparkSession.conf.get(key, str(default)))


def first_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key, with their ``row_no``.

    Spark places a window group limit below the shuffle for this shape, so a task
    forwards at most ``n`` rows per key and a hot key stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("row_no", F.row_number().over(window).cast("bigint")).filter(
        F.col("row_no") <= n
    )


def _solid_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """Stand-ins without NULLs for the key columns: ``(df, stand-ins, original keys)``.

    Grouping, windows and joins on the stand-ins treat NULL as one more key value and,
    unlike ``<=>``, all share one hash partitioning.
    """
    added, stand_ins, originals = {}, [], []
    for key in keys:
        field = df.schema[key]
        if not field.nullable:
            stand_ins.append(key)
            originals.append(F.col(key))
            continue
        blank = "" if isinstance(field.dataType, T.StringType) else "1970-01-01"
        if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            blank = 0
        value, missing = f"_v_{key}", f"_m_{key}"
        added[value] = F.coalesce(F.col(key), F.lit(blank).cast(field.dataType))
        added[missing] = F.col(key).isNull()
        stand_ins += [value, missing]
        originals.append(F.when(~F.col(missing), F.col(value)).alias(key))
    return df.withColumns(added), stand_ins, originals


def parted_by_heat(
    df: DataFrame,
    keys: Sequence[str],
    limit: int | None = None,
    sized_by: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of keys with more than ``limit`` rows.

    The list of hot keys has at most ``rows / limit`` entries, so broadcasting it is safe.
    ``sized_by`` may name a table that is cheaper to count and has at least as many rows
    per key; ``sizes`` gives the counts themselves, one row a key with its ``_rows``.
    """
    limit = _limit(df, limit, ROWS_IN_TASK)
    if sizes is None:
        sizes = (df if sized_by is None else sized_by).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = F.broadcast(sizes.filter(F.col("_rows") > limit).select(*keys))
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def numbered_rows(
    df: DataFrame,
    keys: Sequence[str],
    split_by: Sequence[Column],
    order_by: Sequence[Column],
    name: str,
    sized_by: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Exact ``row_number`` per key; hot keys are numbered in pieces.

    ``split_by`` are integers and must be monotone in the wanted order: ordering by
    ``split_by`` and then ``order_by`` has to equal ordering by ``order_by`` alone. A piece
    is one (key, split) group; it is numbered on its own and shifted by the row count of
    the pieces before it, which comes from a pre-aggregated table.
    """
    columns = df.columns
    solid, group, _ = _solid_keys(df, keys)
    if sized_by is not None:
        sized_by = _solid_keys(sized_by, keys)[0]
    ordinary, hot = parted_by_heat(solid, group, limit, sized_by)
    whole = Window.partitionBy(*group).orderBy(*order_by)
    plain = ordinary.withColumn(name, F.row_number().over(whole).cast("bigint"))

    # NULL sorts first.
    lowest = F.lit(-(2**63))
    pieces = {
        f"_piece{i}": F.coalesce(split.cast("bigint"), lowest) for i, split in enumerate(split_by)
    }
    cut = hot.withColumns(pieces)
    counts = cut.groupBy(*group, *pieces).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, *pieces, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*group, *pieces).orderBy(*order_by)
    pieced = cut.join(offsets, [*group, *pieces]).withColumn(
        name, F.row_number().over(inside).cast("bigint") + F.col("_offset")
    )
    return plain.select(*columns, name).unionByName(pieced.select(*columns, name))


def value_bucket(value: Column, per_octave: int = 128) -> Column:
    """Monotone bucket number of a numeric value: at most ~16,000 for any BIGINT."""
    size = F.floor(F.log2(F.abs(value).cast("double") + F.lit(1.0)) * F.lit(per_octave))
    return F.when(value < 0, -size).otherwise(size).cast("int")


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    sums: Mapping[str, Column] | None = None,
    weight: str | None = None,
    nearest: bool = False,
) -> DataFrame:
    """Exact interpolated percentiles per key as DOUBLE columns, NULL values left out.

    ``weight`` names a column that tells how many times a row counts. With ``nearest``, a percentile
    is the smallest value whose rank reaches the share (to a millionth), in the type of the values.

    A key without values keeps its row, with NULL percentiles. ``sums`` names further columns
    that are summed per key. The same plan serves every size: (key, value) frequencies combine
    map-side, rows are counted per value bucket, and a running count looks only inside buckets
    that hold a wanted rank, so no task sees a whole key.
    """
    sums = dict(sums or {})
    solid, group, originals = _solid_keys(df, list(keys))
    # NULL values have a bucket of their own, before all others, with no rows to rank.
    number = F.coalesce(value_bucket(F.col(value)), F.lit(-(2**31)).cast("int"))
    weighed = F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(0) if weight else None
    rows = F.sum(weighed) if weight else F.count(value)
    frequencies = solid.groupBy(*group, number.alias("_bucket"), F.col(value).alias("_value")).agg(
        rows.alias("_rows"), *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()]
    )
    by_key = Window.partitionBy(*group)
    earlier = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum("_rows").alias("_bucket_rows")]
    totals += [F.sum(f"_sum_{name}").alias(f"_sum_{name}") for name in sums]
    buckets = (
        frequencies.groupBy(*group, "_bucket")
        .agg(*totals)
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_bucket_rows").over(earlier), F.lit(0)),
                "_total": F.sum("_bucket_rows").over(by_key),
                "_nr": F.row_number().over(by_key.orderBy("_bucket")),
                **{f"_all_{name}": F.sum(f"_sum_{name}").over(by_key) for name in sums},
            }
        )
    )

    def position(p: float) -> Column:
        return (F.col("_total") - 1).cast("double") * F.lit(float(p))

    def nearest_rank(p: float) -> Column:
        million = 1_000_000
        return int_div(F.col("_total") * F.lit(round(p * million)) + F.lit(million - 1), F.lit(million)) - 1

    if nearest:
        ranks = {name: (nearest_rank(p), nearest_rank(p)) for name, p in probabilities.items()}
    else:
        ranks = {name: (F.floor(position(p)), F.ceil(position(p))) for name, p in probabilities.items()}
    last = F.col("_before") + F.col("_bucket_rows")
    # The first bucket carries the key and its sums even if no rank lies in it.
    wanted = F.col("_nr") == 1
    for rank in (r for pair in ranks.values() for r in pair):
        wanted = wanted | ((rank >= F.col("_before")) & (rank < last))
    hits = buckets.filter(wanted).select(*group, "_bucket", "_before", "_total", *[f"_all_{n}" for n in sums])
    running = (
        Window.partitionBy(*group, "_bucket")
        .orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = (
        frequencies.select(*group, "_bucket", "_value", "_rows")
        .join(hits, [*group, "_bucket"])
        .withColumn("_end", F.col("_before") + F.sum("_rows").over(running))
        .withColumn("_start", F.col("_end") - F.col("_rows"))
    )

    def at(rank: Column) -> Column:
        inside = (rank >= F.col("_start")) & (rank < F.col("_end"))
        return F.max(F.when(inside, F.col("_value") if nearest else F.col("_value").cast("double")))

    aggregates = [F.max("_total").alias("_total"), *[F.max(f"_all_{n}").alias(n) for n in sums]]
    for name, (low, high) in ranks.items():
        aggregates += [at(low).alias(f"_low_{name}"), at(high).alias(f"_high_{name}")]
    found = located.groupBy(*group).agg(*aggregates)
    results = []
    for name, (low_rank, high_rank) in ranks.items():
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        if nearest:
            results.append(low.alias(name))
            continue
        place = position(probabilities[name])
        between = (high_rank - place) * low + (place - low_rank) * high
        results.append(F.when(low_rank == high_rank, low).otherwise(between).alias(name))
    return found.select("*", *originals, *results).select(*keys, *sums, *probabilities)


def spread_hot_keys(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    rows_per_split: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Add a ``_split`` join column that cuts hot keys of ``many`` into pieces.

    Only keys with more than ``rows_per_split`` rows are cut, and only their rows
    of ``few`` are repeated. The hot-key table has at most
    ``rows(many) / rows_per_split`` rows, which is what makes broadcasting it safe.
    Join the two results on ``[*keys, "_split"]``.
    """
    rows_per_split = _limit(many, rows_per_split, ROWS_PER_SPLIT)
    hot = (
        many.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows_per_split)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(rows_per_split)).cast("int").alias("_pieces"))
    )
    hot = F.broadcast(hot)
    piece = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_pieces"), F.lit(1)))
    cut = many.join(hot, list(keys), "left").withColumn(SPLIT, piece.cast("int")).drop("_pieces")
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    repeated = (
        few.join(hot, list(keys), "left").withColumn(SPLIT, F.explode(pieces)).drop("_pieces")
    )
    return cut, repeated


def hot_cells(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    rows: int | None = None,
    pairs: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Keys whose join would be too much for one task, with a grid of ``_across`` x ``_down`` cells.

    The rows of both sides are counted together in one aggregation. A key with m rows on one side and
    b on the other makes m * b pairs; ``many`` is cut into ``_across`` pieces and ``few`` into
    ``_down``, so that a cell has at most ``rows`` rows of a side and about ``pairs`` pairs. Both
    sides are cut evenly where both are large, so little is repeated. A key is listed only if a side
    has more than min(rows, sqrt(pairs)) rows, 65,536 by default, which bounds the list for broadcasting.
    ``counted`` may name a table that is cheaper to count and has at least as many rows per key as either.
    """
    rows = _limit(many, rows, ROWS_PER_SPLIT)
    pairs = _limit(many, pairs, PAIRS_PER_SPLIT)
    side = max(1, int(pairs**0.5))
    one, none = F.lit(1), F.lit(0)
    if counted is None:
        both = many.select(*keys, one.alias("_m"), none.alias("_b")).unionByName(
            few.select(*keys, none.alias("_m"), one.alias("_b"))
        )
    else:
        both = counted.select(*keys, one.alias("_m"), one.alias("_b"))
    sizes = both.groupBy(*keys).agg(F.sum("_m").alias("_m"), F.sum("_b").alias("_b"))
    m, b = F.col("_m"), F.col("_b")

    def pieces(own: Column, other: Column) -> Column:
        """The other side whole if it is short, else squares."""
        wanted = F.ceil(own * F.least(other, F.lit(side)) / F.lit(float(pairs)))
        return F.greatest(F.when(own > side, wanted).otherwise(1), F.ceil(own / F.lit(rows))).cast("int")

    sized = sizes.filter((m > 0) & (b > 0)).select(*keys, pieces(m, b).alias("_across"), pieces(b, m).alias("_down"))
    return F.broadcast(sized.filter((F.col("_across") > 1) | (F.col("_down") > 1)))


def dealt_by_work(
    many: DataFrame, few: DataFrame, keys: Sequence[str], many_by: Sequence[str], few_by: Sequence[str], hot: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The rows of the keys that ``hot`` lists, with the join columns ``_split`` and ``_split_few``.

    A row of ``many`` is in one of the pieces across and meets all pieces down, and the other way
    round, so every pair meets in exactly one cell of its key's grid.
    """

    def places(pieces: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(pieces) - 1))

    def place(by: Sequence[str], pieces: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.col(pieces)).cast("int")

    cut = many.join(hot, list(keys)).withColumns({SPLIT: place(many_by, "_across"), SPLIT_FEW: places("_down")})
    met = few.join(hot, list(keys)).withColumn(SPLIT_FEW, place(few_by, "_down")).withColumn(SPLIT, places("_across"))
    return cut.drop("_across", "_down"), met.drop("_across", "_down")
