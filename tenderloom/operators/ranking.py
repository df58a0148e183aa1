"""Positions in a global order, and pages of it, without a task that sees all rows.

Rows are dealt out by ranges of the wanted order and sorted inside their range, once, into a written
table. The number of rows in earlier ranges then comes from one small row per range and group, so a
rank needs neither a window over the whole table nor one over a hot group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.operators.skew import _solid_keys
from tenderloom.session import scratch_dir

#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
ROW_BITS = 33


@dataclass(frozen=True)
class Ordered:
    """A written table in global order, and per range and group: rows, and rows before."""

    rows: DataFrame
    parts: DataFrame
    keys: tuple[str, ...]
    group: tuple[str, ...]
    path: str

    def ranked(self, name: str = "rank_no", of: str | None = None) -> DataFrame:
        """Every row with its 1-based position in its group, and with the group's size as ``of``."""
        added = {name: F.col("_at") - F.col("_shift")}
        if of:
            added[of] = F.col("_all")
        drop = {"_at", "_part", "_rows", "_first", "_shift", "_all", *self.group} - set(self.keys)
        return self.rows.join(self.parts, [*self.group, "_part"]).withColumns(added).drop(*drop)

    def slice(self, first: int, last: int, name: str = "rank_no") -> DataFrame:
        """Rows whose global positions are in ``first .. last``; other ranges are not read."""
        if self.keys:
            raise ValueError("a slice is of the whole order, not of groups")
        begin = F.col("_first") - F.col("_shift")
        touched = self.parts.filter((begin <= last) & (begin + F.col("_rows") > first))
        low, high = touched.agg(F.min("_part"), F.max("_part")).first()
        # The part number was written with the rows, so this filter skips row groups.
        rows = self.rows.filter(F.col("_part").between(-1 if low is None else low, -1 if high is None else high))
        kept = Ordered(rows, self.parts, self.keys, self.group, self.path)
        return kept.ranked(name).filter(F.col(name).between(first, last))

    def count(self) -> int:
        return self.parts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]


def globally_ordered(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), folder: str | None = None
) -> Ordered:
    """``df`` written in the order of ``keys`` and ``order``, with what numbering needs.

    ``order`` should end in a full tie-break: rows that tie in everything stay in one range, and
    their order among each other is that of the written table. NULL keys form a group. The table
    goes to ``folder``, which all executors must reach, or to a fresh one below
    ``spark.checkpoint.dir``; it fixes the positions, so a task that runs again finds the same.
    """
    spark = df.sparkSession
    solid, group, _ = _solid_keys(df, list(keys))
    by = [*[F.col(c) for c in group], *order]
    laid = solid.repartitionByRange(*by) if by else solid.coalesce(1)
    laid = laid.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    laid = laid.withColumn("_part", F.shiftright("_at", ROW_BITS))
    path = folder or scratch_dir(spark, "ordered")
    laid.write.parquet(path)
    rows = spark.read.schema(laid.schema).parquet(path)
    parts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    # Without keys this is one row per range: as many as there are partitions.
    in_order = Window.partitionBy(*group).orderBy("_part")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumns(
        {
            "_shift": F.col("_first") - 1 - F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            "_all": F.sum("_rows").over(everything),
        }
    )
    if not keys:
        parts = F.broadcast(parts)
    return Ordered(rows, parts, tuple(keys), tuple(group), path)


def globally_ranked(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    name: str = "rank_no",
    of: str | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Every row with its 1-based position in the order, per group of ``keys`` where given."""
    return globally_ordered(df, order, keys, folder).ranked(name, of)


def page_in_order(ordered: Ordered, page: int, page_size: int, name: str = "rank_no") -> DataFrame:
    """One page, counted from 1, with ranks, ``total_count`` and ``has_more``, however deep it lies.

    Only the ranges that hold the page are read, and no task sees the rows before it.
    """
    total = ordered.count()
    found = ordered.slice((page - 1) * page_size + 1, page * page_size, name)
    return found.withColumns({"total_count": F.lit(total), "has_more": F.lit(page * page_size < total)})


def rows_after(
    df: DataFrame, order: Sequence[tuple[str, bool]], last: Mapping[str, object], page_size: int
) -> DataFrame:
    """The next ``page_size`` rows after the row with the values ``last``.

    ``order`` lists (column, descending) and ends in a unique column; NULL sorts first ascending and
    last descending, as in Spark. The filter goes to the scan, and each task keeps a page at most.
    """
    after, equal = F.lit(False), F.lit(True)
    for name, descending in order:
        column, value = F.col(name), last[name]
        if value is None:
            later = F.lit(False) if descending else column.isNotNull()
        else:
            later = (column < F.lit(value)) | column.isNull() if descending else column > F.lit(value)
        after = after | (equal & F.coalesce(later, F.lit(False)))
        equal = equal & column.eqNullSafe(F.lit(value))
    by = [F.desc(name) if descending else F.asc(name) for name, descending in order]
    return df.filter(after).orderBy(*by).limit(page_size)
