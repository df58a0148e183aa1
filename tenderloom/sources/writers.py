"""Writers for offer reports, structured results and metric points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.money import from_cents
from tenderloom.functions.text import dedup_key
from tenderloom.operators.offers import merge_products, price_insights


def offer_report(offers: DataFrame, quantity: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Report rows: offers under their merged product name, prices with two decimals."""
    products = merge_products(offers, by).select(
        *by,
        "product_key",
        F.col("product_name").alias("_name"),
        F.col("brand").alias("_brand"),
        F.col("ean").alias("_ean"),
        "cheapest_price_cents",
    )
    keyed = offers.withColumn("product_key", dedup_key(F.col("product_name")))
    rows = keyed.join(products, [*by, "product_key"])
    total = F.col("total_cents")
    return rows.select(
        *by,
        "product_key",
        "cheapest_price_cents",
        "total_cents",
        "position",
        F.col("_name").alias("Produkt"),
        F.coalesce("_brand", F.lit("")).alias("Marke"),
        F.coalesce("_ean", F.lit("")).alias("EAN"),
        F.col("merchant_name").alias("Haendler"),
        from_cents(F.col("price_cents")).alias("Preis (EUR)"),
        from_cents(F.col("shipping_cents")).alias("Versand (EUR)"),
        from_cents(total).alias("Gesamtpreis (EUR)"),
        from_cents(total * max(1, int(quantity))).alias("Gesamtpreis x Menge (EUR)"),
        F.col("source").alias("Quelle"),
        F.col("product_url").alias("URL"),
    )


def write_offer_report(
    offers: DataFrame, path: str, quantity: int = 1, by: Sequence[str] = ("query",)
) -> None:
    """``;``-separated report below ``path``: ``offers`` rows and ``insights`` per group.

    Both keep the ``by`` columns, so that offers and insights of one request can be told.

    Offers are sorted by product price, then total, through a range-partitioned sort, so
    part files follow each other in order and no task holds the whole report.
    """
    order = [*by, F.asc_nulls_last("cheapest_price_cents"), "product_key", "total_cents", "position"]
    report = offer_report(offers, quantity, by).orderBy(*order)
    report.drop("product_key", "cheapest_price_cents", "total_cents", "position").write.mode(
        "overwrite"
    ).options(sep=";", header=True, emptyValue="").csv(f"{path}/offers")
    insights = price_insights(offers, by)
    euros = [c for c in insights.columns if c.endswith("_cents")]
    insights.withColumns({c[: -len("_cents")]: from_cents(F.col(c)) for c in euros}).drop(
        *euros
    ).withColumn("quantity", F.lit(max(1, int(quantity)))).write.mode("overwrite").options(
        sep=";", header=True
    ).csv(f"{path}/insights")


def write_structured(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result rows as JSON lines, NULL fields included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


METRIC_BATCH_SCHEMA = (
    "metric STRING, type INT, points ARRAY<STRUCT<timestamp: BIGINT, value: DOUBLE>>, "
    "tags ARRAY<STRING>, resources ARRAY<STRUCT<name: STRING, type: STRING>>"
)


def metric_points(batch: DataFrame) -> DataFrame:
    """Metric series with nested points -> one row per point, with its UTC calendar date.

    The date does not follow the session's time zone, so that all writers fill the same
    partitions.
    """
    rows = batch.select("metric", "type", "tags", "resources", F.explode("points").alias("p"))
    return rows.select(
        "metric",
        "type",
        "tags",
        "resources",
        F.timestamp_seconds("p.timestamp").alias("ts"),
        F.col("p.value").alias("value"),
        F.date_from_unix_date(F.floor(F.col("p.timestamp") / 86400).cast("int")).alias("date"),
    )


def append_metric_points(batch: DataFrame, path: str) -> None:
    """Append points to a table partitioned by date, in files of even size.

    Rows are rebalanced by date before they are written: small dates fill one file instead of one
    per task, and Spark splits a large date into pieces of the advisory size, so none lands in one task.
    """
    points = metric_points(batch).hint("rebalance", "date")
    points.write.mode("append").partitionBy("date").parquet(path)
