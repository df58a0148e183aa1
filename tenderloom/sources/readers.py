"""Readers for procurement tables, telemetry records, shopping results and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions.money import parse_price, price_parse, to_cents
from tenderloom.operators.contracts import ContractTables
from tenderloom.operators.records import record_schema
from tenderloom.schemas import CONTRACT_SCHEMAS, MONEY_COLUMNS

# Fixed value: longest page text that is kept.
MAX_HTML_LENGTH = 200_000


def with_cents(df: DataFrame) -> DataFrame:
    """Replace NUMERIC money columns by ``<name>_cents`` BIGINT columns."""
    money = [c for c in MONEY_COLUMNS if c in df.columns]
    return df.withColumns({f"{c}_cents": to_cents(F.col(c)) for c in money}).drop(*money)


def _tables(frames: dict[str, DataFrame]) -> ContractTables:
    return ContractTables(
        articles=frames["articles"],
        categories=frames["categories"],
        suppliers=frames["suppliers"],
        contracts=frames["contracts"],
        lines=with_cents(frames["contract_articles"]),
        tiers=with_cents(frames["tiered_pricing"]),
    )


def load_contract_tables(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> ContractTables:
    """The six procurement tables from ``<path>/<table>``, read with declared schemas."""
    frames = {
        name: spark.read.format(fmt).schema(schema).options(**options).load(f"{path}/{name}")
        for name, schema in CONTRACT_SCHEMAS.items()
    }
    frames["contracts"] = with_cents(frames["contracts"])
    return _tables(frames)


def load_contract_database(
    spark: SparkSession, url: str, database_schema: str = "contracts", partitions: int = 32, **options
) -> ContractTables:
    """The same tables over JDBC; the two large ones are read in parallel key ranges."""
    keys = {"contract_articles": "contract_article_id", "tiered_pricing": "tier_id"}
    frames = {}
    for name in CONTRACT_SCHEMAS:
        table = f"{database_schema}.{name}"
        reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        if name in keys:
            bounds_query = f"SELECT min({keys[name]}) AS lo, max({keys[name]}) AS hi FROM {table}"
            bounds = (
                spark.read.format("jdbc").options(url=url, query=bounds_query, **options).load().first()
            )
            if bounds["lo"] is not None:
                reader = reader.options(
                    partitionColumn=keys[name],
                    lowerBound=bounds["lo"],
                    upperBound=bounds["hi"],
                    numPartitions=partitions,
                )
        frames[name] = reader.load()
    frames["contracts"] = with_cents(frames["contracts"])
    return _tables(frames)


def read_records(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """Nested JSON records of a telemetry kind, read with the declared schema."""
    return spark.read.schema(record_schema(kind)).options(**options).json(path)


SHOPPING_SCHEMA = (
    "query STRING, shopping_results ARRAY<STRUCT<title: STRING, price: STRING, source: STRING, "
    "link: STRING, rating: DOUBLE, reviews: BIGINT, brand: STRING, thumbnail: STRING>>"
)
DEFAULT_MERCHANT = "Google Shopping"
DEFAULT_TITLE = "Unbekannt"


def shopping_offers(responses: DataFrame) -> DataFrame:
    """Shopping responses -> one offer per result.

    ``price_parse`` says whether the price was read; a missing or ambiguous one gives no offer
    price, so such rows never win a comparison. ``readable_offers`` keeps the others.
    """
    items = responses.select(
        "query", F.posexplode("shopping_results").alias("position", "item")
    ).select("query", "position", "item.*")
    offers = items.withColumns({"price_cents": parse_price(F.col("price")), "price_parse": price_parse(F.col("price"))})
    return offers.select(
        "query",
        F.col("position").cast("bigint").alias("position"),
        F.coalesce("title", F.lit(DEFAULT_TITLE)).alias("product_name"),
        F.lit(None).cast("string").alias("ean"),
        "brand",
        F.col("thumbnail").alias("image_url"),
        F.coalesce("source", F.lit(DEFAULT_MERCHANT)).alias("merchant_name"),
        "price_cents",
        F.lit(0).cast("bigint").alias("shipping_cents"),
        F.col("price_cents").alias("total_cents"),
        F.coalesce("link", F.lit("")).alias("product_url"),
        F.coalesce("link", F.lit("")).alias("source_url"),
        F.lit("google_shopping").alias("source"),
        "rating",
        F.col("reviews").alias("rating_count"),
        "price_parse",
    )


def readable_offers(offers: DataFrame) -> DataFrame:
    return offers.filter(F.col("price_parse") == "ok").drop("price_parse")


def read_shopping_results(spark: SparkSession, path: str, **options) -> DataFrame:
    return shopping_offers(spark.read.schema(SHOPPING_SCHEMA).options(**options).json(path))


def limit_html(pages: DataFrame, limit: int = MAX_HTML_LENGTH) -> DataFrame:
    """Cut page text at ``limit`` characters and say so in ``is_truncated``."""
    return pages.withColumns(
        {
            "is_truncated": F.coalesce(F.length("html") > limit, F.lit(False)),
            "html": F.substring("html", 1, limit),
        }
    )


def read_pages(spark: SparkSession, path: str, cut: int | None = None) -> DataFrame:
    """Rendered pages ``(page_id, url, html)``, whole; ``cut`` limits their characters."""
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return pages if cut is None else limit_html(pages, cut)
