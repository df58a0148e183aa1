"""Article list lines: triage and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.text import article_code, search_query, strip
from tenderloom.operators.offers import by_query_key, query_key

# Label shapes that mark a line as not a product, with their reasons, in order.
LABEL_PATTERNS = (
    (r"(?iU)\bNettoartikel\b", "Net-price contract label (Nettoartikel)"),
    (r"(?iU)\bNettoangebotspreise?\b", "Net-price offer label (Nettoangebotspreise)"),
    (r"(?iU)\bBRUTTOARTIKEL\b", "Gross-price label (Bruttoartikel)"),
    (r"(?iU)\bNLAG\b", "NLAG pricing label"),
)
CATEGORY_LABEL = (
    r"(?iU)^[A-Za-zÄÖÜäöüß\s\-]+(Nettoartikel|Brutto|NLAG|SPECIFIC\.\s*i?NETTOARTIKEL)"
)
CATEGORY_REASON = "Pricing category label, not a specific product"
GROSS_LABEL = r"(?iU)\bBrutto\b"
ARTICLE_NUMBER = r"(?U)\d{4,}"
GROSS_REASON = "Gross-price category label (Brutto), no specific article number"
EMPTY_REASON = "Empty input"

# Labels of net-price lines without a public price, and the unknown maker.
NET_PRICE_LABELS = r"(?i)Nettoartikel|Nettoangebotspreise|Nettoangebotsartikel"
UNKNOWN_MAKER = "unbekannt"


def triage_articles(lines: DataFrame, text: str = "text") -> DataFrame:
    """Mark each line ``skip`` with a reason, or ``search`` with article code and query."""
    stripped = lines.withColumn("original_input", strip(F.coalesce(F.col(text), F.lit(""))))
    line = F.col("original_input")
    reason = F.when(line == "", F.lit(EMPTY_REASON))
    for pattern, label in LABEL_PATTERNS:
        reason = reason.when(line.rlike(pattern), F.lit(label))
    reason = reason.when(line.rlike(CATEGORY_LABEL), F.lit(CATEGORY_REASON)).when(
        line.rlike(GROSS_LABEL) & ~line.rlike(ARTICLE_NUMBER), F.lit(GROSS_REASON)
    )
    specific = F.col("reason").isNull()
    return stripped.withColumn("reason", reason).select(
        *lines.columns,
        "original_input",
        F.when(specific, "search").otherwise("skip").alias("action"),
        specific.alias("is_specific"),
        "reason",
        F.when(specific, article_code(line)).alias("article_code"),
        F.when(specific, search_query(line)).alias("search_query"),
    )


def parse_article_list(texts: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """Article lists -> one row per non-empty line."""
    rows = texts.select(
        id_column, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("line_no", "text")
    )
    return rows.filter(F.length(strip(F.col("text"))) > 0)


def enrich_procurement(
    lines: DataFrame, catalog: DataFrame, market: DataFrame, images: DataFrame
) -> DataFrame:
    """Article lines with product, barcode, best price and image; failed steps keep their row.

    ``lines(line_id, text)``; ``catalog(article_id, ean, article_name, manufacturer)``;
    ``market`` as from ``best_market_offers(offers, "ean")``; ``images(article_id, image_url)``
    with at most one picture per article. Net-price lines have no public price, so their
    price step is skipped.
    """
    # Price and image belong to the article, so they join the catalog; the line table,
    # which may be far larger, is joined once.
    described = (
        catalog.select("article_id", "ean", "article_name", "manufacturer")
        .join(market, "ean", "left")
        .join(images, "article_id", "left")
    )
    answer = F.struct(
        "article_id",
        "ean",
        "article_name",
        "manufacturer",
        "market_price_cents",
        "market_merchant",
        "image_url",
    )
    # Several articles may share a name: the lowest id answers the line.
    products = (
        by_query_key(described, "article_name", "ean")
        .groupBy("query_key")
        .agg(F.min(answer).alias("p"))
        .select("query_key", "p.*")
    )
    named = triage_articles(lines).withColumn("query_key", query_key(F.col("original_input")))
    enriched = named.join(products, "query_key", "left")
    net_price = F.col("original_input").rlike(NET_PRICE_LABELS)
    return enriched.select(
        "line_id",
        F.col("original_input").alias("raw_code"),
        net_price.alias("is_b2b_netto"),
        "action",
        "reason",
        F.coalesce("article_name", "original_input").alias("product_name"),
        F.coalesce("manufacturer", F.lit(UNKNOWN_MAKER)).alias("manufacturer"),
        "ean",
        F.when(F.col("ean").isNotNull(), "found").otherwise("not_found").alias("ean_status"),
        F.when(~net_price, F.col("market_price_cents")).alias("market_price_cents"),
        F.when(~net_price, F.col("market_merchant")).alias("market_merchant"),
        F.when(net_price, "skipped")
        .when(F.col("market_price_cents").isNotNull(), "found")
        .otherwise("not_found")
        .alias("price_status"),
        "image_url",
        F.when(F.col("image_url").isNotNull(), "found").otherwise("not_found").alias("image_status"),
    )
