import pytest
from support import rows
from pyspark.sql import functions as F

from tenderloom.operators import articles as A
from tenderloom.operators import offers as O


@pytest.mark.parametrize(
    "line, action, reason",
    [
        ("Siemens Nettoartikel", "skip", "Net-price contract label (Nettoartikel)"),
        ("ABB Nettoangebotspreise", "skip", "Net-price offer label (Nettoangebotspreise)"),
        ("bruttoartikel Hager", "skip", "Gross-price label (Bruttoartikel)"),
        ("Rexel NLAG 2024", "skip", "NLAG pricing label"),
        ("Hager Brutto", "skip", "Pricing category label, not a specific product"),
        ("3 Stk. Brutto", "skip", A.GROSS_REASON),
        ("3 Stk. Brutto 51234", "search", None),
        ("5TG6-201 Schalter", "search", None),
        ("   \t", "skip", "Empty input"),
        (None, "skip", "Empty input"),
    ],
)
def test_triage(spark, line, action, reason):
    row = A.triage_articles(spark.createDataFrame([(1, line)], "line_id INT, text STRING")).first()
    assert (row.action, row.reason, row.is_specific) == (action, reason, action == "search")
    if action == "skip":
        assert row.article_code is None and row.search_query is None


def test_list_lines(spark):
    df = spark.createDataFrame([(1, "a\n\n  \nb\r\nc")], "list_id INT, text STRING")
    assert rows(A.parse_article_list(df, "list_id").select("text")) == [("a",), ("b",), ("c",)]


def test_enrichment_keeps_failed_lines(spark):
    lines = spark.createDataFrame(
        [(1, "Bosch drill"), (2, "Bosch drill Nettoartikel"), (3, "4006381333931"), (4, "unknown"), (5, "Saw")],
        "line_id INT, text STRING",
    )
    catalog = spark.createDataFrame(
        [(1, "4006381333931", "bosch DRILL", "Bosch"), (2, "4006381333948", "Saw", "Makita"), (7, "1", "Saw", "Z")],
        "article_id INT, ean STRING, article_name STRING, manufacturer STRING",
    )
    offers = spark.createDataFrame(
        [("4006381333931", 500, "M", 1, "u")],
        "ean STRING, total_cents BIGINT, merchant_name STRING, position INT, product_url STRING",
    )
    images = spark.createDataFrame([(2, "https://i/2.jpg")], "article_id INT, image_url STRING")
    got = A.enrich_procurement(lines, catalog, O.best_market_offers(offers, "ean"), images)
    assert rows(got.select("line_id", "manufacturer", "ean_status", "price_status", "image_status", "market_price_cents")) == [
        (1, "Bosch", "found", "found", "not_found", 500),
        (2, "unbekannt", "not_found", "skipped", "not_found", None),
        (3, "Bosch", "found", "found", "not_found", 500),
        (4, "unbekannt", "not_found", "not_found", "not_found", None),
        (5, "Makita", "found", "not_found", "found", None),
    ]
    assert got.filter(F.col("line_id") == 2).first().is_b2b_netto
