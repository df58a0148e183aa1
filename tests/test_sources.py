import datetime as dt
import json

import pytest
from support import rows
from pyspark.sql import functions as F

from tenderloom.operators.records import flatten_records
from tenderloom.schemas import CONTRACT_SCHEMAS
from tenderloom.session import scratch_dir
from tenderloom.sources import readers, writers


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_contract_tables(spark, tmp_path, fmt):
    line = (1, 2, 3, "12.34", None, "5.00", 1, 5, True, None)
    data = {"contract_articles": [line], "tiered_pricing": [(1, 1, 10, None, "9.99", None)]}
    for name, schema in CONTRACT_SCHEMAS.items():
        texts = spark.createDataFrame(data.get(name, []), ", ".join(
            f"{c.split()[0]} {'STRING' if 'DECIMAL' in c else c.split()[1]}" for c in schema.replace("(10,", "(10;").replace("(5,", "(5;").split(", ")
        ))
        typed = texts.select(*[
            F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], schema).schema
        ])
        typed.write.format(fmt).save(f"{tmp_path}/{name}")
    tables = readers.load_contract_tables(spark, str(tmp_path), fmt)
    row = tables.lines.first()
    assert (row.contract_price_cents, row.list_price_cents) == (1234, None)
    assert tables.tiers.first().tier_price_cents == 999
    assert "minimum_order_value_cents" in tables.contracts.columns


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "attributes": {"service": "api"}}\n{"id": "2"}\n')
    df = flatten_records(readers.read_records(spark, str(tmp_path), "log"), "log")
    assert rows(df.select("id", "service", "message")) == [("1", "api", ""), ("2", None, "")]


def test_shopping_results(spark, tmp_path):
    items = [
        {"title": "Drill", "price": "1.299,00 EUR", "source": "Shop", "link": "l", "rating": 4.5, "reviews": 3},
        {"title": "No price", "price": "auf Anfrage"},
        {"price": "5,00"},
    ]
    (tmp_path / "r.json").write_text(json.dumps({"query": "q", "shopping_results": items}))
    got = readers.read_shopping_results(spark, str(tmp_path))
    assert rows(got.select("product_name", "merchant_name", "total_cents", "rating_count", "price_parse")) == [
        ("Drill", "Shop", 129900, 3, "ok"),
        ("No price", "Google Shopping", None, None, "missing"),
        ("Unbekannt", "Google Shopping", 500, None, "ok"),
    ]
    assert readers.readable_offers(got).count() == 2


def test_pages_are_cut_only_on_request(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 200_001), (2, "u", "y"), (3, "u", None)], "page_id INT, url STRING, html STRING")
    df.write.parquet(f"{tmp_path}/p")
    cut = readers.read_pages(spark, f"{tmp_path}/p", cut=200_000)
    assert rows(cut.select("page_id", "is_truncated", F.length("html"))) == [(1, True, 200_000), (2, False, 1), (3, False, None)]
    assert readers.read_pages(spark, f"{tmp_path}/p").agg(F.max(F.length("html"))).first()[0] == 200_001


def test_offer_report(spark, tmp_path):
    offers = spark.createDataFrame(
        [("q", "Drill", "A;B", 1000, 200, 0), ("q", "drill", "C", 900, 0, 1), ("r", "Nail", "D", 5, 0, 2)],
        "query STRING, product_name STRING, merchant_name STRING, price_cents BIGINT, shipping_cents BIGINT, position INT",
    ).selectExpr(
        "*", "price_cents + shipping_cents AS total_cents", "CAST(NULL AS STRING) AS ean", "CAST(NULL AS STRING) AS brand",
        "CAST(NULL AS STRING) AS image_url", "'idealo' AS source", "'u' AS product_url",
    )
    writers.write_offer_report(offers, str(tmp_path / "report"), quantity=3)
    back = spark.read.options(sep=";", header=True).csv(str(tmp_path / "report" / "offers"))
    assert rows(back.select("query", "Produkt", "Haendler", "Versand (EUR)", "Gesamtpreis (EUR)", "Gesamtpreis x Menge (EUR)")) == [
        ("q", "Drill", "A;B", "2.00", "12.00", "36.00"),
        ("q", "Drill", "C", "0.00", "9.00", "27.00"),
        ("r", "Nail", "D", "0.00", "0.05", "0.15"),
    ]
    insights = spark.read.options(sep=";", header=True).csv(str(tmp_path / "report" / "insights")).collect()
    assert [(r["query"], r["median_price"], r["quantity"]) for r in insights] == [("q", "10.50", "3")]


def test_structured_rows_keep_missing_fields(spark, tmp_path):
    writers.write_structured(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "s"))
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("part-*"))
    assert json.loads(text) == {"a": 1, "b": None}


def test_metric_points_append_by_date(spark, tmp_path):
    day = int(dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc).timestamp())
    batch = spark.createDataFrame(
        [("m", 3, [(day, 1.0), (day + 86400, 2.0)], ["env:prod"], [("h", "host")])], writers.METRIC_BATCH_SCHEMA
    )
    path = str(tmp_path / "points")
    writers.append_metric_points(batch, path)
    writers.append_metric_points(batch, path)
    assert {p.name for p in (tmp_path / "points").glob("date=*")} == {"date=2024-03-01", "date=2024-03-02"}
    assert spark.read.parquet(path).groupBy("date").count().count() == 2
    assert spark.read.parquet(path).count() == 4


def test_points_of_a_date_do_not_fill_a_file_per_task(spark, tmp_path):
    day = int(dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc).timestamp())
    batch = spark.createDataFrame(
        [("m", 3, [(day + 86400 * (k % 3) + k, float(k))], ["env:prod"], [("h", "host")]) for k in range(300)],
        writers.METRIC_BATCH_SCHEMA,
    )
    writers.append_metric_points(batch.repartition(16), str(tmp_path / "points"))
    files = list((tmp_path / "points").glob("date=*/*.parquet"))
    assert len(files) == 3 and spark.read.parquet(str(tmp_path / "points")).count() == 300


def test_scratch_folders_come_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark, "a"), scratch_dir(spark, "a")
    assert first.startswith(f"{root}/a-") and first != second
