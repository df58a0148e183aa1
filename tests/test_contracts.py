import datetime as dt
import re

import pytest
from support import rows
from pyspark.sql import functions as F

from tenderloom.operators import contracts as C
from tenderloom.operators import skew

DAY = "2025-06-30"


@pytest.fixture(scope="module")
def tables(spark):
    """Two articles, four suppliers, one expired and one draft contract, overlapping tiers."""
    start, end = dt.date(2025, 1, 1), dt.date(2025, 12, 31)
    make = spark.createDataFrame
    return C.ContractTables(
        articles=make(
            [
                (9, "4006381333931", "tesa Band 50%", "tesa", "tesa SE", "Klebeband", 1, "piece"),
                (31, "4006381333948", "Knipex Zange", "Knipex", "Knipex KG", "Zange isoliert", 2, "piece"),
                (40, "4006381333955", "Lose Ware", None, None, None, 2, "piece"),
            ],
            "article_id INT, ean STRING, article_name STRING, brand STRING, manufacturer STRING, "
            "description STRING, category_id INT, unit STRING",
        ),
        categories=make([(1, "Office"), (2, "Tools")], "category_id INT, category_name STRING"),
        suppliers=make(
            [(i, f"S{i}", None, None, None) for i in range(1, 5)],
            "supplier_id INT, supplier_name STRING, contact_person STRING, email STRING, phone STRING",
        ),
        contracts=make(
            [
                (1, "FC-1", 1, "active", start, end),
                (2, "FC-2", 2, "active", start, end),
                (3, "FC-3", 3, "expired", start, end),
                (4, "FC-4", 4, "active", dt.date(2025, 7, 1), end),
            ],
            "contract_id INT, contract_number STRING, supplier_id INT, status STRING, "
            "valid_from DATE, valid_until DATE",
        ).selectExpr(
            "*",
            "'t' AS title",
            "'1.0' AS version",
            "'30d' AS payment_terms",
            "'DDP' AS delivery_terms",
            "0L AS minimum_order_value_cents",
            "0L AS free_shipping_threshold_cents",
        ),
        lines=make(
            [
                (1, 1, 31, 7990, 9900, 19.29, 1),
                (2, 2, 31, 8490, 9900, 14.24, 5),
                (3, 3, 31, 100, 9900, 99.0, 1),
                (4, 4, 31, 200, 9900, 98.0, 1),
                (5, 1, 9, 15, 20, 25.0, 10),
            ],
            "contract_article_id INT, contract_id INT, article_id INT, contract_price_cents BIGINT, "
            "list_price_cents BIGINT, d DOUBLE, min_order_qty INT",
        ).selectExpr("*", "CAST(d AS DECIMAL(5,2)) AS discount_pct", "3 AS delivery_days", "false AS is_preferred").drop("d"),
        tiers=make(
            [
                (1, 1, 10, 24, 6990, 5.0),
                (2, 1, 25, None, 6490, 10.0),
                (3, 2, 10, 30, 8000, 5.0),
                (4, 2, 20, None, 7500, 8.0),
            ],
            "tier_id INT, contract_article_id INT, min_quantity INT, max_quantity INT, "
            "tier_price_cents BIGINT, discount_pct DOUBLE",
        ),
    )


def demand(spark, *pairs):
    return spark.createDataFrame(
        [(i, a, q) for i, (a, q) in enumerate(pairs)], "demand_id BIGINT, article_id INT, qty BIGINT"
    )


def priced(spark, tables, article, qty):
    df = C.price_for_demand(tables, demand(spark, (article, qty)), DAY)
    return [
        (r.supplier_name, r.unit_price_cents, r.price_type) for r in df.orderBy("price_rank").collect()
    ]


def test_price_depends_on_quantity(spark, tables):
    assert priced(spark, tables, 31, 1) == [("S1", 7990, "contract")]
    assert priced(spark, tables, 31, 5) == [("S1", 7990, "contract"), ("S2", 8490, "contract")]
    assert priced(spark, tables, 31, 24) == [
        ("S1", 6990, "tiered"),
        ("S2", 7500, "tiered"),
        ("S2", 8000, "tiered"),
    ]
    assert priced(spark, tables, 31, 25)[0] == ("S1", 6490, "tiered")


def test_a_quantity_meets_one_gap_beside_a_tier_that_holds_none(spark, tables):
    """The fourth tier ends before it begins."""
    odd = [(1, 1, 10, 24, 6990, 5.0), (2, 1, 30, 20, 1, 10.0), (3, 2, None, 5, 1, 5.0), (4, 2, 10, 5, 1, 5.0)]
    t = C.ContractTables(**{**vars(tables), "tiers": spark.createDataFrame(odd, tables.tiers.schema)})
    for qty in (7, 26, 40):
        assert priced(spark, t, 31, qty) == [("S1", 7990, "contract"), ("S2", 8490, "contract")]
    assert priced(spark, t, 31, 12)[0] == ("S1", 6990, "tiered")


def test_minimum_order_can_leave_no_offer(spark, tables):
    assert priced(spark, tables, 9, 9) == []
    assert priced(spark, tables, 9, 10) == [("S1", 15, "contract")]


def test_totals_and_savings(spark, tables):
    row = C.price_for_demand(tables, demand(spark, (31, 3)), DAY).first()
    assert (row.total_price_cents, row.savings_vs_list_cents) == (3 * 7990, 3 * (9900 - 7990))


def test_bands_cover_every_quantity_once(spark, tables):
    bands = C.cheapest_bands(tables.tiers)
    assert rows(bands.filter("contract_article_id = 2").select("from_qty", "to_qty", "band_price_cents")) == rows(
        spark.createDataFrame(
            [(1, 9, None), (10, 19, 8000), (20, 30, 7500), (31, C.NO_LIMIT, 7500)],
            "a BIGINT, b BIGINT, c BIGINT",
        )
    )


def test_tier_lookup_takes_the_cheapest_overlap(spark, tables):
    got = C.tier_lookup(tables, demand(spark, (31, 22), (31, 6)), DAY)
    assert rows(got.select("demand_id", "contract_id", "tier_price_cents")) == [
        (0, 1, 6990),
        (0, 2, 7500),
        (1, 1, None),
        (1, 2, None),
    ]


def test_lines_without_tier(spark, tables):
    got = C.lines_without_tier(tables, demand(spark, (31, 22), (31, 6)), DAY)
    assert rows(got.select("demand_id", "contract_id")) == [(1, 1), (1, 2)]


def test_recommendations(spark, tables):
    got = C.recommend_order(tables, demand(spark, (31, 13)), DAY)
    assert rows(got.select("supplier_name", "recommended_qty", "unit_price_cents", "savings_pct", "recommendation")) == [
        ("S1", 13, 6990, 29.4, C.EXACT_QUANTITY),
        ("S1", 25, 6490, 34.4, C.ORDER_MORE),
        ("S2", 13, 8000, 19.2, C.EXACT_QUANTITY),
        ("S2", 20, 7500, 24.2, C.ORDER_MORE),
    ]


def test_recommendation_ignores_the_minimum_order(spark, tables):
    got = C.recommend_order(tables, demand(spark, (31, 5)), DAY)
    more = got.filter(F.col("recommendation") == C.ORDER_MORE)
    assert rows(more.select("supplier_name", "recommended_qty")) == [("S1", 10), ("S2", 10)]


@pytest.mark.parametrize("name", ["price_for_demand", "tier_lookup", "lines_without_tier", "recommend_order"])
def test_splitting_hot_articles_changes_nothing(inputs, name):
    def found(**limits):
        return rows(getattr(C, name)(inputs.procurement, inputs.demand, "1998-06-30", **limits))

    whole = found()
    assert found(rows_per_split=3) == whole
    assert found(pairs_per_split=50) == whole


def hot_article(spark, lines, demands):
    """One article in many contracts, asked for many times, and an ordinary one."""
    table = spark.range(lines)
    i = F.col("id").cast("int")
    t = C.ContractTables(
        articles=None, categories=None, tiers=spark.createDataFrame([], TIERS),
        suppliers=spark.createDataFrame([(1, "S")], "supplier_id INT, supplier_name STRING"),
        contracts=table.select(i.alias("contract_id"), F.lit(1).alias("supplier_id"), F.concat(F.lit("C"), i).alias("contract_number"),
                               F.lit("active").alias("status"), F.to_date(F.lit("2025-01-01")).alias("valid_from"),
                               F.to_date(F.lit("2026-01-01")).alias("valid_until")),
        lines=table.select(i.alias("contract_article_id"), i.alias("contract_id"), F.when(i < 3, 2).otherwise(1).alias("article_id"),
                           (i * 7 % 101).cast("bigint").alias("contract_price_cents"), F.lit(500).cast("bigint").alias("list_price_cents"),
                           F.lit(0.0).alias("discount_pct"), F.lit(2).alias("delivery_days"), F.lit(1).alias("min_order_qty")),
    )
    wanted = spark.range(demands).select(F.col("id").alias("demand_id"), F.when(F.col("id") % 9 == 0, 2).otherwise(1).alias("article_id"), F.lit(4).alias("qty"))
    return t, wanted


TIERS = "tier_id INT, contract_article_id INT, min_quantity INT, max_quantity INT, tier_price_cents BIGINT, discount_pct DOUBLE"


@pytest.mark.parametrize("lines, demands, cells", [(40, 200, (4, 18)), (200, 20, (20, 2)), (3000, 1, None)])
def test_work_of_a_hot_article_is_cut_on_both_sides(spark, lines, demands, cells):
    t, wanted = hot_article(spark, lines, demands)
    bands = C.price_schedule(t, "2025-06-30")
    hot = {r.article_id: (r._down, r._across) for r in skew.hot_cells(wanted, bands, ["article_id"], 10**6, 100).collect()}
    if cells:
        down, across = hot[1]
        ordinary = wanted.filter("article_id = 1").count() * (lines - 3)
        assert down * across >= ordinary / 100 and (down, across) == cells
    else:
        assert 1 not in hot or hot[1][0] > 1
    whole = rows(C.price_for_demand(t, wanted, "2025-06-30"))
    assert rows(C.price_for_demand(t, wanted, "2025-06-30", pairs_per_split=100)) == whole
    assert rows(C.price_for_demand(t, wanted, "2025-06-30", rows_per_split=7)) == whole
    assert len(whole) == wanted.filter("article_id = 1").count() * (lines - 3) + wanted.filter("article_id = 2").count() * 3


def test_result_does_not_depend_on_partitions(spark, tables):
    wanted = demand(spark, *[(31, q) for q in range(1, 60)])
    results = [
        rows(C.price_for_demand(tables, wanted.repartition(n), DAY)) for n in (1, 50)
    ]
    assert results[0] == results[1]


def test_status_alone_or_with_dates(tables):
    assert rows(C.active_contracts(tables.contracts).select("contract_id")) == [(1,), (2,), (4,)]
    assert rows(C.active_contracts(tables.contracts, DAY).select("contract_id")) == [(1,), (2,)]


def test_views(tables):
    best = C.best_contract_price(tables)
    assert rows(best.select("article_id", "contract_number", "price_rank")) == [
        (31, "FC-1", 2),
        (31, "FC-2", 3),
        (31, "FC-4", 1),
        (9, "FC-1", 1),
    ]
    assert C.best_tiered_price(tables).count() == 4
    assert C.supplier_article_matrix(tables).count() == 4
    overview = C.contract_overview(tables).select("contract_id", "article_count", "avg_discount_pct")
    assert rows(overview) == [(1, 2, 22.15), (2, 1, 14.24), (3, 1, 99.0), (4, 1, 98.0)]


def test_inactive_contracts_count_unless_told_otherwise(tables):
    def counted(active):
        return rows(C.article_catalog(tables, active).select("article_id", "contract_count", "best_contract_price_cents"))

    assert counted(False) == [(31, 4, 100), (40, 0, None), (9, 1, 15)]
    assert counted(True) == [(31, 3, 200), (40, 0, None), (9, 1, 15)]


def test_pairs_of_article_and_contract_are_counted_in_many_tasks(spark, tables):
    doubled = C.ContractTables(**{**vars(tables), "lines": tables.lines.union(tables.lines)})
    for active in (False, True):
        prices = C.article_prices(doubled, active)
        assert rows(prices) == rows(C.article_prices(tables, active))
        assert {r.article_id: r.contract_count for r in prices.collect()} == {31: 3 if active else 4, 9: 1}
        tasks = C.FAN_OUT * int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = prices._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(rf"RepartitionByExpression \[article_id#\d+, contract_id#\d+\], {tasks}\b", plan)


def test_search_relevance(spark, tables):
    terms = ["4006381333931", "knipex zange", "KNIPEX", "zange", "isol", "50%", "%", "k", "", "nothing"]
    found = C.search_articles(tables, spark.createDataFrame([(t,) for t in terms], "term STRING"))
    got = {(r.term, r.article_id): float(r.relevance) for r in found.collect()}
    assert got == {
        ("4006381333931", 9): 1.0,
        ("knipex zange", 31): 0.95,
        ("KNIPEX", 31): 0.85,
        ("zange", 31): 0.7,
        ("isol", 31): 0.5,
        ("50%", 9): 0.7,
        ("%", 9): 0.7,
        ("k", 31): 0.85,
        ("k", 9): 0.5,
    }


def test_unpriced_matches_come_last(spark, tables):
    found = C.search_articles(tables, spark.createDataFrame([("e",)], "term STRING"))
    ordered = found.orderBy(*C.relevance_order()).collect()
    assert ordered[-1].article_id == 40 and ordered[-1].best_price_cents is None


def test_integrity(tables):
    report = {r.check_name: r.value for r in C.integrity_report(tables).collect()}
    assert report["rows:contract_articles"] == 5
    assert all(v == 0 for k, v in report.items() if not k.startswith("rows:"))
    broken = C.ContractTables(
        **{
            **tables.__dict__,
            "lines": tables.lines.unionAll(tables.lines.filter("contract_article_id = 1")),
            "suppliers": tables.suppliers.filter("supplier_id <> 3"),
            "tiers": tables.tiers.withColumn("max_quantity", F.lit(1)),
        }
    )
    report = {r.check_name: r.value for r in C.integrity_report(broken).collect()}
    assert report["unique:contract_articles.line"] == 1
    assert report["orphan:contracts.supplier_id"] == 1
    assert report["range:tiered_pricing.quantity"] == 4


def test_tiers_meet_lines_before_the_wide_articles(tables):
    """The shuffle for the tiers carries no names or barcodes of articles."""
    joins = [x for x in C.best_tiered_price(tables)._jdf.queryExecution().analyzed().toString().splitlines() if "Join Inner" in x]
    keys = [x.split("(")[1].split("#")[0] for x in joins]
    assert keys.index("article_id") < keys.index("contract_article_id")
