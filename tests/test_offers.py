import random

import pytest
from support import rows, values
from pyspark.sql import functions as F

from tenderloom.functions.text import rfq_lines
from tenderloom.operators import offers as O

SCHEMA = (
    "position BIGINT, product_name STRING, ean STRING, brand STRING, image_url STRING, merchant_name STRING, "
    "total_cents BIGINT, source STRING, category STRING"
)


@pytest.fixture
def make(spark):
    def build(*items):
        data = [
            (
                i,
                o.get("name", "Bosch GSR"),
                o.get("ean"),
                o.get("brand"),
                o.get("image"),
                o.get("merchant", f"M{i}"),
                o["total"],
                o.get("source", "idealo"),
                o.get("category", "drills"),
            )
            for i, o in enumerate(items)
        ]
        return spark.createDataFrame(data, SCHEMA).selectExpr(
            "*", "total_cents AS price_cents", "0L AS shipping_cents", "'u' AS product_url"
        )

    return build


def insight(make, totals, **more):
    row = O.price_insights(make(*[{"total": t, **more} for t in totals]), ["product_name"]).first()
    return row


def test_insights(make):
    row = insight(make, [1000, 2000, 3000])
    assert (row.min_price_cents, row.max_price_cents, row.median_price_cents) == (1000, 3000, 2000)
    assert (row.avg_price_cents, row.price_spread_cents, row.num_offers) == (2000, 2000, 3)
    assert insight(make, [10000, 20000]).price_spread_percent == 66.7
    assert insight(make, [999]) is None
    assert insight(make, [100, 101]).median_price_cents == 101


def test_insights_count_merchants_without_case(make):
    df = make(
        {"total": 100, "merchant": "Shop", "source": "idealo"},
        {"total": 200, "merchant": "SHOP", "source": "geizhals"},
        {"total": 300, "merchant": "Other", "source": "idealo"},
    )
    row = O.price_insights(df, ["category"]).first()
    assert (row.num_merchants, row.sources_with_results) == (2, "geizhals,idealo")


def test_merge_joins_names_without_case(make):
    df = make(
        {"name": "Bosch GSR", "total": 1000},
        {"name": " bosch gsr", "total": 800, "merchant": "Cheap", "ean": "4006381333931", "brand": "Bosch"},
        {"name": "Other", "total": 500, "ean": ""},
        {"name": "Unpriced", "total": None},
    )
    merged = O.merge_products(df).orderBy(F.asc_nulls_last("cheapest_price_cents")).collect()
    assert [m.product_name for m in merged] == ["Other", "Bosch GSR", "Unpriced"]
    bosch = merged[1]
    assert (bosch.num_offers, bosch.cheapest_price_cents, bosch.cheapest_merchant) == (2, 800, "Cheap")
    assert (bosch.ean, bosch.brand) == ("4006381333931", "Bosch")
    assert merged[0].ean is None


def test_first_offer_wins_a_tie(make):
    df = make({"total": 500, "merchant": "First"}, {"total": 500, "merchant": "Second"})
    assert O.merge_products(df).first().cheapest_merchant == "First"
    best = O.best_market_offers(df, "product_name").first()
    assert best.market_merchant == "First"


def test_suppliers_are_ranked_once_per_merchant(make):
    df = make(
        {"total": 900, "merchant": "A"},
        {"total": 700, "merchant": "a"},
        {"total": 800, "merchant": "B"},
        {"total": 700, "merchant": "A"},
    )
    ranked = O.rank_suppliers(df, ["product_name"]).select("supplier_rank", "merchant_name", "total_cents")
    assert rows(ranked) == [(1, "a", 700), (2, "B", 800)]
    row = O.supplier_insights(df, ["product_name"]).first()
    assert (row.num_offers, row.num_merchants, row.median_price_cents) == (4, 2, 750)


def test_alternatives_equal_brute_force(spark, make):
    items = [
        {
            "name": f"P{i % 17}",
            "total": 100 + (i * 37) % 90,
            "source": ("idealo", "geizhals", "google_shopping")[i % 3],
            "category": f"c{i % 2}",
        }
        for i in range(120)
    ]
    references = [(i, f"c{i % 2}", 90 + i * 4) for i in range(30)]
    k = 4
    expected = []
    for ref, category, price in references:
        listed = []
        for source in ("idealo", "geizhals", "google_shopping"):
            cheapest = {}
            for o in items:
                if o["category"] == category and o["source"] == source:
                    cheapest[o["name"].lower()] = min(o["total"], cheapest.get(o["name"].lower(), 10**9))
            below = sorted((t, n) for n, t in cheapest.items() if t < price * 0.95)
            listed += [(t, n) for t, n in below[:k]]
        unique = {}
        for total, name in sorted(listed, key=lambda x: x[0]):
            unique.setdefault(name, total)
        expected += [(ref, total) for total in list(unique.values())[:k]]
    df = spark.createDataFrame(references, "ref_id INT, category STRING, reference_cents BIGINT")
    got = O.cheaper_alternatives(df, make(*items), k)
    assert rows(got.select("ref_id", "cheapest_price_cents")) == sorted(expected, key=lambda r: tuple((False, str(v)) for v in r))


def test_a_price_just_below_the_limit(spark, make):
    df = spark.createDataFrame([(1, "drills", 10000)], "ref_id INT, category STRING, reference_cents BIGINT")
    assert O.cheaper_alternatives(df, make({"total": 9500})).count() == 0
    row = O.cheaper_alternatives(df, make({"total": 9499})).first()
    assert (row.savings_cents, row.savings_percent) == (501, 5.0)


@pytest.mark.parametrize(
    "raw, items",
    [
        ("10 x 4006381333931 | Pos. 1.1", [("4006381333931", 10, "Pos. 1.1")]),
        ("Bosch GSR 18V-28", [("Bosch GSR 18V-28", 1, None)]),
        ("5 x Hilti TE 30-A36, 3 x Fischer FIS V 360", [("Hilti TE 30-A36", 5, None), ("Fischer FIS V 360", 3, None)]),
        ("10x Schraube\n\n  2 X Mutter | A | B \n", [("Schraube", 10, None), ("Mutter", 2, "A | B")]),
        ("Kabel, rot | Pos. 2", [("Kabel, rot", 1, "Pos. 2")]),
        ("a, b\nc", [("a, b", 1, None), ("c", 1, None)]),
        ("   ", []),
        ("10x4mm Draht", [("10x4mm Draht", 1, None)]),
    ],
)
def test_request_texts(spark, raw, items):
    df = O.parse_rfq(spark.createDataFrame([(1, raw)], "rfq_id INT, text STRING"))
    got = [(r.query, r.quantity, r.label) for r in df.orderBy("line_no").collect()]
    assert got == items


def test_request_lines_keep_whole_text(spark):
    raw = "\n".join(f"{i} x item {i}" for i in range(1, 2001))
    assert [len(v) for v in values(spark, [raw], rfq_lines)] == [2000]


def test_request_costs(spark, make):
    df = make(
        {"name": "Drill", "total": 1000, "ean": "4006381333931"},
        {"name": "drill", "total": 900, "merchant": "Best"},
        {"name": "Nail", "total": 5},
    )
    items = O.parse_rfq(
        spark.createDataFrame([(1, "10 x 4006-3813-33931 | A\n2 x DRILL\nUnknown thing")], "rfq_id INT, text STRING")
    )
    costed = O.cost_rfq(items, df)
    got = [(r.query, r.unit_price_cents, r.total_price_cents, r.merchant, r.num_offers, r.error) for r in costed.orderBy("line_no").collect()]
    assert got == [
        ("4006-3813-33931", 900, 9000, "Best", 2, None),
        ("DRILL", 900, 1800, "Best", 2, None),
        ("Unknown thing", None, None, None, 0, O.NO_OFFERS),
    ]
    total = O.rfq_totals(costed).first()
    assert (total.grand_total_cents, total.success_count, total.total_count) == (10800, 2, 3)


def test_request_lines_carry_insights(spark, make):
    """An offer without barcode counts for its product's; one priced offer gives no statistics."""
    df = make(
        {"name": "Drill", "total": 1000, "ean": "4006381333931", "source": "idealo"},
        {"name": " drill", "total": 900, "merchant": "Best", "source": "geizhals"},
        {"name": "DRILL", "total": 2000, "merchant": "best", "source": "geizhals"},
        {"name": "Drill", "total": None, "merchant": "Other"},
        {"name": "Nail", "total": 5},
        {"name": "Nail", "total": None},
    )
    text = "10 x 4006-3813-33931\n2 x drill\n3 x drill\nNail\nUnknown thing"
    items = O.parse_rfq(spark.createDataFrame([(1, text), (2, None)], "rfq_id INT, text STRING"))
    got = O.cost_rfq_with_insights(items, df).orderBy("line_no").collect()
    wanted = (900, 2000, 1000, 1300, 1100, 110.0, 2, "geizhals,idealo")
    assert [tuple(r[c] for c in O.LINE_INSIGHTS) for r in got] == [wanted] * 3 + [(None,) * 8] * 2
    assert [(r.quantity, r.total_price_cents, r.error) for r in got] == [
        (10, 9000, None),
        (2, 1800, None),
        (3, 2700, None),
        (1, 5, None),
        (1, None, O.NO_OFFERS),
    ]
    assert O.cost_rfq_with_insights(items.limit(0), df).count() == 0
    assert O.cost_rfq_with_insights(items, df.limit(0)).filter("error IS NULL").count() == 0


def test_contract_report_has_totals_and_insights(spark, make):
    contracts = spark.createDataFrame(
        [(1, "a", 12000, 3), (2, "a", 9000, 1), (3, "z", 100, 2), (4, None, 100, 2), (5, "b", 100, None)],
        "line INT, ean STRING, contract_price_cents BIGINT, quantity BIGINT",
    )
    market = make({"total": 10000, "ean": "a"}, {"total": 20000, "ean": "a"}, {"total": 50, "ean": "b"})
    got = O.contract_market_report(contracts, market)
    columns = ("contract_total_cents", "market_total_cents", "total_difference_cents", "median_price_cents", "market_url")
    assert rows(got.select("line", *columns)) == [
        (1, 36000, 30000, 6000, 15000, "u"),
        (2, 9000, 10000, -1000, 15000, "u"),
        (3, 200, None, None, None, None),
        (4, 200, None, None, None, None),
        (5, None, None, None, None, "u"),
    ]


def test_contract_verdicts(spark, make):
    contracts = spark.createDataFrame(
        [(1, "a", 12000), (2, "a", 10700), (3, "a", 10300), (4, "a", 10000), (5, "a", 9000), (6, "z", 100)],
        "line INT, ean STRING, contract_price_cents BIGINT",
    )
    got = O.contract_vs_market(contracts, make({"total": 10000, "ean": "a"}, {"total": 20000, "ean": "a"}))
    assert rows(got.select("line", "verdict", "price_difference_percent")) == [
        (1, "urgent_renegotiation", 16.7),
        (2, "renegotiate", 6.5),
        (3, "near_market", 2.9),
        (4, "at_market", 0.0),
        (5, "below_market", -11.1),
        (6, "no_market_data", None),
    ]


def test_top_per_source_takes_what_is_asked(make):
    df = make(*[{"total": i, "source": ("idealo", "geizhals")[i % 2]} for i in range(100)])
    assert O.top_per_source(df, ["category"], 45).count() == 90
    with pytest.raises(ValueError):
        O.top_per_source(df, ["category"], 0)


@pytest.mark.parametrize("limit", ["1", "1000000"])
def test_merchants_of_equal_price_rank_by_arrival(spark, make, limit):
    prices = [("Zeta", 700), ("alpha", 500), ("Mid", 500), ("ALPHA", 500), ("beta", 900), ("Zeta", 500)]
    df = make(*[{"total": t, "merchant": m} for m, t in prices])
    spark.conf.set("spark.tenderloom.rowsInTask", limit)
    try:
        got = O.rank_suppliers(df, ["category"]).orderBy("supplier_rank").collect()
    finally:
        spark.conf.unset("spark.tenderloom.rowsInTask")
    assert [r.merchant_name for r in got] == ["Zeta", "alpha", "Mid", "beta"]


def test_sorted_and_split_price_statistics_agree(spark):
    rng = random.Random(4)
    rows = [
        (rng.choice(["a", "b", "c", None]), rng.randint(1, 9), rng.choice(["M", "m", "N", None]), rng.choice(["x", "y", None]))
        for _ in range(60)
    ] + [("one", 5, "M", "x"), ("two", 5, None, None), ("two", 8, None, None)]
    table = spark.createDataFrame(rows, "k STRING, total_cents BIGINT, merchant_name STRING, source STRING")
    priced = table.withColumn("_merchant", F.lower("merchant_name")).drop("merchant_name").filter("k IS NOT NULL")
    order = sorted(O._split_statistics(priced, ["k"]).columns)
    plain = O._sorted_statistics(priced, ["k"]).select(order)
    want = sorted(map(tuple, O._split_statistics(priced, ["k"]).select(order).collect()))
    # Rows of ordinary groups move once, whatever is worked out from them.
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, plain.collect())) == want and len(want) == 4
    whole = sorted(map(tuple, O.price_insights(table, ["k"]).collect()))
    spark.conf.set("spark.tenderloom.rowsInTask", "10")
    try:
        assert sorted(map(tuple, O.price_insights(table, ["k"]).collect())) == whole
    finally:
        spark.conf.unset("spark.tenderloom.rowsInTask")


def test_ranking_moves_the_offers_of_merchants_once(inputs):
    plan = O.rank_suppliers(inputs.offers, ["article_ean"])._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "merchant_key" in line]
    # Once for the ordinary articles, and for the hot ones once for their rows and once for the counts of their pieces.
    assert len(moved) == 3
