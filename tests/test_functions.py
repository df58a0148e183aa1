import pytest
from support import values
from pyspark.sql import functions as F

from tenderloom.functions import ean, money, text, web

STABILO = "4006381333931"


@pytest.mark.parametrize(
    "price, cents",
    [
        ("7.018,40", 701840),
        ("3,05 je Stück", 305),
        ("etwa 81.25", 8125),
        ("Preis: 640123,09", 64012309),
        ("2.500.000,00 EUR", 250000000),
        ("17 EUR", 1700),
        ("9.800", 980000),
        ("9,800", 980000),
        ("6,40.", 640),
        ("4,321.98", None),
        ("8.765,4", None),
        ("-2,00", None),
        ("12.34.56", None),
        ("nach Absprache", None),
        ("", None),
        (None, None),
    ],
)
def test_price_texts(spark, price, cents):
    assert values(spark, [price], money.parse_price) == [cents]


def test_a_price_text_is_searched_for_its_number_once(spark):
    df = spark.createDataFrame([("ab 7.018,40 EUR",)], "v STRING").select(money.parse_price(F.col("v")).alias("cents"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") + plan.count("regexp_replace") == 1


def test_shipping_texts(spark):
    texts = ["Gratis Versand", "kostenlos", "versandkostenfrei", "0,00 EUR", "4,99 EUR", "10,00", "?", None]
    assert values(spark, texts, money.parse_shipping) == [0, 0, 0, 0, 499, 1000, 0, 0]


def test_money_is_formatted_in_german(spark):
    assert values(spark, [123456, 1234567890, 5, 0], money.format_eur, "BIGINT") == [
        "1.234,56 EUR",
        "12.345.678,90 EUR",
        "0,05 EUR",
        "0,00 EUR",
    ]


def test_savings(spark):
    df = spark.createDataFrame([(10000, 8000), (3333, 2222), (0, 5000)], "a BIGINT, b BIGINT")
    out = df.select(
        money.savings_cents(F.col("a"), F.col("b")), money.savings_percent(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(r) for r in out] == [(2000, 20.0), (1111, 33.3), (-5000, 0.0)]


def test_rounding_is_half_up_and_zero_safe(spark):
    df = spark.createDataFrame([(5, 2), (-5, 2), (4, 3), (7, 0)], "n BIGINT, d BIGINT")
    out = [r[0] for r in df.select(money.div_half_up(F.col("n"), F.col("d"))).collect()]
    assert out == [3, -3, 1, None]


def test_cents_round_trip(spark):
    df = spark.sql("SELECT CAST(12.34 AS DECIMAL(10,2)) AS d, CAST(NULL AS DECIMAL(10,2)) AS n")
    got = df.select(money.to_cents(F.col("d")), money.from_cents(money.to_cents(F.col("d"))), money.to_cents(F.col("n")))
    assert [str(v) for v in got.first()] == ["1234", "12.34", "None"]


def test_check_digits(spark):
    codes = [STABILO, "96385074", "012345678905", "00012345678905", "4006381333932", "12345", "abc", "", None]
    checks = values(spark, codes, ean.ean_check)
    assert [c.valid for c in checks] == [True, True, True, True, False, False, False, False, False]
    assert [c.type for c in checks[:5]] == ["EAN-13", "EAN-8", "UPC-A", "GTIN-14", "EAN-13"]
    assert (checks[4].check_digit, checks[4].expected_check_digit) == (2, 1)
    assert checks[5].error == "EAN must be 8, 12, 13, or 14 digits (got 5)."
    assert checks[6].error == "EAN must contain only digits."
    assert checks[0].error is None


def test_search_type_ignores_the_check_digit(spark):
    texts = [STABILO, "4006-3813 33931", "4006381333932", "Bosch GSR 18V", "123456789"]
    assert values(spark, texts, ean.search_type) == ["ean", "ean", "ean", "name", "name"]


def test_prefix_of_a_short_code_is_padded(spark):
    codes = ["012345678905", STABILO, "12", "abc", "96385074"]
    assert values(spark, codes, ean.country_prefix) == ["001", "400", None, None, "963"]
    assert values(spark, codes[:1], lambda c: ean.country_prefix(c, compat=True)) == ["012"]


def test_prefix_ranges_do_not_overlap(spark):
    prefixes = [r.prefix for r in ean.gs1_prefixes(spark).collect()]
    assert len(prefixes) == len(set(prefixes)) <= 1000
    assert len(ean.gs1_ranges()) == 128


def test_truncate(spark):
    short = values(spark, ["abc", "abcdefghij", "abcdefghijk", None], lambda c: text.truncate(c, 10))
    assert short == ["abc", "abcdefghij", "abcdefg...", ""]


def test_names_are_cleaned(spark):
    decomposed = "Müller    Co\n"
    assert values(spark, [decomposed], text.clean_name) == ["Müller Co"]
    assert values(spark, ["  Bosch GSR "], text.dedup_key) == ["bosch gsr"]


def test_article_codes_and_queries(spark):
    lines = ["Schalter 5TG6-201 weiss", "1234567 Dose", "Rohr 12.5mm", "Dose rund", "5TG6-201"]
    assert values(spark, lines, text.article_code) == ["5TG6-201", "1234567", "12.5mm", None, "5TG6-201"]
    assert values(spark, lines, text.search_query) == [
        "5TG6-201 Schalter  weiss",
        "1234567 Dose",
        "12.5mm Rohr",
        "Dose rund",
        "5TG6-201",
    ]


def test_barcodes_in_page_text_keep_all_digits(spark):
    page = "EAN: 4006381333931 und GTIN 96385074, ean:\n012345678905 EAN x"
    assert values(spark, [page], text.ean_mentions) == [[STABILO, "96385074", "012345678905"]]


def test_redirects_are_unwrapped(spark):
    urls = [
        "https://s.example/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1&rut=2",
        "/aclk?sa=L&adurl=https://b.example/",
        "/url?q=https%3A%2F%2Fc.example%2F&sa=U",
        "/url?q=weather",
        "https://d.example/p",
    ]
    assert values(spark, urls, web.target_url) == [
        "https://a.example/x?y=1",
        "https://b.example/",
        "https://c.example/",
        "/url?q=weather",
        "https://d.example/p",
    ]


@pytest.mark.parametrize(
    "message, code",
    [
        ("no disk left", "INTERNAL_ERROR"),
        ("goto gave up: timeout of 9 s", "NETWORK_TIMEOUT"),
        ("peer said NET::ERR_CONNECTION_REFUSED", "CONNECTION_REFUSED"),
        ("please solve the captcha first", "CAPTCHA_REQUIRED"),
        ("(net::err_name_not_resolved) shop.invalid", "DNS_RESOLUTION_FAILED"),
        (None, "INTERNAL_ERROR"),
    ],
)
def test_fetch_errors(spark, message, code):
    assert values(spark, [message], web.error_code) == [code]


def test_mime_types(spark):
    headers = ["Text/HTML; charset=utf-8", "image/png", "", " ; x", None]
    assert values(spark, headers, web.mime_of) == ["text/html", "image/png", None, None, None]
