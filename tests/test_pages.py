import json

import pytest
from support import rows
from pyspark.sql import functions as F

from tenderloom.functions import web
from tenderloom.operators import pages as P

GOOD = [
    "http://catalog.tools.test",
    "HTTPS://Catalog.Tools.test/drills/list.php?page=4#top",
    "http://catalog.tools.test:80/",
    "https://catalog.tools.test:0443/",
    "http://catalog.tools.test:8080/a",
    "https://me:secret@catalog.tools.test:8443/offer.pdf",
    "http://203.9.0.7/",
    "http://172.15.255.255/",
    "http://[2a00:1450::5]/",
    "http://[::ffff:93.184.0.1]/",
]
#: One URL for every rule.
BAD = {
    "": "empty",
    None: "empty",
    "https://catalog.tools.test/?q=" + "z" * 5000: "too_long",
    "gopher://catalog.tools.test/1": "scheme",
    "mailto:sales@tools.test": "scheme",
    "catalog.tools.test/drills": "scheme",
    "https:///drills": "missing_host",
    "https://catalog.tools.test:25/": "port",
    "https://catalog.tools.test:80800/": "port",
    "http://LocalHost/": "blocked_host",
    "http://127.8.9.1/": "private_ip",
    "http://10.77.0.9:8080/": "private_ip",
    "http://192.168.44.3/": "private_ip",
    "http://172.29.1.1/": "private_ip",
    "http://100.99.3.2/": "private_ip",
    "http://[::1]:8080/": "private_ip",
    "http://[::ffff:10.4.4.4]/": "private_ip",
    "http://[fe80::77]/": "private_ip",
    "http://[fd00:9::2]/": "private_ip",
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in [*GOOD, *BAD]], "url STRING")
    got = {r.url: r.reject_reason for r in P.screen_urls(df).collect()}
    assert got == {**{u: None for u in GOOD}, **BAD}


def test_report_counts_every_url(spark):
    df = spark.createDataFrame([(u,) for u in [*GOOD, *BAD]], "url STRING")
    report = P.url_screen_report(df)
    assert report.agg(F.sum("pages")).first()[0] == len(GOOD) + len(BAD)
    assert ("catalog.tools.test", "port", 2) in rows(report)


@pytest.mark.parametrize(
    "url, good",
    [
        ("https://img.example.com/a.jpg", True),
        ("https://img.example.com/a?w=10", True),
        ("https://img.example.com/a?w=1", False),
        ("https://img.example.com/a?w=1&h=2", False),
        ("https://img.example.com/a?b=2&w=1", False),
        ("data:image/png;base64,AA", False),
        ("https://Pixel.example.com/a.jpg", False),
        ("https://www.facebook.com/tr?id=1", False),
        ("https://img.example.com/a.SVG", False),
        ("https://img.example.com/Placeholder.png", False),
        ("https://img.example.com/blank.gif?x", False),
        ("https://img.example.com/1x1/a", False),
        ("https://img.example.com/1x1.png", False),
        ("", False),
        (None, False),
    ],
)
def test_image_urls(spark, url, good):
    df = spark.createDataFrame([(url,)], "image_url STRING")
    assert P.screen_image_urls(df).count() == int(good)


def page(*blocks, body=""):
    scripts = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    return f"<html><head>{scripts}</head><body>{body}</body></html>"


def test_product_markup(spark):
    one = {"@type": "Product", "name": "Drill", "offers": {"price": "12.50", "url": "u1", "seller": {"name": "Shop"}}}
    many = [{"@type": "ItemList", "name": "Set", "offers": [{"price": 3}, {"price": 0}, {"price": "x"}]}, {"@type": "Product"}]
    html = page(
        json.dumps(one), json.dumps(many), "{broken", json.dumps({"@type": "Article", "offers": {"price": 1}}),
        body='<h1 class="t"> Big <b>Drill</b></h1> EAN: 4006381333931',
    )
    df = spark.createDataFrame([(1, "https://a.example/", html), (2, "http://10.0.0.1/", "Just a moment...")], "page_id INT, url STRING, html STRING")
    mined = P.mine_pages(df).orderBy("page_id").collect()
    assert (mined[0].heading, mined[0].eans, mined[0].is_challenge) == ("Big Drill", ["4006381333931"], False)
    assert (mined[1].heading, mined[1].is_challenge, mined[1].reject_reason) == (None, True, "private_ip")
    offers = P.page_offers(P.mine_pages(df)).select("product_name", "merchant_name", "price_cents", "ean")
    assert rows(offers) == [
        ("Drill", "Shop", 1250, "4006381333931"),
        ("Set", "Unbekannt", 300, "4006381333931"),
    ]


@pytest.mark.parametrize(
    "link, found",
    [
        ("b.png", "http://h.example:81/x/y/b.png"),
        (" /b.png?z=1 ", "http://h.example:81/b.png?z=1"),
        ("//c.example/b.png", "http://c.example/b.png"),
        ("HTTPS://c.example/b.png", "HTTPS://c.example/b.png"),
        ("../b.png", "http://h.example:81/x/b.png"),
        ("../../../b.png?u=../a", "http://h.example:81/b.png?u=../a"),
        ("./a/./b/../c.png", "http://h.example:81/x/y/a/c.png"),
        ("..", "http://h.example:81/x/"),
        ("?p=2", "http://h.example:81/x/y/z.html?p=2"),
        ("#part", "http://h.example:81/x/y/z.html?p=1#part"),
        ("", None),
        (None, None),
    ],
)
def test_absolute_urls(spark, link, found):
    df = spark.createDataFrame([(link, "http://h.example:81/x/y/z.html?p=1#top")], "link STRING, base STRING")
    assert df.select(web.absolute_url(F.col("link"), F.col("base"))).first()[0] == found
    bare = df.select(web.absolute_url(F.lit("b.png"), F.lit("http://h.example"))).first()[0]
    assert bare == "http://h.example/b.png"


def images(spark, *htmls):
    df = spark.createDataFrame([(n, "http://h.example/d/p", h, "extra") for n, h in enumerate(htmls)], "page_id INT, url STRING, html STRING, kind STRING")
    return df, rows(P.page_images(df).select("page_id", "rank_no", "kind", "image_url"))


def test_page_images(spark):
    product = {"@type": ["ProductGroup"], "image": [{"url": None, "contentUrl": "c.png"}, {"name": "none"}, "d.png"]}
    df, got = images(
        spark,
        page(json.dumps(product), json.dumps({"@type": "Product"}), body="<IMG SRC='e.png'><img alt='src=x'><img>"),
        '<meta name="OG:IMAGE" content="a.png"><meta property="og:image"><meta property="og:image" content="b.svg">',
        "<img src=s.png width=99 height=500><img src=t.png width=300px height=300><img src=u.png><img src=v.png width=500 height=500>",
        "",
        None,
        "<img src='" + "x" * 100_000,
    )
    assert got == [
        (0, 1, "schema", "http://h.example/d/c.png"),
        (0, 2, "schema", "http://h.example/d/d.png"),
        (0, 3, "img", "http://h.example/d/e.png"),
        (1, 1, "og", "http://h.example/d/a.png"),
        (2, 1, "img", "http://h.example/d/v.png"),
        (2, 2, "img", "http://h.example/d/t.png"),
        (2, 3, "img", "http://h.example/d/u.png"),
    ]
    first = P.main_images(df)
    assert first.count() == 6 and first.filter("image_url IS NULL").count() == 3


def test_very_many_tags(spark):
    html = "".join(f"<img data-n='{n}' src='/{n}.png' width={n} height={n}>" for n in range(20_000))
    df, _ = images(spark, html)
    found = P.page_images(df)
    assert found.count() == 20_000 - 100
    assert found.filter("rank_no = 1").first().image_url == "http://h.example/19999.png"


def test_barcodes_of_meta_tags(spark):
    html = "<meta content='12345'><meta itemprop=gtin content=40063813><meta content=' 4006381333931 '>EAN 12345670"
    df = spark.createDataFrame([(1, "https://a.example/", html)], "page_id INT, url STRING, html STRING")
    assert P.mine_pages(df).first().eans == ["40063813", "4006381333931", "12345670"]


def test_mining_reads_whole_pages(spark):
    html = "<p>" + "x" * 300_000 + " EAN 4006381333931</p>"
    df = spark.createDataFrame([(1, "https://a.example/", html)], "page_id INT, url STRING, html STRING")
    row = P.mine_pages(df).first()
    assert row.eans == ["4006381333931"] and row.text_length == 300_018


def test_challenge_pages(spark):
    texts = ["Ray ID: 1", "akamai says access denied", "akamai", "access denied", None]
    df = spark.createDataFrame([(t,) for t in texts], "html STRING")
    assert [r.is_challenge for r in P.flag_challenge_pages(df).collect()] == [True, True, False, False, False]


def test_preferred_sources(spark):
    df = spark.createDataFrame([(1, i, f"https://{h}/x") for i, h in enumerate(["a.com", "Shop.Bosch.de", "b.com"])], "q INT, position INT, url STRING")
    got = P.preferred_first(df, ["q"], ["BOSCH.de"]).orderBy("q", *P.preferred_order())
    assert [r.position for r in got.collect()] == [1, 0, 2]
    assert P.preferred_first(df, ["q"], []).filter("is_preferred").count() == 0


def test_error_report(spark):
    log = spark.createDataFrame([("Timeout", "text/html; x"), ("timeout!", "TEXT/HTML"), ("captcha", None)], "message STRING, content_type STRING")
    got = P.fetch_error_report(log).select("error_code", "mime_type", "errors", "category", "retryable")
    assert rows(got) == [
        ("CAPTCHA_REQUIRED", None, 1, "bot_protection", False),
        ("NETWORK_TIMEOUT", "text/html", 2, "network", True),
    ]


def test_barcodes_of_pages_with_numbers_of_their_own(spark, tmp_path):
    """Digits that follow in the next block, barcodes of the page's own, no page text at all."""
    import compare
    import duckdb

    from tenderloom.plans.inputs import Inputs
    from tenderloom.plans.oracle import oracle_queries
    from tenderloom.plans.registry import QUERIES

    own = ["<p>5 nails", "<p>ocean 12345678</p>7", None, '<meta name="date" content="20240131"><b>GTIN:</b> 123456789012</p>', "", "EAN 1234<b>5678"]
    data = [(k, f"https://a.example/{k}", own[k // 8 % len(own)]) for k in range(8 * len(own))]
    spark.createDataFrame(data, "page_id BIGINT, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_barcodes", "page_offers"):
        got = compare.rows_of_spark(QUERIES[name](Inputs(spark, str(tmp_path))))
        assert got == compare.rows_of_sql(con, oracle_queries()[name])
    found = {r.page_id: r.eans for r in QUERIES["page_barcodes"](Inputs(spark, str(tmp_path))).collect()}
    assert found[5] == "4006381333931" and found[13] == "4006381333931,12345678" and found[21] == "4006381333931"
    assert found[24] == "20240131,123456789012" and found[28] == "4006381333931,20240131,123456789012" and found[47] == ""
