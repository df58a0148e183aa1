"""Procurement, offer and telemetry inputs derived from the shared test tables.

Every derivation reads whole tables and grows with them. ``plans.oracle`` states the
same derivations in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions.ean import expected_check_digit
from tenderloom.functions.money import int_div
from tenderloom.operators.contracts import ContractTables
from tenderloom.operators.offers import source_rank

AS_OF = "1998-06-30"
LINE_ID_STEP = 10_000_000


def _cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


class Inputs:
    """Lazily derived DataFrames for one scale-factor directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # -- procurement ----------------------------------------------------------

    @cached_property
    def categories(self) -> DataFrame:
        name = F.col("p_type")
        return (
            self.table("part")
            .select(name.alias("category_name"))
            .distinct()
            .select(_category_id(F.col("category_name")).alias("category_id"), "category_name")
        )

    @cached_property
    def articles(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("article_id"),
            _article_ean(key).alias("ean"),
            F.concat_ws(" ", "p_name", key.cast("string")).alias("article_name"),
            F.col("p_brand").alias("brand"),
            F.concat(F.lit("Maker of "), "p_brand").alias("manufacturer"),
            F.concat(F.col("p_type"), F.lit(" size "), F.col("p_size").cast("string")).alias(
                "description"
            ),
            _category_id(F.col("p_type")).alias("category_id"),
            F.lit("piece").alias("unit"),
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        # Told to be unique, nations are joined only where a query asks for the country.
        nations = self.table("nation").select("n_nationkey", "n_name").dropDuplicates(["n_nationkey"])
        supplier = self.table("supplier")
        return supplier.join(nations, supplier["s_nationkey"] == nations["n_nationkey"], "left").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.concat(F.lit("Contact "), "s_name").alias("contact_person"),
            F.concat(F.lit("sales"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias(
                "email"
            ),
            F.concat(F.lit("+49 "), F.col("s_suppkey").cast("string")).alias("phone"),
            F.col("n_name").alias("country"),
        )

    @cached_property
    def contracts(self) -> DataFrame:
        key = F.col("s_suppkey")
        status = F.when(key % 11 == 10, "expired").when(key % 13 == 12, "draft").otherwise("active")
        return self.table("supplier").select(
            key.alias("contract_id"),
            F.concat(F.lit("FC-"), F.lpad(key.cast("string"), 5, "0")).alias("contract_number"),
            key.alias("supplier_id"),
            F.concat(F.lit("Framework "), "s_name").alias("title"),
            F.lit("1.0").alias("version"),
            status.alias("status"),
            F.to_date(F.when(key % 2 == 0, "1995-01-01").otherwise("1997-01-01")).alias("valid_from"),
            F.to_date(F.when(key % 5 == 4, "1998-12-31").otherwise("2001-12-31")).alias(
                "valid_until"
            ),
            F.lit("30 days net").alias("payment_terms"),
            F.lit("DDP").alias("delivery_terms"),
            (key % 10 * 1000).alias("minimum_order_value_cents"),
            (key % 10 * 5000).alias("free_shipping_threshold_cents"),
        )

    def _unit_cents(self) -> Column:
        return F.floor(F.round(F.col("l_extendedprice") * 100) / F.col("l_quantity")).cast("bigint")

    @cached_property
    def lines(self) -> DataFrame:
        line = F.col("l_partkey") * LINE_ID_STEP + F.col("l_suppkey")
        prices = (
            # Dealt by line, where lines meet their tiers.
            self.table("lineitem")
            .withColumn("contract_article_id", line)
            .repartition("contract_article_id")
            .groupBy("contract_article_id", "l_partkey", "l_suppkey")
            .agg(
                F.min(self._unit_cents()).alias("low"),
                F.max(self._unit_cents()).alias("high"),
                F.min("l_quantity").cast("bigint").alias("min_order_qty"),
                F.min("l_linenumber").cast("bigint").alias("delivery_days"),
            )
        )
        listed = int_div(F.col("high") * 125, F.lit(100))
        discount = int_div((F.col("list_price_cents") - F.col("low")) * 10000, F.col("list_price_cents"))
        return prices.withColumn("list_price_cents", listed).select(
            "contract_article_id",
            F.col("l_suppkey").alias("contract_id"),
            F.col("l_partkey").alias("article_id"),
            F.col("low").alias("contract_price_cents"),
            "list_price_cents",
            (discount.cast("decimal(9,0)") * F.lit("0.01").cast("decimal(3,2)"))
            .cast("decimal(7,2)")
            .alias("discount_pct"),
            "min_order_qty",
            "delivery_days",
            (F.col("l_suppkey") % 7 == 0).alias("is_preferred"),
        )

    @cached_property
    def tiers(self) -> DataFrame:
        steps = F.array(
            *[
                F.struct(
                    F.lit(number).cast("bigint").alias("number"),
                    F.lit(low).cast("bigint").alias("min_quantity"),
                    F.lit(high).cast("bigint").alias("max_quantity"),
                    F.lit(percent).cast("bigint").alias("percent"),
                )
                for number, low, high, percent in ((1, 10, 24, 5), (2, 25, 39, 10), (3, 40, None, 20))
            ]
        )
        line = F.col("contract_article_id")
        return (
            self.lines.filter(F.col("article_id") % 2 == 0)
            .select("contract_article_id", "contract_price_cents", F.explode(steps).alias("s"))
            .select(
                (line * 10 + F.col("s.number")).alias("tier_id"),
                "contract_article_id",
                "s.min_quantity",
                "s.max_quantity",
                int_div(F.col("contract_price_cents") * (100 - F.col("s.percent")), F.lit(100)).alias(
                    "tier_price_cents"
                ),
                F.col("s.percent").cast("decimal(5,2)").alias("discount_pct"),
            )
        )

    @cached_property
    def procurement(self) -> ContractTables:
        return ContractTables(
            articles=self.articles,
            categories=self.categories,
            suppliers=self.suppliers,
            contracts=self.contracts,
            lines=self.lines,
            tiers=self.tiers,
        )

    @cached_property
    def demand(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("demand_id"), F.col("l_partkey").alias("article_id"))
            .agg(F.sum("l_quantity").cast("bigint").alias("qty"))
        )

    @cached_property
    def ordered_articles(self) -> DataFrame:
        """The article of every order line, of which demand rows and contract lines are groups."""
        return self.table("lineitem").select(F.col("l_partkey").alias("article_id"))

    # -- market ---------------------------------------------------------------

    @cached_property
    def offers(self) -> DataFrame:
        number = F.col("l_linenumber")
        name = F.when(number % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
        source = (
            F.when(number % 3 == 0, "idealo").when(number % 3 == 1, "geizhals").otherwise("google_shopping")
        )
        shipping = F.when(number == 1, 0).otherwise(number * 99).cast("bigint")
        parts = self.table("part").select(
            "p_partkey", "p_name", "p_type", "p_brand", _article_ean(F.col("p_partkey")).alias("ean")
        )
        merchants = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
        items = self.table("lineitem").select(
            "l_orderkey",
            F.col("l_partkey").alias("p_partkey"),
            "l_suppkey",
            "l_linenumber",
            self._unit_cents().alias("price_cents"),
        )
        rows = (
            # The wide side last: where neither side is small enough to be sent, rows move while they are narrow.
            items.join(merchants, "l_suppkey")
            .join(parts, "p_partkey")
            .withColumns({"source": source, "shipping_cents": shipping})
        )
        return rows.select(
            F.concat_ws(" ", name, F.col("p_partkey").cast("string")).alias("product_name"),
            F.when(number % 3 == 0, F.col("ean")).otherwise("").alias("ean"),
            F.col("ean").alias("article_ean"),
            F.when(number % 4 == 0, F.col("p_brand")).alias("brand"),
            F.lit(None).cast("string").alias("image_url"),
            F.col("p_type").alias("category"),
            F.col("s_name").alias("merchant_name"),
            "price_cents",
            "shipping_cents",
            (F.col("price_cents") + F.col("shipping_cents")).alias("total_cents"),
            F.concat(
                F.lit("https://shop.example.com/"), F.col("l_suppkey").cast("string")
            ).alias("product_url"),
            "source",
            F.struct(
                source_rank(F.col("source")).alias("source_rank"),
                "l_orderkey",
                "l_linenumber",
                "l_suppkey",
                "price_cents",
            ).alias("position"),
        )

    # -- texts ----------------------------------------------------------------

    @cached_property
    def article_lines(self) -> DataFrame:
        key, name = F.col("p_partkey"), F.col("p_name")
        text_key = key.cast("string")
        kind = key % 10
        text = (
            F.when(kind == 0, F.concat(name, F.lit(" Nettoartikel")))
            .when(kind == 1, F.concat(name, F.lit(" Brutto")))
            .when(kind == 2, F.concat(name, F.lit(" Brutto "), F.lpad(text_key, 5, "1")))
            .when(kind == 3, F.concat(F.lpad(text_key, 5, "7"), F.lit(" "), name))
            .when(kind == 4, F.concat(F.lit("AB"), text_key, F.lit("-XZ9 "), name))
            .when(kind == 5, F.lit("  "))
            .otherwise(F.concat(name, F.lit(" "), text_key))
        )
        return self.table("part").select(key.alias("line_id"), text.alias("text"))

    @cached_property
    def rfq_barcodes(self) -> DataFrame:
        """A request of one line per article: its barcode, in the quantity of its size."""
        columns = [F.col("p_partkey").alias("rfq_id"), _article_ean(F.col("p_partkey")).alias("query")]
        return self.table("part").select(*columns, F.col("p_size").cast("bigint").alias("quantity"))

    @cached_property
    def purchases(self) -> DataFrame:
        """Contract lines with their article's barcode and the quantity ordered under them."""
        ordered = (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("article_id"), F.col("l_suppkey").alias("contract_id"))
            .agg(F.sum("l_quantity").cast("bigint").alias("quantity"))
        )
        lines = self.lines.select("article_id", "contract_id", "contract_price_cents")
        return lines.join(ordered, ["article_id", "contract_id"]).join(
            self.articles.select("article_id", "ean"), "article_id"
        )

    @cached_property
    def offer_texts(self) -> DataFrame:
        """Price and shipping of every offer as shops print them."""
        number, price = F.col("position.l_linenumber"), F.col("price_cents")
        euros, cents = F.floor(price / 100).cast("string"), F.lpad((price % 100).cast("string"), 2, "0")
        grouped = F.concat(F.format_number(F.floor(price / 100), 0), F.lit(","), cents)
        printed = F.when(number % 2 == 0, F.concat(F.lit("ab "), euros, F.lit("."), cents, F.lit(" EUR"))).otherwise(
            F.concat(F.regexp_replace(grouped, r",(?=\d{3})", "."), F.lit(" \u20ac"))
        )
        shipping = (
            F.when(number == 1, "Gratis Versand")
            .when(number == 2, "versandkostenfrei")
            .when(number == 3, "unbekannt")
            .when(number == 4, F.lit(None))
            .otherwise(F.concat(F.lit("zzgl. "), number.cast("string"), F.lit(",99 \u20ac Versand")))
        )
        return self.offers.select(
            "source", "merchant_name", "price_cents", printed.alias("price_text"), shipping.alias("shipping_text")
        )

    @cached_property
    def rfq_requests(self) -> DataFrame:
        key, name = F.col("p_partkey"), F.col("p_name")
        text_key = key.cast("string")
        quantity = (key % 9 + 1).cast("string")
        item = F.concat(name, F.lit(" "), text_key)
        text = (
            F.when(
                key % 3 == 0,
                F.concat(quantity, F.lit(" x "), item, F.lit(" | Pos. "), text_key, F.lit("\n"), item),
            )
            .when(key % 3 == 1, F.concat(quantity, F.lit("x "), item, F.lit(", "), item))
            .otherwise(item)
        )
        return self.table("part").select(key.alias("rfq_id"), text.alias("text"))

    # -- telemetry ------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @staticmethod
    def spans_of(events: DataFrame) -> DataFrame:
        return events.select(
            "event_id",
            "ts",
            F.col("event_type").alias("service"),
            F.when(F.col("user_id") % 2 == 0, "prod").otherwise("dev").alias("env"),
            (F.col("user_id") % 10).alias("resource_no"),
            (_cents(F.col("value")) * 10000).alias("duration_ns"),
            (F.col("value") > 150).alias("is_error"),
        )

    @cached_property
    def spans(self) -> DataFrame:
        return self.spans_of(self.events)

    @cached_property
    def points(self) -> DataFrame:
        value = F.when(
            F.col("event_id") % 17 != 0,
            _cents(F.col("value")).cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)"),
        )
        return self.events.select(
            F.col("event_type").alias("series"), "ts", "event_id", value.alias("value")
        )

    @cached_property
    def fetch_log(self) -> DataFrame:
        messages = (
            "goto: Timeout after 12 s",
            "socket: net::ERR_CONNECTION_RESET by peer",
            "lookup failed (net::ERR_NAME_NOT_RESOLVED)",
            "a captcha blocks the way",
            "the Browser has been closed early",
            "disk quota reached",
        )
        message = F.get(F.array(*[F.lit(m) for m in messages]), (F.col("event_id") % 6).cast("int"))
        header = (
            F.when(F.col("event_id") % 4 == 0, "Text/HTML; charset=utf-8")
            .when(F.col("event_id") % 4 == 1, "image/png")
            .when(F.col("event_id") % 4 == 2, "")
        )
        return self.events.select(
            "event_id", message.alias("message"), header.alias("content_type")
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def event_number(self) -> Column:
        """The number carried in the events' JSON properties."""
        return F.get_json_object("props", "$.k").cast("bigint")

    @cached_property
    def usage(self) -> DataFrame:
        measure = F.array(
            F.struct(F.lit("value").alias("usage_type"), _cents(F.col("value")).alias("value")),
            F.struct(F.lit("k").alias("usage_type"), self.event_number.alias("value")),
        )
        return self.events.select(
            F.col("event_type").alias("product_family"),
            F.col("ts").alias("timestamp"),
            measure.alias("measurements"),
        )

    @cached_property
    def cost(self) -> DataFrame:
        charge = F.array(
            F.struct(
                F.col("event_type").alias("product_name"),
                F.lit("committed").alias("charge_type"),
                _cents(F.col("value")).alias("cost_cents"),
            ),
            F.struct(
                F.col("event_type").alias("product_name"),
                F.lit("on_demand").alias("charge_type"),
                self.event_number.alias("cost_cents"),
            ),
        )
        return self.events.select(
            F.concat(F.lit("org"), (F.col("user_id") % 7).cast("string")).alias("org_name"),
            F.to_date("ts").alias("date"),
            charge.alias("charges"),
        )

    @cached_property
    def test_results(self) -> DataFrame:
        return self.events.select(
            (F.col("user_id") % 20).alias("public_id"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("status"),
        )

    @cached_property
    def hosts(self) -> DataFrame:
        return self.events.groupBy(F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("name")).agg(
            (F.max("value") <= 200).alias("up")
        )

    @cached_property
    def queues(self) -> DataFrame:
        return self.events.groupBy(
            F.concat(F.lit("q/"), F.col("user_id").cast("string")).alias("queueName"),
            F.lit("default").alias("msgVpnName"),
        ).agg(
            F.count(F.lit(1)).alias("spooledMsgCount"),
            F.sum(_cents(F.col("value"))).alias("msgSpoolUsage"),
            F.lit(500_000).cast("bigint").alias("maxMsgSpoolUsage"),
            F.count_if(F.col("event_type") == "click").alias("consumerCount"),
            F.max("event_id").alias("lastEventId"),
        )

    @cached_property
    def tagged_series(self) -> DataFrame:
        user = (F.col("user_id") % 10).cast("string")
        return self.events.select(
            F.concat(F.lit("app."), "event_type", F.lit(".r"), user).alias("metric"),
            F.array(
                F.concat(F.lit("type:"), "event_type"),
                F.concat(F.lit("user:"), user),
                F.concat(F.lit("env:"), F.when(F.col("user_id") % 2 == 0, "prod").otherwise("dev")),
            ).alias("tags"),
        )

    @cached_property
    def titled_events(self) -> DataFrame:
        """Events with a display title; every fifth has none."""
        title = F.when(
            F.col("event_id") % 5 != 0,
            F.concat(F.initcap("event_type"), F.lit(" of user "), F.col("user_id").cast("string")),
        )
        return self.events.select("event_id", title.alias("title"))

    @cached_property
    def shopping_responses(self) -> DataFrame:
        """Shopping search responses with one result per part, prices in several notations."""
        key = F.col("p_partkey")
        euros, cents = (key % 2000).cast("string"), F.lpad((key % 100).cast("string"), 2, "0")
        price = (
            F.when(key % 5 == 0, F.concat(F.lit("1."), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(","), cents, F.lit(" EUR")))
            .when(key % 5 == 1, F.concat(euros, F.lit(","), cents))
            .when(key % 5 == 2, F.concat(F.lit("EUR "), euros, F.lit("."), cents))
            .when(key % 5 == 3, F.lit("auf Anfrage"))
            .otherwise(euros)
        )
        item = F.struct(
            F.col("p_name").alias("title"),
            price.alias("price"),
            F.when(key % 3 != 0, F.col("p_brand")).alias("source"),
            F.concat(F.lit("https://x.example/"), key.cast("string")).alias("link"),
            F.lit(None).cast("double").alias("rating"),
            key.alias("reviews"),
            F.col("p_brand").alias("brand"),
            F.lit(None).cast("string").alias("thumbnail"),
        )
        return self.table("part").select(
            key.cast("string").alias("query"), F.array(item).alias("shopping_results")
        )

    @cached_property
    def image_urls(self) -> DataFrame:
        """Picture links per page in the forms the image screen tells apart."""
        key, number = F.col("page_id"), F.col("page_id").cast("string")
        url = (
            F.when(key % 8 == 0, F.concat(F.lit("https://img.example.com/p/"), number, F.lit(".jpg")))
            .when(key % 8 == 1, F.concat(F.lit("https://img.example.com/p/"), number, F.lit(".SVG")))
            .when(key % 8 == 2, F.concat(F.lit("https://pixel.example.com/"), number, F.lit(".png")))
            .when(key % 8 == 3, F.concat(F.lit("https://img.example.com/i?id="), number, F.lit("&w=1")))
            .when(key % 8 == 4, F.concat(F.lit("https://img.example.com/i?w=1&id="), number))
            .when(key % 8 == 5, F.lit("data:image/png;base64,AAAA"))
            .when(key % 8 == 6, F.concat(F.lit("https://img.example.com/i?w=120&id="), number))
            .otherwise(F.concat(F.lit("https://img.example.com/1x1/"), number, F.lit(".gif")))
        )
        return self.pages.select("page_id", "url", url.alias("image_url"))

    @cached_property
    def marked_pages(self) -> DataFrame:
        """Pages with product markup before their own: offers, picture links and barcodes in many forms."""
        block = '<script type="application/ld+json">%s</script>'
        forms = (
            block % '{"@type":"Product","name":"Drill #","image":"/img/#.jpg","offers":'
            '{"price":"#.50","url":"https://shop.example.com/#","seller":{"name":"Shop"}}}',
            block % '[{"@type":"ItemList","name":"Set #","offers":[{"price":3.25},{"price":0},{"price":"on demand"}]},'
            '{"@type":"Product","image":["pics/#-a.png",{"contentUrl":"//cdn.example.com/#.png"},"data:image/png;base64,AA"]}]',
            block % '{"@graph":[{"@type":["Thing","Product"],"name":"Saw #","image":{"url":"https://img.example.com/#.webp"},'
            '"offers":[{"price":#},{"price":"12.99","seller":{"name":"B"}}]},{"@type":"Article","image":"/no.jpg"}]}',
            '<meta property="og:image" content="../og/#.jpg?a=1&amp;b=2"><meta content=\'/og/#-2.jpg\' property=\'og:image\'>'
            + block % '{"@type":"Product","image":"/img/#.jpg"}',
            '<meta itemprop="gtin13" content=" 4006381333931 "><img alt="a > b" src="/s.svg" data-src="l/#.jpg" width="120" '
            'height="110"><img src=big/#.jpg width=800 height=600><img width="50" height="50" src="/tiny.png">',
            '<img srcset="/set/#-1.jpg 1x, /set/#-2.jpg 2x"><!-- <img src="/c.jpg"> --><script>a=\'<img src="/d.jpg">\'</script>'
            '<img src="https://pixel.example.com/#.gif"><p>EAN: 4006381333931</p>',
            block % "{broken" + block % '{"@type":"Article","name":"#","image":"/no.jpg","offers":{"price":1}}',
            "",
        )
        form = F.get(F.array(*[F.lit(f) for f in forms]), (F.col("page_id") % len(forms)).cast("int"))
        markup = F.replace(form, F.lit("#"), F.col("page_id").cast("string"))
        return self.pages.select("page_id", "url", F.concat(markup, F.coalesce("html", F.lit(""))).alias("html"))

    @cached_property
    def redirects(self) -> DataFrame:
        """Page links wrapped the way search engines wrap them."""
        key, url = F.col("page_id"), F.col("url")
        quoted = F.url_encode(url)
        wrapped = (
            F.when(key % 4 == 0, F.concat(F.lit("https://search.example/l/?uddg="), quoted, F.lit("&rut=1")))
            .when(key % 4 == 1, F.concat(F.lit("/aclk?sa=L&adurl="), quoted))
            .when(key % 4 == 2, F.concat(F.lit("/url?q="), quoted, F.lit("&sa=U")))
            .otherwise(url)
        )
        return self.pages.select("page_id", "url", wrapped.alias("wrapped"))

    def records(self, kind: str) -> DataFrame:
        """JSON text records of a telemetry kind, one per event."""
        event_id = F.col("event_id").cast("string")
        long_text = F.repeat(F.concat("event_type", F.lit(" ")), 90)
        kind_tag = F.array(F.concat(F.lit("type:"), "event_type"))
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
        error = F.when(F.col("event_type") == "error", F.concat(F.lit("E"), event_id))
        bodies = {
            "monitor": F.struct(
                F.col("event_id").alias("id"),
                F.concat(F.lit("mon "), event_id).alias("name"),
                F.lit("metric alert").alias("type"),
                F.col("event_type").alias("overall_state"),
                long_text.alias("message"),
                F.when(F.col("event_id") % 2 == 0, kind_tag).alias("tags"),
                (F.col("event_id") % 5).cast("int").alias("priority"),
            ),
            "host": F.struct(
                F.concat(F.lit("host-"), event_id).alias("name"),
                F.col("event_id").alias("id"),
                (F.col("value") < 50).alias("up"),
                F.struct(
                    F.lit("linux").alias("platform"),
                    F.concat(F.lit("7."), F.col("user_id").cast("string")).alias("agent_version"),
                ).alias("meta"),
            ),
            "incident": F.struct(
                event_id.alias("id"),
                F.struct(
                    F.concat(F.lit("Incident "), event_id).alias("title"),
                    F.col("event_type").alias("state"),
                    F.when(F.col("value") > 100, "SEV-1").otherwise("SEV-3").alias("severity"),
                    F.when(
                        F.col("event_id") % 3 == 0,
                        F.struct(
                            F.struct(
                                F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name")).alias(
                                    "attributes"
                                )
                            ).alias("data")
                        ),
                    ).alias("commander"),
                ).alias("attributes"),
            ),
            "security_signal": F.struct(
                event_id.alias("id"),
                F.struct(
                    F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("title"),
                    long_text.alias("message"),
                    F.lit("high").alias("severity"),
                    F.struct(
                        F.struct(
                            F.struct(F.concat(F.lit("rule "), F.col("event_type")).alias("name")).alias("rule")
                        ).alias("workflow")
                    ).alias("attributes"),
                ).alias("attributes"),
            ),
            "log": F.struct(
                event_id.alias("id"),
                F.struct(
                    stamp.alias("timestamp"),
                    F.when(F.col("value") > 100, "error").otherwise("info").alias("status"),
                    F.col("event_type").alias("service"),
                    long_text.alias("message"),
                    F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"),
                    kind_tag.alias("tags"),
                ).alias("attributes"),
            ),
            "span": F.struct(
                event_id.alias("id"),
                F.struct(
                    F.col("event_type").alias("service"),
                    stamp.alias("timestamp"),
                    F.struct(
                        F.concat(F.lit("t"), event_id).alias("trace_id"),
                        (_cents(F.col("value")) * 10000).alias("duration"),
                        F.lit("").alias("error_type"),
                        error.alias("error_message"),
                    ).alias("attributes"),
                ).alias("attributes"),
            ),
        }
        return self.events.select(F.to_json(bodies[kind]).alias("json"))


def _article_ean(key: Column) -> Column:
    """Barcode of an article number; every 25th has a wrong check digit."""
    body = F.concat(F.lit("40"), F.lpad(key.cast("string"), 10, "0"))
    right = expected_check_digit(F.concat(body, F.lit("0")))
    digit = F.pmod(right + F.when(key % 25 == 0, 1).otherwise(0), F.lit(10))
    return F.concat(body, digit.cast("string"))


def _category_id(name: Column) -> Column:
    """Stable category number from the name."""
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("bigint")
