"""Web pages and fetch logs: URL screening, page mining, error reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import web
from tenderloom.functions.text import ean_mentions, strip_tags, strip_tags_ending_numbers


def screen_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``reject_reason`` (NULL when the URL may be fetched)."""
    # Step by step, so that no extraction is repeated inside the tests that use it.
    source, host = F.col(url), F.col("host")
    steps = [
        {"_scheme": web.url_scheme(source), "_authority": web.url_authority(source)},
        {"host": web.authority_host(F.col("_authority")), "_port": web.authority_port(F.col("_authority"))},
        {"_octets": web.ipv4_octets(host), "_groups": web.ipv6_groups(host)},
        {"_ipv4": web.ipv4_number(host, F.col("_octets"), F.col("_groups"))},
    ]
    parts = pages
    for step in steps:
        parts = parts.withColumns(step)
    names = ("_scheme", "_authority", "host", "_port", "_ipv4", "_groups")
    reason = web.url_reject_reason(source, *map(F.col, names))
    helpers = [c for step in steps for c in step if c != "host"]
    return parts.withColumn("reject_reason", reason).drop(*helpers)


def url_screen_report(pages: DataFrame, url: str = "url") -> DataFrame:
    """Number of pages per host and reject reason (``ok`` when accepted)."""
    reason = F.coalesce("reject_reason", F.lit("ok")).alias("reason")
    return (
        screen_urls(pages.select(url), url)
        .groupBy("host", reason)
        .agg(F.count(F.lit(1)).alias("pages"))
    )


def screen_image_urls(images: DataFrame, url: str = "image_url") -> DataFrame:
    """Only rows whose image URL can be a real picture."""
    return images.filter(web.image_url_ok(F.col(url)))


def preferred_first(urls: DataFrame, by: Sequence[str], preferred: Sequence[str]) -> DataFrame:
    """Add ``is_preferred``: the URL's host contains a preferred source.

    Sort by ``(*by, is_preferred desc, position)`` for the display order.
    """
    host = web.url_host(F.col("url"))
    liked = [F.contains(host, F.lit(source.lower())) for source in preferred]
    flag = F.coalesce(web.any_of(liked), F.lit(False)) if liked else F.lit(False)
    return urls.select(*by, "position", "url", flag.alias("is_preferred"))


def preferred_order() -> list[Column]:
    return [F.when(F.col("is_preferred"), 0).otherwise(1), F.col("position")]


def flag_challenge_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("is_challenge", web.is_challenge(F.col("html")))


def mine_pages(pages: DataFrame) -> DataFrame:
    """One row per page: URL verdict, challenge flag, heading, text length, barcodes, offers.

    Whole pages are read; explode ``offers`` (see ``page_offers``) for offer rows. Barcodes of
    ``<meta>`` tags come before those that the text announces, and end where a tag begins.
    """
    text = strip_tags(F.col("html"))
    mined = flag_challenge_pages(screen_urls(pages)).withColumn("_text", text)
    return mined.select(
        "page_id",
        "url",
        "host",
        "reject_reason",
        "is_challenge",
        web.page_heading(F.col("html")).alias("heading"),
        F.length("_text").cast("bigint").alias("text_length"),
        F.concat(web.meta_eans(F.col("html")), ean_mentions(strip_tags_ending_numbers(F.col("html")))).alias("eans"),
        web.jsonld_offers(F.col("html")).alias("offers"),
    )


def page_offers(mined: DataFrame) -> DataFrame:
    """Offers found in mined pages, one row each, with the page's first barcode."""
    return mined.select(
        "page_id", "url", F.get("eans", F.lit(0)).alias("ean"), F.explode("offers").alias("o")
    ).select("page_id", F.col("url").alias("source_url"), "ean", "o.*")


def _with_images(pages: DataFrame) -> DataFrame:
    """``page_id, url, images``: usable picture links of a page as structs, the best first."""

    def of_kind(kind: str, links: Column) -> Column:
        usable = F.filter(links, web.image_url_ok)
        return F.transform(
            usable,
            lambda link: F.struct(
                F.lit(kind).alias("kind"), web.absolute_url(link, F.col("url")).alias("image_url")
            ),
        )

    body = pages.select("page_id", "url", "html", web.without_scripts(F.col("html")).alias("_body"))
    images = F.concat(
        of_kind("og", web.meta_contents(F.col("_body"), "og:image")),
        of_kind("schema", web.jsonld_images(F.col("html"))),
        of_kind("img", web.tag_images(F.col("_body"))),
    )
    return body.select("page_id", "url", images.alias("images"))


def page_images(pages: DataFrame) -> DataFrame:
    """Picture links of each page, absolute, one row each; ``rank_no`` 1 is the page's main picture.

    Links of ``og:image`` come first, then those of JSON-LD products, then ``<img>`` tags by
    their declared size (see ``web.tag_images``). Pages without a usable link give no row.
    """
    found = _with_images(pages).select("page_id", "url", F.posexplode("images").alias("_at", "i"))
    return found.select(
        "page_id", "url", (F.col("_at") + 1).cast("bigint").alias("rank_no"), "i.kind", "i.image_url"
    )


def main_images(pages: DataFrame) -> DataFrame:
    """Every page with its main picture, NULL where it has none."""
    return _with_images(pages).select("page_id", "url", F.get("images", F.lit(0)).alias("i")).select(
        "page_id", "url", "i.kind", "i.image_url"
    )


def attach_error_meta(errors: DataFrame, code: str = "error_code") -> DataFrame:
    """Add ``category`` and ``retryable`` of each error code (a fixed 21-row dimension)."""
    rows = [(name, category, retry) for name, (category, retry) in web.ERROR_META.items()]
    meta = errors.sparkSession.createDataFrame(rows, f"{code} STRING, category STRING, retryable BOOLEAN")
    return errors.join(F.broadcast(meta), code, "left")


def fetch_error_report(log: DataFrame) -> DataFrame:
    """Fetch errors classified by message and counted by code, category and MIME type."""
    coded = log.select(
        web.error_code(F.col("message")).alias("error_code"),
        web.mime_of(F.col("content_type")).alias("mime_type"),
    )
    counts = coded.groupBy("error_code", "mime_type").agg(F.count(F.lit(1)).alias("errors"))
    return attach_error_meta(counts)
