"""URL, page and fetch-error expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions.money import to_cents
from tenderloom.functions.text import strip

# What a fetchable URL may look like.
MAX_URL_LENGTH = 4096
ALLOWED_SCHEMES = ("http", "https")
ALLOWED_PORTS = (80, 443, 8080, 8443)
BLOCKED_HOSTS = (
    "localhost",
    "metadata.google.internal",
    "metadata.google",
    "169.254.169.254",
    "100.100.100.200",
    "fd00:ec2::254",
)

# IPv4 blocks that are private, loopback, link-local, reserved or carrier NAT.
BLOCKED_IPV4_BLOCKS = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)

# Image hosts that only track, and page texts of a bot challenge.
TRACKING_IMAGE_HOSTS = (
    "pixel.",
    "tracker.",
    "analytics.",
    "doubleclick.net",
    "google-analytics.com",
    "facebook.com/tr",
    "bat.bing.com",
)
CHALLENGE_MARKERS = ("ray id", "cf-challenge", "checking your browser", "just a moment")

# Error code -> (category, retryable).
ERROR_META = {
    "NETWORK_TIMEOUT": ("network", True),
    "CONNECTION_RESET": ("network", True),
    "CONNECTION_REFUSED": ("network", True),
    "DNS_RESOLUTION_FAILED": ("network", False),
    "BOT_BLOCKED": ("bot_protection", False),
    "CAPTCHA_REQUIRED": ("bot_protection", False),
    "LOGIN_REQUIRED": ("bot_protection", False),
    "HTTP_404": ("not_found", False),
    "HTTP_410": ("not_found", False),
    "ELEMENT_NOT_FOUND": ("not_found", False),
    "IMAGE_NOT_FOUND": ("not_found", False),
    "NO_SEARCH_RESULTS": ("not_found", False),
    "INVALID_URL": ("validation", False),
    "SSRF_BLOCKED": ("validation", False),
    "INVALID_PARAMETER": ("validation", False),
    "FILE_TOO_LARGE": ("validation", False),
    "HTTP_5XX": ("server", True),
    "INVALID_IMAGE_DATA": ("extraction", False),
    "DOWNLOAD_FAILED": ("extraction", True),
    "BROWSER_CRASHED": ("internal", True),
    "INTERNAL_ERROR": ("internal", False),
}

# Message fragment -> error code, first hit wins, and the code of other messages.
ERROR_FRAGMENTS = (
    ("timeout", "NETWORK_TIMEOUT"),
    ("net::err_connection_reset", "CONNECTION_RESET"),
    ("net::err_connection_refused", "CONNECTION_REFUSED"),
    ("net::err_name_not_resolved", "DNS_RESOLUTION_FAILED"),
    ("net::err_aborted", "CONNECTION_RESET"),
    ("captcha", "CAPTCHA_REQUIRED"),
    ("login required", "LOGIN_REQUIRED"),
    ("page crashed", "BROWSER_CRASHED"),
    ("browser has been closed", "BROWSER_CRASHED"),
)
DEFAULT_ERROR = "INTERNAL_ERROR"

# Where pages keep product data, and the types of items with offers.
JSONLD_BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
PRODUCT_TYPES = ("Product", "ItemList")


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, flags)


# -- URLs ---------------------------------------------------------------------


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_authority(url: Column) -> Column:
    """Host and port without user information."""
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(netloc, r"^.*@", "")


def authority_host(authority: Column) -> Column:
    bracketed = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    return F.lower(
        F.when(F.startswith(authority, F.lit("[")), bracketed).otherwise(
            F.regexp_replace(authority, r":[^:]*$", "")
        )
    )


def authority_port(authority: Column) -> Column:
    """Explicit port as text, '' when there is none."""
    return F.regexp_extract(authority, r":([^:\]]*)$", 1)


def url_host(url: Column) -> Column:
    return authority_host(url_authority(url))


IPV4 = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
MAPPED_HEX = r"^(?:0*:)*:?ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"


def ipv4_octets(host: Column) -> Column:
    """Octets of a dotted IPv4 literal, also behind an IPv6 ``::ffff:`` prefix; else NULL."""
    dotted = F.regexp_extract(host, rf"^(?:(?:0*:)*:?ffff:)?{IPV4}$", 1)
    return F.when(dotted != "", F.split(dotted, r"\.").cast("array<bigint>"))


def ipv6_groups(host: Column) -> Column:
    """Groups of an IPv6 literal as numbers (0 where the text is elided); else NULL."""
    groups = F.transform(
        F.split(host, ":"),
        lambda text: F.coalesce(
            F.conv(F.when(text.rlike("^[0-9a-f]{1,4}$"), text), 16, 10).cast("bigint"),
            F.lit(0).cast("bigint"),
        ),
    )
    return F.when(F.contains(host, F.lit(":")), groups)


def ipv4_number(host: Column, octets: Column, groups: Column) -> Column:
    """The IPv4 address a host literal stands for as BIGINT, NULL for names and other IPv6."""
    number = F.lit(0).cast("bigint")
    for position in range(4):
        number = number * 256 + F.get(octets, F.lit(position))
    high, low = F.try_element_at(groups, F.lit(-2)), F.try_element_at(groups, F.lit(-1))
    return F.when(F.array_max(octets) <= 255, number).when(
        host.rlike(MAPPED_HEX), high * 65536 + low
    )


def ipv4_blocked(number: Column) -> Column:
    tests = []
    for block in BLOCKED_IPV4_BLOCKS:
        address, bits = block.split("/")
        first = 0
        for part in address.split("."):
            first = first * 256 + int(part)
        last = first + 2 ** (32 - int(bits)) - 1
        tests.append(number.between(F.lit(first).cast("bigint"), F.lit(last).cast("bigint")))
    return F.coalesce(any_of(tests), F.lit(False))


def ipv6_blocked(groups: Column) -> Column:
    """IPv6 literal outside the public unicast range, or in a reserved part of it."""
    first, second = F.get(groups, F.lit(0)), F.get(groups, F.lit(1))
    public = (
        first.between(0x2000, 0x3FFF)
        & ~((first == 0x2001) & ((second < 0x0200) | (second == 0x0DB8)))
        & (first != 0x2002)
        & ~((first == 0x3FFF) & (second < 0x1000))
    ) | (first >= 0xFEC0)
    return F.coalesce(~public, F.lit(False))


def url_reject_reason(
    url: Column,
    scheme: Column,
    authority: Column,
    host: Column,
    port: Column,
    ipv4: Column,
    groups: Column,
) -> Column:
    """Why a URL must not be fetched, NULL when it may be; the first failing test wins.

    The parts are passed in as columns so that a plan extracts each only once.
    """
    private = F.when(ipv4.isNotNull(), ipv4_blocked(ipv4)).otherwise(ipv6_blocked(groups))
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.lit("empty"))
        .when(F.length(url) > MAX_URL_LENGTH, F.lit("too_long"))
        .when(~scheme.isin(*ALLOWED_SCHEMES), F.lit("scheme"))
        .when((authority == "") | (host == ""), F.lit("missing_host"))
        .when((port != "") & ~F.coalesce(port.try_cast("int").isin(*ALLOWED_PORTS), F.lit(False)), F.lit("port"))
        .when(host.isin(*BLOCKED_HOSTS), F.lit("blocked_host"))
        .when(private, F.lit("private_ip"))
    )


def target_url(url: Column) -> Column:
    """Unwrap search redirects: ``uddg``, else an http value of ``adurl``, ``url`` or ``q``."""

    def parameter(key: str) -> Column:
        raw = F.nullif(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1), F.lit(""))
        return F.coalesce(F.call_function("try_url_decode", raw), raw)

    http_values = [
        F.when(F.startswith(parameter(key), F.lit("http")), parameter(key))
        for key in ("adurl", "url", "q")
    ]
    return F.coalesce(parameter("uddg"), *http_values, url)


def image_url_ok(url: Column) -> Column:
    """False for inline data, trackers, SVG, placeholders and one-pixel images."""
    lowered = F.lower(url)
    bad = [
        F.startswith(url, F.lit("data:")),
        *[F.contains(lowered, F.lit(host)) for host in TRACKING_IMAGE_HOSTS],
        F.endswith(lowered, F.lit(".svg")),
        F.contains(lowered, F.lit("placeholder")),
        F.contains(lowered, F.lit("blank.gif")),
        url.rlike(r"/1x1[./]"),
        url.rlike(r"[?&]w=1(?:&|$)"),
    ]
    return F.coalesce((F.length(url) > 0) & ~any_of(bad), F.lit(False))


# -- pages --------------------------------------------------------------------


def is_challenge(html: Column) -> Column:
    lowered = F.lower(html)
    marks = [F.contains(lowered, F.lit(marker)) for marker in CHALLENGE_MARKERS]
    denied = F.contains(lowered, F.lit("akamai")) & F.contains(lowered, F.lit("access denied"))
    return F.coalesce(any_of([*marks, denied]), F.lit(False))


def page_heading(html: Column) -> Column:
    """Text of the first ``<h1>``, NULL if the page has none."""
    inner = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.nullif(strip(F.regexp_replace(inner, r"<[^>]+>", "")), F.lit(""))


def jsonld_items(html: Column, fields: str) -> Column:
    """Items of all JSON-LD blocks as ``array<struct>`` with ``@type`` and the given string fields.

    A block may hold one object, a list of them, or a ``@graph`` of them. ``from_json`` with an
    array schema reads single objects and lists alike; a nested value of a string field is its
    JSON text.
    """
    blocks = F.regexp_extract_all(html, F.lit(JSONLD_BLOCK), F.lit(1))
    item_type = f"array<struct<`@type`:string,{fields},`@graph`:string>>"
    none = F.array().cast(item_type)

    def items_of(block: Column) -> Column:
        items = F.coalesce(F.from_json(block, item_type), none)
        graphs = F.transform(items, lambda x: F.coalesce(F.from_json(x["@graph"], item_type), none))
        return F.concat(items, F.flatten(graphs))

    return F.flatten(F.transform(blocks, items_of))


def jsonld_offers(html: Column) -> Column:
    """JSON-LD product offers as ``array<struct>``; prices that are not positive are dropped.

    ``@type`` may be one name or several and ``offers`` one object or a list.
    """
    offer_type = "array<struct<price:string,url:string,seller:struct<name:string>>>"

    def is_product(kind: Column) -> Column:
        names = F.from_json(kind, "array<string>")
        listed = F.exists(names, lambda name: name.isin(*PRODUCT_TYPES))
        return F.coalesce(kind.isin(*PRODUCT_TYPES) | F.coalesce(listed, F.lit(False)), F.lit(False))

    def item_offers(head: Column) -> Column:
        parsed = F.from_json(head["offers"], offer_type)
        rows = F.transform(
            parsed,
            lambda offer: F.struct(
                head["name"].alias("product_name"),
                F.coalesce(offer["seller"]["name"], F.lit("Unbekannt")).alias("merchant_name"),
                to_cents(offer["price"].try_cast("decimal(20,4)")).alias("price_cents"),
                F.coalesce(offer["url"], F.lit("")).alias("product_url"),
            ),
        )
        priced = F.filter(rows, lambda row: row["price_cents"] > 0)
        return F.when(is_product(head["@type"]), priced)

    found = F.transform(jsonld_items(html, "name:string,offers:string"), item_offers)
    return F.flatten(F.filter(found, lambda rows: rows.isNotNull()))


def jsonld_images(html: Column) -> Column:
    """Picture links of JSON-LD products, in order, as ``array<string>``.

    ``image`` may be a text, an object with ``url`` or ``contentUrl``, or a list of both.
    """

    def links(item: Column) -> Column:
        image = item["image"]
        listed = F.when(F.startswith(image, F.lit("[")), F.from_json(image, "array<string>"))
        return F.transform(
            F.coalesce(listed, F.array(image)),
            lambda one: F.when(
                F.startswith(one, F.lit("{")),
                F.coalesce(F.get_json_object(one, "$.url"), F.get_json_object(one, "$.contentUrl")),
            ).otherwise(one),
        )

    products = F.filter(
        jsonld_items(html, "image:string"), lambda item: F.contains(item["@type"], F.lit("Product"))
    )
    return F.filter(F.flatten(F.transform(products, links)), lambda link: link.isNotNull())


def without_scripts(html: Column) -> Column:
    """The page without comments, scripts and styles, whose text can look like tags."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")


def tags_of(html: Column, name: str) -> Column:
    """Opening tags of a name as ``array<string>``; a bracket inside quotes does not end a tag."""
    inside = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b{inside}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, without its quotes and with ``&amp;`` read; NULL when empty or absent."""
    value = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.nullif(F.replace(F.btrim(value, F.lit("\"' \t\r\n")), F.lit("&amp;"), F.lit("&")), F.lit(""))


def meta_contents(html: Column, name: str) -> Column:
    """Contents of the page's ``<meta>`` tags with this ``property`` or ``name``, in order."""
    named = F.filter(
        tags_of(html, "meta"),
        lambda tag: F.lower(F.coalesce(attribute(tag, "property"), attribute(tag, "name"))) == name,
    )
    return F.filter(F.transform(named, lambda tag: attribute(tag, "content")), lambda x: x.isNotNull())


def meta_eans(html: Column) -> Column:
    """Contents of ``<meta>`` tags that have the form of a barcode, in order."""
    contents = F.transform(tags_of(html, "meta"), lambda tag: attribute(tag, "content"))
    return F.filter(contents, lambda content: content.rlike(r"^(\d{8}|\d{12,14})$"))


#: Where an ``<img>`` keeps its link, and the sides in pixels that matter.
IMAGE_LINKS = ("src", "data-src", "data-lazy-src", "data-original")
LEAST_SIDE, GOOD_SIDE = 100, 400


def tag_images(html: Column) -> Column:
    """Usable links of ``<img>`` tags as ``array<string>``, the best first.

    The first usable link attribute counts, else the first entry of ``srcset``. Pictures whose
    declared sides are both of good size come first, then the others by declared area, pictures
    without declared sides last, ties in page order. Declared sides that are too small drop one.
    """

    # In two steps, so that each attribute is extracted once and not in every test of it.
    def read(tag: Column, number: Column) -> Column:
        links = [attribute(tag, name) for name in IMAGE_LINKS]
        first = F.regexp_extract(attribute(tag, "srcset"), r"^([^\s,]+)", 1)
        sides = [
            F.regexp_extract(attribute(tag, side), r"^(\d{1,6})(?:px)?$", 1).try_cast("bigint").alias(side)
            for side in ("width", "height")
        ]
        usable = F.get(F.filter(F.array(*links, first), image_url_ok), F.lit(0))
        return F.struct(number.alias("number"), usable.alias("link"), *sides)

    def entry(image: Column) -> Column:
        width, height = image["width"], image["height"]
        good = (width >= GOOD_SIDE) & (height >= GOOD_SIDE)
        return F.struct(
            F.when(good, 0).otherwise(1).alias("rank"),
            F.coalesce(-width * height, F.lit(0)).cast("bigint").alias("area"),
            image["number"].alias("number"),
            image["link"].alias("link"),
        )

    def kept(image: Column) -> Column:
        small = F.least(image["width"], image["height"]) < LEAST_SIDE
        return image["link"].isNotNull() & ~F.coalesce(small, F.lit(False))

    images = F.filter(F.transform(tags_of(html, "img"), read), kept)
    return F.transform(F.array_sort(F.transform(images, entry)), lambda image: image["link"])


def absolute_url(link: Column, base: Column) -> Column:
    """``link`` as found on the page ``base``, with dot segments resolved; NULL for an empty link."""
    scheme_pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
    origin = F.regexp_extract(base, rf"{scheme_pattern}//[^/?#]*", 0)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.regexp_replace(F.substr(page, F.length(origin) + 1), r"[^/]*$", "")
    text = F.nullif(F.trim(link), F.lit(""))
    rooted = F.when(F.startswith(text, F.lit("/")), text).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), text)
    )
    path = F.regexp_extract(rooted, r"^[^?#]*", 0)
    segments = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, one: F.when(one == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .when(one == ".", done)
        .otherwise(F.array_append(done, one)),
    )
    dotted = path.rlike(r"/\.\.?(/|$)")
    clean = F.when(dotted, F.concat(F.array_join(kept, "/"), F.substr(rooted, F.length(path) + 1)))
    return (
        F.when(text.rlike(scheme_pattern), text)
        .when(F.startswith(text, F.lit("//")), F.concat(F.regexp_extract(base, scheme_pattern, 0), text))
        .when(F.startswith(text, F.lit("?")), F.concat(page, text))
        .when(F.startswith(text, F.lit("#")), F.concat(F.regexp_extract(base, "^[^#]*", 0), text))
        .when(text.isNotNull(), F.concat(origin, F.coalesce(clean, rooted)))
    )


def mime_of(header: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.substring_index(header, ";", 1))), F.lit(""))


def error_code(message: Column) -> Column:
    lowered = F.lower(message)
    code = F.when(F.lit(False), F.lit(DEFAULT_ERROR))
    for fragment, name in ERROR_FRAGMENTS:
        code = code.when(F.contains(lowered, F.lit(fragment)), F.lit(name))
    return code.otherwise(F.lit(DEFAULT_ERROR))
