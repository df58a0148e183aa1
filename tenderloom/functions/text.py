"""Text expressions: cleaning, article codes, list lines, relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Article code shapes, tried in this order.
ARTICLE_CODE_PATTERNS = (
    r"(?U)\b([A-Z0-9]{2,}[\-\.\/][A-Z0-9\-\.\/]{2,})\b",
    r"(?U)^(\d{5,})\b",
    r"(?U)\b(\d+\.\d+[\w\.]*)\b",
)

# A list line with a leading quantity, and barcode mentions in page text.
QUANTITY_LINE = r"^(\d+)\s*[xX]\s+(.+)$"
EAN_MENTION = r"(?i)(?:EAN|GTIN)[:\s]+(\d{12,14}|\d{8})"

# Characters dropped around the context that follows an article code.
CODE_CONTEXT_TRIM = " ,-./"


# Characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three being ``...``; NULL becomes ''."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(F.coalesce(text, F.lit("")))


def dedup_key(name: Column) -> Column:
    return F.lower(strip(name))


def clean_name(name: Column) -> Column:
    """Collapse white space of any kind. Composed and decomposed letters stay as they are."""
    return strip(F.regexp_replace(name, r"(?U)\s+", " "))


def article_code(text: Column) -> Column:
    """Most likely order code in a description, NULL if none."""
    found = [
        F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        for pattern in ARTICLE_CODE_PATTERNS
    ]
    return F.coalesce(*found)


def search_query(text: Column) -> Column:
    """The code followed by its context, or the whole description without a code."""
    code = article_code(text)
    context = F.btrim(F.replace(text, code, F.lit("")), F.lit(CODE_CONTEXT_TRIM))
    return (
        F.when(code.isNull(), text)
        .when(F.length(context) > 0, F.concat_ws(" ", code, context))
        .otherwise(code)
    )


def rfq_lines(text: Column) -> Column:
    """Request text -> array of raw lines; one comma list counts as several lines."""
    lines = F.split(strip(text), r"\r\n|\n|\r")
    single_comma_list = (
        (F.size(lines) == 1) & text.contains(",") & ~text.contains("|")
    )
    return F.when(single_comma_list, F.split(strip(text), ",")).otherwise(lines)


def rfq_fields(line: Column) -> tuple[Column, Column, Column]:
    """``(query, quantity, label)`` of one raw line; an empty query means no item."""
    body = strip(F.substring_index(line, "|", 1))
    label = F.when(
        line.contains("|"), strip(F.regexp_replace(line, r"(?s)^[^|]*\|", ""))
    )
    counted = body.rlike(QUANTITY_LINE)
    quantity = F.when(
        counted, F.regexp_extract(body, QUANTITY_LINE, 1).try_cast("bigint")
    ).otherwise(F.lit(1).cast("bigint"))
    query = F.when(counted, strip(F.regexp_extract(body, QUANTITY_LINE, 2))).otherwise(body)
    return query, quantity, label


#: Score of a search hit by how its fields meet the term, and of any other hit.
HIT_SCORES = (
    (1.0, "equals", "ean"),
    (0.95, "equals", "name"),
    (0.85, "starts", "name"),
    (0.7, "holds", "name"),
    (0.6, "equals", "brand"),
    (0.5, "holds", "description"),
)
LEAST_SCORE = 0.3


def relevance(term: Column, ean: Column, name: Column, brand: Column, description: Column) -> Column:
    """Match quality of a search term: the best score among the tests that hold."""
    fields = {"ean": ean, "name": F.lower(name), "brand": F.lower(brand), "description": F.lower(description)}
    tests = {"equals": lambda x, t: x == t, "starts": F.startswith, "holds": F.contains}
    scores = [
        F.when(tests[test](fields[field], term if field == "ean" else F.lower(term)), score).otherwise(0.0)
        for score, test, field in HIT_SCORES
    ]
    return F.greatest(F.lit(LEAST_SCORE), *scores).cast("decimal(3,2)")


def strip_tags(html: Column) -> Column:
    return strip(F.regexp_replace(html, r"<[^>]+>", ""))


def strip_tags_ending_numbers(html: Column) -> Column:
    """As ``strip_tags``, but a tag ends a number, so that digits of two blocks do not become one."""
    return strip_tags(F.regexp_replace(html, r"(\d)(?:<[^>]+>)+", "$1 "))


def ean_mentions(text: Column) -> Column:
    """Barcodes announced by ``EAN`` or ``GTIN`` in page text, in order."""
    return F.regexp_extract_all(text, F.lit(EAN_MENTION), F.lit(1))
