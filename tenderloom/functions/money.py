"""Prices as integer cents: parsing, rounding, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shipping texts that mean "free".
FREE_SHIPPING_WORDS = ("gratis", "kostenlos", "frei")

# The first number of a text with everything that belongs to it, and the shapes it may have.
NUMBER = r"(-?\d[\d.,]*)"
EUROS_AND_CENTS = r"^(\d+|\d{1,3}(?:\.\d{3})+)[.,](\d{2})$"
WHOLE_EUROS = r"^(\d+|\d{1,3}(?:\.\d{3})+|\d{1,3}(?:,\d{3})+)$"


def to_cents(amount: Column) -> Column:
    """Numeric euros -> BIGINT cents."""
    return F.round(amount.cast("decimal(20,4)") * F.lit(100), 0).cast("bigint")


def from_cents(cents: Column) -> Column:
    """BIGINT cents -> DECIMAL(20,2) euros."""
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")


def int_div(numerator: Column, denominator: Column) -> Column:
    """BIGINT quotient truncated towards zero; NULL for a zero divisor."""
    zero = F.lit(0).cast("bigint")
    return F.call_function(
        "div", numerator.cast("bigint"), F.nullif(denominator.cast("bigint"), zero)
    )


def div_half_up(numerator: Column, denominator: Column) -> Column:
    """Integer division rounded half away from zero; NULL for a zero divisor.

    Pure BIGINT arithmetic: the result depends neither on summation order nor on
    binary fractions. ``denominator`` must not be negative.
    """
    size = int_div(2 * F.abs(numerator) + denominator, 2 * denominator)
    return F.when(numerator < 0, -size).otherwise(size)


def percent(part: Column, whole: Column, places: int) -> Column:
    """``100 * part / whole`` rounded to ``places`` as DOUBLE; NULL when ``whole`` is 0."""
    scale = 10**places
    return div_half_up(part.cast("bigint") * (100 * scale), whole) / F.lit(float(scale))


def savings_cents(reference: Column, alternative: Column) -> Column:
    return reference - alternative


def savings_percent(reference: Column, alternative: Column) -> Column:
    """Saving in percent of the reference (1 decimal); 0 when the reference is not positive."""
    return F.when(reference > 0, percent(reference - alternative, reference, 1)).otherwise(
        F.lit(0.0)
    )


def offer_total(price: Column, shipping: Column) -> Column:
    return price + shipping


def _number(text: Column) -> Column:
    found = F.rtrim(F.regexp_extract(text, NUMBER, 1), F.lit(".,"))
    return F.nullif(found, F.lit(""))


def parse_price(text: Column) -> Column:
    """Price text -> BIGINT cents; NULL when there is no number or it is ambiguous.

    The first number is read as a whole: ``1.234,56`` and ``1234.56`` have cents, ``1.234``,
    ``1,234`` and ``150`` are whole euros. Anything else, such as ``1,234.56``, ``1.234,5`` or a
    negative number, has no agreed reading; ``price_parse`` says so.
    """
    def cents(number: Column) -> Column:
        digits = F.translate(number, ".,", "")
        return F.when(number.rlike(WHOLE_EUROS), F.concat(digits, F.lit("00"))).when(number.rlike(EUROS_AND_CENTS), digits)

    # The number is found once; named several times in a plain expression, it would be searched for at each place.
    found = F.rtrim(F.regexp_extract(text, NUMBER, 1), F.lit(".,"))
    return F.element_at(F.transform(F.array(found), cents), 1).try_cast("bigint")


def price_parse(text: Column) -> Column:
    """``ok``, ``missing`` or ``ambiguous``: how ``parse_price`` fared."""
    return (
        F.when(parse_price(text).isNotNull(), "ok").when(_number(text).isNull() | text.isNull(), "missing").otherwise("ambiguous")
    )


def parse_shipping(text: Column) -> Column:
    """Shipping text -> BIGINT cents; free words and unreadable text give 0."""
    lowered = F.lower(text)
    free = F.lit(False)
    for word in FREE_SHIPPING_WORDS:
        free = free | lowered.contains(word)
    zero = F.lit(0).cast("bigint")
    return F.when(F.coalesce(free, F.lit(False)), zero).otherwise(
        F.coalesce(parse_price(text), zero)
    )


def format_eur(cents: Column) -> Column:
    """``123456`` -> ``1.234,56 EUR``."""
    return F.concat(
        F.translate(F.format_number(from_cents(cents), 2), ",.", ".,"), F.lit(" EUR")
    )
