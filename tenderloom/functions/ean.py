"""Barcode expressions and the issuing-country dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions.money import int_div

# Barcode lengths and their names.
EAN_TYPES = {8: "EAN-8", 12: "UPC-A", 13: "EAN-13", 14: "GTIN-14"}
EAN_LENGTHS = tuple(EAN_TYPES)

UNASSIGNED = "Unknown / Unassigned"
UNKNOWN = "Unknown"

# GS1 prefix ranges (first, last, issuing organisation).
GS1_RANGES = (
    (0, 19, "United States"),
    (20, 29, "Restricted distribution"),
    (30, 39, "United States"),
    (40, 49, "Restricted distribution"),
    (50, 59, "Coupons"),
    (60, 99, "United States / Canada"),
    (100, 139, "United States"),
    (200, 299, "Restricted distribution"),
    (300, 379, "France / Monaco"),
    (380, 380, "Bulgaria"),
    (383, 383, "Slovenia"),
    (385, 385, "Croatia"),
    (387, 387, "Bosnia and Herzegovina"),
    (389, 389, "Montenegro"),
    (390, 390, "Kosovo"),
    (400, 440, "Germany"),
    (450, 459, "Japan"),
    (460, 469, "Russia"),
    (470, 470, "Kyrgyzstan"),
    (471, 471, "Taiwan"),
    (474, 474, "Estonia"),
    (475, 475, "Latvia"),
    (476, 476, "Azerbaijan"),
    (477, 477, "Lithuania"),
    (478, 478, "Uzbekistan"),
    (479, 479, "Sri Lanka"),
    (480, 480, "Philippines"),
    (481, 481, "Belarus"),
    (482, 482, "Ukraine"),
    (484, 484, "Moldova"),
    (485, 485, "Armenia"),
    (486, 486, "Georgia"),
    (487, 487, "Kazakhstan"),
    (488, 488, "Tajikistan"),
    (489, 489, "Hong Kong"),
    (490, 499, "Japan"),
    (500, 509, "United Kingdom"),
    (520, 521, "Greece"),
    (528, 528, "Lebanon"),
    (529, 529, "Cyprus"),
    (530, 530, "Albania"),
    (531, 531, "North Macedonia"),
    (535, 535, "Malta"),
    (539, 539, "Ireland"),
    (540, 549, "Belgium / Luxembourg"),
    (560, 560, "Portugal"),
    (569, 569, "Iceland"),
    (570, 579, "Denmark / Greenland"),
    (590, 590, "Poland"),
    (594, 594, "Romania"),
    (599, 599, "Hungary"),
    (600, 601, "South Africa"),
    (603, 603, "Ghana"),
    (604, 604, "Senegal"),
    (608, 608, "Bahrain"),
    (609, 609, "Mauritius"),
    (611, 611, "Morocco"),
    (613, 613, "Algeria"),
    (615, 615, "Nigeria"),
    (616, 616, "Kenya"),
    (618, 618, "Ivory Coast"),
    (619, 619, "Tunisia"),
    (620, 620, "Tanzania"),
    (621, 621, "Syria"),
    (622, 622, "Egypt"),
    (623, 623, "Brunei"),
    (624, 624, "Libya"),
    (625, 625, "Jordan"),
    (626, 626, "Iran"),
    (627, 627, "Kuwait"),
    (628, 628, "Saudi Arabia"),
    (629, 629, "United Arab Emirates"),
    (640, 649, "Finland"),
    (690, 699, "China"),
    (700, 709, "Norway"),
    (729, 729, "Israel"),
    (730, 739, "Sweden"),
    (740, 740, "Guatemala"),
    (741, 741, "El Salvador"),
    (742, 742, "Honduras"),
    (743, 743, "Nicaragua"),
    (744, 744, "Costa Rica"),
    (745, 745, "Panama"),
    (746, 746, "Dominican Republic"),
    (750, 750, "Mexico"),
    (754, 755, "Canada"),
    (759, 759, "Venezuela"),
    (760, 769, "Switzerland / Liechtenstein"),
    (770, 771, "Colombia"),
    (773, 773, "Uruguay"),
    (775, 775, "Peru"),
    (777, 777, "Bolivia"),
    (778, 779, "Argentina"),
    (780, 780, "Chile"),
    (784, 784, "Paraguay"),
    (786, 786, "Ecuador"),
    (789, 790, "Brazil"),
    (800, 839, "Italy / San Marino / Vatican"),
    (840, 849, "Spain / Andorra"),
    (850, 850, "Cuba"),
    (858, 858, "Slovakia"),
    (859, 859, "Czech Republic"),
    (860, 860, "Serbia"),
    (865, 865, "Mongolia"),
    (867, 867, "North Korea"),
    (868, 869, "Turkey"),
    (870, 879, "Netherlands"),
    (880, 880, "South Korea"),
    (884, 884, "Cambodia"),
    (885, 885, "Thailand"),
    (888, 888, "Singapore"),
    (890, 890, "India"),
    (893, 893, "Vietnam"),
    (896, 896, "Pakistan"),
    (899, 899, "Indonesia"),
    (900, 919, "Austria"),
    (930, 939, "Australia"),
    (940, 949, "New Zealand"),
    (950, 950, "GS1 Global Office"),
    (951, 951, "EPCglobal"),
    (955, 955, "Malaysia"),
    (958, 958, "Macau"),
    (960, 969, "GS1 Global Office (GTIN-8)"),
    (977, 977, "Serial publications (ISSN)"),
    (978, 979, "Bookland (ISBN)"),
    (980, 980, "Refund receipts"),
    (981, 984, "Common Currency Coupons"),
    (990, 999, "Coupons"),
)


def gs1_ranges() -> list[tuple[int, int, str]]:
    return list(GS1_RANGES)


def gs1_prefixes(spark: SparkSession) -> DataFrame:
    """One row per assigned three-digit prefix: at most 1,000 rows by construction."""
    ranges = spark.createDataFrame(gs1_ranges(), "first INT, last INT, country STRING")
    numbers = ranges.select(F.explode(F.sequence("first", "last")).alias("number"), "country")
    return numbers.select(F.lpad(F.col("number").cast("string"), 3, "0").alias("prefix"), "country")


def normalize_ean(text: Column) -> Column:
    """Drop blanks and hyphens."""
    return F.regexp_replace(text, r"[\s\-]", "")


def ean_type(ean: Column) -> Column:
    kind = F.lit(None).cast("string")
    for length, name in EAN_TYPES.items():
        kind = F.when(F.length(ean) == length, F.lit(name)).otherwise(kind)
    return kind


def search_type(query: Column) -> Column:
    """``ean`` for 8/12/13/14 digits after cleaning (check digit not tested), else ``name``."""
    cleaned = normalize_ean(query)
    return F.when(
        cleaned.rlike(r"^\d+$") & F.length(cleaned).isin(*EAN_LENGTHS), F.lit("ean")
    ).otherwise(F.lit("name"))


def expected_check_digit(ean: Column) -> Column:
    """GS1 check digit of an all-digit code of up to 14 digits.

    Leading zeros add nothing to the weighted sum, so the weights 3, 1, 3, ... from the
    right, before the check digit, serve every length and the expression is arithmetic on
    one number.
    """
    number = ean.try_cast("bigint")
    total = F.lit(0)
    for position in range(1, 14):
        digit = int_div(number, F.lit(10**position)) % F.lit(10)
        total = total + digit * (3 if position % 2 else 1)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("int")


def ean_check(text: Column) -> Column:
    """Struct ``valid, ean, error, type, check_digit, expected_check_digit``."""
    ean = F.trim(text)
    all_digits = ean.rlike(r"^\d+$")
    length_ok = F.length(ean).isin(*EAN_LENGTHS)
    usable = F.coalesce(all_digits & length_ok, F.lit(False))
    actual = F.when(usable, F.ascii(F.right(ean, F.lit(1))) - F.lit(48))
    expected = F.when(usable, expected_check_digit(ean))
    error = (
        F.when(~F.coalesce(all_digits, F.lit(False)), F.lit("EAN must contain only digits."))
        .when(
            ~length_ok,
            F.concat(
                F.lit("EAN must be 8, 12, 13, or 14 digits (got "),
                F.length(ean).cast("string"),
                F.lit(")."),
            ),
        )
        .when(actual != expected, F.lit("Wrong check digit."))
    )
    return F.struct(
        F.coalesce(actual == expected, F.lit(False)).alias("valid"),
        ean.alias("ean"),
        error.alias("error"),
        F.when(usable, ean_type(ean)).alias("type"),
        actual.alias("check_digit"),
        expected.alias("expected_check_digit"),
    )


def country_prefix(text: Column, compat: bool = False) -> Column:
    """GS1 prefix of a barcode; NULL when it is not numeric or shorter than three digits.

    A 12-digit code carries an implicit leading zero, so it is padded to 13
    digits first; ``compat=True`` takes its first three digits as they stand.
    """
    ean = F.trim(text)
    body = ean if compat else F.when(F.length(ean) == 12, F.lpad(ean, 13, "0")).otherwise(ean)
    return F.when(ean.rlike(r"^\d{3,}$"), F.substring(body, 1, 3))
