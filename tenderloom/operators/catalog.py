"""Barcode audit, issuing countries, and lookups over an article catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import ean as eans
from tenderloom.functions.text import clean_name
from tenderloom.operators import skew
from tenderloom.operators.matching import deletion_variants, rarest_key_pairs, text_tokens

NOT_FOUND_HINT = "no article with this barcode"


def tag_issuing_country(catalog: DataFrame, ean: str = "ean", compat: bool = False) -> DataFrame:
    """Add ``gs1_prefix`` and ``country`` from the barcode's first three digits.

    Ranges are expanded to single prefixes, so the lookup is an equi join against a
    dimension that cannot exceed 1,000 rows.
    """
    prefixes = F.broadcast(
        eans.gs1_prefixes(catalog.sparkSession).withColumnsRenamed(
            {"prefix": "gs1_prefix", "country": "_country"}
        )
    )
    tagged = catalog.withColumn("gs1_prefix", eans.country_prefix(F.col(ean), compat))
    country = F.when(F.col("gs1_prefix").isNull(), F.lit(eans.UNKNOWN)).otherwise(
        F.coalesce("_country", F.lit(eans.UNASSIGNED))
    )
    return (
        tagged.join(prefixes, "gs1_prefix", "left").withColumn("country", country).drop("_country")
    )


def checked_catalog(catalog: DataFrame, ean: str = "ean", compat: bool = False) -> DataFrame:
    """Catalog rows with barcode validity, type, check digits and issuing country."""
    check = eans.ean_check(eans.normalize_ean(F.col(ean)))
    checked = catalog.withColumn("_check", check).select(
        *catalog.columns,
        F.col("_check.valid").alias("ean_valid"),
        F.col("_check.type").alias("ean_type"),
        F.col("_check.error").alias("ean_error"),
        F.col("_check.check_digit").alias("check_digit"),
        F.col("_check.expected_check_digit").alias("expected_check_digit"),
    )
    return tag_issuing_country(checked, ean, compat)


def audit_ean_catalog(catalog: DataFrame, ean: str = "ean", compat: bool = False) -> DataFrame:
    """Number of articles by barcode type, validity, error and issuing country."""
    return (
        checked_catalog(catalog, ean, compat)
        .groupBy("ean_type", "ean_valid", "ean_error", "country")
        .agg(F.count(F.lit(1)).alias("articles"))
    )


def lookup_ean(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exact barcode lookup for ``keys(lookup)``; misses keep their row and a hint."""
    wanted = keys.withColumn("ean", eans.normalize_ean(F.col("lookup")))
    rows = catalog.select("ean", "article_id", "article_name", "brand")
    return wanted.join(rows, "ean", "left").withColumn(
        "hint", F.when(F.col("article_id").isNull(), F.lit(NOT_FOUND_HINT))
    )


def prefix_search(prefixes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Articles whose barcode starts with each ``prefix`` (a trailing ``*`` is ignored).

    Every barcode is listed under its own prefixes (at most 14), which makes this an
    equi join; prefix lengths nobody asks for are dropped before the shuffle.
    """
    wanted = (
        prefixes.select("prefix", F.regexp_replace("prefix", r"\*", "").alias("_key"))
        .filter(F.length("_key") > 0)
        .distinct()
    )
    rows = catalog.select("ean", "article_id", "article_name", "brand").filter(F.length("ean") > 0)
    listed = rows.withColumn("_size", F.explode(F.sequence(F.lit(1), F.length("ean"))))
    sizes = wanted.select(F.length("_key").alias("_size")).distinct()
    keyed = listed.join(sizes, "_size", "left_semi").withColumn(
        "_key", F.substr(F.col("ean"), F.lit(1), F.col("_size"))
    )
    return wanted.join(keyed, "_key").select(
        "prefix", "ean", "article_id", "article_name", "brand"
    )


def name_search(
    terms: DataFrame, catalog: DataFrame, category: str | None = None, brand: str | None = None
) -> DataFrame:
    """Articles whose name holds every word of each ``term``, optionally in one category or brand."""
    rows = catalog
    if category is not None:
        rows = rows.filter(F.col("category_name") == category)
    if brand is not None:
        rows = rows.filter(F.col("brand") == brand)
    terms = terms.select("term").distinct()
    pairs = rarest_key_pairs(
        text_tokens(terms, "term", "term"),
        text_tokens(rows, "article_id", "article_name"),
        "term",
        "article_id",
    )
    words = {
        name: F.array_remove(F.array_distinct(F.split(F.lower(name), r"\s+")), "")
        for name in ("term", "article_name")
    }
    return (
        pairs.join(rows.select("article_id", "ean", "article_name", "brand").hint("merge"), "article_id")
        .filter(F.size(F.array_except(words["term"], words["article_name"])) == 0)
        .select(
            "term",
            "article_id",
            "ean",
            "article_name",
            "brand",
            F.size(words["term"]).cast("bigint").alias("matched_words"),
        )
    )


def similar_names(terms: DataFrame, catalog: DataFrame, k: int = 5, max_edits: int = 1) -> DataFrame:
    """Up to ``k`` catalog names per ``term`` within ``max_edits`` edits, nearest first.

    Both sides are listed under their deletion forms, so only texts that really are
    near each other meet, whatever words they share. Forms grow with the square of the
    name length at two edits; more is not supported.
    """
    if max_edits not in (1, 2):
        raise ValueError("max_edits must be 1 or 2")
    wanted = terms.select("term", F.lower(clean_name(F.col("term"))).alias("_term")).distinct()
    names = catalog.select("article_id", "article_name", F.lower(clean_name(F.col("article_name"))).alias("_name"))

    def forms(name: str) -> Column:
        """Hashes of the forms: a false meeting is found out by the distance."""
        return F.explode(F.transform(deletion_variants(F.col(name), max_edits), lambda form: F.xxhash64(form))).alias("_form")

    term_forms = wanted.select("term", "_term", forms("_term"))
    # Equal names share all forms: list each distinct name once and fan out at the end. The planner
    # takes the forms for as large as the names' file; unhinted, it would broadcast them.
    name_forms = names.select("_name").distinct().select("_name", forms("_name")).hint("merge")
    near = (
        term_forms.join(name_forms, "_form")
        .select("term", "_term", "_name")
        .distinct()
        .withColumn("distance", F.levenshtein("_term", "_name"))
        .filter(F.col("distance") <= max_edits)
    )
    # All articles of one name are equally near, so its first k can answer any term.
    by_name = [F.col("article_name"), F.col("article_id")]
    listed = skew.first_rows(names, ["_name"], by_name, k).hint("merge")
    found = near.join(listed, "_name").select(
        "term", "article_id", "article_name", F.col("distance").cast("bigint").alias("distance")
    )
    order = [F.col("distance"), *by_name]
    return skew.first_rows(found, ["term"], order, k).withColumnRenamed("row_no", "match_rank")
