"""Contract prices: views, price for a demand, order recommendations, integrity.

Input tables (money in cents, see ``tenderloom.schemas``):
``articles, categories, suppliers, contracts, lines`` (one article in one
contract) and ``tiers`` (volume prices of a line).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.functions.money import div_half_up, percent
from tenderloom.functions.text import relevance
from tenderloom.operators import skew
from tenderloom.operators.matching import rarest_key_pairs, text_grams

# Upper end of a band without limit.
NO_LIMIT = 2**62

# Partitions of a demand join as a multiple of the session's shuffle partitions.
FAN_OUT = 4

CONTRACT_STATUSES = ("active", "expired", "draft", "terminated")


@dataclass(frozen=True)
class ContractTables:
    articles: DataFrame
    categories: DataFrame
    suppliers: DataFrame
    contracts: DataFrame
    lines: DataFrame
    tiers: DataFrame


def active_contracts(contracts: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Contracts with status ``active``; with ``as_of`` also valid on that day (inclusive)."""
    active = contracts.filter(F.col("status") == "active")
    if as_of is None:
        return active
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return active.filter(day.between(F.col("valid_from"), F.col("valid_until")))


def _supplied_lines(t: ContractTables, as_of: str | None, contract_columns: list[str]) -> DataFrame:
    """Lines of active contracts with their supplier's name.

    Contracts meet suppliers first, so the large line table is joined once.
    """
    contracts = active_contracts(t.contracts, as_of).select(
        "contract_id", "supplier_id", *contract_columns
    )
    suppliers = t.suppliers.select("supplier_id", "supplier_name")
    return t.lines.join(contracts.join(suppliers, "supplier_id"), "contract_id")


def _described_articles(t: ContractTables) -> DataFrame:
    categories = t.categories.select("category_id", "category_name")
    return t.articles.select("article_id", "ean", "article_name", "brand", "category_id").join(
        categories, "category_id"
    )


def best_contract_price(t: ContractTables) -> DataFrame:
    """Every active contract price with its rank per article, cheapest first."""
    lines = _supplied_lines(t, None, ["contract_number", "valid_from", "valid_until"])
    # (article, contract) is unique, so one price and one block of 65,536 contract
    # ids bound the rows numbered together, however hot the article is.
    ranked = skew.numbered_rows(
        lines,
        keys=["article_id"],
        split_by=[F.col("contract_price_cents"), F.shiftright(F.col("contract_id"), 16)],
        order_by=[F.col("contract_price_cents"), F.col("contract_id")],
        name="price_rank",
        sized_by=t.lines,
    )
    return ranked.join(_described_articles(t), "article_id").select(
        "article_id",
        "ean",
        "article_name",
        "brand",
        "category_name",
        "supplier_name",
        "contract_number",
        "contract_price_cents",
        "list_price_cents",
        "discount_pct",
        "delivery_days",
        "min_order_qty",
        "valid_from",
        "valid_until",
        "price_rank",
    )


def best_tiered_price(t: ContractTables) -> DataFrame:
    """One row per volume tier of an active contract line."""
    tiers = t.tiers.select(
        "contract_article_id",
        "min_quantity",
        "max_quantity",
        "tier_price_cents",
        F.col("discount_pct").alias("tier_discount_pct"),
    )
    lines = _supplied_lines(t, None, ["contract_number", "valid_from", "valid_until"])
    return (
        lines.drop("discount_pct")
        .join(tiers, "contract_article_id")
        .join(_described_articles(t), "article_id")
        .select(
            "article_id",
            "ean",
            "article_name",
            "brand",
            "category_name",
            "supplier_name",
            "contract_number",
            F.col("contract_price_cents").alias("base_price_cents"),
            "list_price_cents",
            "min_quantity",
            "max_quantity",
            "tier_price_cents",
            "tier_discount_pct",
            "delivery_days",
            "valid_from",
            "valid_until",
        )
    )


def supplier_article_matrix(t: ContractTables) -> DataFrame:
    """Supplier x active contract x article; sort it at the sink if an order is needed."""
    lines = _supplied_lines(t, None, ["contract_number", "valid_until"])
    return lines.join(_described_articles(t), "article_id").select(
        "supplier_name",
        "ean",
        "article_name",
        "brand",
        "category_name",
        "contract_price_cents",
        "list_price_cents",
        "discount_pct",
        "delivery_days",
        "is_preferred",
        "contract_number",
        "valid_until",
    )


def contract_overview(t: ContractTables) -> DataFrame:
    """Per contract: supplier contact, number of lines and mean discount.

    Lines are aggregated before the join, so a contract with very many lines
    shuffles one partial row per task.
    """
    hundredths = (F.col("discount_pct") * 100).cast("bigint")
    totals = t.lines.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("article_count"),
        F.sum(hundredths).alias("_discount_sum"),
        F.count("discount_pct").alias("_discounts"),
    )
    suppliers = t.suppliers.select(
        "supplier_id", "supplier_name", "contact_person", "email", "phone"
    )
    mean = div_half_up(F.col("_discount_sum"), F.col("_discounts")) / F.lit(100.0)
    return (
        t.contracts.join(suppliers, "supplier_id")
        .join(totals, "contract_id", "left")
        .select(
            "contract_id",
            "contract_number",
            "title",
            "version",
            "status",
            "supplier_name",
            "contact_person",
            "email",
            "phone",
            "valid_from",
            "valid_until",
            t.contracts["payment_terms"],
            "delivery_terms",
            "minimum_order_value_cents",
            "free_shipping_threshold_cents",
            F.coalesce("article_count", F.lit(0)).cast("bigint").alias("article_count"),
            mean.alias("avg_discount_pct"),
        )
    )


def article_prices(t: ContractTables, active_only: bool = False) -> DataFrame:
    """Per article: number of contracts, lowest contract and highest list price.

    By default lines of inactive contracts count too, as in the original view;
    ``active_only=True`` keeps active contracts only.
    """
    lines = t.lines
    if active_only:
        active = active_contracts(t.contracts).select("contract_id")
        lines = lines.join(active, "contract_id", "left_semi")
    # Counting distinct contracts holds each pair of article and contract several times in a task's memory,
    # so pairs are dealt to more tasks than their bytes alone would ask for; hot articles stay cut by contract.
    partitions = FAN_OUT * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["article_id", "contract_id", "contract_price_cents", "list_price_cents"]
    dealt = lines.select(*columns).repartition(partitions, "article_id", "contract_id")
    return dealt.groupBy("article_id").agg(
        F.countDistinct("contract_id").alias("contract_count"),
        F.min("contract_price_cents").alias("best_price_cents"),
        F.max("list_price_cents").alias("list_price_cents"),
    )


def article_catalog(t: ContractTables, active_only: bool = False) -> DataFrame:
    """Article catalog with contract count, best price and largest saving."""
    saving = percent(
        F.col("list_price_cents") - F.col("best_price_cents"), F.col("list_price_cents"), 2
    )
    categories = t.categories.select("category_id", "category_name")
    return (
        t.articles.join(categories, "category_id")
        .join(article_prices(t, active_only), "article_id", "left")
        .select(
            "article_id",
            "ean",
            "article_name",
            "brand",
            "manufacturer",
            "description",
            "category_name",
            "unit",
            F.coalesce("contract_count", F.lit(0)).cast("bigint").alias("contract_count"),
            F.col("best_price_cents").alias("best_contract_price_cents"),
            "list_price_cents",
            saving.alias("max_saving_pct"),
        )
    )


def search_articles(t: ContractTables, terms: DataFrame, active_only: bool = False) -> DataFrame:
    """Articles whose barcode equals, or whose texts contain, each search term.

    ``terms(term)`` may hold many terms: each is looked up by its rarest character
    gram, so only articles sharing that gram are tested, never all pairs. Tables of terms
    and articles are taken to be large and are never broadcast (``rarest_key_pairs``).
    Wildcard characters in a term are matched literally; empty terms find nothing.
    """
    terms = terms.select("term").filter(F.length("term") > 0).distinct()
    texts = t.articles.select(
        "article_id",
        F.concat_ws("\u0001", *[F.lower(c) for c in ("article_name", "brand", "description")]).alias(
            "text"
        ),
    )
    lowered = terms.select("term", F.lower("term").alias("text"))
    by_text = rarest_key_pairs(
        text_grams(lowered, "term", "text", whole_if_short=True),
        text_grams(texts, "article_id", "text"),
        "term",
        "article_id",
    )
    by_ean = terms.join(
        t.articles.select("article_id", F.col("ean").alias("term")).hint("merge"), "term"
    ).select("term", "article_id")
    pairs = by_text.unionByName(by_ean).distinct()
    term, lower_term = F.col("term"), F.lower("term")
    hit = F.col("ean") == term
    for name in ("article_name", "brand", "description"):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), lower_term), F.lit(False))
    categories = t.categories.select("category_id", "category_name")
    found = pairs.join(t.articles.hint("merge"), "article_id").filter(hit).join(categories, "category_id")
    score = relevance(
        term, F.col("ean"), F.col("article_name"), F.col("brand"), F.col("description")
    )
    return found.join(article_prices(t, active_only), "article_id", "left").select(
        "term",
        "article_id",
        "ean",
        "article_name",
        "brand",
        "category_name",
        "best_price_cents",
        "list_price_cents",
        F.coalesce("contract_count", F.lit(0)).cast("bigint").alias("contract_count"),
        score.alias("relevance"),
    )


def relevance_order() -> list[Column]:
    """Sort order of ``search_articles``: best match, then cheapest, unpriced last."""
    return [F.desc("relevance"), F.asc_nulls_last("best_price_cents")]


# -- price for a demand -------------------------------------------------------


def _tier_lists(tiers: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per line with tiers: ``_tiers``, the list of them as ranges of quantities with a price."""
    tier = [
        F.col("min_quantity").cast("bigint").alias("from_qty"),
        F.coalesce(F.col("max_quantity").cast("bigint"), F.lit(NO_LIMIT)).alias("to_qty"),
        F.col("tier_price_cents").alias("band_price_cents"),
    ]
    if with_ids:
        tier.append(F.col("tier_id").cast("bigint").alias("tier_id"))
    known = tiers.filter(F.col("min_quantity").isNotNull())
    return known.groupBy("contract_article_id").agg(F.collect_list(F.struct(*tier)).alias("_tiers"))


def _with_segments(rows: DataFrame) -> DataFrame:
    """Rows with the disjoint ``_segments`` that the ends of their ``_tiers`` cut the quantities into.

    A segment has the lowest price of the tiers over it, NULL where there is none (``is_gap``). A row
    without tiers (NULL) has one segment, a gap.
    """
    none = F.array().cast(rows.schema["_tiers"].dataType)
    starts = F.transform("_tiers", lambda tier: tier["from_qty"])
    ends = F.transform("_tiers", lambda tier: tier["to_qty"] + 1)
    one = F.array(F.lit(1).cast("bigint"))

    def segment(first: Column) -> Column:
        following = F.array_min(F.filter("_cuts", lambda cut: cut > first))
        over = F.filter("_tiers", lambda tier: first.between(tier["from_qty"], tier["to_qty"]))
        return F.struct(
            first.alias("from_qty"),
            F.coalesce(following - 1, F.lit(NO_LIMIT)).alias("to_qty"),
            F.array_min(F.transform(over, lambda tier: tier["band_price_cents"])).alias("band_price_cents"),
            (F.size(over) == 0).alias("is_gap"),
        )

    listed = rows.withColumn("_tiers", F.coalesce("_tiers", none))
    cut = listed.withColumn("_cuts", F.array_distinct(F.concat(one, starts, ends)))
    return cut.withColumn("_segments", F.transform("_cuts", segment)).drop("_cuts")


def _band(kind: Column, first: Column, last: Column, price: Column, tier_id: Column) -> Column:
    return F.struct(
        kind.alias("price_type"),
        first.alias("from_qty"),
        last.alias("to_qty"),
        price.alias("band_price_cents"),
        tier_id.alias("tier_id"),
    )


def _price_bands() -> Column:
    """Bands of a row with segments: its tiers, and the gaps between them, where the base price holds.

    With the gaps spelled out, "no tier matches" is an ordinary band and pricing a demand needs a
    single join. Price and tier of a gap are NULL.
    """
    none = F.lit(None).cast("bigint")

    def step(tier: Column) -> Column:
        return _band(F.lit("tiered"), tier["from_qty"], tier["to_qty"], tier["band_price_cents"], tier["tier_id"])

    def gap(segment: Column) -> Column:
        return _band(F.lit("contract"), segment["from_qty"], segment["to_qty"], none, none)

    gaps = F.filter("_segments", lambda segment: segment["is_gap"] & (segment["from_qty"] >= 1))
    return F.concat(F.transform("_tiers", step), F.transform(gaps, gap))


def _cheapest_bands() -> Column:
    """Bands of a row with segments: one each, so that a quantity meets one band and nothing has to be
    aggregated after the demand join, however the tiers of a line overlap."""
    none = F.lit(None).cast("bigint")

    def band(segment: Column) -> Column:
        price = segment["band_price_cents"]
        kind = F.when(price.isNotNull(), "tiered").otherwise("contract")
        return _band(kind, segment["from_qty"], segment["to_qty"], price, none)

    return F.transform("_segments", band)


def _order_bands() -> Column:
    """Bands of a row with segments: its cheapest ones, and what an order may become to reach a tier."""

    def exact(segment: Column) -> Column:
        order = F.lit(None).cast("bigint").alias("order_qty")
        return F.struct(segment["from_qty"], segment["to_qty"], segment["band_price_cents"], order)

    def more(tier: Column) -> Column:
        start = tier["from_qty"]
        reached_from = F.shiftright(start + 1, 1).alias("from_qty")
        last = (start - 1).alias("to_qty")
        return F.struct(reached_from, last, tier["band_price_cents"], start.alias("order_qty"))

    return F.concat(F.transform("_segments", exact), F.transform("_tiers", more))


def cheapest_bands(tiers: DataFrame) -> DataFrame:
    """Disjoint quantity bands of every line with tiers, each with its cheapest tier price.

    Tiers of a line may overlap. Their ends cut the line into segments, and each segment
    takes the lowest price of the tiers over it (NULL where there is none).
    """
    cut = _with_segments(_tier_lists(tiers)).select("contract_article_id", F.explode("_segments").alias("_band"))
    return cut.select("contract_article_id", "_band.*").drop("is_gap").filter("from_qty <= to_qty")


def price_schedule(t: ContractTables, as_of: str, cheapest: bool = False) -> DataFrame:
    """Bands of all lines valid on ``as_of``, with prices and supplier, cut at the minimum order.

    A line without tiers has one band at its base price. ``cheapest`` merges overlapping
    tiers; otherwise each tier is a band of its own.
    """
    lists = _tier_lists(t.tiers, with_ids=not cheapest)
    return (
        _banded_lines(t, as_of, lists, _cheapest_bands() if cheapest else _price_bands())
        .select(
            "article_id",
            "contract_id",
            "supplier_name",
            "contract_number",
            "price_type",
            F.greatest("from_qty", F.col("min_order_qty").cast("bigint")).alias("from_qty"),
            "to_qty",
            F.coalesce("band_price_cents", "contract_price_cents").alias("unit_price_cents"),
            "list_price_cents",
            "delivery_days",
            "tier_id",
        )
        .filter("from_qty <= to_qty")
    )


def _banded_lines(t: ContractTables, as_of: str, lists: DataFrame, bands: Column) -> DataFrame:
    """Supplied lines with each of their ``bands``, partitioned by article.

    A line meets the list of its tiers first: where both are already dealt by line, that takes no
    shuffle. Lines and names are shuffled by article once a line, with its few tiers; their bands, which
    are more, are spelled out after that. There are ``FAN_OUT`` times the session's partitions, because a
    demand join makes many times the rows that it reads: partitions of the usual size in bytes read
    would spill when sorted.
    """
    tiered = t.lines.join(lists, "contract_article_id", "left")
    # One by one, because the planner knows the size of each of these tables, but takes a join of both for
    # as large as their product and would shuffle the lines for it.
    contracts = active_contracts(t.contracts, as_of).select("contract_id", "supplier_id", "contract_number")
    rows = tiered.join(contracts, "contract_id").join(t.suppliers.select("supplier_id", "supplier_name"), "supplier_id")
    kept = ["article_id", "contract_id", "supplier_name", "contract_number", "contract_price_cents", "min_order_qty"]
    kept += ["list_price_cents", "delivery_days"]
    partitions = FAN_OUT * int(t.lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _with_segments(rows.select(*kept, "_tiers").repartition(partitions, "article_id"))
    listed = dealt.select(*kept, bands.alias("_bands"))
    return listed.select(*kept, F.explode("_bands").alias("_band")).select(*kept, "_band.*")


CELL = ["article_id", skew.SPLIT, skew.SPLIT_FEW]


def _matches(
    t: ContractTables,
    demand: DataFrame,
    bands: DataFrame,
    rows_per_split: int | None,
    pairs_per_split: int | None,
    counted: DataFrame | None,
    by_article: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Demand rows with every band that holds their quantity: of ordinary and of hot articles.

    Ordinary articles take one equi join with a range residual. An article with very many demand
    rows, very many bands or both becomes a grid of cells sized from both counts, which one
    aggregation over both sides takes; where there is none, that branch is empty and drops out
    when the counts are known. ``counted`` may name a table that is cheaper to count, with at least as
    many rows of every article as the demand and as the lines.

    Bands are the outer side of the join, so the rows of a band come out together: written files hold
    its names and prices once a run of rows. With ``by_article`` the demand is, which ranking goes on from.
    """
    fits = F.col("qty").between(F.col("from_qty"), F.col("to_qty"))
    hot = skew.hot_cells(demand, t.lines, ["article_id"], rows_per_split, pairs_per_split, counted)
    listed = F.broadcast(hot.select("article_id"))
    # Merging keeps the result partitioned by article even where one side could be broadcast, for
    # callers that go on to rank: shuffling the inputs once is cheaper than shuffling the matches.
    asked = demand.join(listed, "article_id", "left_anti")
    ordinary = asked.join(bands.hint("merge"), "article_id") if by_article else bands.join(asked, "article_id")
    # Columns that are needed anyway, so that both branches read the same shuffled bands.
    line = "contract_id" if "contract_id" in bands.columns else "contract_number"
    cut, met = skew.dealt_by_work(demand, bands, ["article_id"], ["demand_id"], [line, "from_qty"], hot)
    return ordinary.filter(fits), met.join(cut, CELL).filter(fits).drop(skew.SPLIT, skew.SPLIT_FEW)


def _at_demand(
    t: ContractTables,
    demand: DataFrame,
    bands: DataFrame,
    rows_per_split: int | None,
    pairs_per_split: int | None,
    counted: DataFrame | None,
) -> DataFrame:
    ordinary, hot = _matches(t, demand, bands, rows_per_split, pairs_per_split, counted)
    return ordinary.unionByName(hot)


def price_for_demand(
    t: ContractTables,
    demand: DataFrame,
    as_of: str,
    rows_per_split: int | None = None,
    pairs_per_split: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """All contract prices for each row of ``demand(demand_id, article_id, qty)``.

    Per line the matching tier price, else the base price; ``price_rank`` orders the
    options of one demand row. The join partitions by article, which already
    clusters the ranking keys, so ranking adds a sort but no shuffle. Only of hot articles
    can one demand row have options in several cells; those are shuffled by demand row.
    """
    ordinary, hot = _matches(t, demand, price_schedule(t, as_of), rows_per_split, pairs_per_split, counted, by_article=True)
    # The article comes first because its rows arrive together: sorting moves them little, and written files
    # of an article's rows are smaller.
    rank = F.row_number().over(
        Window.partitionBy("article_id", "demand_id").orderBy(
            "unit_price_cents", "contract_id", "from_qty", "tier_id"
        )
    )
    ranked = ordinary.withColumn("price_rank", rank).unionByName(hot.withColumn("price_rank", rank))
    return ranked.select(
        "demand_id",
        "article_id",
        "qty",
        "supplier_name",
        "contract_number",
        "unit_price_cents",
        (F.col("unit_price_cents") * F.col("qty")).alias("total_price_cents"),
        ((F.col("list_price_cents") - F.col("unit_price_cents")) * F.col("qty")).alias(
            "savings_vs_list_cents"
        ),
        "delivery_days",
        "price_type",
        F.col("price_rank").cast("bigint").alias("price_rank"),
    )


def lines_without_tier(
    t: ContractTables,
    demand: DataFrame,
    as_of: str,
    rows_per_split: int | None = None,
    pairs_per_split: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """(demand, line) pairs for which no tier holds the quantity: the base-price bands."""
    base = price_schedule(t, as_of).filter(F.col("price_type") == "contract")
    return _at_demand(t, demand, base, rows_per_split, pairs_per_split, counted).select(
        "demand_id", "article_id", "qty", "contract_id", "contract_number", "unit_price_cents"
    )


def tier_lookup(
    t: ContractTables,
    demand: DataFrame,
    as_of: str,
    rows_per_split: int | None = None,
    pairs_per_split: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Per (demand, line) the cheapest matching tier price, NULL when no tier matches."""
    bands = price_schedule(t, as_of, cheapest=True)
    tier_price = F.when(F.col("price_type") == "tiered", F.col("unit_price_cents"))
    return _at_demand(t, demand, bands, rows_per_split, pairs_per_split, counted).select(
        "article_id", "demand_id", "qty", "contract_id", tier_price.alias("tier_price_cents")
    )


EXACT_QUANTITY = "exact quantity"
ORDER_MORE = "volume tier - order more to save"


def order_bands(t: ContractTables, as_of: str) -> DataFrame:
    """Bands of what an order may become: its exact quantity, or the start of a later tier.

    A tier starting at ``m`` is suggested for quantities in ``[ceil(m / 2), m - 1]``, that is
    when at most twice the order reaches it. ``order_qty`` is NULL for the exact quantity.
    As in the original, a suggestion ignores the line's minimum order and need not be cheaper.
    """
    is_exact = F.col("order_qty").isNull()
    return (
        _banded_lines(t, as_of, _tier_lists(t.tiers), _order_bands())
        .select(
            "article_id",
            "supplier_name",
            "contract_number",
            F.when(is_exact, F.greatest("from_qty", F.col("min_order_qty").cast("bigint")))
            .otherwise(F.col("from_qty"))
            .alias("from_qty"),
            "to_qty",
            F.coalesce("band_price_cents", "contract_price_cents").alias("unit_price_cents"),
            "list_price_cents",
            "delivery_days",
            "order_qty",
            F.when(is_exact, EXACT_QUANTITY).otherwise(ORDER_MORE).alias("recommendation"),
        )
        .filter("from_qty <= to_qty")
    )


def recommend_order(
    t: ContractTables,
    demand: DataFrame,
    as_of: str,
    rows_per_split: int | None = None,
    pairs_per_split: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Exact-quantity price per line, and every tier reached by at most doubling the order.

    Both options are bands of the same table, so one join answers them.
    """
    options = _at_demand(t, demand, order_bands(t, as_of), rows_per_split, pairs_per_split, counted)
    order_qty = F.coalesce("order_qty", "qty")
    saving = F.col("list_price_cents") - F.col("unit_price_cents")
    return options.select(
        "demand_id",
        "article_id",
        "qty",
        "supplier_name",
        "contract_number",
        order_qty.alias("recommended_qty"),
        "unit_price_cents",
        (F.col("unit_price_cents") * order_qty).alias("total_price_cents"),
        (saving * order_qty).alias("savings_vs_list_cents"),
        percent(saving, F.col("list_price_cents"), 1).alias("savings_pct"),
        "delivery_days",
        "recommendation",
    )


# -- integrity ----------------------------------------------------------------


def _checks(df: DataFrame, **conditions: Column) -> DataFrame:
    """``(check_name, value)`` rows: rows of ``df`` meeting each condition, in one pass."""
    counted = df.agg(*[F.count_if(test).alias(name) for name, test in conditions.items()])
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("check_name"), F.col(f"`{name}`").alias("value"))
            for name in conditions
        ]
    )
    return counted.select(F.explode(pairs).alias("c")).select("c.*")


def _repeated(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return _checks(groups, **{name: F.col("n") > 1})


def _orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    # One row per used key: a key used by very many rows is shuffled once per task.
    used = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = used.join(parent.select(key).distinct(), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")).select(
        F.lit(name).alias("check_name"), "value"
    )


def integrity_report(t: ContractTables) -> DataFrame:
    """Row counts of the six tables and the number of violations of each declared constraint."""
    every = F.lit(True)
    checks = [
        _checks(t.categories, **{"rows:categories": every}),
        _checks(t.suppliers, **{"rows:suppliers": every}),
        _checks(t.articles, **{"rows:articles": every}),
        _checks(
            t.contracts,
            **{
                "rows:contracts": every,
                "range:contracts.dates": F.col("valid_until") <= F.col("valid_from"),
                "domain:contracts.status": ~F.col("status").isin(*CONTRACT_STATUSES),
            },
        ),
        _checks(t.lines, **{"rows:contract_articles": every}),
        _checks(
            t.tiers,
            **{
                "rows:tiered_pricing": every,
                "range:tiered_pricing.quantity": F.col("max_quantity") < F.col("min_quantity"),
            },
        ),
        _repeated(t.categories, ["category_name"], "unique:categories.category_name"),
        _repeated(t.articles, ["ean"], "unique:articles.ean"),
        _repeated(t.contracts, ["contract_number"], "unique:contracts.contract_number"),
        _repeated(t.lines, ["contract_id", "article_id"], "unique:contract_articles.line"),
        _orphans(t.articles, t.categories, "category_id", "orphan:articles.category_id"),
        _orphans(t.contracts, t.suppliers, "supplier_id", "orphan:contracts.supplier_id"),
        _orphans(t.lines, t.contracts, "contract_id", "orphan:contract_articles.contract_id"),
        _orphans(t.lines, t.articles, "article_id", "orphan:contract_articles.article_id"),
        _orphans(
            t.tiers, t.lines, "contract_article_id", "orphan:tiered_pricing.contract_article_id"
        ),
    ]
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check)
    return report
