"""Market offers: merge, rank, statistics, RFQ costing, contract comparison.

An offer row has ``product_name, ean, brand, image_url, merchant_name, source,
price_cents, shipping_cents, total_cents, product_url`` and ``position``, a sortable
column (or struct) giving arrival order. Offers always stay one row each: nothing
gathers the offers of a product, which may hold a large share of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import takewhile
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions.ean import normalize_ean, search_type
from tenderloom.functions.money import div_half_up, percent, savings_cents, savings_percent
from tenderloom.functions.text import dedup_key, rfq_fields, rfq_lines
from tenderloom.operators import skew
from tenderloom.schemas import SOURCE_ORDER

# A cheaper alternative must cost less than this share of the reference price.
ALTERNATIVE_SHARE_PERCENT = 95

NO_OFFERS = "Keine Angebote gefunden"


def source_rank(source: Column) -> Column:
    rank = F.lit(len(SOURCE_ORDER))
    for position, name in reversed(list(enumerate(SOURCE_ORDER))):
        rank = F.when(source == name, F.lit(position)).otherwise(rank)
    return rank


def union_sources(*sources: DataFrame) -> DataFrame:
    """Offers of several sources in one table; columns a source lacks become NULL."""
    merged = sources[0]
    for source in sources[1:]:
        merged = merged.unionByName(source, allowMissingColumns=True)
    return merged


def top_per_source(offers: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` offers per key and source, in arrival order."""
    if n < 1:
        raise ValueError(f"{n} offers per source")
    return skew.first_rows(offers, [*keys, "source"], [F.col("position")], n)


def _sorted_statistics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics of ordinary groups: one shuffle, each group sorted in a task by price and by merchant."""
    group = Window.partitionBy(*by)
    price, merchant, prices = F.col("total_cents"), F.col("_merchant"), F.col("_prices")
    place, earlier = F.row_number().over(group.orderBy(price)), F.lag(merchant).over(group.orderBy(merchant))
    marked = rows.withColumn("_prices", F.count(F.lit(1)).over(group)).filter(prices >= 2).withColumn("_place", place)
    marked = marked.withColumn("_new", merchant.isNotNull() & ~merchant.eqNullSafe(earlier))
    middle = F.when(F.col("_place").isin(F.floor((prices + 1) / 2), F.floor(prices / 2) + 1), price.cast("double"))
    # Few rows per group are left for the set of its sources.
    parts = marked.groupBy(*by, "source").agg(
        F.min(price).alias("_min"),
        F.max(price).alias("_max"),
        F.sum(price).alias("_sum"),
        F.count(price).alias("_prices"),
        F.sum(F.col("_new").cast("bigint")).alias("_merchants"),
        F.sum(middle).alias("_middle"),
        F.count(middle).alias("_middles"),
    )
    return parts.groupBy(*by).agg(
        F.min("_min").alias("min_price_cents"),
        F.max("_max").alias("max_price_cents"),
        F.sum("_sum").alias("_sum"),
        F.sum("_prices").alias("_prices"),
        F.sum("_merchants").alias("num_merchants"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources_with_results"),
        (F.sum("_middle") / F.sum("_middles")).alias("_median"),
    )


def _split_statistics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same of hot groups, of which no task holds a whole one.

    The median is a branch of its own: mixed into one aggregation with the distinct count,
    its value maps would be built per merchant.
    """
    stats = rows.groupBy(*by).agg(
        F.min("total_cents").alias("min_price_cents"),
        F.max("total_cents").alias("max_price_cents"),
        F.sum("total_cents").alias("_sum"),
        F.count("total_cents").alias("_prices"),
        F.countDistinct("_merchant").alias("num_merchants"),
        # Bounded by the domain of sources.
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources_with_results"),
    )
    medians = skew.percentiles(rows, by, "total_cents", {"_median": 0.5})
    return stats.filter(F.col("_prices") >= 2).join(medians, list(by))


def _price_statistics(
    priced: DataFrame, by: Sequence[str], sized_by: DataFrame | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """Statistics of groups with at least two prices; rows without a key belong to none.

    ``sized_by`` and ``sizes`` as in ``skew.parted_by_heat``.
    """
    rows = priced.select(*by, "total_cents", F.lower("merchant_name").alias("_merchant"), "source")
    rows = rows.filter(reduce(and_, [F.col(key).isNotNull() for key in by]))
    ordinary, hot = skew.parted_by_heat(rows, by, sized_by=sized_by, sizes=sizes)
    return _sorted_statistics(ordinary, by).unionByName(_split_statistics(hot, by))


def _insight_columns() -> list[Column]:
    doubled_median = F.round(F.col("_median") * 2).cast("bigint")
    spread = F.col("max_price_cents") - F.col("min_price_cents")
    return [
        F.col("min_price_cents"),
        F.col("max_price_cents"),
        div_half_up(doubled_median, F.lit(2)).alias("median_price_cents"),
        div_half_up(F.col("_sum"), F.col("_prices")).alias("avg_price_cents"),
        spread.alias("price_spread_cents"),
        F.when(doubled_median > 0, percent(2 * spread, doubled_median, 1))
        .otherwise(F.lit(0.0))
        .alias("price_spread_percent"),
        F.col("num_offers"),
        F.col("num_merchants"),
        F.col("sources_with_results"),
    ]


def price_insights(offers: DataFrame, by: Sequence[str], sizes: DataFrame | None = None) -> DataFrame:
    """Price statistics over offer totals per group; groups with fewer than two offers drop out.

    ``sizes`` may give the groups' numbers of offers (``_rows``) where they are known.
    """
    priced = offers.filter(F.col("total_cents").isNotNull())
    return (
        _price_statistics(priced, by, sizes=sizes)
        .withColumn("num_offers", F.col("_prices"))
        .select(*by, *_insight_columns())
    )


def _first_given(value: str) -> Column:
    """First non-empty value in arrival order (an aggregate with map-side combine)."""
    given = F.col(value).isNotNull() & (F.col(value) != "")
    return F.min_by(F.col(value), F.when(given, F.struct(F.col("position"), F.col(value))))


def _cheapest(*columns: str) -> Column:
    return F.min(F.struct("total_cents", "position", *columns))


def merge_products(offers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per product name (trimmed, case-insensitive) with its cheapest offer.

    Name, barcode, brand and image come from the first offer that has them. Sort by
    ``cheapest_price_cents`` with NULLs last at the sink. The offers themselves stay in
    their table and carry the same ``product_key``.
    """
    priced = F.when(F.col("total_cents").isNotNull(), F.struct("total_cents", "position", "merchant_name"))
    merged = (
        offers.withColumn("product_key", dedup_key(F.col("product_name")))
        .groupBy(*by, "product_key")
        .agg(
            F.min_by("product_name", F.struct("position", "product_name")).alias("product_name"),
            _first_given("ean").alias("ean"),
            _first_given("brand").alias("brand"),
            _first_given("image_url").alias("image_url"),
            F.count("total_cents").alias("num_offers"),
            F.min(priced).alias("_best"),
        )
    )
    return merged.select(
        *by,
        "product_key",
        "product_name",
        "ean",
        "brand",
        "image_url",
        "num_offers",
        F.col("_best.total_cents").alias("cheapest_price_cents"),
        F.col("_best.merchant_name").alias("cheapest_merchant"),
    )


def best_offer_per_merchant(offers: DataFrame, by: Sequence[str]) -> DataFrame:
    keyed = offers.filter(F.col("total_cents").isNotNull()).withColumn(
        "merchant_key", F.lower("merchant_name")
    )
    order = [F.col("total_cents"), F.col("position")]
    return skew.first_rows(keyed, [*by, "merchant_key"], order, 1).drop("row_no")


def leading_integers(kind: T.DataType, name: str) -> list[Column]:
    """The integer fields that a position starts with: ordering by them agrees with its own order."""
    if isinstance(kind, T.IntegralType):
        return [F.col(name)]
    fields = kind.fields if isinstance(kind, T.StructType) else []
    return [F.col(name)[f.name] for f in takewhile(lambda f: isinstance(f.dataType, T.IntegralType), fields)]


def rank_suppliers(offers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cheapest offer of each merchant (first wins ties), ranked by total price.

    Merchants of equal price are ranked by their first offer's arrival.
    """
    named = offers.withColumn("merchant_key", F.lower("merchant_name"))
    named = named.filter(reduce(and_, [F.col(c).isNotNull() for c in ("total_cents", "merchant_key", *by)]))
    detail = ["merchant_name", "price_cents", "shipping_cents", "source", "product_url"]
    # The cheapest offer and the first arrival come from one aggregation, combined before the shuffle.
    best = named.groupBy(*by, "merchant_key").agg(
        _cheapest(*detail).alias("_best"), F.min("position").alias("first_position")
    )
    best = best.select(*by, "merchant_key", "first_position", "_best.total_cents", *[f"_best.{c}" for c in detail])
    return skew.numbered_rows(
        best,
        keys=by,
        split_by=[F.col("total_cents"), *leading_integers(best.schema["first_position"].dataType, "first_position")],
        order_by=[F.col("total_cents"), F.col("first_position"), F.col("merchant_key")],
        name="supplier_rank",
        sized_by=offers,
    ).select(
        *by,
        "supplier_rank",
        "merchant_name",
        "price_cents",
        "shipping_cents",
        "total_cents",
        "source",
        "product_url",
    )


def supplier_insights(offers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics over the best offer per merchant; ``num_offers`` counts all offers."""
    best = best_offer_per_merchant(offers, by)
    totals = offers.groupBy(*by).agg(F.count("total_cents").alias("num_offers"))
    return _price_statistics(best, by, sizes=totals.withColumnRenamed("num_offers", "_rows")).join(totals, list(by)).select(*by, *_insight_columns())


def cheaper_alternatives(references: DataFrame, offers: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` cheapest products of the category below 95 % of each reference price.

    ``references(ref_id, category, reference_cents)``. "Below the limit, cheapest first"
    selects a prefix of the category's price list, so the first ``k`` products of each
    category answer every reference in it: at most ``k`` rows per category meet the
    references instead of all pairs.
    """
    if k < 1:
        raise ValueError(f"{k} alternatives")
    keyed = offers.filter(F.col("total_cents").isNotNull()).withColumn(
        "product_key", dedup_key(F.col("product_name"))
    )
    order = [F.col("total_cents"), F.col("source_rank"), F.col("product_key"), F.col("position")]
    detail = ["product_name", "brand", "merchant_name", "product_url"]
    per_source = (
        keyed.groupBy("category", "source", "product_key")
        .agg(_cheapest(*detail).alias("best"))
        .select("category", "source", "product_key", "best.*")
        .withColumn("source_rank", source_rank(F.col("source")))
    )
    listed = skew.first_rows(per_source, ["category", "source"], order, k)
    named = skew.first_rows(listed.drop("row_no"), ["category", "product_key"], order, 1)
    shortlist = skew.first_rows(named.drop("row_no"), ["category"], order, k)
    limit = F.col("reference_cents") * ALTERNATIVE_SHARE_PERCENT
    reference, price = F.col("reference_cents"), F.col("total_cents")
    return (
        references.join(shortlist, "category")
        .filter(price * 100 < limit)
        .select(
            "ref_id",
            "category",
            "reference_cents",
            F.col("row_no").alias("alternative_rank"),
            "product_name",
            "brand",
            F.col("total_cents").alias("cheapest_price_cents"),
            F.col("merchant_name").alias("cheapest_merchant"),
            "source",
            savings_cents(reference, price).alias("savings_cents"),
            savings_percent(reference, price).alias("savings_percent"),
        )
    )


# -- request for quotation ----------------------------------------------------


def parse_rfq(requests: DataFrame, id_column: str = "rfq_id", text: str = "text") -> DataFrame:
    """Free-text requests -> one row per item ``(id, line_no, query, quantity, label)``."""
    lines = requests.select(id_column, F.posexplode(rfq_lines(F.col(text))).alias("line_no", "line"))
    query, quantity, label = rfq_fields(F.col("line"))
    return lines.select(
        id_column,
        F.col("line_no").cast("bigint").alias("line_no"),
        query.alias("query"),
        quantity.alias("quantity"),
        label.alias("label"),
    ).filter(F.length("query") > 0)


def query_key(query: Column) -> Column:
    """Lookup key of a query: the cleaned barcode or the lower-case name."""
    kind = search_type(query)
    return F.concat_ws(
        ":", kind, F.when(kind == "ean", normalize_ean(query)).otherwise(dedup_key(query))
    )


def by_query_key(df: DataFrame, name: str, ean: str) -> DataFrame:
    """Each row once under its name and, if it has one, once under its barcode."""
    keys = F.array(
        F.concat(F.lit("name:"), dedup_key(F.col(name))),
        F.concat(F.lit("ean:"), F.nullif(normalize_ean(F.col(ean)), F.lit(""))),
    )
    return df.withColumn("query_key", F.explode(keys)).filter(F.col("query_key").isNotNull())


def cost_rfq(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Cheapest product, unit and line total for each requested item; failures keep their row."""
    products = by_query_key(merge_products(offers), "product_name", "ean")
    priced = F.when(
        F.col("cheapest_price_cents").isNotNull(),
        F.struct("cheapest_price_cents", "product_key", "product_name", "cheapest_merchant"),
    )
    found = products.groupBy("query_key").agg(
        F.min(priced).alias("best"), F.sum("num_offers").alias("num_offers")
    )
    unit = F.col("best.cheapest_price_cents")
    missing = unit.isNull()
    return (
        items.withColumn("query_key", query_key(F.col("query")))
        .join(found, "query_key", "left")
        .select(
            *[c for c in items.columns],
            F.col("best.product_name").alias("product_name"),
            unit.alias("unit_price_cents"),
            (unit * F.col("quantity")).alias("total_price_cents"),
            F.col("best.cheapest_merchant").alias("merchant"),
            F.when(missing, F.lit(0)).otherwise(F.col("num_offers")).cast("bigint").alias("num_offers"),
            F.when(missing, F.lit(NO_OFFERS)).alias("error"),
        )
    )


#: Statistics of the offers found for a line; their number is the line's own ``num_offers``.
LINE_INSIGHTS = (
    "min_price_cents",
    "max_price_cents",
    "median_price_cents",
    "avg_price_cents",
    "price_spread_cents",
    "price_spread_percent",
    "num_merchants",
    "sources_with_results",
)


def query_insights(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Price statistics per query over all offers of all products that the query finds.

    An offer counts for its product's barcode even if it names none itself. Only products that
    are asked for meet their offers, and each query key is worked out once.
    """
    wanted = items.select(query_key(F.col("query")).alias("query_key")).distinct()
    products = by_query_key(merge_products(offers), "product_name", "ean").select("query_key", "product_key", "num_offers")
    asked = products.join(wanted, "query_key", "left_semi")
    keyed = offers.withColumn("product_key", dedup_key(F.col("product_name")))
    found = keyed.select("product_key", "merchant_name", "source", "total_cents").join(asked.drop("num_offers"), "product_key")
    sizes = asked.groupBy("query_key").agg(F.sum("num_offers").alias("_rows"))
    return price_insights(found, ["query_key"], sizes).select("query_key", *LINE_INSIGHTS)


def cost_rfq_with_insights(items: DataFrame, offers: DataFrame) -> DataFrame:
    """``cost_rfq`` with the statistics of each line's offers; NULL for fewer than two priced offers."""
    costed = cost_rfq(items, offers).withColumn("query_key", query_key(F.col("query")))
    return costed.join(query_insights(items, offers), "query_key", "left").drop("query_key")


def rfq_totals(costed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Grand total and number of priced and all lines, per request or overall."""
    return costed.groupBy(*by).agg(
        F.coalesce(F.sum("total_price_cents"), F.lit(0)).alias("grand_total_cents"),
        F.count_if(F.col("error").isNull()).alias("success_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


# -- contract against market --------------------------------------------------

# Verdicts by how far the contract price exceeds the best market price, in percent.
URGENT_ABOVE = 15
RENEGOTIATE_ABOVE = 5


def market_verdict(contract_cents: Column, market_cents: Column) -> Column:
    excess = (contract_cents - market_cents) * 100
    return (
        F.when(market_cents.isNull(), "no_market_data")
        .when(excess > URGENT_ABOVE * F.greatest(contract_cents, F.lit(0)), "urgent_renegotiation")
        .when(excess > RENEGOTIATE_ABOVE * F.greatest(contract_cents, F.lit(0)), "renegotiate")
        .when(excess > 0, "near_market")
        .when(excess < 0, "below_market")
        .otherwise("at_market")
    )


def best_market_offers(offers: DataFrame, key: str) -> DataFrame:
    """Cheapest offer per key; one partial row per key and task is shuffled."""
    priced = offers.filter(F.col("total_cents").isNotNull() & F.col(key).isNotNull())
    return (
        priced.groupBy(key)
        .agg(
            _cheapest("merchant_name", "product_url").alias("best"),
            F.count(F.lit(1)).alias("total_offers_found"),
        )
        .select(
            key,
            F.col("best.total_cents").alias("market_price_cents"),
            F.col("best.merchant_name").alias("market_merchant"),
            F.col("best.product_url").alias("market_url"),
            "total_offers_found",
        )
    )


def compare_with_market(
    contracts: DataFrame, market: DataFrame, key: str, more: Sequence[str] = ()
) -> DataFrame:
    """Join contract prices to best market prices; also the streaming form (market static).

    ``more`` names further columns of the market side to keep.
    """
    contract, best = F.col("contract_price_cents"), F.col("market_price_cents")
    return contracts.join(market, key, "left").select(
        *contracts.columns,
        "market_price_cents",
        "market_merchant",
        (contract - best).alias("price_difference_cents"),
        F.when(contract > 0, percent(contract - best, contract, 1)).alias(
            "price_difference_percent"
        ),
        F.coalesce("total_offers_found", F.lit(0)).cast("bigint").alias("total_offers_found"),
        market_verdict(contract, best).alias("verdict"),
        *more,
    )


def contract_vs_market(contracts: DataFrame, offers: DataFrame, key: str = "ean") -> DataFrame:
    """Each contract price against the cheapest market offer of the same article."""
    return compare_with_market(contracts, best_market_offers(offers, key), key)


def contract_market_report(
    contracts: DataFrame, offers: DataFrame, key: str = "ean", quantity: str = "quantity"
) -> DataFrame:
    """``contract_vs_market`` with totals for a quantity, the best offer's address and price statistics.

    The market side is one row per article (best offer and statistics) before it meets the
    contracts. Totals are NULL without a quantity and the market's without an offer; statistics
    are NULL for fewer than two priced offers.
    """
    best = best_market_offers(offers, key)
    insights = price_insights(offers, [key]).select(key, *LINE_INSIGHTS)
    market = best.join(insights, key, "left")
    verdicts = compare_with_market(contracts, market, key, more=("market_url", *LINE_INSIGHTS))
    count = F.col(quantity)
    return verdicts.withColumns(
        {
            "contract_total_cents": F.col("contract_price_cents") * count,
            "market_total_cents": F.col("market_price_cents") * count,
            "total_difference_cents": F.col("price_difference_cents") * count,
        }
    )
