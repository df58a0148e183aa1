"""Mixing sources to target weights by weighted sampling without replacement.

A source's target is its share of the budget by weight, at most ``max_epochs`` times its size,
the excess reshared. Whole epochs take every document; the rest of a target is filled by
Efraimidis-Spirakis sampling: every document draws an exponential key divided by its quality
weight, and documents are taken by ascending key until the words run out.

The draw is a hash of the id, so reruns agree. A hot source is not sorted in one task: quality
weights have few levels, hence the distribution of keys within a source is known in closed form
and cuts its documents into even pieces of ascending keys. Prefix sums then need a window over
pieces and one inside each piece, of at most about ``piece_rows`` documents.

Defined results: a null or empty text has size 0 and is taken with 0 words; a null source is a
source of its own, weighted last; repeated rows draw equal keys and are ordered by size and text; a table
without words has targets 0; extra columns are kept by ``mix_documents``; an empty table gives
an empty result. Documents are taken whole, so a source misses its target by at most half of one
document's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.llm.common import SPACE, Workspace

#: Weights by the source's rank, the budget and the most epochs of a source.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
PIECE_ROWS = 4_000
#: Quality weights; sampling prefers higher ones.
LEVELS = (0.5, 1.0)


def document_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def quality_level(text: Column, size: Column) -> Column:
    """Weight 1 for texts whose words have 3 to 10 characters on average, else one half."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.when(mean.between(4, 11), F.lit(LEVELS[1])).otherwise(F.lit(LEVELS[0]))


def uniform_draw(doc_id: Column) -> Column:
    """In (0, 1), from the first 48 bits of the id's MD5."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sources: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` with ``target``: one row a source, so the windows below see
    sources, never documents.

    Resharing until no target exceeds its cap is water filling: in order of cap / weight, the
    capped sources are those whose ratio is below the level that the rest would get. Levels fall
    from the first source that is not capped on, so that level is the largest of the others.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = sources.withColumns(
        {
            "_weight": F.get(weights, (F.row_number().over(names) - 1) % len(WEIGHTS)),
            "_cap": (max_epochs * F.col("source_size")).cast("double"),
            "_all": F.sum("source_size").over(everything) * F.lit(budget),
        }
    )
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    filled = ranked.withColumn("_level", level)
    first = F.max(F.when(F.col("_cap") >= F.col("_level") * F.col("_weight"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(first, F.lit(0.0)) * F.col("_weight"))
    return filled.select("source", "source_size", target.alias("target"))


def plan_mix(sized: DataFrame, piece_rows: int = PIECE_ROWS, budget: float = BUDGET) -> DataFrame:
    """``taken`` and ``copies`` for rows with ``source, size, level, draw, tie, mark``; other columns stay."""
    levels = sized.groupBy("source", "level").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    by_source = levels.groupBy("source").agg(
        F.sum("n").alias("_n"),
        F.sum("words").alias("source_size"),
        *[F.sum(F.when(F.col("level") == w, F.col("n")).otherwise(0)).alias(f"_n{k}") for k, w in enumerate(LEVELS)],
    )
    targets = source_targets(by_source.select("source", "source_size"), budget)
    plan = (
        by_source.drop("source_size")
        .withColumnRenamed("source", "_source")
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .drop("source")
        .withColumns(
            {
                "_epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                .otherwise(0)
                .cast("bigint"),
                "_pieces": F.ceil(F.col("_n") / F.lit(piece_rows)),
            }
        )
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    )
    keyed = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_key", -F.log(F.col("draw")) / F.col("level")
    )
    share = sum((F.col(f"_n{k}") * (1 - F.exp(-F.col("_key") * w)) for k, w in enumerate(LEVELS)), F.lit(0.0))
    piece = F.least(F.floor(share / F.col("_n") * F.col("_pieces")), F.col("_pieces") - 1)
    keyed = keyed.withColumn("_piece", piece.cast("bigint"))
    pieces = keyed.groupBy(F.col("_source").alias("_s"), F.col("_piece").alias("_p")).agg(F.sum("size").alias("_w"))
    earlier = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_s", "_p", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before"))
    inside = (
        Window.partitionBy("_source", "_piece")
        .orderBy("_key", "size", "tie", "mark")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keyed.join(pieces, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")))
    at = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # A document is taken if at least half of it lies below the line.
    extra = (at + F.col("size") / 2 <= F.col("_rest")).cast("bigint")
    out = placed.withColumn("copies", F.col("_epochs") + F.when(F.col("_rest") > 0, extra).otherwise(0))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    helpers = [c for c in out.columns if c.startswith("_") and c not in sized.columns]
    return out.drop(*helpers)


def _sized(docs: DataFrame, keep: list[Column]) -> DataFrame:
    text, doc_id = F.col("_row")["text"], F.col("_row")["doc_id"]
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    out = out.withColumn("size", document_size(text))
    return out.select(
        *keep,
        F.col("_row")["source"].alias("source"),
        "size",
        quality_level(text, F.col("size")).alias("level"),
        uniform_draw(doc_id).alias("draw"),
        doc_id.alias("tie"),
        F.xxhash64(text).alias("mark"),
    )


def mix_plan(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row."""
    space = Workspace(docs.sparkSession, "mixing")
    sized = space.table(_sized(docs.select("doc_id", "source", "text"), []), "sizes")
    out = plan_mix(sized, budget=budget)
    return out.select(F.col("tie").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def mix_documents(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    space = Workspace(docs.sparkSession, "mixing")
    sized = space.table(_sized(docs, [F.col("_row")]).withColumn("_at", F.expr("uuid()")), "rows")
    chosen = plan_mix(sized.drop("_row"), budget=budget)
    chosen = chosen.filter("copies > 0").select(F.col("_at").alias("_chosen"), "copies")
    joined = sized.select("_at", "_row").join(chosen, F.col("_at") == F.col("_chosen"))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
