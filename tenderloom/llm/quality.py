"""Quality rules with a verdict per host.

Base rules look at one text. Their failures are summed per host, each host's failure rate is
shrunk towards the rate of all hosts by an empirical beta prior, and documents of a host whose
shrunk rate exceeds ``max_rate`` are rejected with it. All of it is DataFrame work: facts of a
text are array expressions in its own row, the only shuffle moves a few numbers per document,
and sums per host combine before it, so a host with a third of the rows is no hot spot.

Defined results: a null or empty text has no words and fails the base rules; a null host takes
part in the prior with none of its own documents and is never rejected as a host; repeated rows
count one by one; extra columns, whatever their names, are kept by ``filter_quality``; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import SPACE, Workspace, let, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes when more than this share of its documents fails, after shrinking.
MAX_HOST_RATE = 0.5
#: Fixed value: the characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"

FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostPrior:
    """Beta(alpha, beta) of the hosts' failure rates."""

    alpha: float
    beta: float


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Windows are sorted with their positions; equal neighbours are repeats. Their positions in
    order then give the covered words: each start covers three, less where the next one begins.
    """

    def of_sorted(windows: Column) -> Column:
        repeated = F.filter(
            windows,
            lambda x, k: x["w"].eqNullSafe(F.get(windows, k - 1)["w"]) | x["w"].eqNullSafe(F.get(windows, k + 1)["w"]),
        )
        return let(F.sort_array(F.transform(repeated, lambda x: x["at"])), of_starts)

    def of_starts(starts: Column) -> Column:
        cover = F.transform(starts, lambda x, k: F.least(F.coalesce(F.get(starts, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(cover, F.lit(0).cast("bigint"), lambda a, x: a + x)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("at")
        ),
    )
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(F.sort_array(windows), of_sorted))


def with_facts(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the base facts of ``text`` and ``base_failed`` as columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_words": words_of(F.col(text)), "_lines": lines}).withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": (F.size(F.split(whole, SYMBOLS)) - 1).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": _repeat_words(F.col("_words")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_lines")


def host_counts(facts: DataFrame, host: str) -> DataFrame:
    return (
        facts.filter(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    )


def fit_prior(hosts: DataFrame) -> HostPrior | None:
    """Method of moments over hosts weighted by their documents; None without any.

    The variance between hosts is what the observed one exceeds binomial noise by.
    """
    row = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n").alias("n"),
        F.sum("failed").alias("failed"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"),
    ).first()
    if not row["hosts"]:
        return None
    mean = (row["failed"] + 0.5) / (row["n"] + 1.0)
    noise = mean * (1 - mean)
    spread = (row["squares"] - 2 * mean * row["failed"] + mean * mean * row["n"] - noise * row["hosts"]) / row["n"]
    strength = min(max(noise / max(spread, 1e-9) - 1, 2.0), 1e6)
    return HostPrior(mean * strength, (1 - mean) * strength)


def rejected_hosts(facts: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame | None:
    """Column ``host``: those whose shrunk failure rate exceeds ``max_rate``."""
    hosts = host_counts(facts, host)
    prior = fit_prior(hosts)
    if prior is None:
        return None
    rate = (F.col("failed") + prior.alpha) / (F.col("n") + prior.alpha + prior.beta)
    return hosts.filter(rate > max_rate).select("host")


def _judged(facts: DataFrame, host: str, max_rate: float) -> DataFrame:
    bad = rejected_hosts(facts, host, max_rate)
    if bad is None:
        return facts.withColumn("kept", ~F.col("base_failed"))
    bad = bad.select(F.col("host").alias("_bad_host"))
    return (
        facts.join(bad, F.col(host) == F.col("_bad_host"), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("_bad_host").isNull())
        .drop("_bad_host")
    )


def judge_quality(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, the facts, base_failed and kept of every row."""
    space = Workspace(docs.sparkSession, "quality")
    facts = with_facts(docs.select("doc_id", F.col("source").alias("_host"), F.col("text").alias("_text")), "_text")
    facts = space.table(facts.drop("_text"), "facts")
    return _judged(facts, "_host", max_rate).select("doc_id", *FACTS, "base_failed", "kept")


def filter_quality(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The kept rows with the columns of ``docs``.

    Rows travel as one struct beside their facts, so names cannot clash; the written table is
    read twice, once for the facts alone.
    """
    space = Workspace(docs.sparkSession, "quality")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    rows = rows.withColumns({"_host": F.col("_row")["source"], "_text": F.col("_row")["text"]})
    facts = space.table(with_facts(rows, "_text").select("_row", "_host", "base_failed"), "facts")
    return _judged(facts, "_host", max_rate).filter("kept").select("_row.*")
