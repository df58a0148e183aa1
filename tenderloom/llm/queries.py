"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.llm import bpe
from tenderloom.llm.ann import nearest_vectors
from tenderloom.llm.common import Workspace, let, read_table, words_of
from tenderloom.llm.language_model import score_held_out
from tenderloom.llm.langid import identify
from tenderloom.llm.merkle import build_manifest, prove_documents
from tenderloom.llm.mixing import mix_plan
from tenderloom.llm.ngram_join import near_duplicates
from tenderloom.llm.quality import judge_quality
from tenderloom.llm.runs import collapse_runs
from tenderloom.llm.token_counts import count_tokens
from tenderloom.llm.token_files import read_token_files, write_token_files
from tenderloom.llm.toxicity import score_documents
from tenderloom.llm.wrappers import extract_pages


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'token-files').root}/blocks"
    write_token_files(read_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_token_files(spark, path, digest=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents"))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(read_table(spark, sf_dir, "embeddings"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(read_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def _id_hash() -> Column:
    """crc32 of the id's decimal text; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth text (by the hash of its id) becomes periodic from some word on."""
    h = _id_hash()
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.sequence(F.lit(0).cast("bigint"), n - 1)
        picked = F.transform(place, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(picked, " ")).otherwise("")

    planted = F.when(h % 10 == 0, let(words_of(F.col("text")), rewritten)).otherwise(F.col("text"))
    return docs.select("doc_id", planted.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    length, period = longest["length"], -longest["p"]
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-longest["s"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        ((1000 * length - 1000 * length % period) / period).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    without_breaks = F.translate("text", "\n", "")
    claimed = F.when(_id_hash() % 2 == 0, without_breaks).otherwise(F.col("text"))
    proved = prove_documents(build_manifest(read_table(spark, sf_dir, "documents"), claimed))
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return proved.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_main_text": op2_main_text,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_token_files": op5_token_files,
    "op6_quality_rules": op6_quality_rules,
    "op7_nearest_vectors": op7_nearest_vectors,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_language_model": op9_language_model,
    "op10_bpe": op10_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_counts": op12_token_counts,
    "op13_merkle_manifest": op13_merkle_manifest,
}
