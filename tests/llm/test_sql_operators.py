"""Operators that SQL expresses, on awkward rows."""

import pytest
from llm.helpers import DOCUMENTS, EXTRA, documents, prose, save, spark_rows, sql_rows
from pyspark.sql import functions as F

from tenderloom.llm.mixing import mix_documents, mix_plan, plan_mix
from tenderloom.llm.ngram_join import keep_one_of_each
from tenderloom.llm.oracle import ORACLE
from tenderloom.llm.quality import filter_quality, judge_quality
from tenderloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_awkward_rows_agree_with_sql(spark, tmp_path, name):
    save(documents(spark).dropDuplicates(["doc_id"]), tmp_path, "documents")
    assert spark_rows(QUERIES[name](spark, str(tmp_path))) == sql_rows(tmp_path, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_main_text", "op7_nearest_vectors"}))
def test_empty_tables(spark, tmp_path, name):
    save(documents(spark, []), tmp_path, "documents")
    save(spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT"), tmp_path, "labels")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_filters_keep_columns_of_any_name(spark):
    docs = documents(spark, extra=True)
    for keep in (filter_quality, mix_documents, keep_one_of_each):
        out = keep(docs)
        assert out.columns == docs.columns
        assert all(r[name] == 7 for r in out.collect() for name in EXTRA)


def test_quality_facts(spark):
    rows = [(1, "a b c a b c\nq\nq\n \n \n#x", "en", "s", 0), (2, None, "en", None, 0)]
    got = {r.doc_id: r for r in judge_quality(documents(spark, rows)).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words) == (9, 10, 1, 1, 6)
    assert got[2].base_failed and not got[2].kept


def test_a_host_of_failures_goes_with_its_good_documents(spark):
    good = [(k, prose(k, 100), "en", f"h{k % 5}", None) for k in range(100)]
    bad = [(1000 + k, "short", "en", "spam", None) for k in range(200)] + [(2000, prose(9, 100), "en", "spam", None)]
    kept = {r.doc_id for r in filter_quality(documents(spark, good + bad)).collect()}
    assert kept == set(range(100))


def test_mix_reaches_targets_and_repeats_documents(spark):
    rows = [(k, prose(k, 20 + k % 30), "en", None if k % 7 == 0 else f"s{k % 4}", None) for k in range(900)]
    docs = documents(spark, rows)
    plan = mix_plan(docs).collect()
    total = sum(r.size for r in plan)
    by = {}
    for r in plan:
        assert 0 <= r.taken <= 2 * r.size
        key = (r.target, r.source_size)
        by[key] = by.get(key, 0) + r.taken
    assert sum(t for t, _ in by) == pytest.approx(1.5 * total)
    assert all(abs(taken - target) <= 50 and target <= 2 * size for (target, size), taken in by.items())
    copies = {r.doc_id: r.copies for r in plan}
    mixed = {r.doc_id: r["count"] for r in mix_documents(docs).groupBy("doc_id").count().collect()}
    assert mixed == {k: c for k, c in copies.items() if c}


def test_pieces_do_not_change_the_mix(spark):
    rows = [(k, "s", 10 + k % 9, 1.0 if k % 3 else 0.5, (k + 0.5) / 500, k, 0) for k in range(500)]
    sized = spark.createDataFrame(rows, "id INT, source STRING, size BIGINT, level DOUBLE, draw DOUBLE, tie BIGINT, mark BIGINT")
    few, many = (plan_mix(sized, piece_rows=n, budget=0.4).orderBy("id").collect() for n in (1000, 7))
    assert few == many


def test_one_of_each_group_stays(spark):
    kept = sorted(r.doc_id for r in keep_one_of_each(documents(spark)).collect() if r.doc_id < 100)
    assert kept == [0, 3, 4, 5, 6, 8, 9, 10, 11, 13]


def test_rows_without_id_stay(spark):
    rows = [(None, prose(1, 50), "en", "s", None), (None, prose(1, 50), "en", "s", None), (1, prose(1, 50), "en", "s", None)]
    assert keep_one_of_each(spark.createDataFrame(rows, DOCUMENTS)).count() == 3
    assert keep_one_of_each(spark.createDataFrame(rows, DOCUMENTS).filter(F.lit(False))).count() == 0
