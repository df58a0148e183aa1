"""Signature trees, components and vector graphs against brute force."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from llm.helpers import WORDS, documents, prose
from pyspark.sql import functions as F

from tenderloom.llm import ngram_join
from tenderloom.llm.ann import Graph, nearest_vectors
from tenderloom.llm.common import Workspace
from tenderloom.llm.components import connected_components
from tenderloom.llm.ngram_join import SignatureTree, bitmap, near_duplicates, shingle_sets, traverse


def find_roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 140)] + [(200, 200 + k) for k in range(1, 60)]
    edges += [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(70)]
    found = connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a BIGINT, b BIGINT"))
    found = {r.node: r.component for r in found.collect()}
    want = find_roots({n for e in edges for n in e}, edges)
    assert {n: found.get(n, n) for n in want} == want


def edited(words, share, rng):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def family_documents():
    """Families of near copies around the threshold, chains, and texts that share a passage."""
    rng = random.Random(3)
    texts = []
    passage = prose(99, 60)
    for family in range(6):
        base = prose(family, rng.randrange(40, 300)).split()
        for k in range(12):
            base = edited(base, 0.01 * (k % 3), rng) if family % 2 else base
            texts.append(" ".join(edited(base, 0.01 * (k % 4), rng)))
    texts += [f"{prose(500 + k, 90)} {passage}" for k in range(25)] + ["", "a b", "a b", "a b c d"]
    return [(k, t, "en", "s", None) for k, t in enumerate(texts)]


@pytest.mark.parametrize("block", [2000, 5])
def test_join_loses_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = family_documents()
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()) for d, w in ((r[0], r[1].split()) for r in rows)}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = find_roots(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, rows)).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}


def test_traversal_keeps_every_pair_that_can_link():
    texts = pa.array([r[1] for r in family_documents()])
    sets = [s for s in shingle_sets(texts) if len(s)]
    bits = np.frombuffer(b"".join(map(bitmap, sets)), np.uint64).reshape(len(sets), -1)
    tree = SignatureTree(np.array([len(s) for s in sets]), np.arange(len(sets)), bits)
    i, j = traverse(tree, tree, 85)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                assert (b, a) in found
    assert len(found) < len(sets) * (len(sets) - 1) // 4


def test_equal_ids_are_one_node(spark):
    rows = [(1, prose(1, 40), "en", "s", 0), (5, prose(1, 40), "en", "s", 0), (5, prose(2, 40), "en", "s", 0), (7, prose(2, 40), "en", "s", 0)]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(documents(spark, rows)).collect())
    assert got == [(1, 1), (5, 1), (5, 1), (7, 1)]


def test_repeated_rows_stay_in_their_groups(spark):
    """Groups of hashes that differ only in a row that occurs twice, and a table of which every row does."""
    rng = random.Random(11)
    rows = []
    for family in range(200):
        base = prose(7000 + family, 300).split()
        other = list(base)
        for at in rng.sample(range(290), 4):
            other[at] = f"changed{at}"
        for k, words in ((0, base), (1, other), (1, other), (3, [*base[:-1], "last"])):
            rows.append((10 * family + k, " ".join(words), "en", "s", 0))
    sets = {r[0]: set(zip(*(r[1].split()[k:] for k in range(4)))) for r in rows}
    links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and 100 * len(x & y) >= 85 * len(x | y)]
    assert len(links) >= 400
    want = find_roots(sets, links)
    for table in (rows, rows * 2):
        got = sorted((r.doc_id, r.component_id) for r in near_duplicates(documents(spark, table)).collect())
        assert got == sorted((r[0], want[r[0]]) for r in table)


def test_passages_rare_in_a_batch_are_common():
    """A passage that one text of each batch has; equal texts, which do not meet, count once."""
    passage = prose(99, 40)
    batches = []
    for k in range(12):
        texts = [f"{prose(9000 + k, 50)} {passage}", prose(9500, 50), prose(9500, 50)]
        batches.append(pa.RecordBatch.from_arrays([pa.array([3 * k, 3 * k + 1, 3 * k + 2]), pa.array(texts)], ["doc_id", "text"]))
    rows = pa.Table.from_batches(ngram_join._facts(4)(iter(batches)))
    named = rows.filter(pa.compute.equal(rows["texts"], 0))
    found = dict(zip(*(pa.compute.list_flatten(named[c]).to_pylist() for c in ("hashes", "counts"))))
    assert rows.num_rows == 36 + named.num_rows
    assert {found.get(int(h)) for h in shingle_sets(pa.array([passage]))[0].view(np.int64)} == {12}
    assert not any(int(h) in found for h in shingle_sets(pa.array([prose(9500, 50)]))[0].view(np.int64))


def test_only_sizes_that_permit_a_link_meet_in_trees(spark, monkeypatch):
    """At 85 % 17 and 20 can link, 16 and 20 cannot; groups of one block are not written with their bitmaps."""
    rows = [(1, 10, 17, 10), (1, 11, 20, 11), (2, 10, 17, 10), (2, 12, 400, 12), (3, 13, 50, 13), (3, 14, 51, 13)]
    named = spark.createDataFrame(rows, "key BIGINT, doc BIGINT, n BIGINT, component BIGINT")
    assert sorted((r.key, r.doc) for r in ngram_join._open(named, 85).collect()) == [(1, 10), (1, 11)]
    twins = spark.createDataFrame([(1, 1, 30, 1), (1, 2, 30, 2), (1, 3, 31, 3)], named.schema)
    assert sorted(r.doc for r in ngram_join._open(twins, 100).collect()) == [1, 2]
    written = []
    table = Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, name: (written.append((name, df.columns)), table(self, df, name))[1])
    near_duplicates(documents(spark, family_documents())).collect()
    assert [n for n, columns in written if {"bits", "members"} & set(columns)] == ["leaders"]


def brute_force(ids, vectors, query, k):
    score = vectors @ vectors[query]
    order = [i for i in np.lexsort((ids, -score)) if i != query]
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


def test_vector_search_recall_and_edge_rows(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)
    vectors[100:200] = vectors[100]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    bad = [(4000, None), (4020, []), (4040, [0.0] * 24), (4060, [None] + [1.0] * 23), (4080, [float("nan")] + [1.0] * 23)]
    bad += [(4100, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (20, vectors[20].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id BIGINT, embedding ARRAY<FLOAT>").withColumn("shard", F.lit(1))
    got = {}
    for r in nearest_vectors(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    wide, ids = vectors.astype(np.float64), np.arange(3000)
    hits = 0
    for q, found in got.items():
        want = brute_force(ids, wide, q, 20)
        assert len(found) == 20 and q not in [v for v, _ in found]
        assert all(s == pytest.approx(float(wide[v] @ wide[q]), abs=1e-12) for v, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in found} & {v for v, _ in want})
    assert hits / (20 * len(got)) >= 0.9
    assert [v for v, _ in got[100][:20]] == [v for v, _ in brute_force(ids, wide, 100, 20)]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (3, [1.0, 2.0, 3.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert [tuple(r) for r in nearest_vectors(few).collect()] == [(0, 1, 1, 0.5)]
    assert nearest_vectors(few.filter("vec_id > 5")).count() == 0


def test_graph_levels_shrink():
    rng = np.random.default_rng(2)
    graph = Graph.build(rng.normal(size=(2000, 8)).astype(np.float32), rng.random(2000))
    assert [len(level.nodes) for level in graph.levels][0] == 2000 and len(graph.levels) > 1
