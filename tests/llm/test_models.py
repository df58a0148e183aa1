"""Language id, language model and toxicity against brute force and held-out labels."""

import collections
import math
import pickle
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import DOCUMENTS, documents, prose

from tenderloom.llm import langid
from tenderloom.llm.langid import Parser, Samples, identify
from tenderloom.llm.language_model import discounts, score_held_out
from tenderloom.llm.queries import QUERIES
from tenderloom.llm.toxicity import INDEX, BlockMaxIndex, Model, Terms, _pairs, keep_clean, score_documents

DATA = "/root/testdata/sf0.001"


def phrases(text, sample):
    count, piece = 0, ""
    for c in text:
        if piece + c in sample:
            piece += c
        else:
            count += 1
            piece = c if c in sample else ""
    return count + 1


def test_cross_parsing_is_the_greedy_parse():
    samples = Samples((("a", prose(1, 200)), ("b", prose(2, 200)[::-1])))
    texts = [prose(3, 50), "zzz", "river stone", prose(4, 30)[::-1], "a"]
    found, sizes, letters = Parser(samples).phrases(pa.array(texts))
    plain = [re.sub(r"[^a-z]+", " ", t) for t in texts]
    for k, (_, sample) in enumerate(samples.texts):
        assert found[k].tolist() == [phrases(t, sample) for t in plain]
    assert sizes.tolist() == [len(t) for t in plain] and letters.tolist() == [sum(c.isalpha() for c in t) for t in plain]


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_blocks_do_not_end_phrases(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    samples = Samples((("a", prose(1, 200)), ("b", "a" * 50 + " b")))
    texts = ["", prose(3, 400), "a" * 3001, "q", prose(1, 300), " - ", "a b" * 40]
    found, _, _ = Parser(samples).phrases(pa.array(texts))
    plain = [re.sub(r"[^a-z]+", " ", t).lstrip() for t in texts]
    for k, (_, sample) in enumerate(samples.texts):
        assert found[k].tolist() == [phrases(t, sample) if t else 0 for t in plain]


def test_results_do_not_depend_on_neighbours():
    parser = Parser(Samples((("a", prose(1, 200)), ("b", prose(2, 200)))))
    texts = [" river", "stone ", " window x", "river", "", "  "]
    together = parser.phrases(pa.array(texts))[0]
    assert together.T.tolist() == [parser.phrases(pa.array([t]))[0][:, 0].tolist() for t in texts]


def test_every_script_has_its_own_letters(spark):
    """Eight languages of invented words, among them scripts of thousands of letters."""
    alphabets = {
        "la": (0x61, 26), "el": (0x3B1, 24), "ru": (0x430, 32), "ar": (0x628, 30),
        "he": (0x5D0, 27), "ja": (0x3041, 80), "ko": (0xAC00, 2000), "zh": (0x4E00, 3000),
    }
    rows = []
    for n, (lang, (start, size)) in enumerate(alphabets.items()):
        rng = random.Random(n)
        words = ["".join(chr(start + rng.randrange(size)) for _ in range(rng.randint(1, 6))) for _ in range(400)]
        rows += [(1000 * n + k, " ".join(rng.choices(words, k=40)), lang, None, None) for k in range(100)]
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in identify(documents(spark, rows)).collect() if r.held_out]
    right = collections.Counter(truth[r.doc_id] for r in held if r.lang_pred == truth[r.doc_id])
    assert right == collections.Counter(truth[r.doc_id] for r in held)


def test_languages_of_awkward_and_labelled_texts(spark):
    got = {r.doc_id: r for r in identify(documents(spark)).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (3, 4, 5))
    assert got[100].lang_pred == "en" and 0 <= got[100].score <= 1
    nothing = identify(documents(spark, [(1, "text", None, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in QUERIES["op4_language_id"](spark, DATA).collect() if r.held_out]
    assert held and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def brute_force_scores(texts):
    """(base, score) per id by the formulas, over plain dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {d: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(lower)) if w] for d, t in texts}
    used = [d for d in words if zlib.crc32(str(d).encode()) % 10]
    single, pairs = collections.Counter(), collections.Counter()
    for d in used:
        line = [*words[d], "<end>"]
        single.update(line)
        pairs.update(zip(["<start>", *words[d]], line))
    n, v = sum(single.values()), len(single)
    context = single + collections.Counter({"<start>": len(used)})
    ended = collections.Counter(w for _, w in pairs)

    def of(counter):
        return (0.0, *discounts([sum(c == k for c in counter.values()) for k in (1, 2, 3, 4)]))

    d2, d1 = of(pairs), of(ended)
    floor = sum(d1[min(c, 3)] for c in ended.values()) / len(pairs) / (v + 1) if pairs else 1 / (v + 1)
    rest = collections.Counter()
    for (a, _), c in pairs.items():
        rest[a] += d2[min(c, 3)]

    def p(a, w):
        low = (ended[w] - d1[min(ended[w], 3)]) / max(len(pairs), 1) + floor
        return low if not context[a] else (pairs[a, w] - d2[min(pairs[a, w], 3)] + rest[a] * low) / context[a]

    out = {}
    for d, line in words.items():
        tokens = [*line, "<end>"]
        base = sum(math.log10((single[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = sum(math.log10(p(a, w)) for a, w in zip(["<start>", *line], tokens))
        out[d] = (len(tokens), sum(single[w] > 0 for w in tokens), n, base, score)
    total = sum(p("river", w) for w in single) + rest["river"] / context["river"] * floor if context["river"] else 1
    assert total == pytest.approx(1)
    return out


def test_language_model_is_the_formula(spark):
    docs = documents(spark).dropDuplicates(["doc_id"])
    want = brute_force_scores([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = score_held_out(docs).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        tokens, known, n, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_language_model_without_training_rows(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    (row,) = score_held_out(documents(spark, [(held, "a b", "en", "s", None)])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        terms = np.sort(rng.choice(60, rng.integers(0, 8), replace=False))
        weights = rng.random(len(terms))
        vectors.append((terms, weights / max(np.linalg.norm(weights), 1e-9)))
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = BlockMaxIndex(vectors, 60)
    for q in range(0, 700, 7):
        found, score = index.nearest(*vectors[q], 10)
        every = dense @ dense[q]
        want = np.lexsort((np.arange(700), -every.round(12)))[:10]
        want = want[every[want] > 0]
        assert score == pytest.approx(every[want])
        assert set(np.flatnonzero(every > score.min() + 1e-9) if len(score) else []) <= set(found.tolist())


def test_index_and_terms_take_little_memory():
    rng = np.random.default_rng(5)
    parts = [(np.sort(rng.choice(50_000, 200, replace=False)).astype(np.int32), rng.random(200)) for _ in range(2000)]
    texts = pa.array([" ".join(f"w{t}" for t in terms) for terms, _ in parts])
    tracemalloc.start()
    index = BlockMaxIndex(parts, 50_000)
    kept, most = tracemalloc.get_traced_memory()
    assert most < 70 * 400_000, "bytes while it is built"
    tracemalloc.reset_peak()
    _, text, _, count = _pairs(texts)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(text) == count.sum() == 400_000 and peak - kept < 45 * 400_000
    assert len(pickle.dumps(index)) < 40 * 400_000
    assert index.nearest(*parts[7], 1)[0].tolist() == [7]


def test_workers_map_the_model_and_hold_no_copy(tmp_path):
    rng = np.random.default_rng(6)
    parts = [(np.sort(rng.choice(900, 50, replace=False)), rng.random(50)) for _ in range(300)]
    terms = Terms(pa.array([f"t{k}" for k in range(900)]), rng.random(900), 1.5)
    made = Model(terms, np.arange(300) * 3, np.arange(300) % 2, BlockMaxIndex(parts, 900), np.array([0.1, 2.0, -1.0]), 0.25)
    made.write(str(tmp_path / "model.arrow"))
    before = pa.total_allocated_bytes()
    model = Model.read(str(tmp_path / "model.arrow"))
    assert pa.total_allocated_bytes() - before < 10_000
    assert all(not getattr(model.index, name).flags.owndata for name in INDEX) and not model.ids.flags.owndata
    assert model.terms.names.equals(terms.names) and (model.terms.other, model.base) == (1.5, 0.25)
    for terms_of, weights in parts[:20]:
        want, got = made.index.nearest(terms_of, weights, 5), model.index.nearest(terms_of, weights, 5)
        assert all(np.array_equal(x, y) for x, y in zip(want, got))
        assert made.probability(made.votes(*want)) == model.probability(model.votes(*got))
    none = Model(Terms(pa.array([], pa.string()), np.zeros(0)), np.zeros(0), np.zeros(0), BlockMaxIndex([], 0), base=0.5)
    none.write(str(tmp_path / "none.arrow"))
    none = Model.read(str(tmp_path / "none.arrow"))
    assert none.coefficients is None and none.probability(np.zeros(3)) == 0.5 and len(none.terms.names) == 0


def toxic_tables(spark):
    docs, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = prose(k, 120) + (" you scoundrel. what a rotten, Villain" if toxic else "")
        docs.append((k, text, "en", "s", None))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    docs += [(1000, None, "en", "s", None), (1001, "", "en", "s", None), (None, "scoundrel villain", "en", "s", None)]
    labels += [(None, 1, 1), (1000, 1, None), (0, 1, 1)]
    return spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")


def test_toxic_texts_are_caught_and_clean_ones_stay(spark):
    docs, labels = toxic_tables(spark)
    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert all(got[k].predicted == (k % 4 == 0) for k in range(400))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score < 0.5
    assert all(e.toxic == 1 for e in got[0].evidence) and got[0].evidence
    kept = keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k in range(400) if k % 4} | {1000, 1001, None}


def test_a_text_without_marked_terms_finds_its_copy(spark):
    docs, labels = toxic_tables(spark)
    odd, plain = (next(k for k in range(low, low + 999) if zlib.crc32(str(k).encode()) % 5) for low in (2000, 3000))
    more = [(odd, prose(8001, 60), "en", "s", None), (plain, prose(8002, 60), "en", "s", None)]
    more += [(odd + 5000, prose(8001, 60), "en", "s", None), (plain + 5000, prose(8002, 60), "en", "s", None)]
    docs = docs.union(spark.createDataFrame(more, DOCUMENTS))
    labels = labels.union(spark.createDataFrame([(odd, 1, 1), (plain, 1, 0)], labels.schema))
    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    for k, kind in ((odd, 1), (plain, 0)):
        nearest = got[k + 5000].evidence[0]
        assert (nearest.doc_id, nearest.toxic) == (k, kind) and nearest.similarity == pytest.approx(1)
    assert all(len(got[k].evidence) == 3 for k in range(400))


def test_few_labels_still_find_neighbours(spark):
    got = QUERIES["op1_toxicity"](spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.evidence for r in got if len(re.findall("[a-z]+", (texts[r.doc_id] or "").lower())) > 5)
    assert len({r.score for r in got}) > 10


def test_labels_of_one_kind(spark):
    docs, labels = toxic_tables(spark)
    assert {r.score for r in score_documents(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in score_documents(docs, labels.limit(0)).collect()} == {0.0}
