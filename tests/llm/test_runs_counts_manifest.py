"""Periodic runs, token counts and the Merkle manifest against brute force, the library and SQL."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from llm.helpers import awkward_documents, documents, prose, save, spark_rows, sql_rows
from pyspark.sql import functions as F

from tenderloom.llm import merkle, runs, token_counts
from tenderloom.llm.oracle import ORACLE
from tenderloom.llm.queries import op11_periodic_runs, op12_token_counts, op13_merkle_manifest, vocabulary

# -- runs ---------------------------------------------------------------------


def runs_by_hand(words, exponent=4, shortest=6):
    """Every maximal stretch, period by period; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= exponent * q:
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items() if n >= shortest)


def found_runs(texts, exponent=4, shortest=6):
    codes = np.array([c for t in texts for c in t], np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = [[] for _ in texts]
    r = runs.find_runs(codes, offsets, exponent, shortest)
    for t, *row in zip(r.text.tolist(), r.start.tolist(), r.length.tolist(), r.period.tolist(), strict=True):
        got[t].append(tuple(row))
    return got


@pytest.mark.parametrize("exponent, shortest", [(2, 2), (3, 5), (4, 6)])
def test_runs_equal_brute_force(exponent, shortest):
    rng = random.Random(exponent)
    for _ in range(150):
        texts = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(50))] for _ in range(5)]
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        texts.append(unit * rng.randrange(1, 9) + texts[0][:3])
        want = [sorted(runs_by_hand(t, exponent, shortest), key=lambda r: (r[0], r[2])) for t in texts]
        assert found_runs(texts, exponent, shortest) == want


def test_one_long_stretch_and_a_long_period():
    assert found_runs([[5] * 30_000]) == [[(0, 30_000, 1)]]
    unit = list(range(700))
    assert found_runs([[9, 9, *unit * 6, 3]]) == [[(2, 4200, 700)]]
    assert found_runs([]) == [] and found_runs([[], [1]]) == [[], []]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op11_by_hand(doc_id, text):
    words = (text or "").replace("\x0b", " ").replace("\x0c", " ").translate({9: " ", 10: " ", 13: " "}).split(" ")
    words = [w for w in words if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(runs_by_hand(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": best and best[0], "length": best and best[1],
        "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": digest("".join(f"{s},{m},{q}\n" for s, m, q in found)),
        "collapsed_sha256": digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def extra_documents():
    loop = "go on and on " * 9
    return [*awkward_documents(), (None, prose(7, 40), None, None, None), (None, loop, "en", "s1", 1),
            *[(k, f"{prose(k, 5)} " + " ".join(["x y z"] * (k % 7)), "en", "s9", k) for k in range(200, 260)]]


def test_query_of_runs(spark, tmp_path):
    rows = extra_documents()
    save(documents(spark, rows, extra=True), tmp_path, "documents")
    want = [op11_by_hand(r[0], r[1]) for r in rows]
    got = spark_rows(op11_periodic_runs(spark, str(tmp_path)))
    assert got == sorted([tuple(w[k] for k in sorted(w)) for w in want], key=repr)
    assert sum(w["n_runs"] for w in want) > 20
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in rows)


def test_operator_of_runs_keeps_columns(spark):
    docs = documents(spark, [(1, "a a a a a a b", "en", "s", 1), (2, None, None, None, None)], extra=True)
    got = {r["doc_id"]: r for r in runs.collapse_runs(docs, keep=("doc_id", "key", "a.b")).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 6, 1)] and got[1]["collapsed"] == "a b"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[2]["a.b"] == 7
    assert runs.collapse_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(docs, exponent=1)


# -- token counts -------------------------------------------------------------

MODEL = vocabulary("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a\nb", "<s> x </s><unk>", "a\u2581b", "\u2581", "\ufb01 A\u030a e\u0301",
    "a\x00b", "\x00", "\u3000x", "a\u00a0b", "<0x0A>", "x\r\ny\r\n", "\t\tif x:\n    return  1\n\n\n", "日本語 テキスト",
    "😀😀 😀", "a" * 3000, " " * 100, "    \n     x", "x  \n  \n", None,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_are_the_librarys(library):
    rng = random.Random(5)
    letters = list("ab  \n\t\r\u2581é.\x00the")
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(1500)]
    with open(MODEL, "rb") as file:
        lookup = token_counts.Pieces(file.read())
    assert lookup.separable
    tokens = [b" the", b" a", b"\n", b" ", b"  ", b"\na", b" " + b"a" * 15, b" a\x00", " é".encode()]
    for known in ([], tokens):
        table = token_counts.Table.build(known, lookup.lengths(known))
        got = token_counts.count_slice(pa.array(texts), lookup, table).tolist()
        assert got == [len(library.encode(t or "")) for t in texts]


def test_cache_stays_within_its_bytes(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 4000)
    with open(MODEL, "rb") as file:
        lookup = token_counts.Pieces(file.read())
    tokens = [f" w{k}".encode() for k in range(300)]
    for _ in range(3):
        assert lookup.lengths(tokens).tolist() == [len(library.encode(t.decode()[1:])) for t in tokens]
        assert len(lookup.young) + len(lookup.old) <= 4000 // token_counts.ENTRY_BYTES


def test_table_finds_keys_exactly():
    rng = random.Random(2)
    tokens = sorted({bytes(rng.randrange(3) for _ in range(rng.randrange(1, 17))) for _ in range(2000)})
    known, other = tokens[::2], tokens[1::2]
    table = token_counts.Table.build(known, np.arange(len(known)) % 200)

    def keys(items):
        low = np.array([int.from_bytes(t[:8], "little") for t in items], np.uint64)
        high = np.array([int.from_bytes(t[8:], "little") for t in items], np.uint64)
        return low, high, np.array([len(t) for t in items])

    assert table.find(*keys(known)).tolist() == [k % 200 for k in range(len(known))]
    assert (table.find(*keys(other)) == -1).all()


def test_query_of_token_counts(spark, tmp_path, library):
    rows = [*extra_documents(), *[(500 + k, t, None, None, None) for k, t in enumerate(ODD)], (600, prose(3, 9000), "", "", 1)]
    save(documents(spark, rows, extra=True), tmp_path, "documents")
    want = []
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert spark_rows(op12_token_counts(spark, str(tmp_path))) == sorted(want, key=repr)
    assert any(w[3] for w in want)
    empty = documents(spark).limit(0)
    assert token_counts.count_tokens(empty, MODEL).count() == 0


# -- manifest -----------------------------------------------------------------


def test_missing_nodes_are_the_fewest():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 60)
        known = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        width = merkle.widths(n)
        asked = merkle.missing_nodes(np.array(known), width)
        # By hand: a node is needed if its parent lies on a known path and nothing known lies below it.
        want = []
        for level, size in enumerate(width[:-1]):
            above = {k // 3 ** (level + 1) for k in known}
            below = {k // 3**level for k in known}
            want += [(level, p) for p in range(size) if p // 3 in above and p not in below]
        assert asked == want


def root_by_hand(rows):
    def code(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def up(level):
        while len(level) > 1:
            level = [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        return level[0]

    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = digest("".join(code(v) for v in (doc_id, source, lang, n_chars, text)))
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    return up([up([leaf[2] for leaf in sorted(trees[s])]) for s in names])


def many_documents():
    rows = [(k, f"text {k}\nline" if k % 3 else None, None if k % 5 else "en", f"s{k % 7 if k % 2 else 0}", k) for k in range(300)]
    return [*rows, *extra_documents(), (None, "x\ny", "en", "", 0), (None, "x\ny", "en", "", 0), (4, "é\n", "x", "ß", -5)]


def test_query_of_the_manifest_equals_sql(spark, tmp_path):
    rows = many_documents()
    save(documents(spark, rows, extra=True), tmp_path, "documents")
    got = op13_merkle_manifest(spark, str(tmp_path))
    assert spark_rows(got) == sql_rows(tmp_path, ORACLE["op13_merkle_manifest"])
    assert {r["root"] for r in got.select("root").collect()} == {root_by_hand(rows)}
    assert {r["verified"] for r in got.select("verified").collect()} == {True, False}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_small_leaf_partitions_give_the_same_proofs(spark, levels):
    rows = many_documents()
    docs = documents(spark, rows)
    built = merkle.build_manifest(docs, levels=levels)
    assert built.root == root_by_hand(rows)
    proved = merkle.prove_documents(built)
    whole = merkle.prove_documents(merkle.build_manifest(docs))
    assert spark_rows(proved) == spark_rows(whole)
    assert proved.filter("verified").count() == len(rows)


def test_one_document_one_source_and_none(spark):
    one = [(1, "a", "en", "s", 1)]
    got = merkle.prove_documents(merkle.build_manifest(documents(spark, one))).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got] == [(root_by_hand(one),) * 3 + ([],)]
    same = [(k, "a", "en", None, 1) for k in range(10)]
    got = merkle.prove_documents(merkle.build_manifest(documents(spark, same), levels=1)).collect()
    assert {r["root"] for r in got} == {root_by_hand(same)} and all(r["verified"] for r in got)
    empty = merkle.build_manifest(documents(spark).limit(0))
    assert empty.root is None and merkle.prove_documents(empty).count() == 0


def test_a_changed_text_does_not_verify(spark):
    docs = documents(spark, [(k, f"t{k}", "en", f"s{k % 2}", k) for k in range(40)])
    claimed = F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text"))
    got = merkle.prove_documents(merkle.build_manifest(docs, claimed, levels=2))
    assert [r["doc_id"] for r in got.filter("not verified").collect()] == [7]
