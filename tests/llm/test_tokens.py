"""BPE and token files against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import awkward_documents, documents
from tokenizers import Tokenizer

from tenderloom.llm import bpe, token_files
from tenderloom.llm.queries import vocabulary
from tenderloom.llm.token_files import Grammar, compress, read_token_files, write_token_files

PATH = vocabulary("word_bpe_49k.json")
ODD = [
    "don't I'll they've <|endoftext|>x<|startoftext|>", "ΑΣ ΣΑΣ İstanbul ﬁ é a\u0085b c", "😀😀 123 4½ x²",
    "a\x00b 힣 ñ", "'s're's '' !!!??? ...", "日本語テキスト", "<|ENDOFTEXT|>", "​‍ ạ́", "ǅ ẞ ß", "x" * 3000,
    "aaaa aaaaaaaaa abababab", "antidisestablishmentarianism", "<|endoftext|", "\x1c\x1d\x1e\x1f",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_encoding_is_the_librarys(library):
    texts = ODD + [r[1] or "" for r in awkward_documents()]
    found = bpe.EncodedSlice(pa.array(texts), bpe.encoder(PATH))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert found.ids().to_pylist() == want
    assert [t or "" for t in found.decoded().to_pylist()] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert found.counts().tolist() == [len(i) for i in want]


def test_pieces_have_the_room_of_words(monkeypatch):
    model = bpe.Encoder(PATH, 100)
    encoded = []
    encode = model.encode_piece
    monkeypatch.setattr(model, "encode_piece", lambda piece: encoded.append(piece) or encode(piece))
    letters = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(180)]
    first = [model.encode_word(w) for w in letters]
    found = bpe.EncodedSlice(pa.array([" ".join(w.title() for w in letters), " ".join(letters)]), model)
    assert found.ids().to_pylist() == [[i for ids in first for i in ids]] * 2
    assert encoded == letters


def test_every_word_of_the_vocabulary_and_random_letters(library):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 25))) for _ in range(3000)]
    words += [name.replace("</w>", "") for name in library.get_vocab() if name.isascii()][:5000]
    model = bpe.encoder(PATH)
    for word in words:
        if word and " " not in word:
            assert model.encode_word(word) == library.encode(word, add_special_tokens=False).ids, word


def test_operators_agree(spark, library):
    docs = documents(spark)
    import hashlib

    want = sorted(
        (d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest())
        for d, i in ((r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in awkward_documents())
    )
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(docs, PATH).collect()) == want
    full = bpe.encode(docs, PATH, keep=("doc_id", "source")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in full) == [w[:2] for w in want]
    assert all(bpe.encoder(PATH).decode(r.ids) == (r.decoded or "") for r in full)


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(7)
    for ids in (
        np.zeros(0, int), np.full(1000, 3), rng.integers(0, 4, 5000), np.tile(rng.integers(0, 1000, 50), 200),
        rng.zipf(1.5, 20000) % 49408,
    ):
        rules, lengths, sequence = compress(ids, 49408)
        grammar = Grammar(49408, rules.tobytes(), lengths.tobytes(), sequence.tobytes())
        assert (grammar.read(0, len(ids)) == ids).all()
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert (grammar.read(a, b) == ids[a:b]).all()
    assert len(sequence) < len(ids)


def test_files_hold_documents_in_order(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    path = str(tmp_path / "blocks")
    write_token_files(documents(spark), path, PATH)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(awkward_documents(), key=lambda r: r[0])
    start = 0
    for r, (doc, text, *_) in zip(got, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, start, len(ids), ids)
        start += len(ids)
    digest = {r.start: r.ids_crc32 for r in read_token_files(spark, path, digest=True).collect()}
    assert digest == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
