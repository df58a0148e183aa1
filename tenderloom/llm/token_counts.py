"""Token counts by a two-tier lookup in the map task; pre-tokens are never shuffled.

A pre-token is a line feed or a run of spaces with what follows up to the next of either. No piece
of the vocabulary reaches across such a border (checked when the model is loaded), so a text has as
many tokens as its pre-tokens have together.

* Tier one: the lengths of the most frequent pre-tokens, in an open-addressing table of fixed size
  that is broadcast. Its keys are the pre-tokens themselves, of at most 16 bytes, held as two
  integers: a hit is exact. A slice of texts is looked up at once, without making its words.
* Tier two: other pre-tokens are made distinct per slice and looked up in a cache of the worker,
  bounded in bytes, and only what it lacks goes to the tokenizer.

Which pre-tokens tier one holds changes the time and never a result. They come from a bounded random
sample of the rows: every task keeps a sketch of frequent items, and only sketches meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import Workspace, ranges, slices

#: Fixed value: the character that stands for a space in pieces.
MARK = "\u2581"

#: Bytes of text of one slice; a longer text is a slice of its own.
SLICE = 4 << 20

#: Bytes of pre-tokens in a worker's cache, and what an entry takes besides its letters.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 120

#: Longest key of tier one.
KEY_BYTES = 16

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Pieces:
    """Lengths of pre-tokens by the library, remembered within a byte limit.

    Two generations of equal size: what is still used moves to the younger one, and the older one
    is dropped when the younger is full.
    """

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.bytes = 0
        size = self.library.get_piece_size()
        inner = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_byte(i))]
        names = [self.library.id_to_piece(i) for i in inner if not self.library.is_unknown(i)]
        # What a line feed in front adds: the mark that begins every text, and its own byte.
        self.front = "\n"
        self.extra = len(self.library.encode(self.front))
        self.separable = (
            any(self.library.is_byte(i) for i in range(size))
            and not any("\n" in n or " " in n or MARK in n.lstrip(MARK) for n in names)
            and self.library.encode("\n", out_type=str) == [MARK, "<0x0A>"]
            and self.library.encode("a  b ", out_type=str)[-1] == MARK
            and self.library.normalize("\ufb01 A\u030a\u3000\n ") == f"{MARK}\ufb01{MARK}A\u030a\u3000\n{MARK}"
        )

    def whole(self, texts: list[str]) -> list[int]:
        """Lengths of whole texts."""
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]

    def lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Lengths of distinct pre-tokens."""
        found = np.empty(len(tokens), np.int64)
        lost = []
        young, old = self.young, self.old
        for k, token in enumerate(tokens):
            n = young.get(token)
            if n is None:
                n = old.pop(token, None)
                if n is None:
                    lost.append(k)
                    continue
                self._keep(token, n)
                young, old = self.young, self.old
            found[k] = n
        if lost:
            texts = [self.front + tokens[k].decode() for k in lost]
            for k, n in zip(lost, self.whole(texts), strict=True):
                found[k] = n - self.extra
                self._keep(tokens[k], n - self.extra)
        return found

    def _keep(self, token: bytes, n: int) -> None:
        if len(token) + ENTRY_BYTES > CACHE_BYTES // 8:
            return
        self.bytes += len(token) + ENTRY_BYTES
        if self.bytes > CACHE_BYTES // 2:
            self.old, self.young, self.bytes = self.young, {}, len(token) + ENTRY_BYTES
        self.young[token] = n


_PIECES: dict[bytes, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The worker's library and cache of one model; another model replaces them."""
    key = hashlib.sha256(model).digest()
    if key not in _PIECES:
        _PIECES.clear()
        _PIECES[key] = Pieces(model)
    return _PIECES[key]


@dataclass(frozen=True)
class Table:
    """Open addressing over keys of one or two integers; ``size`` 0 marks a free slot."""

    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    value: np.ndarray
    probes: int

    @staticmethod
    def build(tokens: list[bytes], lengths: np.ndarray) -> Table:
        bits = max(4, (2 * len(tokens)).bit_length())
        table = Table(*(np.zeros(1 << bits, t) for t in (np.uint64, np.uint64, np.uint8, np.uint8)), 1)
        probes = 1
        for token, n in zip(tokens, lengths, strict=True):
            low, high = (np.uint64(int.from_bytes(part, "little")) for part in (token[:8], token[8:]))
            at = int(_slots(np.array([low]), np.array([high]), bits)[0])
            tried = 1
            while table.size[at]:
                at, tried = (at + 1) & ((1 << bits) - 1), tried + 1
            table.low[at], table.high[at], table.size[at], table.value[at] = low, high, len(token), n
            probes = max(probes, tried)
        return Table(table.low, table.high, table.size, table.value, probes)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.low, self.high, self.size, self.value))

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        found = np.full(len(low), -1, np.int64)
        bits = len(self.size).bit_length() - 1
        slot = _slots(low, high, bits)
        open_ = np.arange(len(low))
        for _ in range(self.probes):
            at = slot[open_]
            there = self.size[at]
            hit = (there == size[open_]) & (self.low[at] == low[open_]) & (self.high[at] == high[open_])
            found[open_[hit]] = self.value[at[hit]]
            open_ = open_[~hit & (there > 0)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.size) - 1)
        return found


def _slots(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    mixed = (low * _ODD[0]) ^ (high * _ODD[1])
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[2]
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def pre_tokens(text: Column) -> Column:
    """Pre-tokens of a text, the space that begins every text included."""
    return F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit("(?: +|\n)[^ \n]*"), F.lit(0))


def frequent_pre_tokens(docs: DataFrame, most: int, sample_rows: int) -> list[bytes]:
    """The commonest short pre-tokens of about ``sample_rows`` rows drawn at random."""
    rows = docs.count()
    drawn = docs.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed=7)
    tokens = drawn.select(F.explode(pre_tokens(F.col("text"))).alias("t")).filter(F.octet_length("t") <= KEY_BYTES)
    top = tokens.agg(F.expr(f"approx_top_k(t, {most}, {4 * most})").alias("top")).first()["top"]
    return sorted(item["item"].encode() for item in top or [])


def count_slice(texts: pa.Array, lookup: Pieces, table: Table) -> np.ndarray:
    """Tokens of every text of a slice; nulls are empty."""
    texts = pc.fill_null(texts, "")
    total = np.zeros(len(texts), np.int64)
    filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    alone = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False) | (not lookup.separable)
    # A text that holds the mark itself has borders of its own.
    for k in np.flatnonzero(alone & filled):
        total[k] = lookup.whole([texts[int(k)].as_py()])[0]
    rows = np.flatnonzero(filled & ~alone)
    if not len(rows):
        return total
    spaced = pc.binary_join_element_wise(pa.scalar(""), texts.take(pa.array(rows)), " ").cast(pa.large_binary())
    ends = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(rows) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    padded = np.zeros(len(data) + KEY_BYTES, np.uint8)
    padded[: len(data)] = data
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins |= data == 0x0A
    begins[ends[:-1]] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(data)))
    # Every eight bytes as an integer, at any place.
    window = np.ndarray((len(data) + 9,), np.dtype("<u8"), padded, strides=(1,))
    low = window[starts] & _MASKS[np.minimum(sizes, 8)]
    high = window[starts + 8] & _MASKS[np.clip(sizes - 8, 0, 8)]
    found = np.full(len(starts), -1, np.int64)
    short = np.flatnonzero(sizes <= KEY_BYTES)
    found[short] = table.find(low[short], high[short], sizes[short])
    missing = np.flatnonzero(found < 0)
    if len(missing):
        limits = np.concatenate([[0], np.cumsum(sizes[missing])])
        bytes_ = data[ranges(starts[missing], sizes[missing])]
        rare = pa.Array.from_buffers(pa.large_binary(), len(missing), [None, pa.py_buffer(limits), pa.py_buffer(bytes_)])
        coded = rare.dictionary_encode()
        lengths = lookup.lengths(coded.dictionary.to_pylist())
        found[missing] = lengths[coded.indices.to_numpy(zero_copy_only=False)]
    sums = np.concatenate([[0], np.cumsum(found)])
    first = np.searchsorted(starts, ends)
    total[rows] = sums[first[1:]] - sums[first[:-1]]
    return total


def count_tokens(
    docs: DataFrame, path: str, limit: int = 4096, frequent: int = 16_384, sample_rows: int = 4_096
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (doc_id, text).

    ``path`` is a model file of the sentencepiece library. Texts count whole, without begin or end
    tokens. A null text is empty: no bytes, no tokens. A null doc_id is kept, repeated rows stay
    repeated, further columns are left out, an empty table gives no rows. ``frequent`` and
    ``sample_rows`` bound tier one (at most 600 kB at the default) and do not change results.
    A model whose pieces reach across spaces is applied to whole texts.
    """
    Workspace.ship(docs.sparkSession)
    with open(path, "rb") as file:
        model = file.read()
    lookup = Pieces(model)
    tokens = frequent_pre_tokens(docs, frequent, sample_rows) if lookup.separable else []
    lengths = lookup.lengths(tokens)
    fits = lengths < 256
    table = Table.build([t for t, ok in zip(tokens, fits, strict=True) if ok], lengths[fits])
    sent = docs.sparkSession.sparkContext.broadcast((model, table))
    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _counter(sent, limit), "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT, over_limit BOOLEAN"
    )
    return counted


def _counter(sent, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = sent.value
        lookup = pieces(model)
        for part in slices(batches, "text", SLICE):
            texts = part.column("text")
            n_tokens = count_slice(texts, lookup, table)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run
