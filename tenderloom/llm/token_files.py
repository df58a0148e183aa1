"""Token-id files compressed by Re-Pair grammars, with random access.

Texts are encoded with a tokenizer file through the tokenizers library: every distinct word of a
slice once, since no token crosses ASCII white space. Each document ends with ``END_ID``.

The file format is a Parquet dataset of blocks, documents in ascending id order. A block has
about ``BLOCK_IDS`` ids (a longer document has a block of its own) and its own grammar:

* ``rules``: pairs of 16-bit symbols; rule k stands for symbol ``first + k`` and names earlier ones,
* ``lengths``: how many ids each rule expands to (32-bit), for finding a position without expansion,
* ``sequence``: the block as 16-bit symbols,
* ``doc_ids`` and ``ends``: the documents and where each ends, in ids,
* ``part``, ``before``: the range of ids that the block lies in and the ids before it there.

Re-Pair replaces the most frequent pairs by new symbols until none is frequent. One round takes
all pairs of at least an eighth of the highest count that cannot overlap one another, so a block needs a
few dozen rounds; ranges of documents are independent tasks, and nothing passes the driver.

Defined results: null and empty texts are the end id alone; a null id sorts first; rows that share
an id are ordered by their ids' bytes; other columns are ignored; an empty table gives an empty
dataset and result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderloom.llm.bpe import CACHED_WORDS, Generations
from tenderloom.llm.common import SLICE_BYTES, Workspace, ranges, slices, split_words

END_ID = 1
BLOCK_IDS = 1 << 20
#: A pair must occur so often in its block to become a rule.
MIN_PAIRS = 16
#: Bits of the hash that bounds counts.
HASH_BITS = 18
#: Symbols are 16-bit, terminals included.
SYMBOLS = 1 << 16
#: Words of one text for the library, and words remembered at once.
WORDS_AT_ONCE = 200
KEPT_AT_ONCE = 50_000
#: Fixed value: closing punctuation that the pattern splits from letters.
PUNCTUATION = ".,;:!?"

BLOCKS = (
    "part INT, number INT, before BIGINT, size BIGINT, doc_ids ARRAY<BIGINT>, ends ARRAY<BIGINT>, "
    "first INT, rules BINARY, lengths BINARY, sequence BINARY"
)


class WordEncoder:
    """Ids of words through the library, many in one call, remembered as 16-bit values.

    A word of plain letters and closing punctuation is two pieces for any vocabulary file whose
    pattern splits letters from punctuation and whose normaliser lower-cases; its letters, in
    lower case, and its punctuation are then encoded once for all words that share them.
    """

    def __init__(self, path: str):
        # A task has one core; the library would start a thread for every core of the machine.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.size > SYMBOLS:
            raise ValueError(f"a vocabulary of {self.size} ids does not fit 16-bit symbols")
        special = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not t.normalized]
        self.mark = special[0].content if special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else -1
        self.known = Generations(CACHED_WORDS)
        self.splits = all(self._ids(w) == self._ids(w[:-2].lower()) + self._ids(w[-2:]) for w in ("Ab.,", "Éa;!", "Zß:?"))

    def _ids(self, text: str) -> list[int]:
        # This call of the library leaves out the places of tokens in the text.
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _call(self, words: list[str]) -> list[bytes]:
        """A special token between words keeps them apart; words that contain it go alone."""
        if self.mark is None or any(self.mark in w for w in words):
            return [np.array(self._ids(w), "<u2").tobytes() for w in words]
        ids = np.array(self._ids(self.mark.join(words)), np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        ends = [*((marks - np.arange(len(marks))) * 2).tolist(), 2 * (len(ids) - len(marks))]
        raw = ids[ids != self.mark_id].astype("<u2").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _encode(self, words: list[str]) -> list[bytes]:
        found = [self.known.peek(w) for w in words]
        missing = [k for k, ids in enumerate(found) if ids is None]
        for at in range(0, len(missing), WORDS_AT_ONCE):
            some = missing[at : at + WORDS_AT_ONCE]
            for k, ids in zip(some, self._call([words[k] for k in some])):
                found[k] = ids
        for at in range(0, len(words), KEPT_AT_ONCE):
            self.known.keep(words[at : at + KEPT_AT_ONCE], found[at : at + KEPT_AT_ONCE])
        return found

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        coded = words.dictionary_encode()
        found = self._encode(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        flat = np.frombuffer(b"".join(found), "<u2")
        at = coded.indices.to_numpy(zero_copy_only=False)
        return flat[ranges((np.cumsum(sizes) - sizes)[at], sizes[at])], sizes[at]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        if not self.splits or not len(words):
            return self._table(words)
        core = pc.utf8_rtrim(words, characters=PUNCTUATION)
        plain = pc.match_substring_regex(core, r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$")
        tail = pc.if_else(plain, pc.replace_substring_regex(words, rf"^.*[^{PUNCTUATION}]", ""), "")
        front_ids, front = self._table(pc.if_else(plain, pc.utf8_lower(core), words))
        tail_ids, back = self._table(tail)
        ends = np.cumsum(front + back)
        out = np.empty(int(front.sum() + back.sum()), "<u2")
        out[ranges(ends - front - back, front)] = front_ids
        out[ranges(ends - back, back)] = tail_ids
        return out, front + back


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker and file."""
    return WordEncoder(path)


def _encode(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_encoder(path)
        for part in slices(batches, "text", 2 * SLICE_BYTES):
            words, codes, offsets = split_words(part.column("text"))
            table, sizes = model.words(words)
            starts = np.cumsum(sizes) - sizes
            ids = table[ranges(starts[codes], sizes[codes])]
            ends = np.concatenate([[0], np.cumsum(sizes[codes])])[offsets]
            last = np.array([end_id], "<u2").tobytes()
            out = [ids[a:b].tobytes() + last for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return run


def _choose(keys: np.ndarray, counts: np.ndarray, room: int) -> list[int]:
    """Frequent pairs, most frequent first, of which no two can overlap in the sequence."""
    order = np.lexsort((keys, -counts))
    order = order[counts[order] * 8 >= counts[order[0]]]
    lefts: set[int] = set()
    rights: set[int] = set()
    chosen = []
    for key in keys[order].tolist():
        a, b = key >> 16, key & 0xFFFF
        if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        chosen.append(key)
        if len(chosen) == room:
            break
    return chosen


def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as pairs, lengths, sequence) of a block whose ids are all below ``first``."""
    sequence = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules = 0
    lengths = np.ones(SYMBOLS, np.int64)
    while len(sequence) > 1 and first + n_rules < SYMBOLS:
        pairs = sequence[:-1] << np.uint32(16) | sequence[1:]
        # Counts of hashes bound the counts of pairs; only pairs that may be frequent are counted.
        mark = (pairs * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)
        bound = np.bincount(mark, minlength=1 << HASH_BITS)
        least = max(MIN_PAIRS, int(bound.max()) // 8)
        ordered = np.sort(pairs[(bound >= least)[mark]])
        at = np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))
        counts = np.diff(at, append=len(ordered))
        often = counts >= least
        if not often.any():
            if least == MIN_PAIRS:
                break
            often = counts >= min(max(int(counts.max(initial=0)), MIN_PAIRS), least)
            if not often.any():
                ordered = np.sort(pairs)
                at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                counts = np.diff(at, append=len(ordered))
                often = counts >= MIN_PAIRS
                if not often.any():
                    break
        chosen = _choose(ordered[at[often]], counts[often], SYMBOLS - first - n_rules)
        is_left, is_right = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool)
        # Pairs of a round name symbols of earlier rounds only.
        order = np.argsort(np.array(chosen, np.uint32))
        named = np.array(chosen, np.uint32)
        a, b = named >> np.uint32(16), named & np.uint32(0xFFFF)
        new = first + n_rules + np.arange(len(named))
        lengths[new] = lengths[a] + lengths[b]
        is_left[a] = is_right[b] = True
        rules.append(np.stack([a, b], axis=1))
        n_rules += len(named)
        named, symbol = named[order], new[order].astype(np.uint32)
        hit = np.flatnonzero(is_left[sequence[:-1]] & is_right[sequence[1:]])
        place = np.minimum(np.searchsorted(named, pairs[hit]), len(named) - 1)
        real = named[place] == pairs[hit]
        hit, place = hit[real], place[real]
        # Only pairs of one symbol overlap themselves: take every other one of a run.
        run = np.concatenate([[0], np.flatnonzero(np.diff(hit) != 1) + 1])
        inside = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
        take = inside % 2 == 0
        hit, place = hit[take], place[take]
        sequence[hit] = symbol[place]
        keep = np.ones(len(sequence), bool)
        keep[hit + 1] = False
        sequence = sequence[keep]
    pairs = np.concatenate([np.zeros((0, 2), np.uint32), *rules]).astype("<u2")
    return pairs, lengths[first : first + n_rules].astype("<u4"), sequence.astype("<u2")


class Grammar:
    """A block's rules, for expanding it or any part of it."""

    def __init__(self, first: int, rules: bytes, lengths: bytes, sequence: bytes):
        self.sequence = np.frombuffer(sequence, "<u2").astype(np.int64)
        own = np.frombuffer(lengths, "<u4").astype(np.int64)
        self.length = np.concatenate([np.ones(first, np.int64), own])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.zeros(int(self.length.sum()), np.uint32)
        self.flat[:first] = np.arange(first)
        for k, (a, b) in enumerate(np.frombuffer(rules, "<u2").reshape(-1, 2).tolist(), first):
            at, middle = self.start[k], self.start[k] + self.length[a]
            self.flat[at:middle] = self.flat[self.start[a] : self.start[a] + self.length[a]]
            self.flat[middle : at + self.length[k]] = self.flat[self.start[b] : self.start[b] + self.length[b]]
        self.ends = np.cumsum(self.length[self.sequence])

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block; only the symbols that cover them are expanded."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        low = int(np.searchsorted(self.ends, start, "right"))
        high = int(np.searchsorted(self.ends, stop, "left")) + 1
        symbols = self.sequence[low:high]
        ids = self.flat[ranges(self.start[symbols], self.length[symbols])]
        skip = start - int(self.ends[low] - self.length[self.sequence[low]])
        return ids[skip : skip + stop - start]


def _blocks(first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, before, size = 0, 0, 0
        docs: list[int | None] = []
        texts: list[bytes] = []

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<u2")
            rules, lengths, sequence = compress(ids, first)
            row = {
                "part": part,
                "number": number,
                "before": before,
                "size": len(ids),
                "doc_ids": docs,
                "ends": np.cumsum([len(t) // 2 for t in texts]).tolist(),
                "first": first,
                "rules": rules.tobytes(),
                "lengths": lengths.tobytes(),
                "sequence": sequence.tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                raw = ids.as_py()
                if texts and size + len(raw) // 2 > BLOCK_IDS:
                    yield block()
                    number, before, size = number + 1, before + size, 0
                    docs, texts = [], []
                docs.append(doc)
                texts.append(raw)
                size += len(raw) // 2
        if texts:
            yield block()

    return run


BLOCK_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("number", pa.int32()),
        ("before", pa.int64()),
        ("size", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("first", pa.int32()),
        ("rules", pa.binary()),
        ("lengths", pa.binary()),
        ("sequence", pa.binary()),
    ]
)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the dataset at ``path``."""
    spark = docs.sparkSession
    space = Workspace(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Written first, because choosing the ranges reads the ids' column and must not encode twice.
    encoded = f"{space.root}/encoded"
    coded = rows.mapInArrow(_encode(vocabulary, end_id), "doc_id BIGINT, ids BINARY")
    coded.write.option("compression", "zstd").parquet(encoded)
    coded = spark.read.schema(coded.schema).parquet(encoded)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True)
    ordered = coded.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(_blocks(first), BLOCKS).write.parquet(path)


def _decode(digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                grammar = Grammar(row["first"], row["rules"], row["lengths"], row["sequence"])
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                ids = grammar.read(0, row["size"]).astype("<u4")
                if digest:
                    out = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                    value = pa.array(out, pa.int64())
                else:
                    edges = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    value = pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["base"]),
                        pa.array(ends - starts),
                        value,
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or ids_crc32) of every document, in order of the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("size").alias("total"))
    # One row per range of documents, as many as the writer had partitions.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(parts), "part").withColumn("base", F.col("base") + F.col("before"))
    value = "ids_crc32 BIGINT" if digest else "ids ARRAY<INT>"
    placed = placed.select("doc_ids", "ends", "size", "first", "rules", "lengths", "sequence", "base")
    return placed.mapInArrow(_decode(digest), f"doc_id BIGINT, start BIGINT, n_tokens BIGINT, {value}")
