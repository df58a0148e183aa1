"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is parsed
greedily into the longest pieces that occur in the sample; the fewer pieces it takes, the closer
the text. Phrases times log2 of the sample's length, over the text's length, is the cross-parsing
estimate of entropy in bits a letter; the lowest wins, ties to the smaller language name.

Texts are lower-cased letters with single separators. The 61 commonest letters of the samples are
one symbol each; any other letter of a sample is an escape symbol and three digits of its code point,
so every letter of every script keeps its own code (letters that no sample has share one symbol) and automata fit dense tables of 64 columns. A phrase may
end inside such a code. All blocks of a slice advance together, one symbol a step, so a step is one
array lookup for every block and language. Blocks only spread the work: each is parsed again from
the state in which the block before it ended, until no state changes, which gives the greedy parse
of the whole text.

The sample per language has at most ``SAMPLE_CHARS`` characters, in pieces from anywhere in
at most ``SAMPLE_DOCS`` documents, the first by a hash of the id, and is all that reaches the driver.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any
learned language every text is ``und``; repeated rows are scored one by one; only doc_id, text
and, for learning, lang are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.llm.bpe import SuffixAutomaton
from tenderloom.llm.common import Workspace, doc_remainder, slices

SAMPLE_DOCS = 200
SAMPLE_CHARS = 40_000
BLOCK = 2048
#: Shortest piece of a document in the sample, where it has so much text.
SAMPLE_PIECE = 400
#: Rounds in which blocks pass on their states; texts still unsettled then are parsed in one go.
ROUNDS = 4
#: Symbols: 0 separates words, 1 to LETTERS are frequent letters and digits, ESCAPE begins another letter
#: of a sample, UNSEEN is a letter of none.
LETTERS = 61
ESCAPE = 62
UNSEEN = 63
DIGITS = 3
WIDTH = 64
MISS = 1 << 30
UNKNOWN = "und"


@dataclass(frozen=True)
class Samples:
    """Labelled text per language."""

    texts: tuple[tuple[str, str], ...]


def learn(docs: DataFrame, use: Column) -> Samples:
    """Samples from the rows of ``docs`` (doc_id, text, lang) for which ``use`` holds."""
    rows = docs.select("doc_id", "text", "lang", use.alias("_use")).filter(
        F.col("_use") & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    first = rows.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE_DOCS)
    first = first.withColumn("_docs", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    # At most SAMPLE_DOCS rows a language.
    chosen = rows.join(F.broadcast(first.select("doc_id", "lang", "_docs").distinct()), ["doc_id", "lang"])
    size = F.greatest(F.ceil(SAMPLE_CHARS / F.col("_docs")), F.lit(SAMPLE_PIECE)).cast("int")
    room = F.greatest(F.length("text") - size + 1, F.lit(1))
    start = (1 + F.pmod(F.xxhash64("doc_id", F.lit("piece")), room)).cast("int")
    found = chosen.select("lang", F.substr("text", start, size).alias("text"), F.xxhash64("doc_id").alias("h"))
    texts: dict[str, list[str]] = {}
    for row in sorted(found.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        have = texts.setdefault(row["lang"], [])
        if sum(map(len, have)) < SAMPLE_CHARS:
            have.append(row["text"])
    return Samples(tuple((lang, "\n".join(have)[:SAMPLE_CHARS]) for lang, have in sorted(texts.items())))


class Parser:
    """Tables of all languages for parsing many texts at once."""

    def __init__(self, samples: Samples):
        self.names = [lang for lang, _ in samples.texts]
        counts = Counter(c for _, text in samples.texts for c in text.lower() if c.isalpha())
        common = sorted(counts, key=lambda c: (-counts[c], c))
        letters = {c: min(k, ESCAPE) for k, c in enumerate(common, 1)}
        self.symbols = np.zeros(0x110000, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.symbols[code] = letters.get(c.lower(), UNSEEN)
                self.lower[code] = ord(c.lower()[0])
        tables, self.roots, self.weights = [], [], []
        size = 0
        for _, text in samples.texts:
            coded = self._code(text)
            automaton = SuffixAutomaton()
            automaton.add([int(s) for s in coded])
            table = np.full((len(automaton.next), WIDTH), -1, np.int64)
            for state, edges in enumerate(automaton.next):
                for symbol, to in edges.items():
                    table[state, symbol] = to
            start = np.where(table[0] < 0, 0, table[0])
            tables.append(np.where(table < 0, (start + size) | MISS, table + size).astype(np.int32))
            self.roots.append(size)
            self.weights.append(math.log2(max(len(coded), 2)))
            size += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def _expand(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, which characters are letters, where each character's symbols end)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        short = self.symbols[points]
        rare = short == ESCAPE
        ends = np.cumsum(np.where(rare, 1 + DIGITS, 1))
        symbols = short
        if rare.any():
            symbols = np.repeat(short, np.where(rare, 1 + DIGITS, 1))
            rest = self.lower[points[rare]]
            for digit in range(1, 1 + DIGITS):
                symbols[ends[rare] - digit] = 1 + rest % LETTERS
                rest = rest // LETTERS
        return symbols, short != 0, ends

    @staticmethod
    def _single(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places of symbols, without separators that follow another or begin a text."""
        before = np.concatenate([[0], symbols[:-1]])
        before[starts[starts < len(symbols)]] = 0
        return np.flatnonzero((symbols != 0) | (before != 0))

    def _code(self, text: str) -> np.ndarray:
        symbols = self._expand(text)[0]
        return symbols[self._single(symbols, np.zeros(1, np.int64))]

    def phrases(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases per language and text, symbols per text, letters per text)."""
        texts = pc.fill_null(texts, "")
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        raw, is_letter, ends = self._expand("".join(texts.to_pylist()))
        stops = np.cumsum(lengths)
        letters = np.concatenate([[0], np.cumsum(is_letter)])
        letters = letters[stops] - letters[stops - lengths]
        stops = np.concatenate([[0], ends])[stops]
        at = self._single(raw, np.concatenate([[0], stops[:-1]])) if len(raw) else np.zeros(0, np.int64)
        coded = raw[at]
        stops = np.searchsorted(at, stops)
        sizes = np.diff(stops, prepend=0)
        found = np.zeros((len(self.names), len(sizes)), np.int64)
        if len(coded) and self.names:
            owner, missed = self._parse(coded, stops, sizes)
            for k in range(len(self.names)):
                found[k] = np.bincount(owner, missed[k], len(sizes)).astype(np.int64) + (sizes > 0)
        return found, sizes, letters

    def _parse(self, coded: np.ndarray, stops: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text of each block, phrases that end inside it per language) of the greedy parse of whole texts."""
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = (stops - sizes)[owner] + number * BLOCK
        length = np.minimum(BLOCK, stops[owner] - starts)
        entry = np.repeat(np.array(self.roots, np.int64)[:, None], len(starts), 1)
        missed, left = self._walk(coded, starts, length, entry)
        later = np.flatnonzero(number)
        for _ in range(ROUNDS):
            later = later[(left[:, later - 1] != entry[:, later]).any(axis=0)]
            if not len(later):
                return owner, missed
            entry[:, later] = left[:, later - 1]
            missed[:, later], left[:, later] = self._walk(coded, starts[later], length[later], entry[:, later])
            # The block after one that was parsed again may have another state to begin with.
            later = later + 1
            later = later[later < len(number)]
            later = later[number[later] > 0]
        later = later[(left[:, later - 1] != entry[:, later]).any(axis=0)]
        if len(later):
            texts, at = np.unique(owner[later], return_index=True)
            begin = later[at]
            size = stops[texts] - starts[begin]
            whole, _ = self._walk(coded, starts[begin], size, left[:, begin - 1])
            number_of = np.full(len(sizes), np.iinfo(np.int64).max)
            number_of[texts] = number[begin]
            missed[:, number >= number_of[owner]] = 0
            missed[:, begin] = whole
        return owner, missed

    def _walk(
        self, coded: np.ndarray, starts: np.ndarray, length: np.ndarray, state: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end inside each block, state after it) per language, from the states before."""
        order = np.argsort(-length, kind="stable")
        starts, length, state = starts[order], length[order], state[:, order]
        missed = np.zeros(state.shape, np.int64)
        stop = 0
        # Blocks by falling length: all that reach a step come first.
        for n in range(len(length), 0, -1):
            if n < len(length) and length[n - 1] == length[n]:
                continue
            for t in range(stop, int(length[n - 1])):
                now = self.table.take(state[:, :n] * WIDTH + coded[starts[:n] + t])
                missed[:, :n] += now >> 30
                state[:, :n] = now & (MISS - 1)
            stop = int(length[n - 1])
        back = np.argsort(order, kind="stable")
        return missed[:, back], state[:, back]

    def predict(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(language, posterior under equal priors) of each text."""
        if not self.names:
            return pa.array([UNKNOWN] * len(texts)), np.zeros(len(texts))
        found, _, letters = self.phrases(texts)
        bits = found * np.array(self.weights)[:, None]
        best = bits.argmin(axis=0)
        lead = bits - bits.min(axis=0)
        score = np.where(letters > 0, 1 / np.exp2(-np.minimum(lead, 1000)).sum(axis=0), 0.0)
        names = pa.array(self.names).take(pa.array(best))
        return pc.if_else(pa.array(letters > 0), names, UNKNOWN), score


@lru_cache(maxsize=2)
def parser(samples: Samples) -> Parser:
    """One per worker."""
    return Parser(samples)


def _predict(samples: Samples) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(samples)
        for part in slices(batches, "text"):
            lang, score = model.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), lang, pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, samples: Samples) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    Workspace.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_predict(samples), "doc_id BIGINT, lang_pred STRING, score DOUBLE")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose id's crc32 mod 4 is 2 are never learned from."""
    held = doc_remainder(F.col("doc_id"), 4) == 2
    out = predict(docs, learn(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
