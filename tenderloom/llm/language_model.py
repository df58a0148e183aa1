"""Interpolated modified Kneser-Ney bigram model: counted in Spark, memory-mapped for scoring.

1. Words are counted by 64-bit hash. Tasks combine before the shuffle and send one packed array
   per bucket of hashes; each bucket becomes a sorted hash array with counts. A word's id is its
   rank over all buckets.
2. Bigrams (ids of two neighbours, from a start to an end mark) are counted the same way. Their
   buckets are ranges of the pair: a pair's place follows from the words' counts as if they were
   independent, so a frequent first word spreads over many buckets.
3. Bigram buckets send, per first word, how many pairs occur once, twice and more, and per second
   word in how many pairs it ends; both are kept beside the word arrays.
4. Scoring maps the arrays into memory and looks up the distinct pairs of a slice of texts.

p(w | v) = (c(vw) - D(c)) / c(v) + g(v) p(w), where p(w) is the same with the number of pairs that
end in w, itself interpolated with 1 / (V + 1). Discounts come from the counts of counts.

Nothing is pruned. Arrays are files in the shared folder, written under a temporary name and
renamed, so a repeated task leaves the same files; the folder must be mounted on all machines.
The driver holds one row per bucket.

Defined results: null and empty texts are the end token alone; without training rows every known
count is 0 and the model is uniform; repeated rows are scored one by one; only doc_id and text are
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import Workspace, doc_remainder, save_array, slices, split_words

#: The end token's hash; no word contains a blank.
END = xxhash.xxh3_64_intdigest(" end")
CHARS_PER_WORD_BUCKET = 64 << 20
CHARS_PER_PAIR_BUCKET = 32 << 20
#: Entries that a task combines before it sends them.
HELD = 4 << 20
SLICE = 8 << 20
#: Added to every count of the base score.
BASE_ADD = 0.1

Batches = Iterator[pa.RecordBatch]


def combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class Held:
    """Counts of one task, combined when they grow too many."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """True when they should be sent."""
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.size += len(keys)
        if self.size > HELD:
            keys, counts = combine(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return self.size > HELD * 3 // 4

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = combine(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [], [], 0
        return out


def _small(values: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds them."""
    top = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _packed(values: np.ndarray) -> dict:
    values = _small(values)
    return {"width": values.itemsize, "data": values.tobytes()}


def _unpack(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.frombuffer(x["data"], f"<u{x['width']}").astype(np.uint64) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


PACKED = pa.struct([("width", pa.int32()), ("data", pa.binary())])
PACKED_SQL = "STRUCT<width: INT, data: BINARY>"


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, code per word, starts)."""
    words, codes, offsets = split_words(texts, lower=True)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words)), codes, offsets


def _buckets(bounds: np.ndarray, rows: list[dict], schema: pa.Schema, build: Callable[[int, slice], dict]) -> pa.RecordBatch:
    """One row for every bucket that has entries."""
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        rows.append(build(b, slice(bounds[b], bounds[b + 1])))
    return pa.RecordBatch.from_pylist(rows, schema=schema)


WORD_ROWS = pa.schema([("bucket", pa.int32()), ("keys", PACKED), ("counts", PACKED)])


def _count_words(bits: int) -> Callable[[Batches], Batches]:
    def rows(held: Held) -> pa.RecordBatch:
        keys, counts = held.take()
        edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
        return _buckets(
            edges,
            [],
            WORD_ROWS,
            lambda b, s: {"bucket": b, "keys": _packed(keys[s]), "counts": _packed(counts[s])},
        )

    def run(batches: Batches) -> Batches:
        held = Held()
        for part in slices(batches, "text", SLICE):
            hashes, codes, _ = _hashes(part.column("text"))
            held.add(np.array([END], np.uint64), np.array([part.num_rows]))
            if held.add(hashes, np.bincount(codes, minlength=len(hashes))):
                yield rows(held)
        if held.size:
            yield rows(held)

    return run


def _write_words(path: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, counts = combine(_unpack(table["keys"]), _unpack(table["counts"]).astype(np.int64))
        save_array(f"{path}/words-{bucket}.npy", keys)
        save_array(f"{path}/counts-{bucket}.npy", counts)
        save_array(f"{path}/before-{bucket}.npy", np.cumsum(counts) - counts)
        return pa.table(
            {
                "bucket": pa.array([bucket], pa.int32()),
                "size": pa.array([len(keys)], pa.int64()),
                "total": pa.array([int(counts.sum())], pa.int64()),
            }
        )

    return run


@dataclass(frozen=True)
class Layout:
    """Where the arrays are and how ids run over the word buckets."""

    path: str
    bits: int
    first: tuple[int, ...]
    mass: tuple[int, ...]
    words: int
    tokens: int
    texts: int
    pair_buckets: int


@lru_cache(maxsize=8192)
def _open(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


class Vocabulary:
    """Ids and counts of words; the start mark has the id after the last word."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.start = layout.words
        self.first = np.array(layout.first, np.int64)
        self.mass = np.array(layout.mass, np.int64)

    def _bucket_runs(self, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(len(self.first)))
        for b in range(len(self.first) - 1):
            if edges[b + 1] > edges[b] and self.first[b + 1] > self.first[b]:
                yield b, order[edges[b] : edges[b + 1]]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for b, at in self._bucket_runs((hashes >> np.uint64(64 - self.layout.bits)).astype(np.int64)):
            known = _open(f"{self.layout.path}/words-{b}.npy")
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            out[at] = np.where(known[place] == hashes[at], place + self.first[b], -1)
        return out

    def lookup(self, name: str, ids: np.ndarray, shape: tuple[int, ...] = ()) -> np.ndarray:
        """Values of an array beside the words; 0 for ids that are not words."""
        out = np.zeros((len(ids), *shape), np.int64)
        inside = np.where((ids >= 0) & (ids < self.start), ids, -1)
        bucket = np.where(inside >= 0, np.searchsorted(self.first, inside, "right") - 1, len(self.first))
        for b, at in self._bucket_runs(bucket):
            out[at] = _open(f"{self.layout.path}/{name}-{b}.npy")[inside[at] - self.first[b]]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """As first words: the start mark stands before every text."""
        return np.where(ids == self.start, self.layout.texts, self.lookup("counts", ids))

    def before(self, ids: np.ndarray) -> np.ndarray:
        """Count of all words with smaller ids."""
        at = np.clip(np.searchsorted(self.first, ids, "right") - 1, 0, len(self.mass) - 1)
        return np.where(ids == self.start, self.layout.tokens, self.lookup("before", ids) + self.mass[at])


def _texts_as_ids(texts: pa.Array, vocabulary: Vocabulary):
    """(ids per distinct word with start and end added, codes of first words, of second words, text of each pair)."""
    hashes, codes, offsets = _hashes(texts)
    ids = np.concatenate([vocabulary.ids(np.append(hashes, np.uint64(END))), [vocabulary.start]])
    end, start = len(hashes), len(hashes) + 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    first = np.full(len(owner), start, np.int64)
    second = np.full(len(owner), end, np.int64)
    edges = np.cumsum(sizes + 1)
    is_end = np.zeros(len(owner), bool)
    is_end[edges - 1] = True
    is_start = np.zeros(len(owner), bool)
    is_start[edges - sizes - 1] = True
    first[~is_start] = codes
    second[~is_end] = codes
    return ids, first, second, owner


def _pair_bucket(layout: Layout, before: np.ndarray, count: np.ndarray, before_second: np.ndarray) -> np.ndarray:
    place = before + count * (before_second / max(layout.tokens, 1))
    return np.minimum(place * layout.pair_buckets / max(layout.tokens + layout.texts, 1), layout.pair_buckets - 1).astype(
        np.int64
    )


PAIR_ROWS = pa.schema([("bucket", pa.int32()), ("first", PACKED), ("second", PACKED), ("counts", PACKED)])


def _count_pairs(layout: Layout) -> Callable[[Batches], Batches]:
    def rows(held: Held, vocabulary: Vocabulary) -> pa.RecordBatch:
        keys, counts = held.take()
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        known, back = np.unique(first, return_inverse=True)
        ends, back_ends = np.unique(second, return_inverse=True)
        bucket = _pair_bucket(
            layout, vocabulary.before(known)[back], vocabulary.counts(known)[back], vocabulary.before(ends)[back_ends]
        )
        order = np.argsort(bucket, kind="stable")
        first, second, counts, bucket = first[order], second[order], counts[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(layout.pair_buckets + 1))
        return _buckets(
            edges,
            [],
            PAIR_ROWS,
            lambda b, s: {
                "bucket": b,
                "first": _packed(first[s]),
                "second": _packed(second[s]),
                "counts": _packed(counts[s]),
            },
        )

    def run(batches: Batches) -> Batches:
        vocabulary, held = Vocabulary(layout), Held()
        for part in slices(batches, "text", SLICE):
            ids, first, second, _ = _texts_as_ids(part.column("text"), vocabulary)
            keys = ids[first].astype(np.uint64) << np.uint64(32) | ids[second].astype(np.uint64)
            if held.add(*np.unique(keys, return_counts=True)):
                yield rows(held, vocabulary)
        if held.size:
            yield rows(held, vocabulary)

    return run


#: kind 0: counts of counts of pairs; 1: per first word; 2: per second word.
SIDE_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", PACKED), ("values", PACKED)])
SIDES = f"bucket INT, kind INT, ids {PACKED_SQL}, values {PACKED_SQL}"


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def _write_pairs(layout: Layout) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys = _unpack(table["first"]) << np.uint64(32) | _unpack(table["second"])
        keys, counts = combine(keys, _unpack(table["counts"]).astype(np.int64))
        save_array(f"{layout.path}/pairs-{bucket}.npy", keys)
        save_array(f"{layout.path}/pair-counts-{bucket}.npy", _small(counts))
        rows = [{"bucket": -1, "kind": 0, "ids": _packed(np.zeros(0)), "values": _packed(_counts_of_counts(counts))}]
        edges = np.append(np.array(layout.first, np.int64), layout.words + 1)
        first = (keys >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        kinds = np.stack([np.add.reduceat((counts == 1), at), np.add.reduceat((counts == 2), at), np.add.reduceat((counts > 2), at)], 1)
        known = first[at]
        second, ends = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        for kind, ids, values in ((1, known, kinds), (2, second, ends)):
            cuts = np.searchsorted(ids, edges)
            _buckets(
                cuts,
                rows,
                SIDE_ROWS,
                lambda b, s, kind=kind, ids=ids, values=values: {
                    "bucket": b,
                    "kind": kind,
                    "ids": _packed(ids[s] - edges[b]),
                    "values": _packed(values[s].ravel()),
                },
            )
        return pa.Table.from_pylist(rows, schema=SIDE_ROWS)

    return run


STATS = pa.schema([("kind", pa.int32()), ("values", pa.list_(pa.int64()))])


def _write_sides(layout: Layout) -> Callable[[pa.Table], pa.Table]:
    """Per word bucket; the start mark's own bucket follows the last."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        rows = [(r["kind"], r["ids"], r["values"]) for r in table.select(["kind", "ids", "values"]).to_pylist()]

        def values(x: dict) -> np.ndarray:
            return np.frombuffer(x["data"], f"<u{x['width']}").astype(np.int64)

        if bucket < 0:
            total = np.sum([values(v) for _, _, v in rows], axis=0)
            return pa.Table.from_pylist([{"kind": 0, "values": total.tolist()}], schema=STATS)
        edges = [*layout.first, layout.words + 1]
        size = edges[bucket + 1] - edges[bucket]
        followed, ended = np.zeros((size, 3), np.int64), np.zeros(size, np.int64)
        for kind, ids, found in rows:
            if kind == 1:
                followed[values(ids)] += values(found).reshape(-1, 3)
            else:
                ended[values(ids)] += values(found)
        save_array(f"{layout.path}/followed-{bucket}.npy", followed.astype(np.uint32))
        save_array(f"{layout.path}/ended-{bucket}.npy", ended.astype(np.uint32))
        stats = [int(ended.sum()), *_counts_of_counts(ended).tolist()]
        return pa.Table.from_pylist([{"kind": 2, "values": stats}], schema=STATS)

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """For counts 1, 2 and more, from how many n-grams occur 1 to 4 times."""
    if not n[0]:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    layout: Layout
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    #: Distinct pairs, and how many words end 1, 2 and more of them.
    pairs: int
    ended: tuple[int, int, int]


def train(docs: DataFrame, use: Column) -> Model:
    """From the texts of ``docs`` (doc_id, text) for which ``use`` holds."""
    space = Workspace(docs.sparkSession, "language-model")
    path = space.mount("arrays")
    rows = docs.filter(use).select(F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    bits = max(3, int(size["chars"] // CHARS_PER_WORD_BUCKET).bit_length())
    counted = rows.mapInArrow(_count_words(bits), f"bucket INT, keys {PACKED_SQL}, counts {PACKED_SQL}")
    kind = "bucket INT, size BIGINT, total BIGINT"
    found = {r["bucket"]: r for r in counted.groupBy("bucket").applyInArrow(_write_words(path), kind).collect()}
    sizes = [found[b]["size"] if b in found else 0 for b in range(1 << bits)]
    totals = [found[b]["total"] if b in found else 0 for b in range(1 << bits)]
    first, mass = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(totals)])
    if first[-1] >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    layout = Layout(
        path=path,
        bits=bits,
        first=tuple(first.tolist()),
        mass=tuple(mass.tolist()),
        words=int(first[-1]),
        tokens=int(mass[-1]),
        texts=size["texts"],
        pair_buckets=max(8, int(size["chars"] // CHARS_PER_PAIR_BUCKET) + 1),
    )
    kind = f"bucket INT, first {PACKED_SQL}, second {PACKED_SQL}, counts {PACKED_SQL}"
    sides = rows.mapInArrow(_count_pairs(layout), kind).groupBy("bucket").applyInArrow(_write_pairs(layout), SIDES)
    stats = sides.groupBy("bucket").applyInArrow(_write_sides(layout), "kind INT, values ARRAY<BIGINT>").collect()
    of_pairs = [r["values"] for r in stats if r["kind"] == 0] or [[0, 0, 0, 0]]
    of_words = np.sum([r["values"] for r in stats if r["kind"] == 2], axis=0).tolist() if stats else [0] * 5
    more = layout.words - of_words[1] - of_words[2]
    return Model(
        layout=layout,
        pair_discounts=discounts(of_pairs[0]),
        word_discounts=discounts(of_words[1:]),
        pairs=of_words[0],
        ended=(of_words[1], of_words[2], more if layout.words else 0),
    )


class Scorer:
    """Log-probabilities of texts under a trained model."""

    def __init__(self, model: Model):
        self.model = model
        self.layout = model.layout
        self.vocabulary = Vocabulary(model.layout)
        self.pair = np.array([0.0, *model.pair_discounts])
        self.word = np.array([0.0, *model.word_discounts])
        spread = float(np.dot(model.ended, model.word_discounts)) / model.pairs if model.pairs else 1.0
        self.floor = spread / (self.layout.words + 1)

    def word_probability(self, ids: np.ndarray) -> np.ndarray:
        ended = self.vocabulary.lookup("ended", ids)
        return (ended - self.word[np.minimum(ended, 3)]) / max(self.model.pairs, 1) + self.floor

    def backoff(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        followed = self.vocabulary.lookup("followed", ids, (3,))
        start = ids == self.vocabulary.start
        if start.any() and self.layout.texts:
            followed[start] = _open(f"{self.layout.path}/followed-{len(self.layout.first) - 1}.npy")[0]
        return np.where(counts > 0, followed @ self.pair[1:] / np.maximum(counts, 1), 1.0)

    def pair_counts(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs in order of bucket and key."""
        out = np.zeros(len(keys), np.int64)
        edges = np.searchsorted(bucket, np.arange(self.layout.pair_buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[b], edges[b + 1])
            try:
                known = _open(f"{self.layout.path}/pairs-{b}.npy")
            except FileNotFoundError:  # no training pair lies in this range
                continue
            place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            counts = _open(f"{self.layout.path}/pair-counts-{b}.npy")[place]
            out[at] = np.where(known[place] == keys[at], counts, 0)
        return out

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        ids, first, second, owner = _texts_as_ids(texts, self.vocabulary)
        count = self.vocabulary.lookup("counts", ids)
        as_first = self.vocabulary.counts(ids)
        before = self.vocabulary.before(ids)
        low = self.word_probability(ids)
        back = self.backoff(ids, as_first)
        size = self.layout.tokens + BASE_ADD * (self.layout.words + 1)
        base = np.log10((count + BASE_ADD) / size)
        texts_n = len(texts)
        out = {
            "n_tokens": np.bincount(owner, minlength=texts_n),
            "n_known": np.bincount(owner, count[second] > 0, texts_n).astype(np.int64),
            "base_score": np.bincount(owner, base[second], texts_n),
        }
        pairs, back_to = np.unique(first << 32 | second, return_inverse=True)
        v, w = pairs >> 32, pairs & 0xFFFFFFFF
        p = back[v] * low[w]
        known = np.flatnonzero((ids[v] >= 0) & (ids[w] >= 0))
        if len(known):
            v, w = v[known], w[known]
            keys = ids[v].astype(np.uint64) << np.uint64(32) | ids[w].astype(np.uint64)
            bucket = _pair_bucket(self.layout, before[v], as_first[v], before[w])
            order = np.lexsort((keys, bucket))
            found = np.zeros(len(keys), np.int64)
            found[order] = self.pair_counts(keys[order], bucket[order])
            p[known] += (found - self.pair[np.minimum(found, 3)]) / np.maximum(as_first[v], 1)
        out["score"] = np.bincount(owner, np.log10(p)[back_to], texts_n)
        return out


def _score(model: Model) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        scorer = Scorer(model)
        for part in slices(batches, "text", SLICE):
            found = scorer.score(part.column("text"))
            names = ["n_tokens", "n_known", "base_score", "score"]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(found[c]) for c in names]], ["doc_id", *names]
            )

    return run


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probability) of every row."""
    kind = "doc_id BIGINT, n_tokens BIGINT, n_known BIGINT, base_score DOUBLE, score DOUBLE"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_score(model), kind)


def score_held_out(docs: DataFrame) -> DataFrame:
    """All rows under the model of those whose id's crc32 mod 10 is not 0."""
    held = doc_remainder(F.col("doc_id"), 10) == 0
    model = train(docs, ~held)
    out = score_texts(docs, model)
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.layout.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
