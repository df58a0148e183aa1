"""Toxicity by nearest labelled examples.

Terms are words, lower-cased and without punctuation at their ends. A text's TF-IDF vector holds all
terms of the examples, with document frequencies over all texts. None is left out: terms that speak
for the toxic label (by chi-square over all labelled texts, equal texts once) weigh more, and no term
weighs less than its TF-IDF. Terms of no example cannot add to a product; they count in a text's
length, with the root mean square of their inverse document frequencies.
Examples are a bounded sample of labelled texts. A text's nearest examples by exact cosine come
from an inverted index in blocks: the largest weight of each term in each block bounds the score
of its examples, those of largest bound are scored, then all whose bound can reach the k-th found.
Votes weighted by similarity, toxic and clean, are turned into a probability by logistic
calibration on the examples themselves, each left out of its own search. Vectors live in the tasks
that score them and are not written.

Bound of the model, which does not limit the texts that are scored: ``MAX_EXAMPLES`` examples a
label, first by a hash of the id. Statistics of labels cover all labelled texts.

Defined results: null and empty texts have no terms and get the score of no similarity; without
labels of both kinds every score is the share of toxic labels, or 0 without any; labels with a
null id or value are ignored, repeated ones count once, toxic if any is; repeated rows are scored
one by one; other columns are kept by ``keep_clean``; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.llm.common import SLICE_BYTES, Workspace, begin, doc_remainder, frees, ranges, slices, split_words

MAX_EXAMPLES = 4000
#: A term weighs more by what the root of its chi-square exceeds this.
CHANCE = 2.0
NEIGHBOURS = 16
EXAMPLES_PER_BLOCK = 64
#: Blocks scored first, by falling bound; their scores decide which others are needed.
FIRST_BLOCKS = 16
#: Ids of labelled texts sent to every task; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Fixed value: characters trimmed from the ends of a word.
PUNCTUATION = ".,;:!?\"'()[]{}|<>*#-…"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, a code per word, where each text's words start); code -1 for no term."""
    words, codes, offsets = split_words(texts)
    terms = pc.utf8_trim(pc.utf8_lower(words), characters=PUNCTUATION).dictionary_encode()
    of_word = terms.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    blank = pc.index(terms.dictionary, pa.scalar("", pa.string())).as_py()
    if blank >= 0:
        of_word = np.where(of_word == blank, -1, of_word)
    return terms.dictionary, of_word[codes] if len(codes) else codes, offsets


def _pairs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, text, term, occurrences) of each term in each text."""
    terms, codes, offsets = terms_of(texts)
    # Sorted in place: a slice has millions of words, and every worker holds one.
    pairs = np.repeat(np.arange(len(texts), dtype=np.int64) << 32, np.diff(offsets))
    pairs |= codes
    pairs = pairs[codes >= 0]
    del codes
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    count = np.diff(first, append=len(pairs))
    pairs = pairs[first]
    return terms, pairs >> 32, pairs & 0xFFFFFFFF, count


@frees
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each term: how many texts have it, how many labelled and how many toxic ones."""
    begin("toxicity")
    for part in slices(batches, "text"):
        terms, text, term, _ = _pairs(part.column("text"))
        toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64)
        every = np.bincount(term, minlength=len(terms))
        known, bad = (np.bincount(term, x[text], len(terms)).astype(np.int64) for x in (toxic >= 0, toxic == 1))
        yield pa.RecordBatch.from_arrays([terms, *map(pa.array, (every, known, bad))], ["term", "texts", "known", "bad"])


@frees
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each example and how often it has them."""
    begin("toxicity")
    for part in slices(batches, "text"):
        names, text, term, count = _pairs(part.column("text"))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=part.num_rows))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (names.take(pa.array(term)), pa.array(count.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "terms", "counts"])


def _own_terms(known: pa.Array, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The counts of known terms; of all others one row a batch: their texts and squared inverse frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.is_in(batch.column("term"), known)
            kept = batch.filter(own)
            texts = batch.column("texts").filter(pc.invert(own)).to_numpy(zero_copy_only=False)
            squares = float((((np.log((1 + rows) / (1 + texts)) + 1) ** 2) * texts).sum())
            last = [None, int(texts.sum()), 0, 0]
            columns = [pa.concat_arrays([c, pa.array([x], c.type)]) for c, x in zip(kept.columns, last)]
            columns.append(pa.array([0.0] * kept.num_rows + [squares]))
            yield pa.RecordBatch.from_arrays(columns, ["term", "texts", "known", "bad", "squares"])

    return run


@dataclass(frozen=True)
class Terms:
    """The examples' terms with their factors: inverse document frequency times weight for the label."""

    names: pa.Array
    factor: np.ndarray
    #: The factor of all terms that no example has.
    other: float = 1.0

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each text's terms start, terms, weights); lengths count all terms of a text."""
        names, text, term, count = _pairs(texts)
        at = pc.fill_null(pc.index_in(names, self.names), -1).to_numpy(zero_copy_only=False)[term].astype(np.int64)
        keep = at >= 0
        weight = 1 + np.log(count)
        weight *= np.where(keep, self.factor[at], self.other) if len(self.factor) else self.other
        length = np.sqrt(np.bincount(text, weight * weight, len(texts)))
        weight = (weight / length[text])[keep]
        ends = np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(texts)))])
        return ends, at[keep], weight


@dataclass(frozen=True)
class Vectors:
    """The vectors of the examples, one after the other."""

    ends: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Vectors:
        ends = np.cumsum([0, *(len(t) for t, _ in parts)])
        terms, weights = (np.concatenate([p[k] for p in parts] or [np.zeros(0)]) for k in (0, 1))
        return cls(ends, terms.astype(np.int32), weights)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ends[at], self.ends[at + 1])
        return self.terms[own], self.weights[own]


class BlockMaxIndex:
    """Postings by term and block of examples, with each block's largest weight per term.

    Cells are the pairs of term and block that have postings; a term's cells lie together.
    """

    def __init__(self, vectors: Vectors | list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        if isinstance(vectors, list):
            vectors = Vectors.of(vectors)
        self.count = len(vectors)
        self.blocks = -(-max(self.count, 1) // EXAMPLES_PER_BLOCK)
        owner = np.repeat(np.arange(self.count, dtype=np.int32), np.diff(vectors.ends))
        # Stable: a term's postings stay in order of the examples.
        order = np.argsort(vectors.terms, kind="stable")
        self.owner, self.weight = owner[order], vectors.weights[order]
        del owner
        cell = vectors.terms[order] * np.int64(self.blocks)
        del order
        cell += self.owner // EXAMPLES_PER_BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.start = np.append(first, len(cell)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        cell = cell[first]
        self.block = (cell % self.blocks).astype(np.int32)
        self.cells = np.searchsorted(cell, np.arange(n_terms + 1) * self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, nearest first, ties to the earlier one."""
        size = self.cells[terms + 1] - self.cells[terms]
        cell = ranges(self.cells[terms], size)
        weight, block = np.repeat(weights, size), self.block[cell]
        bound = np.bincount(block, weight * self.most[cell], self.blocks)
        order = np.argsort(-bound, kind="stable")
        chosen = np.zeros(self.blocks, bool)
        chosen[order[:FIRST_BLOCKS]] = True
        now = chosen[block]
        score = self._scores(cell[now], weight[now])
        found = np.flatnonzero(score)
        least = np.partition(score[found], -k)[-k] if len(found) >= k else 0.0
        # Of the other blocks only those that can still reach the k-th; sums may differ in their last digits.
        rest = ~chosen & (bound > 0) & (bound >= least - 1e-9)
        if rest.any():
            now = rest[block]
            score += self._scores(cell[now], weight[now])
            found = np.flatnonzero(score)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        best = found[np.lexsort((found, -score[found]))[:k]]
        return best, score[best]

    def _scores(self, cell: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of the examples in the blocks of some cells, 0 for all others."""
        size = self.start[cell + 1] - self.start[cell]
        posting = ranges(self.start[cell], size)
        return np.bincount(self.owner[posting], self.weight[posting] * np.repeat(weight, size), self.count)


#: The arrays of an index, in the order in which they are written.
INDEX = ("owner", "weight", "start", "most", "block", "cells")


@dataclass
class Model:
    """Terms, examples and calibration. Tasks map a file of it and build and copy nothing."""

    terms: Terms
    ids: np.ndarray
    toxic: np.ndarray
    index: BlockMaxIndex
    coefficients: np.ndarray | None = None
    base: float = 0.0

    def votes(self, found: np.ndarray, score: np.ndarray) -> np.ndarray:
        """1 and the roots of the summed similarities of toxic and of clean neighbours."""
        toxic = self.toxic[found] == 1 if len(found) else np.zeros(0, bool)
        return np.array([1.0, np.sqrt(score[toxic].sum()), np.sqrt(score[~toxic].sum())])

    def probability(self, votes: np.ndarray) -> float:
        if self.coefficients is None:
            return self.base
        return float(1 / (1 + np.exp(-np.clip(votes @ self.coefficients, -50, 50))))

    def write(self, path: str) -> None:
        """One Arrow file: a row with a list for each array."""
        numbers = [np.array([self.terms.other, self.base]), self.coefficients, self.terms.factor, self.ids, self.toxic]
        columns = [self.terms.names, *[None if x is None else pa.array(x) for x in (*numbers, *(getattr(self.index, a) for a in INDEX))]]
        lists = [pa.nulls(1, pa.list_(pa.float64())) if c is None else pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        batch = pa.RecordBatch.from_arrays(lists, [f"c{k}" for k in range(len(lists))])
        with pa.OSFile(path, "wb") as out, pa.ipc.new_file(out, batch.schema) as file:
            file.write_batch(batch)

    @classmethod
    def read(cls, path: str) -> Model:
        """The model of a file, whose arrays stay in it."""
        batch = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
        names, *arrays = (c[0].values for c in batch.columns)
        numbers, coefficients, factor, ids, toxic, *parts = (None if x is None else x.to_numpy() for x in arrays)
        index = BlockMaxIndex.__new__(BlockMaxIndex)
        index.count, index.blocks = len(ids), -(-max(len(ids), 1) // EXAMPLES_PER_BLOCK)
        for name, part in zip(INDEX, parts):
            setattr(index, name, part)
        return cls(Terms(names, factor, float(numbers[0])), ids, toxic, index, coefficients, float(numbers[1]))

    def ship(self, space: Workspace) -> str:
        """The file in the shared folder, or its name where Spark sends it if that folder is not mounted."""
        name = f"model-{uuid.uuid4().hex}.arrow"
        if space.mounted():
            path = os.path.join(space.mount("model"), name)
            self.write(path)
            return path
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="toxicity-")), name)
        self.write(path)
        space.spark.sparkContext.addFile(path)
        return name


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients by Newton steps on the ridge-penalised weighted likelihood."""
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        slope = x.T @ (weight * (y - p)) - 0.01 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(beta))
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _calibrate(model: Model, vectors: Vectors, shares: dict[int, float]) -> None:
    votes = np.zeros((len(model.toxic), 3))
    votes[:, 0] = 1
    for i in range(len(vectors)):
        terms, weights = vectors[i]
        if len(terms):
            found, score = model.index.nearest(terms, weights, NEIGHBOURS + 1)
            other = found != i
            votes[i] = model.votes(found[other][:NEIGHBOURS], score[other][:NEIGHBOURS])
    y = model.toxic.astype(float)
    model.coefficients = _logistic(votes, y, np.array([shares[int(t)] for t in model.toxic]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    space = Workspace(spark, "toxicity")
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(doc_remainder(F.col("doc_id"), 5) != 0)
    marks = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.length("text").alias("size"))
    marks = marks.filter("size > 0").join(known, "doc_id")
    # Equal texts count once.
    single = marks.groupBy("mark", "size", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    single = space.table(single.distinct(), "labelled")
    totals = {r["toxic"]: r["n"] for r in single.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, bad = sum(totals.values()), totals.get(1, 0)
    base = bad / n if n else 0.0
    none = BlockMaxIndex(Vectors.of([]), 0)
    model = Model(Terms(pa.array([], pa.string()), np.zeros(0)), np.zeros(0), np.zeros(0), none, base=base)
    if not bad or bad == n:
        return model
    marked = docs.withColumn("mark", F.xxhash64("text"))
    order = F.xxhash64("doc_id"), "doc_id"
    chosen = single.withColumn("_n", F.row_number().over(Window.partitionBy("toxic").orderBy(*order))).filter(F.col("_n") <= MAX_EXAMPLES)
    some = marked.join(F.broadcast(chosen.drop("_n")), "doc_id").dropDuplicates(["doc_id", "toxic", "mark"])
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("toxic").orderBy(*order, "mark")))
    some = some.filter(F.col("_n") <= MAX_EXAMPLES).select("doc_id", "toxic", "text")
    kind = "doc_id BIGINT, toxic INT, terms ARRAY<STRING>, counts ARRAY<INT>"
    bags = some.withColumn("toxic", F.col("toxic").cast("int")).mapInArrow(_bags, kind).toArrow()
    terms = bags["terms"].combine_chunks()
    ends = terms.offsets.to_numpy().astype(np.int64)
    names = terms.flatten().dictionary_encode()
    known, code = names.dictionary, names.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    times = bags["counts"].combine_chunks().flatten().to_numpy().astype(np.int32)
    ids, kinds = bags["doc_id"].to_numpy().copy(), bags["toxic"].to_numpy().copy()
    ends = ends - ends[0]
    # Only codes are needed from here on; the driver gives back the examples' words.
    del bags, terms, names
    pa.default_memory_pool().release_unused()

    toxic = F.coalesce(F.col("toxic").cast("int"), F.lit(-1)).alias("toxic")
    labelled = F.broadcast(single) if n <= BROADCAST_IDS else single
    counts = docs.join(labelled, "doc_id", "left").select("text", toxic)
    counts = counts.mapInArrow(_count, "term STRING, texts BIGINT, known BIGINT, bad BIGINT").groupBy("term")
    counts = space.table(counts.agg(*[F.sum(c).alias(c) for c in ("texts", "known", "bad")]), "terms")
    rows = docs.count()
    kind = "term STRING, texts BIGINT, known BIGINT, bad BIGINT, squares DOUBLE"
    found = counts.mapInArrow(_own_terms(known, rows), kind).toArrow().combine_chunks()
    others = found.filter(pc.is_null(found["term"]))
    square = (pc.sum(others["squares"]).as_py() or 0.0) / max(pc.sum(others["texts"]).as_py() or 0, 1)
    found = found.filter(pc.is_valid(found["term"])).combine_chunks()
    at = pc.index_in(known, found["term"].combine_chunks())
    texts, r, a = (found[c].take(at).to_numpy().astype(np.float64) for c in ("texts", "known", "bad"))
    gap = np.maximum(a * n - r * bad, 0)
    root = np.sqrt(n * gap * gap / np.maximum(r * (n - r) * bad * (n - bad), 1))
    factor = (np.log((1 + rows) / (1 + texts)) + 1) * (1 + np.maximum(root - CHANCE, 0))
    model.terms = Terms(known, factor, float(np.sqrt(square or 1.0)))

    del found, others
    weight = 1 + np.log(times)
    weight *= factor[code]
    strong, common = np.full(len(ids), -1), np.full(len(ids), -1)
    for i, own in enumerate(map(slice, ends[:-1], ends[1:])):
        t, w = code[own], weight[own]
        w /= max(np.sqrt((w * w).sum()), 1e-9)
        # Blocks hold examples of one strong term for the label, and of one commonest term, which is of one language.
        if len(t):
            strong[i] = t[np.argmax(root[t])] if root[t].max() > CHANCE else -1
            common[i] = t[np.argmax(texts[t])]
    place = np.lexsort((ids, kinds, common, strong))
    sizes = np.diff(ends)[place]
    at = ranges(ends[:-1][place], sizes)
    vectors = Vectors(np.concatenate([[0], np.cumsum(sizes)]), code[at], weight[at])
    del at, weight, times, code
    model.ids, model.toxic, model.index = ids[place], kinds[place], BlockMaxIndex(vectors, len(known))
    pa.default_memory_pool().release_unused()
    taken = {t: int((model.toxic == t).sum()) for t in (0, 1)}
    _calibrate(model, vectors, {t: totals[t] / max(taken[t], 1) for t in (0, 1)})
    return model


def _score(shipped: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        # A full path stays as it is.
        model = Model.read(SparkFiles.get(shipped))
        far = model.probability(np.array([1.0, 0.0, 0.0]))
        for part in slices(batches, "text", SLICE_BYTES // 2):
            ends, terms, weights = model.terms.vectors(part.column("text"))
            score = np.full(part.num_rows, far)
            evidence: list[list] = [[] for _ in range(part.num_rows)]
            for i in np.flatnonzero(np.diff(ends)).tolist():
                at = slice(ends[i], ends[i + 1])
                found, near = model.index.nearest(terms[at], weights[at], NEIGHBOURS)
                score[i] = model.probability(model.votes(found, near))
                evidence[i] = [
                    {"doc_id": int(model.ids[e]), "toxic": int(model.toxic[e]), "similarity": float(s)}
                    for e, s in zip(found[:3], near[:3])
                ]
            kind = pa.list_(
                pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())])
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(score), pa.array(evidence, kind)], ["doc_id", "score", "evidence"]
            )

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the three nearest examples) of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = learn(docs, labels)
    kind = "doc_id BIGINT, score DOUBLE, evidence ARRAY<STRUCT<doc_id: BIGINT, toxic: INT, similarity: DOUBLE>>"
    scored = docs.mapInArrow(_score(model.ship(Workspace(docs.sparkSession, "toxicity"))), kind)
    held = doc_remainder(F.col("doc_id"), 5) == 0
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic.

    A row without id cannot be named by its score and stays; of rows that share an id all go if
    one is toxic.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    toxic = score_documents(docs.select("doc_id", "text"), labels).filter("predicted = 1")
    toxic = space.table(toxic.select(F.col("doc_id").alias("_toxic")).distinct(), "toxic")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    return rows.join(toxic, F.col("_row")["doc_id"] == F.col("_toxic"), "left_anti").select("_row.*")
