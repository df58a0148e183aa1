"""Near duplicates: exact Jaccard join of word-shingle sets through signature trees.

1. Every text becomes the set of its shingles' 64-bit hashes. Equal sets form a class; one
   representative goes on, so copies never meet pairwise.
2. Two sets with Jaccard >= t share one of their first ``n - ceil(t n) + 1`` hashes in any fixed
   order (prefix filter), so representatives are grouped by each of those hashes. The order puts
   hashes that are frequent within pieces of the input last, so texts that merely share a common
   passage seldom meet; at most ``MAX_COMMON`` are told apart, which bounds what tasks receive and
   decides only how much work there is.
3. All members of a group are paired with its smallest one; pairs that sizes and bitmaps permit
   are checked on the exact sets. This joins a large family of near copies in linear work.
4. What is left are groups with several components of sizes that permit a link. Their members form signature trees: a node
   holds the OR of its members' token bitmaps and the range of their sizes. Trees are traversed
   in pairs from the roots; a pair of nodes is dropped if its sizes cannot match, if the largest
   overlap its bitmaps permit is too small, or if both lie in one component. Large groups are
   cut into blocks of about ``BLOCK`` members, each with a tree, and block pairs are spread.
5. Surviving pairs are checked on the exact sets, and components are taken over all links.

Nothing is capped: no group, candidate list or text is cut. Sets are compared by 64-bit hashes of
their shingles; no link is lost unless hashes of different shingles in a document collide.

Defined results: null or empty texts have no shingles and no links; rows with a null id get
component null; rows that share an id are one node; repeated rows each get their row; other
columns are kept by ``keep_one_of_each``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.llm.common import Workspace, frees, slices, split_words
from tenderloom.llm.components import connected_components

WORDS = 4
#: Jaccard threshold in percent.
PERCENT = 85
BITS = 4096
BLOCK = 500
#: Bytes of text handled at once.
SLICE = 8 << 20
#: Hashes that a task counts at once; a hash is common if the counts of at least ``PIECE_OFTEN`` add up to ``OFTEN``.
#: The more are counted at once, the rarer the passage that is still told from chance.
PIECE_HASHES = 4_000_000
PIECE_OFTEN = 2
OFTEN = 6
MAX_COMMON = 200_000
LEAF = 16
#: Ids sent to every task to choose rows by; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; ASCII letters are lower-cased."""
    words, codes, offsets = split_words(texts, lower=True)
    hashes = word_hashes(words)[codes]
    size = len(hashes)
    chained = np.full(size, np.uint64(n), np.uint64)
    for k in range(n):
        chained[: size - k] = _mix(chained[: size - k] + hashes[k:])
    out = []
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if stop - start >= n:
            out.append(np.unique(chained[start : stop - n + 1]))
        elif stop > start:
            whole = np.full(1, np.uint64(stop - start), np.uint64)
            for k in range(start, stop):
                whole = _mix(whole + hashes[k])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


Batches = Iterator[pa.RecordBatch]


def _frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of several of the sets, and of how many."""
    flat = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    at = np.flatnonzero(np.concatenate([flat[:1] == flat[:1], flat[1:] != flat[:-1]]))
    count = np.diff(at, append=len(flat))
    often = count >= PIECE_OFTEN
    return flat[at[often]], count[often]


def _facts(n: int) -> Callable[[Batches], Batches]:
    """Size and two hashes of each set; one more row for the frequent hashes of each ``PIECE_HASHES`` of them."""

    def rows(docs: pa.Array, sizes: list[int], h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(docs), pa.list_(pa.int64()))
        columns = [pa.array(np.ones(len(docs), np.int32)), docs, pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), none, none], FACT_COLUMNS)

    def counts(sets: list[np.ndarray]) -> pa.RecordBatch:
        often, count = _frequent(sets)
        zero = pa.array([0], pa.int64())
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (often.view(np.int64), count)]
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), zero, zero, zero, *lists], FACT_COLUMNS)

    @frees
    def run(batches: Batches) -> Batches:
        # Equal sets count once: they form a class and do not meet.
        piece: dict[tuple[int, int], np.ndarray] = {}
        held = 0
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(part.column("text"), n)
            h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            h2 = np.array([_mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield rows(part.column("doc_id"), [len(s) for s in sets], h1, h2)
            for mark, own in zip(zip(h1.tolist(), h2.tolist()), sets):
                if mark not in piece:
                    piece[mark] = own
                    held += len(own)
                if held >= PIECE_HASHES:
                    yield counts(list(piece.values()))
                    piece, held = {}, 0
        if piece:
            yield counts(list(piece.values()))

    return run


FACT_COLUMNS = ["texts", "doc_id", "n", "h1", "h2", "hashes", "counts"]


def common_hashes(facts: DataFrame) -> np.ndarray:
    """Sorted hashes that the pieces name often, the most frequent of them."""
    pairs = facts.filter("texts = 0").select(F.explode(F.arrays_zip("hashes", "counts")).alias("x"))
    sums = pairs.groupBy(F.col("x.hashes").alias("hash")).agg(F.sum("x.counts").alias("count"))
    top = sums.filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "hash").limit(MAX_COMMON)
    found = top.select("hash").toArrow()["hash"].combine_chunks().to_numpy(zero_copy_only=False)
    return np.sort(found.astype(np.int64).view(np.uint64))


def _leaders(n: int, percent: int, common: np.ndarray) -> Callable[[Batches], Batches]:
    """Size, prefix and bitmap of each set."""

    def prefix(hashes: np.ndarray) -> np.ndarray:
        length = len(hashes) - least_overlap(len(hashes), percent) + 1
        if not len(common):
            return hashes[:length]
        place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        last = common[place] == hashes
        return np.concatenate([hashes[~last], hashes[last]])[:length]

    @frees
    def run(batches: Batches) -> Batches:
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(part.column("text"), n)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            bits = pa.array([bitmap(s) for s in sets], pa.binary())
            lists = _lists([prefix(s) for s in sets])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, lists, bits], ["doc", "n", "prefix", "bits"])

    return run


def _may_link(percent: int) -> Callable[[Batches], Batches]:
    """The pairs whose bitmaps permit enough overlap."""

    @frees
    def run(batches: Batches) -> Batches:
        for part in slices(batches, "bits_a", 4 << 20):
            size_a, size_b = (part.column(c).to_numpy() for c in ("na", "nb"))
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(part.num_rows, -1) for c in ("bits_a", "bits_b"))
            both = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
            free_a = size_a - np.bitwise_count(a).sum(axis=1, dtype=np.int64)
            free_b = size_b - np.bitwise_count(b).sum(axis=1, dtype=np.int64)
            keep = (np.minimum(free_a, free_b) + both) * (100 + percent) >= percent * (size_a + size_b)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _check(n: int, percent: int) -> Callable[[Batches], Batches]:
    """The pairs whose sets pass; rows come in order of ``b``, whose set is kept between them."""

    @frees
    def run(batches: Batches) -> Batches:
        for part in slices(batches, "text_a", SLICE // 2):
            left = shingle_sets(part.column("text_a"), n)
            others = part.column("text_b").dictionary_encode()
            right = shingle_sets(others.dictionary, n)
            keep = []
            for x, at in zip(left, others.indices.to_pylist()):
                y = right[at]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class SignatureTree:
    """Levels of nodes over members sorted by size and component; level 0 holds the members."""

    def __init__(self, sizes: np.ndarray, components: np.ndarray, bits: np.ndarray):
        self.order = np.lexsort((components, sizes))
        sizes, components, bits = sizes[self.order], components[self.order], bits[self.order]
        slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, slack, components, components)]
        while len(self.levels[-1][0]) > 1:
            union, low, high, free, first, last = self.levels[-1]
            at = np.arange(0, len(union), LEAF)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(union, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(free, at),
                    np.minimum.reduceat(first, at),
                    np.maximum.reduceat(last, at),
                )
            )


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs can hold a pair of members that links and is not yet connected."""
    low_a, high_a, low_b, high_b = a[1][i], a[2][i], b[1][j], b[2][j]
    keep = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    keep &= ~((a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j]))
    at = np.flatnonzero(keep)
    shared = np.empty(len(at), np.int64)
    for s in range(0, len(at), 1 << 15):
        k = at[s : s + (1 << 15)]
        shared[s : s + len(k)] = np.bitwise_count(a[0][i[k]] & b[0][j[k]]).sum(axis=1, dtype=np.int64)
    most = np.minimum(a[3][i[at]], b[3][j[at]]) + shared
    keep[at] = most * (100 + percent) >= percent * (low_a[at] + low_b[at])
    return keep


def traverse(left: SignatureTree, right: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Member positions of the pairs that survive; for one tree with itself, each pair once."""
    same = left is right
    p, q = len(left.levels) - 1, len(right.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = _possible(left.levels[p], right.levels[q], i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i) or p == q == 0:
            break
        down_left, down_right = p >= q and p > 0, q >= p and q > 0
        if down_left:
            p -= 1
            i = (i[:, None] * LEAF + np.arange(LEAF)).ravel()
            j = np.repeat(j, LEAF)
            ok = i < len(left.levels[p][0])
            i, j = i[ok], j[ok]
        if down_right:
            q -= 1
            j = (j[:, None] * LEAF + np.arange(LEAF)).ravel()
            i = np.repeat(i, LEAF)
            ok = j < len(right.levels[q][0])
            i, j = i[ok], j[ok]
        if same:
            ok = i <= j
            i, j = i[ok], j[ok]
    if same:
        i, j = i[i != j], j[i != j]
    return left.order[i], right.order[j]


def _tree(members: pa.StructArray) -> tuple[SignatureTree, np.ndarray]:
    field = {name: members.field(name) for name in ("doc", "n", "component", "bits")}
    bits = np.frombuffer(b"".join(field["bits"].to_pylist()), np.uint64).reshape(len(members), -1)
    tree = SignatureTree(field["n"].to_numpy(), field["component"].to_numpy(), bits)
    return tree, field["doc"].to_numpy()


def _join_blocks(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            for row in range(batch.num_rows):
                left, docs = _tree(batch.column("members")[row].values)
                other = batch.column("others")[row]
                right, others = _tree(other.values) if other.is_valid else (left, docs)
                i, j = traverse(left, right, percent)
                found_a.append(docs[i])
                found_b.append(others[j])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _of_ids(rows: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """The rows whose id is among ``ids`` (doc), which is written and whose size is checked."""
    wanted = ids.select(F.col("doc").alias("_wanted"))
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted
    return rows.join(wanted, F.col(name) == F.col("_wanted"), "left_semi")


def _ids_of(space: Workspace, pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc")))
    return space.table(both.distinct(), "ids")


def _with_both(pairs: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns ``names`` of the rows of both documents of each pair, with ``_a`` and ``_b`` appended."""
    for side in ("a", "b"):
        own = rows.select(F.col("doc").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names])
        pairs = pairs.join(own, side)
    return pairs


def _near_pairs(space: Workspace, leaders: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and bitmaps permit."""
    pairs = space.table(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    sized = _with_both(pairs, _of_ids(leaders.select("doc", "n"), _ids_of(space, pairs), "doc"), ["n"])
    sized = sized.filter((100 * F.col("n_b") >= percent * F.col("n_a")) & (100 * F.col("n_a") >= percent * F.col("n_b")))
    sized = space.table(sized.distinct(), "sized")
    rows = _of_ids(leaders.select("doc", "bits"), _ids_of(space, sized), "doc")
    full = _with_both(sized.withColumnsRenamed({"n_a": "na", "n_b": "nb"}), rows, ["bits"])
    return full.mapInArrow(_may_link(percent), "a BIGINT, b BIGINT")


def _linked(space: Workspace, docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact sets pass, from the texts of both."""
    pairs = space.table(pairs.distinct(), "candidates")
    texts = _of_ids(docs.withColumnRenamed("doc_id", "doc"), _ids_of(space, pairs), "doc")
    joined = _with_both(pairs, texts, ["text"])
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_check(n, percent), "a BIGINT, b BIGINT")


def _blocks(open_rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Blocks of groups: members of a component lie together, large components are split."""
    sizes = open_rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    per_key = sizes.groupBy("key").agg(F.sum(F.least("c", F.lit(BLOCK))).alias("k"))
    rows = open_rows.join(sizes, ["key", "component"]).join(per_key, "key")
    own = F.ceil(F.col("c") / F.lit(BLOCK))
    block = F.when(
        F.col("c") > BLOCK, F.struct(F.col("component").alias("x"), F.pmod(F.xxhash64("doc"), own).alias("y"))
    ).otherwise(
        F.struct(
            F.pmod(F.xxhash64("component"), F.ceil(F.col("k") / F.lit(BLOCK))).alias("x"), F.lit(-1).cast("bigint").alias("y")
        )
    )
    member = F.struct("doc", "n", "component", "bits")
    return (
        rows.withColumn("block", block)
        .join(marks, ["doc", "n"])
        .groupBy("key", "block")
        .agg(
            F.collect_list(member).alias("members"),
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            F.min("component").alias("first"),
            F.max("component").alias("last"),
        )
    )


def _tree_pairs(space: Workspace, open_rows: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of ``open_rows`` (key, doc, n, component); ``leaders`` has doc, n, bits, each row once.

    Bitmaps outweigh all else here. A group of one block goes straight into its tree, with one
    shuffle; only the blocks of larger groups are written, because they meet one another.
    """
    sizes = open_rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    per_key = sizes.groupBy("key").agg(F.sum("c").alias("c"))
    large = space.table(per_key.filter(F.col("c") > BLOCK).select("key"), "large")
    one = open_rows.join(large, "key", "left_anti").join(leaders, ["doc", "n"])
    one = one.groupBy("key").agg(F.collect_list(F.struct("doc", "n", "component", "bits")).alias("members"))
    one = one.select("members", F.lit(None).cast(one.schema["members"].dataType).alias("others"))
    found = one.mapInArrow(_join_blocks(percent), "a BIGINT, b BIGINT")
    if large.isEmpty():
        return found
    rows = space.table(open_rows.join(large, "key", "left_semi"), "large-rows")
    marks = _of_ids(leaders, space.table(rows.select("doc").distinct(), "ids"), "doc")
    return found.union(_block_pairs(space, rows, marks, percent))


def _block_pairs(space: Workspace, open_rows: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of groups of several blocks."""
    blocks = space.table(_blocks(open_rows, marks), "blocks")
    inside = blocks.filter("first < last").select("members", F.lit(None).cast(blocks.schema["members"].dataType).alias("others"))
    between = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") < F.col("b.block"))
    between &= (100 * F.col("a.high") >= percent * F.col("b.low")) & (100 * F.col("b.high") >= percent * F.col("a.low"))
    one = (F.col("a.first") == F.col("a.last")) & (F.col("b.first") == F.col("b.last"))
    between &= ~(one & (F.col("a.first") == F.col("b.first")))
    many = blocks.groupBy("key").count().filter("count > 1").select("key")
    several = blocks.join(many, "key", "left_semi")
    across = several.alias("a").join(several.alias("b"), between).select(F.col("a.members").alias("members"), F.col("b.members").alias("others"))
    work = inside.union(across)
    return work.repartition(space.spark.sparkContext.defaultParallelism * 4).mapInArrow(
        _join_blocks(percent), "a BIGINT, b BIGINT"
    )


def _open(named: DataFrame, percent: int) -> DataFrame:
    """The rows (key, doc, n, component) whose group has another component of a size that permits a link.

    Sizes that permit one differ by the width of a band at most, so they lie in one band or in neighbouring ones.
    """
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    band, ends = F.col("band"), [F.min("low").alias("low"), F.max("high").alias("high")]
    rows = named.withColumn("band", F.floor(F.log("n") / F.lit(width)))
    cells = rows.withColumns({"low": F.col("component"), "high": F.col("component")}).groupBy("key", "band").agg(*ends)
    near = cells.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).groupBy("key", "band").agg(*ends)
    return rows.join(near.filter("low < high").select("key", "band"), ["key", "band"], "left_semi").drop("band")


def _several(space: Workspace, leaders: DataFrame) -> DataFrame:
    """The ids (_again) of several rows."""
    again = leaders.groupBy("doc").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc").alias("_again"))
    again = space.table(again, "again")
    return F.broadcast(again) if again.count() <= BROADCAST_IDS else again


def _once(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Distinct rows, of which only those of ids of several rows need to be made distinct."""
    twice = F.col("doc") == F.col("_again")
    return rows.join(several, twice, "left_anti").union(rows.join(several, twice, "left_semi").distinct())


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    space = Workspace(docs.sparkSession, "ngram-join")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kind = "texts INT, doc_id BIGINT, n BIGINT, h1 BIGINT, h2 BIGINT, hashes ARRAY<BIGINT>, counts ARRAY<BIGINT>"
    facts = space.table(texts.mapInArrow(_facts(n), kind), "facts")
    common = common_hashes(facts)
    facts = facts.filter("texts = 1").select("doc_id", "n", "h1", "h2")
    linkable = facts.filter("doc_id IS NOT NULL AND n > 0")
    same = ["h1", "h2", "n"]
    classes = space.table(linkable.groupBy(*same).agg(F.min("doc_id").alias("doc")), "classes")
    leaders = _of_ids(texts, space.table(classes.select("doc").distinct(), "ids"))
    kind = "doc BIGINT, n BIGINT, prefix ARRAY<BIGINT>, bits BINARY"
    leaders = space.table(leaders.mapInArrow(_leaders(n, percent, common), kind).filter("n > 0"), "leaders")
    several = _several(space, leaders)
    keys = _once(leaders.select(F.explode("prefix").alias("key"), "doc"), several)
    mark = F.xxhash64("doc")
    shared = keys.groupBy("key").agg(
        F.min("doc").alias("first"),
        F.max("doc").alias("last"),
        F.count("*").alias("members"),
        F.bit_xor(mark).alias("mark"),
        # 32 bits a member, so that the sum cannot overflow.
        F.sum(F.shiftrightunsigned(mark, 32)).alias("sum"),
    )
    # Groups of the same members are walked once.
    group = ["first", "last", "members", "mark", "sum"]
    shared = shared.filter("first < last").groupBy(*group).agg(F.min("key").alias("key")).select("key", "first")
    shared = space.table(shared, "shared")
    live = space.table(keys.join(shared, "key").select("key", "doc", "first"), "live")

    star = live.filter("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    links = space.table(_linked(space, texts, _near_pairs(space, leaders, star, percent), n, percent), "links")
    parts = connected_components(space, links)

    named = live.join(parts.withColumnRenamed("node", "doc"), "doc", "left")
    named = named.join(_once(leaders.select("doc", "n"), several), "doc")
    named = space.table(named.select("key", "doc", "n", F.coalesce("component", "doc").alias("component")), "named")
    rest = space.table(_open(named, percent), "open")
    marks = _of_ids(leaders.select("doc", "n", "bits"), space.table(rest.select("doc").distinct(), "ids"), "doc")
    found = _tree_pairs(space, rest, _once(marks, several), percent)
    found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    more = space.table(_linked(space, texts, found, n, percent), "links")

    again = linkable.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    twins = linkable.join(again, "doc_id", "left_semi").join(classes, same)
    twins = twins.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).filter("a <> b")
    parts = connected_components(space, links.union(more).union(twins))
    members = facts.select("doc_id", *same).join(classes, same, "left").join(parts, F.col("doc") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc", "doc_id"))
    return members.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document per component: the smallest id, one row of it.

    Rows with a null id or without words have no duplicates and stay.
    """
    space = Workspace(docs.sparkSession, "dedup")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(row.alias("_row")).withColumns(
        {"_id": F.col("_row")["doc_id"], "_text": F.xxhash64(F.col("_row")["text"])}
    )
    found = near_duplicates(docs, n, percent)
    gone = found.filter((F.col("component_id") != F.col("doc_id")) & (F.col("n_shingles") > 0))
    gone = space.table(gone.select(F.col("doc_id").alias("_id")).distinct(), "gone")
    kept = rows.join(gone, "_id", "left_anti")
    again = kept.filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.count("*").alias("_c")).filter("_c > 1")
    twice = kept.join(again.select("_id"), "_id", "left_semi")
    order = Window.partitionBy("_id").orderBy("_text")
    once = twice.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    single = kept.join(again.select("_id"), "_id", "left_anti")
    return single.select("_row.*").union(once.select("_row.*"))
