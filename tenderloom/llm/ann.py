"""Largest inner products through hierarchical navigable small-world graphs, one per shard.

Vectors get one more component that gives all of a shard the same length, so that the nearest by
angle are those of the largest inner product. Levels are drawn per node by a hash, each with one
sixteenth of the one below. At every level a node's candidates are its exact nearest in the shard
(a shard is bounded, so this is a few matrix products); links go to candidates that are nearer to
the node than to any link chosen before, and back. Graphs are stored as flat neighbour arrays.

Where lengths differ, a node also points to those of largest inner product with it, since answers
are often long vectors that are not near by angle.

Search descends by beams, a block of queries at once. Every query meets every shard, in blocks;
answers of all shards are merged by exact double-precision scores.

Equal vectors are one node with its ``k + 1`` smallest ids: more of them cannot be in any answer.
Every other vector is a node; nothing is sampled.

Defined results: vectors that are null, empty or zero or hold null or non-finite components take
no part, nor do rows with a null id; vectors of another length are never neighbours; ties go to
the smaller id; rows repeated with the same id and vector count once; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.llm.common import Workspace

SHARD_ROWS = 16_384
LINKS = 16
CANDIDATES = 48
LEVEL_RATIO = 16
BEAM = 192
UPPER_BEAM = 32
EXPANDED_AT_ONCE = 4
QUERY_BLOCK = 512
BLOCKS_PER_GROUP = 64


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Level:
    """``nodes`` of one level and a row of neighbours for each, padded with -1."""

    nodes: np.ndarray
    links: np.ndarray


def _nearest(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of each row's k nearest other rows, nearest first."""
    n = len(vectors)
    k = min(k, n - 1)
    ids = np.empty((n, k), np.int32)
    near = np.empty((n, k), np.float32)
    for at in range(0, n, 1024):
        score = vectors[at : at + 1024] @ vectors.T
        rows = np.arange(len(score))
        score[rows, at + rows] = -np.inf
        best = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-score, axis=1)[:, :k]
        value = np.take_along_axis(score, best, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        ids[at : at + 1024] = np.take_along_axis(best, order, 1)
        near[at : at + 1024] = np.take_along_axis(value, order, 1)
    return ids, near


def _diverse(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, limit: int) -> np.ndarray:
    """Which candidates become links: nearer to the node than to every earlier link."""
    chosen = np.zeros(ids.shape, bool)
    for at in range(0, len(ids), 512):
        some = vectors[ids[at : at + 512]]
        among = some @ some.transpose(0, 2, 1)
        mask = chosen[at : at + 512]
        for r in range(ids.shape[1]):
            closest = np.where(mask, among[:, r, :], -np.inf).max(axis=1)
            mask[:, r] = (near[at : at + 512, r] > closest) & (mask.sum(axis=1) < limit)
    return chosen


def _level(vectors: np.ndarray, nodes: np.ndarray, links: int) -> Level:
    """``vectors`` end with the component that makes their lengths equal."""
    if len(nodes) < 2:
        return Level(nodes, np.full((len(nodes), 1), -1, np.int32))
    own = vectors[nodes]
    far = np.zeros((len(nodes), 0), np.int32)
    if own[:, -1].max() > 1e-2:
        far = _nearest(np.ascontiguousarray(own[:, :-1]), links)[0]
    ids, near = _nearest(own, CANDIDATES)
    chosen = _diverse(own, ids, near, links)
    source, rank = np.nonzero(chosen)
    target, score = ids[source, rank], near[source, rank]
    # Links in both directions; a node keeps its nearest when more than twice as many arrive.
    a = np.concatenate([source, target])
    b = np.concatenate([target, source])
    value = np.concatenate([score, score])
    pair = np.unique(a.astype(np.int64) * len(nodes) + b, return_index=True)[1]
    a, b, value = a[pair], b[pair], value[pair]
    order = np.lexsort((-value, a))
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(len(nodes)))
    place = np.arange(len(a)) - start[a]
    keep = place < 2 * links
    out = np.full((len(nodes), 2 * links), -1, np.int32)
    out[a[keep], place[keep]] = b[keep]
    return Level(nodes, np.concatenate([out, far], 1))


class Graph:
    """Levels from the bottom up; links are positions within their level."""

    def __init__(self, vectors: np.ndarray, levels: list[Level]):
        self.vectors = vectors
        self.levels = levels
        self.searchable = self.augment(vectors)

    @staticmethod
    def augment(vectors: np.ndarray) -> np.ndarray:
        wide = vectors.astype(np.float64)
        square = (wide * wide).sum(axis=1)
        rest = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0))
        scale = np.sqrt(square.max(initial=1.0)) or 1.0
        return (np.concatenate([wide, rest[:, None]], 1) / scale).astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, draws: np.ndarray) -> Graph:
        """``draws`` in [0, 1) decide the levels."""
        wide = cls.augment(vectors)
        levels = [_level(wide, np.arange(len(vectors), dtype=np.int32), LINKS)]
        share = 1.0 / LEVEL_RATIO
        while True:
            nodes = np.flatnonzero(draws < share).astype(np.int32)
            if len(nodes) < UPPER_BEAM or len(nodes) == len(levels[-1].nodes):
                break
            levels.append(_level(wide, nodes, LINKS))
            share /= LEVEL_RATIO
        return cls(vectors, levels)

    def _beam(self, level: Level, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the level, similarities) of the best found per query, from start positions."""
        n, count = len(level.nodes), len(queries)
        rows = np.arange(count)[:, None]
        width = min(width, n)
        seen = np.zeros((count, n + 1), bool)
        seen[:, n] = True
        start = np.where(start < 0, n, start)
        fresh = ~seen[rows, start]
        seen[rows, start] = True
        where = np.append(level.nodes, 0)
        score = np.einsum("qkd,qd->qk", self.searchable[where[start]], queries)
        score = np.where(fresh, score, -np.inf)
        ids, open_ = start, fresh.copy()
        while True:
            if ids.shape[1] > width:
                best = np.argpartition(-score, width - 1, axis=1)[:, :width]
                ids, score, open_ = ids[rows, best], score[rows, best], open_[rows, best]
            waiting = np.where(open_, score, -np.inf)
            few = min(EXPANDED_AT_ONCE, waiting.shape[1])
            next_ = np.argpartition(-waiting, few - 1, axis=1)[:, :few]
            live = np.isfinite(waiting[rows, next_])
            if not live.any():
                return ids, score
            open_[rows, next_] = False
            around = level.links[ids[rows, next_] % n]
            around = np.where(live[:, :, None] & (around >= 0), around, n).reshape(count, -1)
            around.sort(axis=1)
            new = ~seen[rows, around]
            new[:, 1:] &= around[:, 1:] != around[:, :-1]
            seen[rows, around] = True
            q, k = np.nonzero(new)
            value = np.full(around.shape, -np.inf, np.float32)
            value[q, k] = np.einsum("kd,kd->k", self.searchable[level.nodes[around[q, k]]], queries[q])
            ids = np.concatenate([ids, around], 1)
            score = np.concatenate([score, value], 1)
            open_ = np.concatenate([open_, new], 1)

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, exact scores) of the k best per query, unordered; -1 pads."""
        wide = np.concatenate([queries, np.zeros((len(queries), 1), queries.dtype)], 1).astype(np.float32)
        top = self.levels[-1]
        start = np.tile(np.arange(min(UPPER_BEAM, len(top.nodes))), (len(queries), 1))
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            ids, score = self._beam(level, wide, start, beam if depth == 0 else UPPER_BEAM)
            if depth:
                below = self.levels[depth - 1].nodes
                start = np.searchsorted(below, level.nodes[ids % len(level.nodes)])
                start = np.where(np.isfinite(score), start, -1)
        n = len(self.levels[0].nodes)
        good = np.isfinite(score)
        ids = np.where(good, ids % n, 0)
        exact = np.full(ids.shape, -np.inf)
        wide_queries, wide_vectors = queries.astype(np.float64), self.vectors.astype(np.float64)
        for q in range(len(queries)):
            exact[q] = wide_vectors[ids[q]] @ wide_queries[q]
        exact = np.where(good, exact, -np.inf)
        k = min(k, exact.shape[1])
        best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
        rows = np.arange(len(queries))[:, None]
        return np.where(good[rows, best], ids[rows, best], -1), exact[rows, best]


def _pack(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def _build(table: pa.Table) -> pa.Table:
    shard, dim = table["shard"][0].as_py(), table["dim"][0].as_py()
    table = table.combine_chunks()
    vectors = table["embedding"].combine_chunks().flatten().to_numpy().astype(np.float32).reshape(-1, dim)
    graph = Graph.build(vectors, table["draw"].to_numpy())
    row = {
        "shard": shard,
        "dim": dim,
        "vectors": _pack(vectors, "<f4"),
        "ids": table["ids"].to_pylist(),
        "nodes": [_pack(level.nodes, "<i4") for level in graph.levels],
        "links": [_pack(level.links, "<i4") for level in graph.levels],
    }
    return pa.Table.from_pylist([row], schema=GRAPH_SCHEMA)


GRAPH_SCHEMA = pa.schema(
    [
        ("shard", pa.int64()),
        ("dim", pa.int32()),
        ("vectors", pa.binary()),
        ("ids", pa.list_(pa.list_(pa.int64()))),
        ("nodes", pa.list_(pa.binary())),
        ("links", pa.list_(pa.binary())),
    ]
)
GRAPHS = (
    "shard BIGINT, dim INT, vectors BINARY, ids ARRAY<ARRAY<BIGINT>>, nodes ARRAY<BINARY>, links ARRAY<BINARY>"
)


def build_graphs(space: Workspace, vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard from ``vec_id, embedding``; written."""
    ordered = Window.partitionBy("embedding").orderBy("vec_id")
    first = vectors.withColumn("_n", F.row_number().over(ordered)).filter(F.col("_n") <= k + 1)
    nodes = first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = space.table(nodes.withColumn("dim", F.size("embedding")), "nodes")
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("shards"))
    placed = nodes.join(F.broadcast(sizes), "dim")  # one row per vector length
    mark = F.xxhash64("embedding")
    placed = placed.select(
        "dim",
        F.pmod(mark, F.col("shards")).alias("shard"),
        "embedding",
        "ids",
        (F.pmod(F.xxhash64(mark, F.lit("level")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("draw"),
    )
    # Groups have about shard_rows vectors by construction.
    return space.table(placed.groupBy("dim", "shard").applyInArrow(_build, GRAPHS), "graphs")


def _answers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                dim = row["dim"]
                if row["graph"] is not None:
                    held = row["graph"]
                    vectors = np.frombuffer(held["vectors"], "<f4").reshape(-1, dim)
                    nodes = [np.frombuffer(x, "<i4") for x in held["nodes"]]
                    links = [np.frombuffer(x, "<i4").reshape(len(n), -1) for x, n in zip(held["links"], nodes)]
                    graph, ids = Graph(vectors, [Level(n, x) for n, x in zip(nodes, links)]), held["ids"]
                    continue
                queries = np.frombuffer(row["queries"], "<f4").reshape(-1, dim)
                found, score = graph.search(queries, k + 1)
                out_q, out_v, out_s = [], [], []
                for q, query in enumerate(row["query_ids"]):
                    hits = [
                        (-s, v)
                        for node, s in zip(found[q].tolist(), score[q].tolist())
                        if node >= 0
                        for v in ids[node]
                        if v != query
                    ]
                    hits.sort()
                    for s, v in hits[:k]:
                        out_q.append(query)
                        out_v.append(v)
                        out_s.append(-s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())],
                    ["query_id", "vec_id", "score"],
                )

    return run


def _pack_queries(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    flat = table["embedding"].combine_chunks().flatten().to_numpy().astype("<f4")
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "block": pa.array([table["block"][0].as_py()], pa.int64()),
            "query_ids": pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())),
            "queries": pa.array([flat.tobytes()], pa.binary()),
        }
    )


def search(space: Workspace, graphs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found of every row of ``queries`` (vec_id, embedding)."""
    count = queries.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    groups = -(-blocks // BLOCKS_PER_GROUP)
    packed = (
        queries.withColumns({"dim": F.size("embedding"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks))})
        .groupBy("dim", "block")
        .applyInArrow(_pack_queries, "dim INT, block BIGINT, query_ids ARRAY<BIGINT>, queries BINARY")
    )
    packed = space.table(packed, "queries").withColumn("group", F.pmod(F.col("block"), F.lit(groups)))
    held = F.struct("vectors", "ids", "nodes", "links").alias("graph")
    numbers = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g.cast("bigint"))
    left = graphs.select("dim", "shard", F.explode(numbers).alias("group"), held)
    left = left.withColumns({"query_ids": F.lit(None).cast("array<bigint>"), "queries": F.lit(None).cast("binary")})
    # Every query meets every shard: blocks of the stated query set against all rows.
    right = packed.join(graphs.select("dim", "shard"), "dim").select(
        "dim", "shard", "group", F.lit(None).cast(left.schema["graph"].dataType).alias("graph"), "query_ids", "queries"
    )
    work = left.unionByName(right).repartition("dim", "shard", "group")
    work = work.sortWithinPartitions("dim", "shard", "group", F.col("graph").isNull())
    found = work.mapInArrow(_answers(k), "query_id BIGINT, vec_id BIGINT, score DOUBLE").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_vectors(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``every``, among all other rows."""
    space = Workspace(vectors.sparkSession, "ann")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    rows = space.table(rows, "vectors")
    graphs = build_graphs(space, rows, k)
    return search(space, graphs, rows.filter(F.col("vec_id") % every == 0), k)
