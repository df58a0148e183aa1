"""A Merkle manifest of a dataset, and proofs of all its documents by octopus multiproofs.

Leaves are digests of rows, computed in the JVM. Every source has a tree of degree three over its
leaves in ascending order of doc_id; the roots of these trees, in order of the source, are the
leaves of one more tree, whose root stands for the dataset. Node (tree, level, position) is the
SHA-256 of its children's hexadecimal digests.

Leaves are cut into partitions of 3**LEVELS neighbours of one source, so the largest source spreads
over many tasks and no task holds more than one partition. A task climbs its partition; the digests
that come out are the leaves of the next round, until every tree has its root.

To prove all documents, a leaf partition asks once for what it cannot derive: for its whole set of
leaves the *octopus* walk goes up level by level, joins known nodes into their parents and notes the
coordinates of siblings that are missing. For a full partition these are a few nodes above it. One
join fetches them; the partition then derives all shared interior nodes and expands each document's
own proof from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import Workspace
from tenderloom.operators.ranking import globally_ranked

#: Children of a node, and levels that one task climbs (6,561 leaves a partition).
DEGREE, LEVELS = 3, 8

#: Name of the tree over the roots of all sources; trees of sources begin with ``-`` or ``=``.
TOP = "*"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree STRING, level INT, position BIGINT, width BIGINT, digest STRING"


def field_code(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row's values."""
    return F.sha2(F.concat(*[field_code(v) for v in values]).cast("binary"), 256)


def tree_name(source: Column) -> Column:
    """A name per source that sorts by UTF-8 bytes, null first."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def _join(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def widths(leaves: int) -> list[int]:
    """Number of nodes of each level of a tree, up to its root."""
    found = [leaves]
    while found[-1] > 1:
        found.append(-(-found[-1] // DEGREE))
    return found


def climb(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes above neighbours that begin at a multiple of ``DEGREE ** levels``, level by level."""
    found = [digests]
    for _ in range(levels):
        below = found[-1]
        found.append([_join(below[i : i + DEGREE]) for i in range(0, len(below), DEGREE)])
    return found


def missing_nodes(known: np.ndarray, width: Sequence[int]) -> list[tuple[int, int]]:
    """(level, position) of the fewest nodes that, with the known leaves, give all their proofs."""
    found: list[tuple[int, int]] = []
    known = np.unique(known)
    for level, n in enumerate(width[:-1]):
        parents = np.unique(known // DEGREE)
        children = (parents[:, None] * DEGREE + np.arange(DEGREE)).ravel()
        lost = np.setdiff1d(children[children < n], known, assume_unique=True)
        found += [(level, int(p)) for p in lost]
        known = parents
    return found


def _climber(levels: int, whole: bool):  # noqa: ANN202
    """Nodes above one partition: its top, or (``whole``) all nodes above its leaves."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        tree, width = table["tree"][0].as_py(), table["width"][0].as_py()
        level, position = table["level"][0].as_py(), table["position"][0].as_py()
        sizes = widths(width)[: levels + 1]
        nodes = climb(table["digest"].to_pylist(), len(sizes) - 1)
        rows = []
        for up in range(1 if whole else len(sizes) - 1, len(sizes)):
            first = position // DEGREE**up
            rows += [(tree, level + up, first + k, sizes[up], d) for k, d in enumerate(nodes[up])]
        names = [c.split()[0] for c in NODES.split(", ")]
        return pa.table(dict(zip(names, (list(c) for c in zip(*rows, strict=True)), strict=True)), schema=_NODE_SCHEMA)

    return run


_NODE_SCHEMA = pa.schema(
    [("tree", pa.string()), ("level", pa.int32()), ("position", pa.int64()), ("width", pa.int64()), ("digest", pa.string())]
)


def _partition_of(levels: int) -> Column:
    return F.expr(f"position div {DEGREE**levels}").alias("block")


def _above(leaves: DataFrame, levels: int, whole: bool) -> DataFrame:
    """One round: every partition of ``leaves`` (columns of NODES) climbs ``levels`` levels."""
    return leaves.groupBy("tree", _partition_of(levels)).applyInArrow(_climber(levels, whole), NODES)


@dataclass(frozen=True)
class Manifest:
    """Written tables: leaves (doc_id, source, tree, position, n, leaf, claimed), nodes above the
    leaf partitions, trees (tree, n, place, subroot), and the root (null for an empty dataset)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    sources: int
    levels: int


def _forest(space: Workspace, leaves: DataFrame, levels: int, whole: bool) -> DataFrame:
    """All nodes at the tops of leaf partitions and above; ``whole`` has those below the tops too."""
    rounds = [space.table(_above(leaves, levels, whole), "nodes")]
    level = levels
    while True:
        open_ = rounds[-1].filter((F.col("level") == level) & (F.col("width") > 1))
        if open_.isEmpty():
            break
        rounds.append(space.table(_above(open_, levels, True), "nodes"))
        level += levels
    found = rounds[0]
    for part in rounds[1:]:
        found = found.unionByName(part)
    return found


def build_manifest(
    docs: DataFrame, claimed: Column | None = None, space: Workspace | None = None, levels: int = LEVELS
) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text).

    ``claimed`` is the text that someone presents instead of a row's own; the leaf of the row with
    that text is kept beside the true one, for proofs. Null values have a code of their own; null
    sources form a tree and null ids come first in theirs. Rows of one id are ordered by their
    leaf, so repeated rows are leaves of their own and no order of input changes the root. Further
    columns are ignored. An empty table has no trees and no root.
    """
    space = space or Workspace(docs.sparkSession, "manifest")
    own = [docs[f"`{c}`"] for c in FIELDS]
    shown = own[:-1] + [own[-1] if claimed is None else claimed]
    digests = docs.select(
        own[0].cast("bigint").alias("doc_id"),
        own[1].alias("source"),
        tree_name(own[1]).alias("tree"),
        leaf_digest(*own).alias("leaf"),
        leaf_digest(*shown).alias("claimed"),
        F.monotonically_increasing_id().alias("spot"),
    )
    # Written first, so that texts are read once and equal rows keep their places.
    digests = space.table(digests, "digests")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("spot")]
    ranked = globally_ranked(digests, order, ["tree"], "position", "n", f"{space.root}/ordered")
    leaves = space.table(ranked.withColumn("position", F.col("position") - 1).drop("spot"), "leaves")
    bottom = leaves.select(
        "tree", F.lit(0).alias("level"), "position", F.col("n").alias("width"), F.col("leaf").alias("digest")
    )
    nodes = _forest(space, bottom, levels, whole=False)
    subroots = nodes.filter(F.col("width") == 1).select("tree", F.col("digest").alias("subroot"))
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    placed = globally_ranked(sizes.join(subroots, "tree"), [F.col("tree")], (), "place", None, f"{space.root}/placed")
    trees = space.table(placed.withColumn("place", F.col("place") - 1), "trees")
    sources = trees.count()
    if not sources:
        return Manifest(leaves, nodes, trees, None, 0, levels)
    crown = trees.select(
        F.lit(TOP).alias("tree"),
        F.lit(0).alias("level"),
        F.col("place").alias("position"),
        F.lit(sources).cast("bigint").alias("width"),
        F.col("subroot").alias("digest"),
    )
    nodes = nodes.unionByName(crown)
    if sources == 1:
        return Manifest(leaves, nodes, trees, trees.first()["subroot"], 1, levels)
    top = _forest(space, crown, levels, whole=True)
    root = top.filter(F.col("width") == 1).first()["digest"]
    return Manifest(leaves, nodes.unionByName(top), trees, root, sources, levels)


_ASKED = "tree STRING, block BIGINT, n BIGINT, place BIGINT, in_tree STRING, level INT, position BIGINT"


def _asker(levels: int, sources: int):  # noqa: ANN202
    """The coordinates that each leaf partition (tree, block, n, place) lacks, and one row without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, block, n, place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                first = block * DEGREE**levels
                known = np.arange(first, min(n, first + DEGREE**levels))
                rows.append((tree, block, n, place, None, None, None))
                rows += [(tree, block, n, place, tree, *c) for c in missing_nodes(known, widths(n))]
                rows += [(tree, block, n, place, TOP, *c) for c in missing_nodes(np.array([place]), widths(sources))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ASKED_TYPES, strict=True)], _ASKED_NAMES
            ) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _ASKED_TYPES], _ASKED_NAMES)

    return run


_ASKED_NAMES = [c.split()[0] for c in _ASKED.split(", ")]
_ASKED_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]


def _siblings(nodes: dict[int, str], position: int, width: int) -> tuple[list[str], list[str]]:
    """Digests left and right of a node within its run."""
    first = position // DEGREE * DEGREE
    run = range(first, min(first + DEGREE, width))
    return [nodes[p] for p in run if p < position], [nodes[p] for p in run if p > position]


def _prover(levels: int, sources: int, root: str):  # noqa: ANN202
    """All proofs of one leaf partition from its leaves and the nodes that it fetched."""

    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("position")
        if not leaves.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _PROOF_TYPES})
        n, place = fetched["n"][0].as_py(), fetched["place"][0].as_py()
        got: dict[tuple[str, int], dict[int, str]] = {}
        rows = zip(*[fetched[c].to_pylist() for c in ("in_tree", "level", "position", "digest")], strict=True)
        for tree, level, position, digest in rows:
            if tree is not None:
                got.setdefault((tree, level), {})[position] = digest
        tree_, start = leaves["tree"][0].as_py(), leaves["position"][0].as_py()
        own = widths(n)
        inner = climb(leaves["leaf"].to_pylist(), min(levels, len(own) - 1))
        # Above the partition all its documents share one path: through the source, then the top.
        path = []
        at, digest = start // DEGREE ** (len(inner) - 1), inner[-1][0]
        for level in range(len(inner) - 1, len(own) - 1):
            path.append(_siblings(got.get((tree_, level), {}), at, own[level]))
            digest, at = _fold(digest, [path[-1]]), at // DEGREE
        subroot, at = digest, place
        for level, width in enumerate(widths(sources)[:-1]):
            path.append(_siblings(got.get((TOP, level), {}), at, width))
            digest, at = _fold(digest, [path[-1]]), at // DEGREE
        shared = [d for pair in path for side in pair for d in side]
        steps: list[list] = [[path, shared]]
        # From the partition's top down: each node's steps are its own siblings and its parent's steps.
        for nodes in reversed(inner[:-1]):
            steps = [_extended(nodes, k, steps[k // DEGREE]) for k in range(len(nodes))]
        proofs = [s[1] for s in steps]
        folded = [_fold(c, s[0]) for c, s in zip(leaves["claimed"].to_pylist(), steps, strict=True)]
        count = leaves.num_rows
        columns = [
            leaves["doc_id"], leaves["leaf"], [subroot] * count, [root] * count, proofs, folded, [f == root for f in folded],
        ]
        return pa.table(
            {name: pa.array(c, kind) if isinstance(c, list) else c for (name, kind), c in zip(_PROOF_TYPES, columns, strict=True)}
        )

    return run


def _extended(nodes: list[str], k: int, parent: list) -> list:
    first = k // DEGREE * DEGREE
    left, right = nodes[first:k], nodes[k + 1 : first + DEGREE]
    return [[(left, right), *parent[0]], [*left, *right, *parent[1]]]


def _fold(digest: str, steps: Sequence[tuple[list[str], list[str]]]) -> str:
    """The root that a digest and its siblings lead to."""
    for left, right in steps:
        digest = _join([*left, digest, *right])
    return digest


PROOFS = (
    "doc_id BIGINT, leaf STRING, subroot STRING, root STRING, proof ARRAY<STRING>, folded_root STRING, verified BOOLEAN"
)
_PROOF_TYPES = list(
    zip(
        [c.split()[0] for c in PROOFS.split(", ")],
        [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()],
        strict=True,
    )
)


def prove_documents(manifest: Manifest) -> DataFrame:
    """Every document's proof against the manifest.

    ``proof`` lists the digests of siblings level by level up to the root, left to right;
    ``folded_root`` is where the claimed leaf leads with them, ``verified`` whether that is the root.
    """
    spark = manifest.leaves.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], PROOFS)
    levels, sources = manifest.levels, manifest.sources
    # Every leaf partition has one top among the nodes: at ``levels``, or the root of a small tree.
    tops = manifest.nodes.filter((F.col("tree") != TOP) & (F.col("level") <= levels))
    parts = tops.select("tree", F.col("position").alias("block"))
    asked = parts.join(manifest.trees.select("tree", "n", "place"), "tree").mapInArrow(_asker(levels, sources), _ASKED)
    there = manifest.nodes.select(F.col("tree").alias("in_tree"), "level", "position", "digest")
    fetched = asked.join(there, ["in_tree", "level", "position"], "left")
    leaves = manifest.leaves.select("tree", "position", "doc_id", "leaf", "claimed", _partition_of(levels))
    proved = leaves.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block"))
    return proved.applyInArrow(_prover(levels, sources, manifest.root), PROOFS)
