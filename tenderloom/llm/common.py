"""Helpers of the corpus operators: shared tables, words as Arrow dictionaries, sets of rows.

The word definition of every operator is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.
Arrow's ASCII white-space split uses exactly that set.
"""

from __future__ import annotations

import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.session import scratch_dir

#: Fixed value: white space of the word definition, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"

#: Bytes of text handled at once inside a task; longer single texts form a slice of their own.
SLICE_BYTES = 16 << 20

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


class Workspace:
    """A fresh folder below ``spark.checkpoint.dir`` for the tables of one operator call.

    Written tables replace lineage: a lost executor costs only the running tasks.
    The folder stays, because results are lazy and read from it.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = scratch_dir(spark, purpose)
        self.ship(spark)

    @staticmethod
    def ship(spark: SparkSession) -> None:
        """Let workers on this machine find the package wherever the driver was started."""
        spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def mounted(self) -> bool:
        return urlparse(self.root).scheme in ("", "file")

    def mount(self, name: str) -> str:
        """A folder for memory-mapped arrays; the shared folder must be mounted on every machine."""
        url = urlparse(self.root)
        if not self.mounted():
            raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {url.scheme}://")
        path = os.path.join(url.path, name)
        os.makedirs(path, exist_ok=True)
        return path


#: What empties the caches that operators keep in a worker, by operator; the operator that ran last.
_CACHES: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def keeps_cache(owner: str, clear: Callable[[], None]) -> None:
    """Name what empties an operator's cache in this worker."""
    _CACHES[owner] = clear


def begin(owner: str) -> None:
    """At the start of a task: workers outlive stages, so what other operators have kept goes now."""
    if _LAST and _LAST[0] != owner:
        for name, clear in _CACHES.items():
            if name != owner:
                clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
    _LAST[:] = [owner]


def frees(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives its freed memory back: it waits beside later stages that need no Python."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return whole


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids count as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


def save_array(path: str, array: np.ndarray) -> None:
    """Atomic write, so that a repeated task attempt leaves the same file."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, path)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of at most ``limit`` bytes of one column, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, a code per word, where each text's words start), nulls as empty."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    words = coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        counts = np.concatenate([[0], np.cumsum(keep)])
        offsets = counts[offsets]
        codes = codes[keep]
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return words, codes, offsets


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of every range, one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
