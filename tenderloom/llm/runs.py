"""Runs of repeated words by the branching-tandem test on an enhanced suffix array.

A slice of texts is one sequence of word numbers; every text ends in a mark of its own, and suffixes
are told apart by text first, so nothing is compared across texts. Over that sequence, in arrays:

1. The suffix array by prefix doubling, which sorts only suffixes that still tie, its inverse, and
   the LCP array, read from the ranks of the doubling rounds.
2. The LCP intervals by jumping to the nearest smaller neighbours. An interval of depth d holds the
   suffixes that share d words; positions of value d inside it separate its children.
3. The branching-tandem test: every suffix i of each child but the largest asks the inverse suffix
   array whether i + d (or i - d, for the second half) lies in the interval too, but not in i's own
   child. Then the d words at i are followed by the same d words, and the square cannot be moved right.
4. A run of period d has one such square, its last. Squares are rotated left as far as words agree,
   again by the ranks of the doubling rounds, and squares of one stretch are merged into the run of
   the smallest period.

For a least exponent e, a suffix must have its e - 2 predecessors at distance d in the interval as
well; this is exact and leaves few squares to rotate. No tree is built. The sum of all children but
the largest is at most n log n, whatever the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.common import Workspace, ranges, slices, split_words

#: Bytes of text of one slice; a longer text is a slice of its own.
SLICE = 2 << 20

#: Members of LCP intervals that are tested at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Runs:
    """Runs of a sequence of texts, by text, start and period; starts count within the text."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray

    @staticmethod
    def none() -> Runs:
        return Runs(*[np.zeros(0, np.int64)] * 4)


class SuffixArray:
    """Suffix array, its inverse and LCP of ``symbols``, whose every text ends in a number used once.

    ``ranks[j]`` names the first 2**j symbols of each suffix: equal names, equal symbols.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        heads = np.flatnonzero(np.diff(symbols[order], prepend=-1))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        self.ranks: list[np.ndarray] = []
        tied = self._tied(order, rank, np.arange(n))
        step = 1
        while len(tied):
            self.ranks.append(rank.astype(np.int32))
            at = order[tied]
            # Ties share their first ``step`` symbols, so the suffix ``step`` further on exists.
            key = rank[at] * n + rank[at + step]
            sorted_ = np.argsort(key)
            at, key = at[sorted_], key[sorted_]
            order[tied] = at
            new = np.flatnonzero(np.diff(key, prepend=-1))
            rank[at] = np.repeat(tied[new], np.diff(np.append(new, len(at))))
            tied = self._tied(order, rank, tied)
            step *= 2
        self.order = order
        self.inverse = rank
        self.lcp = np.zeros(n + 1, np.int64)
        if n > 1:
            self.lcp[1:n] = self.common(order[:-1], order[1:])

    @staticmethod
    def _tied(order: np.ndarray, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Those of ``places`` whose suffix shares its rank with a neighbour."""
        if len(places) < 2:
            return places[:0]
        r = rank[order[places]]
        same = r[1:] == r[:-1]
        return places[np.append(same, False) | np.insert(same, 0, False)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of what the suffixes at ``a`` and ``b`` (all different) share at their beginning."""
        length = np.zeros(len(a), np.int64)
        if not self.ranks:
            return length
        live = np.flatnonzero(self.ranks[0][a] == self.ranks[0][b])
        for j in range(len(self.ranks) - 1, -1, -1):
            x, y = a[live] + length[live], b[live] + length[live]
            length[live[self.ranks[j][x] == self.ranks[j][y]]] += 1 << j
        return length

    def common_before(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """As ``common``, leftwards from the symbols before ``a`` and ``b``, at most ``room``."""
        length = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            open_ = np.flatnonzero(length + (1 << j) <= room)
            x, y = a[open_] - length[open_] - (1 << j), b[open_] - length[open_] - (1 << j)
            length[open_[self.ranks[j][x] == self.ranks[j][y]]] += 1 << j
        return length


def nearest_smaller(values: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
    """For each of ``places``, the next place in direction ``step`` with a smaller value.

    Everything between a place and its pointer is at least as large, so a pointer may take over the
    pointer of what it points to; pointers at least double where values do not fall.
    """
    to = np.arange(len(values), dtype=np.int64) + step
    live = places
    while len(live):
        live = live[values[to[live]] >= values[live]]
        to[live] = to[to[live]]
    return to


def squares(array: SuffixArray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, d) of the last square of every run of period d with at least ``exponent`` periods.

    Periods that are multiples of a smaller one are among them.
    """
    lcp, order, inverse = array.lcp, array.order, array.inverse
    found_at, found_d = [], []
    inner = np.flatnonzero(lcp > 0)
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = nearest_smaller(lcp, inner, -1), nearest_smaller(lcp, inner, 1)
    # The interval has at least the predecessors, both halves of the square.
    inner = inner[right[inner] - left[inner] >= exponent]
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Members of an interval are the places left .. right - 1; equal bounds, equal interval.
    by = np.argsort(left[inner] * (len(lcp) + 1) + right[inner], kind="stable")
    inner = inner[by]
    low, high = left[inner], right[inner]
    first = np.flatnonzero((np.diff(low, prepend=-1) != 0) | (np.diff(high, prepend=-1) != 0))
    cuts = np.diff(np.append(first, len(inner)))
    group = np.repeat(np.arange(len(first)), cuts)
    # Children: one before each cut, and one after the last cut.
    begin = np.empty(len(inner) + len(first), np.int64)
    end = np.empty_like(begin)
    owner = np.empty_like(begin)
    slot = np.arange(len(inner)) + group
    begin[slot] = np.where(np.isin(np.arange(len(inner)), first), low, np.roll(inner, 1))
    end[slot], owner[slot] = inner, group
    last = first + cuts - 1
    slot = last + np.arange(len(first)) + 1
    begin[slot], end[slot], owner[slot] = inner[last], high[first], np.arange(len(first))
    size = end - begin
    heads = first + np.arange(len(first))
    largest = np.maximum.reduceat(size, heads)
    is_largest = size == largest[owner]
    # One of them only, if several are largest.
    seen = np.cumsum(is_largest)
    before = (seen[heads] - is_largest[heads])[owner]
    chosen = np.flatnonzero(~(is_largest & (seen - before == 1)))
    depth, low, high = lcp[inner[first]], low[first], high[first]
    ends = np.cumsum(size[chosen])
    at = 0
    while at < len(chosen):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        part = chosen[at:stop]
        at = stop
        members = order[ranges(begin[part], size[part])]
        child = np.repeat(part, size[part])
        d = depth[owner[child]]
        for first_half in (members, members - d):
            ok = _tandem(first_half, members, d, child, begin, end, low[owner[child]], high[owner[child]], inverse, exponent)
            found_at.append(first_half[ok])
            found_d.append(d[ok])
    return np.concatenate(found_at), np.concatenate(found_d)


def _tandem(
    place: np.ndarray, member: np.ndarray, d: np.ndarray, child: np.ndarray, begin: np.ndarray, end: np.ndarray,
    low: np.ndarray, high: np.ndarray, inverse: np.ndarray, exponent: int,
) -> np.ndarray:
    """Whether the d symbols at ``place`` end a stretch of ``exponent`` copies and branch there."""
    n = len(inverse)
    ok = (place - (exponent - 2) * d >= 0) & (place + d < n)
    live = np.flatnonzero(ok)
    # The other half of the square belongs to another child: the square branches.
    other = inverse[np.where(place[live] == member[live], place[live] + d[live], place[live])]
    c = child[live]
    fits = (other >= low[live]) & (other < high[live]) & ~((other >= begin[c]) & (other < end[c]))
    ok[live[~fits]] = False
    live = live[fits]
    for back in range(1, exponent - 1):
        there = inverse[place[live] - back * d[live]]
        fits = (there >= low[live]) & (there < high[live])
        ok[live[~fits]] = False
        live = live[fits]
    return ok


def find_runs(codes: np.ndarray, offsets: np.ndarray, exponent: int = 4, shortest: int = 6) -> Runs:
    """Runs of at least ``exponent`` (2 or more) periods and ``shortest`` words in every text.

    ``codes`` numbers the words, ``offsets`` tells where each text starts.
    """
    counts = np.diff(offsets)
    used = np.flatnonzero(counts >= max(shortest, exponent))
    if not len(used):
        return Runs.none()
    counts = counts[used]
    words = codes[ranges(offsets[used], counts)].astype(np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    text = np.repeat(np.arange(len(used)), counts)
    width = int(words.max()) + 2
    symbols = np.zeros(len(words) + len(used), np.int64)
    symbols[ranges(starts, counts)] = text * width + words + 1
    # The mark of a text is smaller than its words and larger than those of earlier texts.
    symbols[starts + counts] = np.arange(len(used)) * width
    array = SuffixArray(symbols)
    place, d = squares(array, exponent)
    if not len(place):
        return Runs.none()
    text = np.searchsorted(starts, place, "right") - 1
    moved = array.common_before(place, place + d, place - starts[text])
    start, stop = place - moved, place + 2 * d
    by = np.lexsort((d, stop, start))
    start, stop, d, text = start[by], stop[by], d[by], text[by]
    new = (np.diff(start, prepend=-1) != 0) | (np.diff(stop, prepend=-1) != 0)
    keep = np.flatnonzero(new)
    keep = keep[stop[keep] - start[keep] >= shortest]
    by = keep[np.lexsort((d[keep], start[keep]))]
    return Runs(used[text[by]], (start - starts[text])[by], (stop - start)[by], d[by])


def dropped_words(runs: Runs, offsets: np.ndarray) -> np.ndarray:
    """Flags of the words that some run holds after its first period."""
    change = np.zeros(int(offsets[-1]) + 1, np.int64)
    begin = offsets[runs.text] + runs.start
    np.add.at(change, begin + runs.period, 1)
    np.add.at(change, begin + runs.length, -1)
    return np.cumsum(change[:-1]) > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_slice(texts: pa.Array, exponent: int, shortest: int) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of every text of a slice."""
    words, codes, offsets = split_words(texts)
    runs = find_runs(codes, offsets, exponent, shortest)
    kept = ~dropped_words(runs, offsets)
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int32)
    names = words.take(pa.array(codes[kept]))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names), " ")
    limits = np.searchsorted(runs.text, np.arange(len(offsets))).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(a) for a in (runs.start, runs.length, runs.period)], fields=list(RUN))
    return pa.ListArray.from_arrays(pa.array(limits), rows), collapsed


def _collapser(exponent: int, shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            runs, collapsed = collapse_slice(part.column("text"), exponent, shortest)
            yield pa.RecordBatch.from_arrays([part.column("kept"), runs, collapsed], ["kept", "runs", "collapsed"])

    return run


def collapse_runs(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), exponent: int = 4, shortest: int = 6
) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` (text, ...) with ``runs`` and ``collapsed``.

    ``runs`` are the maximal stretches of words with a period of which they hold at least
    ``exponent`` and that have at least ``shortest`` words: (start, length, smallest period), by
    start, then period. ``collapsed`` has the words that no run holds after its first period, joined
    by one space. A null text has no words; a row without runs has an empty array. Repeated rows and
    null ids stay as they are, an empty table gives no rows, further columns are left out. A kept
    column may not be called ``runs`` or ``collapsed``.
    """
    if exponent < 2 or shortest < 1:
        raise ValueError("a run has at least two periods and one word")
    if {"runs", "collapsed"} & set(keep):
        raise ValueError("runs and collapsed are names of results")
    Workspace.ship(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("kept"), "text")
    found = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
    schema = T.StructType([rows.schema["kept"]]).add("runs", T.ArrayType(found)).add("collapsed", T.StringType())
    return rows.mapInArrow(_collapser(exponent, shortest), schema).select("kept.*", "runs", "collapsed")
