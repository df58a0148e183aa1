"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can be last in a correct encoding.
A suffix automaton over the vocabulary gives, at each position, the vocabulary tokens that end
there; the one whose neighbour, the last token of the shorter prefix, does not merge across the
boundary is stored. Back-pointers then give the ids. The work is linear in the word for a bounded
token length, unlike merging pair by pair.

Texts are cut at ASCII white space, which no token, normalisation or pattern crosses; each
distinct word of a slice is cut into pieces once, and pieces, which words share, are looked up in a
bounded two-generation cache.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are
encoded one by one; columns of ``docs`` other than the text and those to keep are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import SLICE_BYTES, Workspace, begin, keeps_cache, ranges, slices, split_words

#: Offset that marks the last character of a word inside automaton strings.
WORD_END = 0x1000
#: Words kept per cache generation of a worker.
CACHED_WORDS = 300_000
NEVER = 1 << 60


def byte_characters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Generations:
    """A bounded memory: what the last two generations did not ask for is forgotten."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def peek(self, key: str) -> list[int] | None:
        found = self.young.get(key)
        return self.old.get(key) if found is None else found

    def get(self, key: str, compute: Callable[[str], list[int]]) -> list[int]:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = compute(key)
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found

    def keep(self, keys: list[str], values: list) -> None:
        """Remember some keys, far fewer than the limit, as asked for now."""
        if len(self.young) + len(keys) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update(zip(keys, values))


class SuffixAutomaton:
    """Of several strings: transitions, suffix links and lengths; strings end in states of their own length."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: str) -> int:
        """The state of the longest string of ``p`` with ``c`` appended, cloned out if it shares one."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: str) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        state = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        self.link[state] = self._split(p, c) if p >= 0 else 0
        return state

    def add(self, text: str) -> int:
        state = 0
        for c in text:
            state = self.extend(state, c)
        return state


class Encoder:
    """Ids of words for a BPE vocabulary with word ends, byte-level characters and lower case."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.characters = byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: name for name, i in (model["vocab"] | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.numerals = [str(i) for i in range(len(self.names))]
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        ids = model["vocab"]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.created: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.rank[a << 20 | b] = rank
            if whole not in self.parts:
                self.parts[whole], self.created[whole] = (a, b), rank
        self._pairs: dict[int, bool] = {}
        self._spines: dict[int, tuple[list, list]] = {}
        self._build({i: self._marked(name) for name, i in ids.items()})
        # Words differ in case and punctuation where pieces do not, so pieces have the room of words too.
        self._pieces = Generations(2 * cached)

    def _marked(self, name: str) -> str:
        if name.endswith(self.suffix) and len(name) > len(self.suffix):
            name = name[: -len(self.suffix)]
            return name[:-1] + chr(ord(name[-1]) + WORD_END)
        return name

    def _build(self, strings: dict[int, str]) -> None:
        automaton = SuffixAutomaton()
        reachable = [i for i in sorted(strings, key=lambda i: self.created.get(i, -1)) if self._reachable(i)]
        ends = {i: automaton.add(strings[i]) for i in reachable}
        size = len(automaton.next)
        self.next, self.link, self.length = automaton.next, automaton.link, automaton.length
        self.token = [-1] * size
        self.token_length = {i: len(strings[i]) for i in reachable}
        # Later strings may clone a state; look the final one up by walking.
        for i in ends:
            state = 0
            for c in strings[i]:
                state = self.next[state][c]
            self.token[state] = i
        self.above = [0] * size
        for state in sorted(range(1, size), key=self.length.__getitem__):
            up = self.link[state]
            self.above[state] = up if up <= 0 or self.token[up] >= 0 else self.above[up]

    def _spine(self, token: int) -> tuple[list, list]:
        """(right, left): the parts at that edge, from the token inwards, each with the rank that uses it up."""
        known = self._spines.get(token)
        if known is None:
            sides = []
            for side in (1, 0):
                part, until, line = token, NEVER, []
                while True:
                    line.append((part, until))
                    if part not in self.parts:
                        break
                    until, part = self.created[part], self.parts[part][side]
                sides.append(line)
            known = self._spines[token] = (sides[0], sides[1])
        return known

    def _crosses(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether a merge across the boundary comes before both sides are whole, or at all.

        Parts x and y meet if the pair's rank comes before x is used up, and no later than y is:
        of equal ranks the leftmost pair merges first.
        """
        rank = self.rank
        for x, x_until in self._spine(left)[0]:
            for y, y_until in self._spine(right)[1]:
                at = rank.get(x << 20 | y)
                if at is not None and at < before and at < x_until and at <= y_until:
                    return True
        return False

    def _reachable(self, token: int) -> bool:
        """Whether the token's own string is encoded as this token."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        ok = self._whole.get(left, True) and self._whole.get(right, True)
        ok = ok and not self._crosses(left, right, self.created[token])
        self._whole[token] = ok
        return ok

    @property
    def _whole(self) -> dict[int, bool]:
        return self.__dict__.setdefault("_whole_tokens", {})

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[key] = not self._crosses(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer."""
        characters = self.characters
        text = "".join([characters[b] for b in piece.encode("utf-8")])
        text = text[:-1] + chr(ord(text[-1]) + WORD_END)
        follow, link, length = self.next, self.link, self.length
        token, above, token_length = self.token, self.above, self.token_length
        known = self._pairs.get
        last = [0] * (len(text) + 1)
        state = matched = 0
        for i, c in enumerate(text, 1):
            while state and c not in follow[state]:
                state = link[state]
                matched = length[state]
            state = follow[state][c]
            matched += 1
            v = state if matched == length[state] and token[state] >= 0 else above[state]
            while True:
                t = token[v]
                j = i - token_length[t]
                if j:
                    fits = known(last[j] << 20 | t)
                    if fits is None:
                        fits = self.compatible(last[j], t)
                    if not fits:
                        v = above[v]
                        continue
                last[i] = t
                break
        out = []
        i = len(text)
        while i:
            out.append(last[i])
            i -= token_length[last[i]]
        return out[::-1]

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        if text.isalpha() and text.isascii():
            return self._piece(text)
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self._piece(piece)
        return out

    def _piece(self, piece: str) -> list[int]:
        return self._pieces.get(piece, self.encode_piece)

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text without ASCII white space."""
        if self.specials is None or "<" not in word:
            return self._plain(word)
        out: list[int] = []
        at = 0
        for found in self.specials.finditer(word):
            out += [*self._plain(word[at : found.start()]), self.special[found.group()]]
            at = found.end()
        return out + self._plain(word[at:])

    def decode(self, ids: list[int]) -> str:
        """Token names joined by spaces, as for a tokenizer file that names no decoder."""
        return " ".join([self.names[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str, cached: int = CACHED_WORDS) -> Encoder:
    """One per worker, vocabulary file and number of words kept."""
    return Encoder(path, cached)


keeps_cache("bpe", encoder.cache_clear)


class EncodedSlice:
    """Ids of the texts of one slice, by distinct word."""

    def __init__(self, texts: pa.Array, model: Encoder):
        words, self.codes, self.offsets = split_words(texts)
        found = [model.encode_word(w) for w in words.to_pylist()]
        self.model = model
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.fromiter(chain.from_iterable(found), np.int32, int(self.sizes.sum()))

    def counts(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.sizes[self.codes])])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def ids(self) -> pa.ListArray:
        """Ids of each text."""
        at = ranges(self.starts[self.codes], self.sizes[self.codes])
        ends = np.concatenate([[0], np.cumsum(self.counts())]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(self.table[at]))

    def _joined(self, names: list[str]) -> pa.Array:
        """One text per row: the ids' ``names`` joined by spaces, first within each distinct word."""
        used = np.flatnonzero(self.sizes)
        pieces = pa.array(names, pa.string()).take(pa.array(self.table))
        ends = np.concatenate([self.starts, [len(self.table)]]).astype(np.int32)
        per_word = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces), " ")
        codes, keep = self.codes, self.sizes[self.codes] > 0
        if len(used) < len(self.sizes):
            codes = codes[keep]
        ends = np.concatenate([[0], np.cumsum(keep)])[self.offsets].astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), per_word.take(pa.array(codes))), " ")

    def id_texts(self) -> pa.Array:
        """Decimal ids joined by spaces."""
        return self._joined(self.model.numerals)

    def decoded(self) -> pa.Array:
        return self._joined(self.model.names)


def _sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer() if t.is_valid else b"").hexdigest() for t in texts], pa.string())


def _digests(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        model = encoder(path)
        for part in slices(batches, "text"):
            found = EncodedSlice(part.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found.counts()), _sha256(found.id_texts()), _sha256(found.decoded())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    Workspace.ship(docs.sparkSession)
    schema = "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_digests(path), schema)


def _encode(path: str, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        model = encoder(path, CACHED_WORDS // 5)
        # Ids, both joined texts and digests are held at once, so slices are small here.
        for part in slices(batches, "text", SLICE_BYTES // 8):
            found = EncodedSlice(part.column("text"), model)
            columns = {"kept": part.column("kept"), "n_tokens": pa.array(found.counts()), "ids": found.ids()}
            if digest:
                columns |= {"ids_sha256": _sha256(found.id_texts()), "decoded_sha256": _sha256(found.decoded())}
            else:
                columns["decoded"] = found.decoded()
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _encoded(docs: DataFrame, path: str, kept: list[str], digest: bool) -> DataFrame:
    Workspace.ship(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("kept"), "text")
    last = "ids_sha256 STRING, decoded_sha256 STRING" if digest else "decoded STRING"
    kind = f"kept {rows.schema['kept'].dataType.simpleString()}, n_tokens BIGINT, ids ARRAY<INT>, {last}"
    out = rows.mapInArrow(_encode(path, digest), kind)
    return out.select("kept.*", *[c for c in out.columns if c != "kept"])


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with n_tokens, ids and the decoded text."""
    return _encoded(docs, path, list(keep), digest=False)


def encode_with_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``encode``, with SHA-256 of the joined ids and of the decoded text instead of the text."""
    return _encoded(docs, path, list(keep), digest=True)
