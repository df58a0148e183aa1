"""Main text of pages through wrappers inferred per host.

A wrapper is a union-free regular expression over the tags of a host's pages: every element has a
sequence of parts, each an element expression or a text slot, which may be optional or repeated.
It starts as one page and is generalised page by page: the sequences below equal elements are
aligned; neighbours of the same kind become one repeated part, and parts that only one side has
become optional. Slots remember their text while it is the same on every page.

The expression then shows where a host keeps its article: the ``article`` or ``main`` element, else
the deepest element that holds most of the text that differs between pages and lies outside links
and marked boilerplate; where that text is in a repeated part, the element around all repetitions.
Every element of a page that matches the content part is read, in order. Slots of one fixed text
inside it, seen on all of several different pages, are notices. A page is read along its host's wrapper; parts that the wrapper does not know follow
the same rules on their own.

A wrapper is learned from at most ``SAMPLE_PAGES`` pages of its host, the first by a hash of the
id; every page is read whole. Hosts are independent; pages are not moved by host, because wrappers
are sent to the pages, by broadcast while their number and size stay below checked bounds.

Defined results: null or empty html gives an empty text; a null url belongs to one nameless host;
unclosed elements end where HTML implies it, cut-off markup is dropped; repeated rows are read one
by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.llm.common import Workspace, slices

SAMPLE_PAGES = 12
#: Wrappers sent to every task, and their total characters; beyond, they are joined by host.
BROADCAST_HOSTS = 100_000
BROADCAST_CHARS = 64 << 20
#: A fixed text must be on so many different pages, all of the sample, to be a notice.
NOTICE_PAGES = 5

RAW = "script|style|noscript|template|textarea|svg|iframe|xmp|noembed|noframes|title"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: What a start tag closes, up to the nearest of the second set.
IMPLIED = {
    **{t: (frozenset(["p"]), frozenset("td th table button".split())) for t in BLOCK - {"html", "head", "body", "option"}},
    "li": (frozenset("li p".split()), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd p".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd p".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th p".split()), frozenset(["table"])),
    "td": (frozenset("td th p".split()), frozenset("tr table".split())),
    "th": (frozenset("td th p".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
DROPPED_TAGS = frozenset(
    "nav footer aside form button select textarea input menu dialog head title fieldset".split()
)
#: Words in class, id or role that mark boilerplate.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices alert warning "
    "newsletter subscribe subscription signup login share sharing social comment comments reply replies discussion "
    "disqus related recommended recommendation popular trending widget toolbar pagination pager search popup modal "
    "overlay copyright legal disclaimer form contentinfo complementary hidden".split()
)
CONTENT_WORDS = frozenset("article content post entry story main".split())
#: Elements whose fixed text can be a notice; words inside a paragraph and headings cannot.
NOTICE_TAGS = frozenset("div p section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Node:
    """An element; ``name`` is its tag with its class, id and role words."""

    tag: str
    name: str
    words: frozenset[str]
    children: list[Node | str] = field(default_factory=list)

    @property
    def boilerplate(self) -> bool:
        return self.tag in DROPPED_TAGS or bool(self.words & DROPPED_WORDS)


def _name(tag: str, attributes: str) -> tuple[str, frozenset[str]]:
    words = []
    for found in ATTRIBUTE.finditer(attributes):
        if found[1].lower() == "hidden":
            words.append("hidden")
        else:
            words += re.split(r"[^a-z]+", html.unescape(found[2] or found[3] or found[4] or "").lower())
    kept = sorted({w for w in words if w})
    return ".".join([tag, *kept[:4]]), frozenset(kept)


def parse(page: str) -> Node:
    """The page's tree; scripts, styles, comments and declarations are left out."""
    root = Node("", "", frozenset())
    stack = [root]
    at = 0
    for found in TOKEN.finditer(page):
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if found["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        closes, limits = IMPLIED.get(tag, (frozenset(), frozenset()))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in limits:
                break
            if stack[k].tag in closes:
                del stack[k:]
        attributes = found["attributes"]
        node = Node(tag, *(_name(tag, attributes) if attributes.strip(" /") else (tag, frozenset())))
        stack[-1].children.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


TEXT = "#"


@dataclass
class Part:
    """An element expression or a text slot (name ``#``) of a wrapper."""

    name: str
    optional: bool = False
    repeated: bool = False
    #: Of a slot: its text while all pages agree, else None; of an element: its parts.
    text: str | None = None
    parts: list[Part] = field(default_factory=list)
    #: Characters outside links that the pages have here, and on how many pages it was seen.
    chars: int = 0
    pages: int = 1
    role: str = ""

    def as_list(self) -> list:
        return [self.name, self.role, [p.as_list() for p in self.parts]]


def _plain(text: str) -> str:
    return " ".join(html.unescape(text).split())


def expression(node: Node, in_link: bool = False) -> Part:
    """The expression of one page's element, with neighbours of one kind joined."""
    out = Part(node.name)
    in_link = in_link or node.tag == "a"
    for child in node.children:
        if isinstance(child, str):
            text = _plain(child)
            if text:
                out.parts.append(Part(TEXT, text=text, chars=0 if in_link else len(text)))
        else:
            out.parts.append(expression(child, in_link))
    out.parts = _fold(out.parts)
    return out


def _fold(parts: list[Part]) -> list[Part]:
    """Equal neighbours as one repeated part."""
    out: list[Part] = []
    for part in parts:
        if out and out[-1].name == part.name and part.name != TEXT:
            out[-1] = _merge(out[-1], part)
            out[-1].repeated = True
            out[-1].pages = part.pages
        else:
            out.append(part)
    return out


def _aligned(left: list[Part], right: list[Part]) -> Iterator[tuple[Part | None, Part | None]]:
    """Longest common subsequence of the parts' names, with what lies between its members."""
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            if left[i].name == right[j].name:
                best[i][j] = best[i + 1][j + 1] + 1
            else:
                best[i][j] = max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n and j < m:
        if left[i].name == right[j].name:
            yield left[i], right[j]
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            yield left[i], None
            i += 1
        else:
            yield None, right[j]
            j += 1
    for part in left[i:]:
        yield part, None
    for part in right[j:]:
        yield None, part


def _merge(left: Part, right: Part) -> Part:
    """The least expression of this form that covers both."""
    out = Part(
        left.name,
        left.optional or right.optional,
        left.repeated or right.repeated,
        left.text if left.text == right.text else None,
        chars=left.chars + right.chars,
        pages=left.pages + right.pages,
    )
    for a, b in _aligned(left.parts, right.parts):
        if a and b:
            out.parts.append(_merge(a, b))
        else:
            alone = a or b
            alone.optional = True
            out.parts.append(alone)
    out.parts = _fold_merged(out.parts)
    return out


def _fold_merged(parts: list[Part]) -> list[Part]:
    out: list[Part] = []
    for part in parts:
        if out and out[-1].name == part.name:
            pages = max(out[-1].pages, part.pages)
            out[-1] = _merge(out[-1], part)
            out[-1].repeated, out[-1].pages = True, pages
        else:
            out.append(part)
    return out


def _words(name: str) -> tuple[str, frozenset[str]]:
    tag, *words = name.split(".")
    return tag, frozenset(words)


def _dropped(name: str, inside: bool) -> bool:
    tag, words = _words(name)
    if tag in DROPPED_TAGS or words & DROPPED_WORDS:
        return True
    return not inside and (tag == "header" or "header" in words)


def _weight(part: Part) -> int:
    """Characters that may be article text."""
    if part.name == TEXT:
        return part.chars if part.text is None or part.pages < 2 else 0
    return 0 if _dropped(part.name, False) else sum(map(_weight, part.parts))


def _content(root: Part) -> list[Part]:
    """The content part; of a named one also its siblings of the same name."""
    named: list[tuple[int, int, list[Part]]] = []

    def walk(part: Part, siblings: list[Part]) -> None:
        tag, words = _words(part.name)
        rank = 3 if tag == "article" else 2 if tag == "main" or "main" in words else 1 if words & CONTENT_WORDS else 0
        if _dropped(part.name, False):
            return
        if rank:
            equal = [p for p in siblings if p.name == part.name]
            named.append((rank, sum(map(_weight, equal)), equal))
        for below in part.parts:
            if below.name != TEXT:
                walk(below, part.parts)

    walk(root, [root])
    total = _weight(root)
    for rank in (3, 2, 1):
        found = [(w, k) for k, (r, w, _) in enumerate(named) if r == rank]
        if found and (max(found)[0] * 2 >= total or rank > 1):
            return named[max(found, key=lambda x: (x[0], -x[1]))[1]][2]
    part = root
    while True:
        below = [(_weight(p), -k) for k, p in enumerate(part.parts) if p.name != TEXT]
        if not below or max(below)[0] * 5 < total * 4:
            return [part]
        child = part.parts[-max(below)[1]]
        if child.repeated or _words(child.name)[0] in HEADINGS | {"p", "pre", "blockquote"}:
            return [part]
        part = child


def _mark(root: Part, pages: int) -> Part:
    """Give the content element and notices their roles."""
    content = _content(root)
    for part in content:
        part.role = "content"

    def notices(part: Part) -> None:
        for below in part.parts:
            fixed = _words(below.name)[0] in NOTICE_TAGS and not below.repeated and below.parts
            if fixed and pages >= NOTICE_PAGES and below.pages >= pages:
                texts = [p for p in below.parts if p.name == TEXT]
                if len(texts) == len(below.parts) and all(t.text is not None and t.pages >= pages for t in texts):
                    below.role = "notice"
                    continue
            if below.name != TEXT:
                notices(below)

    for part in content:
        notices(part)
    return root


def infer(pages: list[str]) -> Part:
    """The wrapper of a host from some of its pages."""
    different = list(dict.fromkeys(pages))
    wrapper = expression(parse(different[0]))
    for page in different[1:]:
        wrapper = _merge(wrapper, expression(parse(page)))
    return _mark(wrapper, len(different))


def _follow(node: Node, known: list | None) -> Iterator[tuple[Node | str, list | None]]:
    """Children with the wrapper parts that they match, in order where possible."""
    parts = known[2] if known else []
    at = 0
    for child in node.children:
        if isinstance(child, str):
            yield child, None
            continue
        hit = next((k for k in range(at, len(parts)) if parts[k][0] == child.name), None)
        if hit is None:
            hit = next((k for k in range(at) if parts[k][0] == child.name), None)
        else:
            at = hit
        yield child, parts[hit] if hit is not None else None


def _find(node: Node, known: list) -> Iterator[tuple[Node, list]]:
    """All elements that match a content part, in the page's order."""
    if known[1] == "content":
        yield node, known
        return
    for child, part in _follow(node, known):
        if part:
            yield from _find(child, part)


def _collect(node: Node, known: list | None, blocks: list[list[str]]) -> None:
    for child, part in _follow(node, known):
        if isinstance(child, str):
            blocks[-1].append(html.unescape(child))
            continue
        if child.boilerplate or (part and part[1] == "notice"):
            continue
        if child.tag == "br":
            blocks[-1].append(" ")
        elif child.tag in BLOCK:
            blocks.append([])
            _collect(child, part, blocks)
            blocks.append([])
        else:
            _collect(child, part, blocks)


def extract(page: str, wrapper: list | None) -> str:
    """The main text of a page: its blocks joined by an empty line."""
    root = parse(page)
    found = list(_find(root, wrapper)) if wrapper else []
    if not found:
        own = _mark(expression(root), 1).as_list()
        found = list(_find(root, own)) or [(root, own)]
    blocks: list[list[str]] = [[]]
    for node, known in found:
        _collect(node, known, blocks)
        blocks.append([])
    texts = [" ".join("".join(b).split()) for b in blocks]
    return "\n\n".join([t for t in texts if t])


@lru_cache(maxsize=1024)
def _loaded(wrapper: str) -> list:
    return json.loads(wrapper)


def _infer(table: pa.Table) -> pa.Table:
    wrapper = infer(table["html"].to_pylist())
    return pa.table({"host": table["host"].slice(0, 1), "wrapper": pa.array([json.dumps(wrapper.as_list())])})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        wrappers = part.column("wrapper").to_pylist()
        texts = [
            extract(page, _loaded(w) if w else None) if page else ""
            for page, w in zip(part.column("html").to_pylist(), wrappers)
        ]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def with_hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host.alias("host"))


def learn_wrappers(space: Workspace, pages: DataFrame) -> DataFrame:
    """``host, wrapper`` from the rows of ``with_hosts``; written."""
    order = Window.partitionBy("host").orderBy(F.xxhash64("page_id"), "page_id")
    some = pages.filter(F.length("html") > 0).select("host", "page_id")
    some = some.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE_PAGES)
    some = space.table(some.select("host", "page_id").distinct(), "sample")
    chosen = F.broadcast(some) if some.count() <= BROADCAST_HOSTS * SAMPLE_PAGES else some
    sample = pages.filter(F.length("html") > 0).join(chosen.dropna(), ["host", "page_id"], "left_semi")
    rank = Window.partitionBy("host").orderBy("page_id", F.xxhash64("html"))
    sample = sample.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= SAMPLE_PAGES)
    kind = "host STRING, wrapper STRING"
    return space.table(sample.select("host", "html").groupBy("host").applyInArrow(_infer, kind), "wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    space = Workspace(pages.sparkSession, "wrappers")
    rows = with_hosts(pages)
    wrappers = learn_wrappers(space, rows)
    size = wrappers.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("wrapper")), F.lit(0)).alias("c")).first()
    small = size["n"] <= BROADCAST_HOSTS and size["c"] <= BROADCAST_CHARS
    joined = rows.join(F.broadcast(wrappers) if small else wrappers, "host", "left")
    kind = "page_id BIGINT, url STRING, text STRING, n_chars BIGINT"
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, kind)
