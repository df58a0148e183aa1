"""Wrappers on invented templates, and the pipeline against its stages' rules."""

import html
import re

import pytest
from llm.helpers import documents, prose

import corpus_pipeline
from tenderloom.llm.queries import QUERIES
from tenderloom.llm.wrappers import extract, extract_pages, infer, parse

DATA = "/root/testdata/sf0.001"


def news(k):
    related = "".join(f"<li><a href='/{j}'>{prose(j, 3)}</a>" for j in range(k % 4))
    return (
        f"<html><head><title>t{k}</title><script>if (a < b) '</p>'</script></head><body><header><h1>Daily</h1></header>"
        f"<nav><ul><li><a href=/>Home</a></ul></nav><div class='layout'><div id='main-content'><h2>Title {k}</h2>"
        f"<p>{prose(k, 40)} &amp; more<p>Sec<b>ond</b>  {k}<br>line&nbsp;two</p><div class=callout>Read our letter every week</div>"
        f"<ul class='related-links'>{related}</ul></div><div class='side-bar x1'><p>{prose(k + 50, 30)}</div></div>"
        f"<section id=comments><p>{prose(k + 90, 20)}</p></section><form><p>Mail</form><footer>end {k}</footer>"
    )


def expected(k):
    return f"Title {k}\n\n{prose(k, 40)} & more\n\nSecond {k} line two"


def test_article_without_named_element():
    pages = [news(k) for k in range(8)]
    wrapper = infer(pages).as_list()
    assert [extract(p, wrapper) for p in pages] == [expected(k) for k in range(8)]


REPEATED = {
    "sections": ("<div>", "<section><p>{}</p></section>", "</div>"),
    "divs": ("", "<div><p>{}</p></div>", ""),
    "rows": ("<table>", "<tr><td>{}</td></tr>", "</table>"),
    "articles": ("<main>", "<article><p>{}</p></article>", "</main>"),
    "articles between rules": ("", "<article><p>{}</p></article><hr>", ""),
    "articles in rows": ("", "<div class=row><article><p>{}</p></article></div>", ""),
    "named blocks": ("<div>", "<div class=content><p>{}</p></div>", "</div>"),
    "nested": ("<div>", "<section><div><div><p>{}</p></div></div></section>", "</div>"),
}


@pytest.mark.parametrize("layout", REPEATED)
def test_every_repetition_of_the_content_is_read(layout):
    first, each, last = REPEATED[layout]
    texts = [[prose(100 * k + j, 30 + 5 * j) for j in range(1 + k % 4)] for k in range(9)]
    pages = ["<html><body><nav><a href=/>Home</a></nav>" + first + "".join(map(each.format, t)) + last for t in texts]
    for known in (infer(pages).as_list(), infer(pages[:1]).as_list(), None):
        assert [extract(p, known) for p in pages] == ["\n\n".join(t) for t in texts]


def test_pages_of_two_hosts_and_awkward_rows(spark):
    rows = [(k, f"http://News.example.org/{k}", news(k)) for k in range(8)]
    rows += [(20, None, "<article><p>alone"), (21, "http://x.example/", None), (22, "x", ""), (23, "y", "plain <b>words")]
    rows += [(24, "http://x.example/", "<article><p>cut <a href='"), (0, "http://news.example.org/0", news(0))]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract_pages(df).collect())
    want = [(k, expected(k), len(expected(k))) for k in range(8)] + [(0, expected(0), len(expected(0)))]
    want += [(20, "alone", 5), (21, "", 0), (22, "", 0), (23, "plain words", 11), (24, "cut", 3)]
    assert got == sorted(want)
    assert extract_pages(df.limit(0)).count() == 0


def test_given_pages(spark):
    got = {r.page_id: r.text for r in QUERIES["op2_main_text"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        assert got[r.page_id] == "\n\n".join(p for p in plain if p)


def test_unclosed_and_misplaced_tags():
    root = parse("<ul><li>a<li>b</ul></div><p>c<table><tr><td>d<td>e</table>")
    assert [getattr(c, "tag", c) for c in root.children] == ["ul", "p", "table"]


def test_pipeline_stages_keep_columns_and_follow_on(spark, tmp_path):
    docs = documents(spark).dropDuplicates(["doc_id"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert len(ids["toxicity"]) == 54
    # Too few words or too many repeats go: 3 to 11.
    assert ids["quality_rules"] == [0, 1, 2, 12, 13, *range(100, 140)]
    assert ids["ngram_jaccard"] == [0, 13, *range(100, 140)]
    assert set(ids["mixing"]) <= set(ids["ngram_jaccard"]) and len(ids["mixing"]) > len(ids["ngram_jaccard"])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == ids["mixing"]
    assert all(r.n_tokens == len(r.ids) for r in out)
