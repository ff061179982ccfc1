"""Extraction with and without a wrapper, broken pages, and both ways of joining wrappers."""

import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import main_text as m

ARTICLE = "<article><h1>Title &amp; more</h1><p>First   <b>bold</b>\n para&shy;graph.</p><p>Second<br>line<ul><li>one<li>two</ul></article>"
WANT = "Title & more\n\nFirst bold para\xadgraph.\n\nSecond line\n\none\n\ntwo"


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a>Home</a></ul></nav><header>Site</header>{ARTICLE}<footer>&copy;</footer></body></html>",
    f"<body><div class='cookie-notice'>We use cookies</div>{ARTICLE}<aside>Side</aside><section id=comments><article><p>I disagree</p></article></section></body>",
    f"<body><script>var x='</p><p>no';</script><!-- <p>no</p> --><form><p>Search</p></form>{ARTICLE}<div id='sidebar' >x</div><div class=ad>Buy</div>",
    f"<main>{ARTICLE}<div class='related posts'>More</div></main><p>outside</p>",
    ARTICLE.replace("</article>", "<div class=\"comments\"><p>First!</p></div></article>"),
    ARTICLE.replace("</p>", "").replace("</article>", ""),
    f"<body class='has-sidebar'><div class='content with-sidebar'>{ARTICLE.replace('<article>', '<article><header>').replace('</h1>', '</h1></header>')}</div><div id=header><h1>Site</h1></div></body>",
    ARTICLE.replace("<h1>", "<div class='entry-header'><h1>").replace("</h1>", "</h1></div>"),
    f"<body><div hidden>no</div><noscript>no</noscript>{ARTICLE}<p clas",
])
def test_marked_pages(page):
    assert m.extract(page, None) == WANT


@pytest.mark.parametrize(("page", "want"), [("", ""), ("plain words", "plain words"), ("<p>a < b &lt; c", "a < b < c"), ("<p>x</p  ><P>Y</P>", "x\n\nY"), ("<div><b>a<p>b</b>c</div>d", "a\n\nbc\n\nd"), ("<p>unclosed \"<a href='x>y'>link</a>", "unclosed \"link"), ("<<p>>x", "<\n\n>x"), ("<p>&#233;&eacute;&nbsp;&amp;amp;</p>", "éé &amp;"), ("<script>never closed <p>x", ""), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc")])
def test_broken_pages(page, want):
    assert m.extract(page, None) == want


def pages(n=12):
    """Pages of one host without any marks: a menu and a foot that don't change, a text that does."""
    body = "<body><div><span>Home</span></div><div><div>All rights</div><p>Story {0}</p><p>It goes on with {0} and so on.</p></div><div>Imprint</div></body>"
    return [(k, f"http://h.example.com/{k}", body.format(f"number {k}")) for k in range(n)]


def finished(found):
    """The wrapper as it is for these pages alone: candidates with exact counts."""
    inducer = m.Inducer()
    for _, url, page in found:
        inducer.add(m.host(url), page)
    wrap = m.Wrapper.load(inducer.wraps["h.example.com"].dump())
    return m.Finished(m.Finished.dump(wrap, wrap.candidates()))


def test_wrapper_finds_the_constant_nodes():
    wrap = finished(pages())
    assert m.extract(pages()[3][2], wrap) == "Story number 3\n\nIt goes on with number 3 and so on."
    other = "<body><div><span>Home</span></div><div><div>All rights</div><p>Other</p></div><div>Imprint</div></body>"
    assert m.extract(other, wrap) == "Other", "a layout that wasn't seen is aligned"
    assert m.extract(pages()[3][2], None) != m.extract(pages()[3][2], wrap), "the marks alone don't tell"


def test_merging_is_the_same_in_any_split():
    whole = m.Inducer()
    for _, url, page in pages():
        whole.add(m.host(url), page)
    merged = m.Wrapper()
    for k in range(3):
        one = m.Inducer()
        for _, url, page in pages()[k::3]:
            one.add(m.host(url), page)
        merged.merge(m.Wrapper.load(one.wraps["h.example.com"].dump()))
    want = whole.wraps["h.example.com"]
    assert (merged.label, merged.kids, merged.pages) == (want.label, want.kids, want.pages)
    assert [sorted(c) for c in merged.candidates()] == [sorted(c) for c in want.candidates()]


def plain_match(a, b, x=0, y=0):
    """Simple tree matching by direct recursion."""
    if a.label[x] != b.label[y]:
        return 0
    p, q = a.kids[x], b.kids[y]
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p)):
        for j in range(len(q)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_match(a, b, p[i], q[j]))
    return 1 + best[-1][-1]


SHAPES = st.recursive(st.sampled_from("abc").map(lambda t: (t, [])), lambda kids: st.tuples(st.sampled_from("abc"), st.lists(kids, max_size=4)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(SHAPES, max_size=4), st.lists(SHAPES, max_size=4))
def test_alignment_is_simple_tree_matching(one, two):
    def tree(forest):
        out = m.Tree()
        todo = [(0, forest)]
        for at, kids in todo:
            todo += [(out.add(at, label), below) for label, below in kids]
        return out

    a, b = tree(one), tree(two)
    found = m.align(a, b)
    assert len(found) == plain_match(a, b) and len(set(found.values())) == len(found)
    up = {k: p for p, kids in enumerate(a.kids) for k in kids}
    assert all(a.label[x] == b.label[y] and (x == 0 or y in b.kids[found[up[x]]]) for x, y in found.items())


def test_values_are_equal_where_texts_are():
    page = m.parse("<div><p>a  b</p><p>a b</p><p>a<br>b</p><ul><li>a b</ul></div><div><p>a b</p></div><p>c")
    each = m.values(page)
    p = [n for n, t in enumerate(page.tag) if t == "p"]
    assert each[p[0]] == each[p[1]] == each[p[3]] != each[p[2]] and each[p[4]] not in (each[p[0]], each[p[2]])


@pytest.mark.parametrize("tag", ["div", "b", "ul><li", "table><tr><td", "span>x<div"])
def test_deep_and_long_pages(tag):
    deep = "<article>" + f"<{tag}>" * 100_000 + "text" + "</p></li>" * 1000 + "<p>end" * 3
    assert m.extract(deep, None).endswith("text\n\nend\n\nend\n\nend")
    found = [(k, "http://h.example.com", f"<div>Same</div>{'<div>' * 20_000}number {k}") for k in range(4)]
    assert m.extract(found[1][2], finished(found)) == "number 1"
    assert m.extract("<p>word</p>" * 200_000, None) == "\n\n".join(["word"] * 200_000)


class Plain(HTMLParser):
    """What the contract asks of the driver's pages, by the standard library's parser: the article's blocks, nothing of what is marked as not main text."""

    BLOCK = ("article", "main", "p", "div", "h1", "h2", "h3", "ul", "ol", "li", "section", "table", "tr", "td", "th", "blockquote", "pre", "header", "nav", "aside", "footer", "form", "body", "html", "head")
    OUT = ("nav", "aside", "footer", "form", "script", "style", "head")
    NAMED = ("ad", "cookie", "comments", "sidebar", "related", "share", "newsletter")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.stack = [], [], []

    def end(self):
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("meta", "link", "img", "input", "hr"):
            if tag in self.BLOCK:
                self.end()
            named = re.split("[^a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")))
            self.stack.append((tag, tag in self.OUT or any(n in self.NAMED for n in named)))

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.stack]:
            if tag in self.BLOCK:
                self.end()
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(out for _, out in self.stack):
            self.parts.append(data)


def test_driver_pages_against_a_plain_extractor(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in m.extracted(rows).collect()}
    for r in rows.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        plain.end()
        assert got[r.page_id].text == "\n\n".join(plain.out)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_operator(spark, sent):
    rows = [*pages(), (100, "http://other.example.org:80/x", ARTICLE), (101, None, None), (102, "", ""), (103, "HTTP://H.example.com/y", "<body><div><span>Home</span></div></body>"), (0, *pages()[0][1:])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string").repartition(5)
    got = sorted((r.page_id, r.text, r.n_chars) for r in m.extracted(df, sent).collect())
    texts = [(k, f"Story number {k}\n\nIt goes on with number {k} and so on.") for k in [0, *range(12)]]
    texts += [(100, WANT), (101, ""), (102, ""), (103, "Home")]
    assert got == sorted((k, t, len(t)) for k, t in texts)
    assert m.extracted(df.where("false"), sent).count() == 0


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_constant_elements_among_varying_ones_are_template(spark, sent):
    """A notice among the paragraphs of the article, at a place that differs, and the cells of a table layout."""
    prose = lambda k: [f"<p>Story {k}, part {i}</p>" for i in range(3 + k % 5)]
    rows, want = [], {}
    for k in range(40):
        parts = prose(k)
        parts.insert(k % 3, "<p>Read also our letter</p>")
        rows.append((k, "http://a.org/x", f"<article><h1>Head {k}</h1>{''.join(parts)}</article>"))
        want[k] = "\n\n".join([f"Head {k}", *(f"Story {k}, part {i}" for i in range(3 + k % 5))])
        rows.append((100 + k, "http://b.org/x", f"<table><tr><td>Start</td><td>Contact</td></tr><tr><td>Text of {k}</td><td>More of {k}</td></tr><tr><td>All rights</td></tr></table>"))
        want[100 + k] = f"Text of {k}\n\nMore of {k}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in m.extracted(df, sent).collect()} == want
