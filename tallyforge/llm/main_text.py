"""Main text of pages by wrapper induction.

Every page becomes a tree in which neighbouring elements of one kind are one node,
each element with a hash of the text below it. The trees of a host are aligned by
simple tree matching and merged into a wrapper: tasks merge the pages they read,
then wrappers are merged host by host in two steps, so all pages take part and no
task holds more than wrappers. At each node the wrapper keeps the texts that may
be on most pages (a frequent-items summary, which loses none that are); a second
pass over the pages aligns them with the finished wrapper and counts these texts
exactly, each once a page. What at least SHARE of a node's pages hold is template,
wherever it stands among its neighbours; the varying slots are content. Wrappers
are small; if all of them together are at most SENT_BYTES they go to the tasks,
else pages are joined with the wrapper of their host.

Text is taken from the varying slots, without what HTML itself marks as not the
article: menus, headers, footers, asides, forms, what isn't shown (``hidden`` and
``aria-hidden``), and elements whose class, id or role names a menu, notice,
advert, sidebar or comments. Where a page has an ``article`` or ``main`` element
only that counts. The head of an article is its own.

Defined results: null, empty and textless pages give the empty string; pages of
any depth and length are read whole; a host of fewer than FEW pages (MANY inside
the article) has no template, so the marks decide alone; where all text would be
template the marks decide alone too; the same page twice is extracted twice, and
repeated or null ids don't matter; a null url is a host of its own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed, chunks, tidy
from tallyforge.llm.dom import BLOCKS, Page, parse

#: Pages that make a constant node template, outside and inside the article, and the share of them that must agree.
FEW, MANY, SHARE = 3, 8, 0.8
#: Texts kept for each element that a page has at a wrapper node. Any number above 1 / SHARE loses no text that is template.
VALUES = 8
SENT_BYTES = 64 << 20
PAGE_BYTES = 2 << 20
#: Elements that come in rows, and how many other neighbours of one label are aligned one by one.
ROWS = frozenset(["p", "li", "tr", "td", "th", "dt", "dd", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"])
APART = 8
#: Layouts whose alignment one task remembers.
REMEMBERED = 20_000

#: Elements that never hold main text.
OUTSIDE = frozenset(["script", "style", "noscript", "template", "head", "nav", "aside", "footer", "form", "button", "select", "input", "textarea", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "menu", "dialog", "title", "meta", "link"])
#: Words of class, id and role that name what isn't main text.
NAMES = frozenset(["ad", "ads", "adv", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"])

#: Those that are believed whatever the element holds.
SURE = frozenset(["breadcrumb", "breadcrumbs", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "pagination"])

_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*:/*(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def excluded(page: Page, node: int, in_article: bool) -> bool:
    """Whether HTML or its naming marks the element as not main text.

    A name such as ``with-sidebar`` on what holds the page's heading tells of the
    layout and excludes nothing.
    """
    tag = page.tag[node]
    if tag in OUTSIDE or page.hidden[node] or tag == "header" and not in_article:
        return True
    if not page.name[node] or tag in ("html", "body", "main"):
        return False
    found = NAMES.intersection(_SPLIT.split(page.name[node]))
    if in_article:
        found -= {"header"}
    return bool(found) and (not found.isdisjoint(SURE) or not page.headed[node])


class Tree:
    """An ordered tree of labelled nodes by number, 0 the root; children after their parents."""

    def __init__(self) -> None:
        self.label, self.kids = ["#root"], [[]]
        #: A page's elements at each node.
        self.elements: list[list[int]] = [[0]]

    def add(self, parent: int, label: str) -> int:
        self.label.append(label)
        self.kids.append([])
        self.elements.append([])
        self.kids[parent].append(len(self.label) - 1)
        return len(self.label) - 1

    def shapes(self) -> list[int]:
        """A number for each node's labels and order of descendants."""
        out = [0] * len(self.label)
        for node in range(len(out) - 1, -1, -1):
            out[node] = xxhash.xxh64_intdigest(f"{self.label[node]}:{','.join(str(out[k]) for k in self.kids[node])}")
        return out


def blocks(page: Page) -> list[list[int]]:
    """For each element its block children."""
    out: list[list[int]] = [[] for _ in page.tag]
    for node in range(1, len(page.tag)):
        if page.tag[node] in BLOCKS:
            # Blocks in an inline element belong to its text.
            if page.parent[node] == 0 or page.tag[page.parent[node]] in BLOCKS:
                out[page.parent[node]].append(node)
    return out


def aligned_form(page: Page) -> Tree:
    """The tree that is aligned: neighbours of one label are one node if they are rows of text (ROWS) or more than APART; the children of such a node are those of all its elements, one for each label."""
    below = blocks(page)
    label = [f"{t}.{n}" if n else t for t, n in zip(page.tag, page.name, strict=True)]
    tree = Tree()
    at = 0
    while at < len(tree.label):
        several = len(tree.elements[at]) > 1
        merged: dict[str, int] = {}
        for element in tree.elements[at]:
            side = below[element]
            i = 0
            while i < len(side):
                j = i
                while j < len(side) and label[side[j]] == label[side[i]]:
                    j += 1
                one = several or page.tag[side[i]] in ROWS or j - i > APART
                for group in [side[i:j]] if one else [[k] for k in side[i:j]]:
                    if several and label[side[i]] in merged:
                        node = merged[label[side[i]]]
                    else:
                        node = merged[label[side[i]]] = tree.add(at, label[side[i]])
                    tree.elements[node] += group
                i = j
        at += 1
    return tree


def values(page: Page) -> list[int]:
    """A hash of the text below each element, from one running hash of the page."""
    total, power, place = [0], [1], [0] * len(page.tag)
    out = [0] * len(page.tag)
    for e in page.events:
        if e.__class__ is str:
            piece = " ".join(e.split())
            if not piece:
                continue
        elif e < 0:
            span = len(total) - 1 - place[-e]
            out[-e] = (total[-1] - total[place[-e]] * power[span]) % _PRIME >> 9
            continue
        else:
            place[e] = len(total) - 1
            if page.tag[e] not in BLOCKS:
                continue
            piece = f"<{page.tag[e]}>"
        total.append((total[-1] * _BASE + xxhash.xxh64_intdigest(piece)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    return out


def _best(a: list[int], b: list[int], size: dict[tuple[int, int], int]) -> list[list[int]]:
    """Table of the most nodes that the first i and j trees of two forests can match in order."""
    best = [[0] * (len(b) + 1)]
    for x in a:
        up, row = best[-1], [0]
        for j, y in enumerate(b):
            row.append(max(up[j + 1], row[j], up[j] + size.get((x, y), 0)))
        best.append(row)
    return best


def align(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the nodes of ``a`` and their partners in ``b``, as many as labels and order allow. Equal subtrees are matched as they are."""
    shape_a, shape_b = a.shapes(), b.shapes()
    pairs = [(0, 0)]
    for x, y in pairs:  # grows; each pair comes from that of the parents alone
        if shape_a[x] != shape_b[y]:
            pairs += [(i, j) for i in a.kids[x] for j in b.kids[y] if a.label[i] == b.label[j]]
    count = [1] * len(a.label)
    for node in range(len(a.label) - 1, 0, -1):
        for k in a.kids[node]:
            count[node] += count[k]
    size: dict[tuple[int, int], int] = {}
    for x, y in reversed(pairs):
        size[x, y] = count[x] if shape_a[x] == shape_b[y] else 1 + _best(a.kids[x], b.kids[y], size)[-1][-1]
    found = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        found[x] = y
        if shape_a[x] == shape_b[y]:
            todo += zip(a.kids[x], b.kids[y], strict=True)
            continue
        best = _best(a.kids[x], b.kids[y], size)
        i, j = len(a.kids[x]), len(b.kids[y])
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((a.kids[x][i], b.kids[y][j]))
    return found


class Wrapper(Tree):
    """The merged trees of a host's pages, with the pages and the frequent texts of each node."""

    def __init__(self) -> None:
        super().__init__()
        self.pages = [0]
        self.counts: list[dict[int, int]] = [{}]
        #: What a count may lack, and the texts met, of each node.
        self.lost, self.met = [0], [0]
        self.version = 0

    def add(self, parent: int, label: str) -> int:
        for column, new in ((self.pages, 0), (self.counts, {}), (self.lost, 0), (self.met, 0)):
            column.append(new)
        return super().add(parent, label)

    def place(self, other: Tree) -> dict[int, int]:
        """The partner of each node of ``other``; nodes without one are added, in order."""
        found = align(other, self)
        for node in range(len(other.label)):
            order = None
            for k, kid in enumerate(other.kids[node]):
                if kid not in found:
                    found[kid] = new = self.add(found[node], other.label[kid])
                    self.version += 1
                    order = self.kids[found[node]]
                    order.pop()
                    order.insert(order.index(found[other.kids[node][k - 1]]) + 1 if k else 0, new)
        return found

    def count(self, node: int, pages: int, more: dict[int, int], lost: int, met: int) -> None:
        """Adds to a node's summary. When full it is cut to VALUES texts for each element of a page by taking the next largest count from all, which is noted as lost."""
        self.pages[node] += pages
        self.lost[node] += lost
        self.met[node] += met
        counts = self.counts[node]
        for v, n in more.items():
            counts[v] = counts.get(v, 0) + n
        room = VALUES * max(1, -(-self.met[node] // self.pages[node]))
        if len(counts) > 2 * room:
            cut = sorted(counts.values(), reverse=True)[room]
            self.counts[node] = {v: n - cut for v, n in counts.items() if n > cut}
            self.lost[node] += cut

    def merge(self, other: Wrapper) -> None:
        for node, mine in self.place(other).items():
            if node:
                self.count(mine, other.pages[node], other.counts[node], other.lost[node], other.met[node])

    def candidates(self) -> list[list[int]]:
        """Each node's texts that may be on SHARE of its pages."""
        return [[v for v, n in c.items() if n + lost >= SHARE * p] if p >= FEW and node else [] for node, (c, lost, p) in enumerate(zip(self.counts, self.lost, self.pages, strict=True))]

    def dump(self) -> str:
        return json.dumps([self.label, self.kids, self.pages, [list(c.items()) for c in self.counts], self.lost, self.met], separators=(",", ":"))

    @staticmethod
    def load(text: str) -> Wrapper:
        out = Wrapper()
        out.label, out.kids, out.pages, counts, out.lost, out.met = json.loads(text)
        out.counts = [dict(c) for c in counts]
        return out


class Inducer:
    """Wrappers of the hosts of the pages seen so far. Alignments are remembered by layout, until the wrapper grows."""

    def __init__(self) -> None:
        self.wraps: dict[str, Wrapper] = {}
        self.known: dict[tuple[str, int], tuple[int, dict[int, int]]] = {}

    def add(self, name: str, html: str) -> None:
        page = parse(html)
        tree = aligned_form(page)
        wrap = self.wraps.setdefault(name, Wrapper())
        key = name, tree.shapes()[0]
        version, found = self.known.get(key, (-1, {}))
        if version != wrap.version:
            found = wrap.place(tree)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = wrap.version, found
        each = values(page)
        for node, mine in found.items():
            if node:
                some = dict.fromkeys([each[e] for e in tree.elements[node]], 1)
                wrap.count(mine, 1, some, 0, len(some))


class Finished:
    """A host's finished wrapper: its form, and for each node the texts asked for (candidates, or template)."""

    def __init__(self, text: str) -> None:
        self.tree = Tree()
        self.tree.label, self.tree.kids, texts = json.loads(text)
        self.texts = [frozenset(t) for t in texts]
        self.empty = not any(self.texts)
        self.known: dict[int, dict[int, int]] = {}

    @staticmethod
    def dump(wrap: Tree, texts: list[list[int]]) -> str:
        return json.dumps([wrap.label, wrap.kids, texts], separators=(",", ":"))

    def met(self, page: Page) -> Iterator[tuple[int, list[int], list[int]]]:
        """The wrapper nodes that the page has, top down, the page's elements there, and those whose text is asked for."""
        tree = aligned_form(page)
        shape = tree.shapes()[0]
        if shape not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[shape] = align(tree, self.tree)
        each = values(page)
        for node, mine in sorted(self.known[shape].items()):
            if node:
                yield mine, tree.elements[node], [e for e in tree.elements[node] if each[e] in self.texts[mine]]

    def counted(self, page: Page) -> Iterator[tuple[int, int | None]]:
        """(node, None) for each node that the page has, and (node, text) for each text asked for that it holds there."""
        each = values(page)
        for node, _, some in self.met(page):
            if self.texts[node]:
                yield node, None
                yield from ((node, v) for v in {each[e] for e in some})

    def template(self, page: Page) -> set[int]:
        """The page's elements that are template."""
        return {e for _, _, some in self.met(page) for e in some}


def extract(html: str, wrap: Finished | None) -> str:
    """The page's main text: blocks in page order, joined by two newlines."""
    page = parse(html)
    dropped = wrap.template(page) if wrap and not wrap.empty else set()
    for drop in (dropped, set()) if dropped else (dropped,):
        out = _text(page, drop)
        if out:
            return "\n\n".join(out)
    return ""


def _text(page: Page, dropped: set[int]) -> list[str]:
    """The blocks of the articles, or of the page if there are none."""
    whole: list[str] = []
    inside: list[str] = []
    parts: list[str] = []
    skipping = article = 0
    articles = False

    def end() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                (inside if article else whole).append(text)

    # With an article its head is its own; without one no text is inside, so one walk serves both.
    for e in page.events:
        if e.__class__ is str:
            if not skipping:
                parts.append(e)
            continue
        node = abs(e)
        tag = page.tag[node]
        if skipping:
            if -e == skipping:
                skipping = 0
        elif tag == "br":
            if e > 0:
                parts.append(" ")
        elif e > 0 and (node in dropped or excluded(page, node, bool(article))):
            skipping = node
            if tag in BLOCKS:
                end()
        else:
            if tag in BLOCKS:
                end()
            if tag in ("article", "main"):
                if e > 0 and not article:
                    article, articles = node, True
                elif -e == article:
                    article = 0
    end()
    return inside if articles else whole


def _merge_group(key: tuple, rows: pa.Table) -> pa.Table:
    wrap = Wrapper()
    for text in rows["wrapper"].to_pylist():
        wrap.merge(Wrapper.load(text))
    return pa.table({"host": [key[0].as_py()], "wrapper": [wrap.dump()]})


def _merge_last(key: tuple, rows: pa.Table) -> pa.Table:
    wrap = Wrapper()
    for text in rows["wrapper"].to_pylist():
        wrap.merge(Wrapper.load(text))
    found = wrap.candidates()
    return pa.table({"host": [key[0].as_py()], "wrapper": [Finished.dump(wrap, found)], "some": [any(found)]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, finished wrapper with the candidates of each node, whether there are some) of all pages."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inducer = Inducer()

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"host": list(inducer.wraps), "wrapper": [w.dump() for w in inducer.wraps.values()]}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))
            inducer.__init__()
            return out

        for batch in chunks(batches, "html", PAGE_BYTES):
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    inducer.add(host(url), page)
            if len(inducer.wraps) > 5000:
                yield taken()
        yield taken()

    part = pages.select("url", "html").mapInArrow(run, "host string, wrapper string")
    some = part.withColumn("salt", F.spark_partition_id() % 32).groupBy("host", "salt").applyInArrow(_merge_group, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(_merge_last, "host string, wrapper string, some boolean")


def _with_wrappers(pages: DataFrame, found: DataFrame, sent_bytes: int, work: Callable, schema: str) -> DataFrame:
    """``work(batch, wrapper of each row)`` over the pages; wrappers are sent if they are small in all, else joined by host."""
    size = found.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0)).alias("n")).first().n
    if size <= sent_bytes:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in found.collect()})

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[str, Finished | None] = {}
            for batch in chunks(batches, "html", PAGE_BYTES):
                wraps = []
                for url in batch.column("url").to_pylist():
                    name = host(url)
                    if name not in loaded:
                        loaded[name] = Finished(sent.value[name]) if name in sent.value else None
                    wraps.append(loaded[name])
                yield work(batch, wraps)

        return pages.mapInArrow(run, schema)

    @tidy
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("host", pa.array([host(u) for u in batch.column("url").to_pylist()], pa.string()))

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wrap = None, None
        for batch in chunks(batches, "html", PAGE_BYTES):
            each = []
            for text in batch.column("wrapper").to_pylist():
                if text != last:
                    last, wrap = text, Finished(text) if text else None
                each.append(wrap)
            yield work(batch, each)

    return pages.mapInArrow(named, "page_id long, url string, html string, host string").join(found, "host", "left").mapInArrow(joined, schema)


def _counted(batch: pa.RecordBatch, wraps: list[Finished | None]) -> pa.RecordBatch:
    seen: Counter = Counter()
    for url, html, wrap in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), wraps, strict=True):
        if html and wrap and not wrap.empty:
            name = host(url)
            seen.update((name, node, v) for node, v in wrap.counted(parse(html)))
    return pa.RecordBatch.from_pydict({"host": [h for h, _, _ in seen], "node": [n for _, n, _ in seen], "text": [v for *_, v in seen], "n": list(seen.values())}, pa.schema([("host", pa.string()), ("node", pa.int32()), ("text", pa.int64()), ("n", pa.int64())]))


def _settled(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """A host's wrapper with the template texts of its nodes, from the exact counts."""
    if not left.num_rows:
        return pa.table({"host": pa.array([], pa.string()), "wrapper": pa.array([], pa.string())})
    label, kids, _ = json.loads(left["wrapper"][0].as_py())
    inside = [False] * len(label)
    for node in range(len(label)):  # children have larger numbers than their parents
        for k in kids[node]:
            inside[k] = inside[node] or label[k].split(".")[0] in ("article", "main")
    rows = right.to_pylist()
    pages = {r["node"]: r["n"] for r in rows if r["text"] is None}
    texts: list[list[int]] = [[] for _ in label]
    for r in rows:
        least = MANY if inside[r["node"]] else FEW
        if r["text"] is not None and pages[r["node"]] >= least and r["n"] >= SHARE * pages[r["node"]]:
            texts[r["node"]].append(r["text"])
    return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps([label, kids, texts], separators=(",", ":"))]})


def templates(pages: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(host, finished wrapper with the template of each node), for the hosts that have some that may be."""
    found = checkpointed(wrappers(pages))
    some = found.where("some").drop("some")
    counts = _with_wrappers(pages, some, sent_bytes, _counted, "host string, node int, text long, n long").groupBy("host", "node", "text").agg(F.sum("n").alias("n"))
    return checkpointed(some.groupBy("host").cogroup(counts.groupBy("host")).applyInArrow(_settled, "host string, wrapper string"))


def _extracted(batch: pa.RecordBatch, wraps: list[Finished | None]) -> pa.RecordBatch:
    texts = [extract(page, w) if page else "" for page, w in zip(batch.column("html").to_pylist(), wraps, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html")
    return _with_wrappers(pages, templates(pages, sent_bytes), sent_bytes, _extracted, "page_id long, url string, text string, n_chars long")
