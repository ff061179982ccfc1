"""A small forgiving HTML parser for text extraction. Pages of any depth: nothing recurses."""

from __future__ import annotations

import re
from collections import Counter

#: Elements without content, elements whose content is raw text, and elements that end a text block.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
BLOCKS = frozenset(["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"])
#: What a start tag closes if it is open (up to the nearest of the second set).
CLOSES = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"]))}
#: Elements that show that what holds them holds the page's text.
HEADED = frozenset(["h1", "main"])

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|[!?][^>]*(?:>|\Z))", re.DOTALL)
_NAMED = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.IGNORECASE)


class Page:
    """Elements by number in page order, 0 the root.

    ``events`` are strings of text, n where element n opens and -n where it closes
    (the root has no events); ``name`` holds the words of class, id and role.
    """

    __slots__ = ("events", "headed", "hidden", "name", "parent", "tag")

    def __init__(self) -> None:
        self.tag, self.name, self.hidden, self.parent, self.headed = ["#root"], [""], [False], [-1], [False]
        self.events: list[str | int] = []


def parse(html: str) -> Page:
    """The elements of a page, however broken. Comments, declarations and raw text are left out."""
    page = Page()
    events, tags = page.events, page.tag
    stack = [0]
    open_: Counter = Counter()
    at = 0
    n = len(html)
    low = None

    def close(k: int) -> None:
        """Closes what is open from place ``k`` of the stack."""
        while len(stack) > k:
            done = stack.pop()
            open_[tags[done]] -= 1
            events.append(-done)

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            events.append(html[at:])
            break
        if m.start() > at:
            events.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        close(k)
                        break
                    if tag not in BLOCKS and tags[stack[k]] in BLOCKS:
                        break  # an inline end tag doesn't close a block
            continue
        if tag in BLOCKS and open_["p"]:
            # A block ends an open paragraph, with what is open in it.
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == "p":
                    close(k)
                    break
                if tags[stack[k]] in BLOCKS:
                    break
        if tag in CLOSES:
            shut, until = CLOSES[tag]
            if any(open_[t] for t in shut):
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in until:
                        break
                    if tags[stack[k]] in shut:
                        close(k)
                        if tag != "tr":
                            break
        name, hidden = "", False
        if m[3] and not m[3].isspace():
            for key, a, b, c in _NAMED.findall(m[3]):
                key = key.lower()
                if key == "hidden" or key == "aria-hidden" and (a or b or c).lower() == "true":
                    hidden = True
                elif key in ("class", "id", "role"):
                    name += " " + (a or b or c).lower()
        node = len(tags)
        tags.append(tag)
        page.name.append(name.strip())
        page.hidden.append(hidden)
        page.parent.append(stack[-1])
        page.headed.append(False)
        events.append(node)
        if tag in HEADED:
            above = stack[-1]
            while above >= 0 and not page.headed[above]:
                page.headed[above] = True
                above = page.parent[above]
        if tag in RAW:
            events.append(-node)
            if low is None:
                low = html.lower() if html.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            end = low.find(f"</{tag}", at)
            at = n if end < 0 else end
            if end >= 0:
                shut = html.find(">", end)
                at = n if shut < 0 else shut + 1
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            open_[tag] += 1
        else:
            events.append(-node)
    close(1)
    return page
