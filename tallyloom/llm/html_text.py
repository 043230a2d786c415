"""The main text of web pages, by a minimum cut.

A page is read into blocks of text, each under its chain of open elements. A linear classifier of a block - how long it is, how much of it is links,
whether it ends like a sentence, what its element and the marks of the elements around it say - gives log-odds, and these are the capacities to the two
terminals: what it costs to call the block boilerplate, or content, against the classifier. Neighbours in the page are joined by edges of smoothness, and so are
blocks near each other in the document tree, by way of a node for every element that holds text. The minimum cut, found by maximum flow, is the labelling
of least cost; blocks on the source's side are the text.

The weights are parameters (`WEIGHTS`, `SMOOTH`): no table has labelled blocks to learn them from.

Edge cases: null and empty pages, and pages with boilerplate alone, have an empty text. Markup that is not closed ends with the page; a comment, script or
style that never ends hides the rest, as in browsers. Character references are decoded as HTML 5 has it. Repeated rows and null ids are pages
like others. A page of any length is one row's work: time grows with its length, not its square. Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tallyloom.session import bounded_batches

# Elements by what they are in HTML.
RAW = "script style title textarea iframe noembed noframes noscript xmp template svg math select object canvas audio video".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = (
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
#: Elements that end an open one of the same group when they start.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: An element of these ends the search for one to end.
SCOPE = {"ul", "ol", "dl", "menu", "table", "td", "th", "body", "html", "article", "section", "main", "div", "nav", "aside", "footer", "header", "form", "blockquote", "figure", "li", "dd"}

# What marks a part of a page, as elements, roles and words of class and id.
CONTENT = {"article", "main"}
CONTENT_WORDS = {"article", "articlebody", "content", "entry", "main", "maincontent", "post", "story"}
BOILERPLATE = {"nav", "footer", "aside", "dialog", "menu", "button", "fieldset", "legend", "label"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "tablist", "toolbar"}
BOILERPLATE_WORDS = {
    "ad", "adbox", "adcontainer", "ads", "adslot", "adspace", "adunit", "adv", "alert", "announcement", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "billboard", "breadcrumb", "breadcrumbs", "captcha", "comment", "comments", "commentlist", "consent", "cookie", "cookies",
    "copyright", "discussion", "disclaimer", "disqus", "dropdown", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "paywall",
    "pager", "pagination", "popup", "privacy", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "shoutbox", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "taboola", "tagcloud", "toc", "toolbar", "topbar", "widget", "widgets",
}
#: Marks that a main or article element inside takes back: pages put all they hold into one form, or a search around its results.
WEAK = {"form", "search", "header"}
#: Beside these, "sidebar" names a layout and not a part of the page.
LAYOUT_WORDS = {"container", "has", "layout", "no", "page", "with", "without", "wrapper"}

#: Of a block's log-odds: constant, for each word up to MOST, sentence end, share of link text, by element, and by what is around it.
WEIGHTS = {"bias": -1.5, "word": 0.1, "sentence": 1.0, "links": -5.0, "p": 0.5, "h1": 1.5, "li": -0.4, "td": -0.4, "inside": 4.0, "outside": -3.0, "boilerplate": -14.0}
MOST = 40
#: Capacity between neighbours with one parent, between others, of a block to its element's node, and of that to the one around it.
SMOOTH = {"next": 0.6, "far": 0.15, "element": 0.4, "around": 0.2}
UNIT = 1000

_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ONE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
_SENTENCE = re.compile("[.!?…。！？:;][\"'”’»)\\]]*$")  # noqa: RUF001


@dataclass
class Element:
    name: str
    parent: Element | None
    inside: bool = False  # of an article
    mark: str | None = None  # of boilerplate
    node: int = -1
    links: bool = False


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def opened(name: str, attributes: str, parent: Element) -> Element:
    """An element with what its name and attributes say of it, and what it takes from the one around it."""
    e = Element(name, parent, parent.inside, parent.mark, links=parent.links or name == "a")
    found = {k.lower(): a or b or c for k, a, b, c in _ONE.findall(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    words = {w.lower() for w in _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}")} if found and name not in ("body", "html") else set()
    if "sidebar" in words and words & LAYOUT_WORDS:
        words.discard("sidebar")
    mark = None
    if name in BOILERPLATE:
        mark = name
    elif role in ROLES:
        mark = role
    elif bad := words & BOILERPLATE_WORDS:
        mark = min(bad - WEAK or bad)
    elif name == "form":
        mark = name
    elif not parent.inside and (name == "header" or ("header" in words and not words & CONTENT_WORDS)):
        mark = "header"
    elif attributes and (_HIDDEN.search(_QUOTED.sub("", attributes)) or _NONE.search(found.get("style", ""))):
        mark = "hidden"
    good = name in CONTENT or role in CONTENT or found.get("itemprop") == "articleBody" or (words & CONTENT_WORDS and not mark)
    if mark:
        e.mark = mark if e.mark is None or e.mark in WEAK else e.mark
    elif good:
        if name in CONTENT and e.mark in WEAK:
            e.mark = None
        e.inside = e.inside or e.mark is None
    return e


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order: white space is single and outer white space gone."""
    root = Element("html", None)
    stack, blocks, current, at, end = [root], [], None, 0, len(page)
    lower = None

    def flush() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                blocks.append(current)
            current = None

    def say(text: str) -> None:
        nonlocal current
        if current is None:
            if text.isspace():
                return
            top = len(stack) - 1
            while top and stack[top].name not in BLOCKS:
                top -= 1
            current = Block(stack[top])
        text = entities.unescape(text) if "&" in text else text
        current.parts.append(text)
        current.linked += len(text) if stack[-1].links else 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        two = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if two in ("!", "?"):
            close = page.find(">", lt)
            at = close + 1 if close >= 0 else end
            continue
        closing = two == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if m is None:
            if closing:  # a bogus comment
                close = page.find(">", lt)
                at = close + 1 if close >= 0 else end
            else:
                say("<")
                at = lt + 1
            continue
        name = m[0].lower()
        rest = _ATTRIBUTES.match(page, m.end())
        gt = rest.end() if rest else page.find(">", m.end()) + 1
        if not gt:
            break
        attributes, at = page[m.end() : gt - 1], gt
        if closing:
            k = len(stack) - 1
            while k and stack[k].name != name:
                k -= 1
            if name in BLOCKS:
                flush()
            if k:
                del stack[k:]
            continue
        if name in RAWS:
            if not attributes.endswith("/") or name not in ("svg", "math"):
                lower = page.lower() if lower is None else lower
                close = lower.find(f"</{name}", at)
                while close >= 0 and lower[close + len(name) + 2 : close + len(name) + 3] not in ("", ">", "/", " ", "\t", "\n", "\r", "\f"):
                    close = lower.find(f"</{name}", close + 2)
                gt = page.find(">", close) if close >= 0 else -1
                at = gt + 1 if gt >= 0 else end
            continue
        if name == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            ended = ENDS.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p" or stack[k].name in ended:
                    del stack[k:]
                    if not ended:
                        break
                elif stack[k].name in SCOPE:
                    break
        if name not in VOIDS and not attributes.endswith("/"):
            stack.append(opened(name, attributes, stack[-1]))
    flush()
    return blocks


BLOCKS, RAWS, VOIDS = frozenset(BLOCK), frozenset(RAW), frozenset(VOID)


def log_odds(b: Block, somewhere: bool) -> float:
    """Of content against boilerplate, for a block; somewhere: the page has an element that is marked as its article."""
    w = WEIGHTS
    z = w["bias"] + w["word"] * min(b.text.count(" ") + 1, MOST) + w["links"] * min(1.0, b.linked / len(b.text)) + w.get(b.element.name, 0.0)
    if _SENTENCE.search(b.text):
        z += w["sentence"]
    if b.element.mark:
        z += w["boilerplate"]
    elif b.element.inside:
        z += w["inside"]
    elif somewhere:
        z += w["outside"]
    return z


def cut(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut: terminals[i] > 0 is the capacity from the source to i, < 0 that from i to the
    sink; edges (i, j, c) carry c either way. Blocking flows over levels, from the sink's side back; a node that ties stays out."""
    n = len(terminals)
    out: list[list[int]] = [[] for _ in range(n)]
    to, left = [], []
    for i, j, c in edges:
        if c > 0:
            out[i].append(len(to))
            to.append(j)
            left.append(c)
            out[j].append(len(to))
            to.append(i)
            left.append(c)
    supply, demand = [max(0, t) for t in terminals], [max(0, -t) for t in terminals]
    while True:
        level, queue = [-1] * n, deque(i for i in range(n) if supply[i])
        for i in queue:
            level[i] = 0
        found = False
        while queue:
            i = queue.popleft()
            found = found or demand[i] > 0
            for e in out[i]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not found:
            return [x >= 0 for x in level]
        tried = [0] * n
        for s in range(n):
            while supply[s] and level[s] == 0:
                path, i = [], s
                while not demand[i]:
                    while tried[i] < len(out[i]):
                        e = out[i][tried[i]]
                        if left[e] and level[to[e]] == level[i] + 1:
                            break
                        tried[i] += 1
                    if tried[i] < len(out[i]):
                        path.append(out[i][tried[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        tried[i] += 1
                    else:
                        break
                if not demand[i]:
                    break
                flow = min([supply[s], demand[i], *(left[e] for e in path)])
                supply[s] -= flow
                demand[i] -= flow
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow


def labels(blocks: list[Block]) -> list[bool]:
    """Which blocks are content."""
    somewhere = any(b.element.inside for b in blocks)
    terminals = [round(UNIT * log_odds(b, somewhere)) for b in blocks]
    if not terminals or max(terminals) <= 0 or min(terminals) >= 0:
        return [t > 0 for t in terminals]
    edges, holders = [], []
    unit = {k: round(UNIT * v) for k, v in SMOOTH.items()}
    for i, b in enumerate(blocks):
        if i:
            near = b.element is blocks[i - 1].element or b.element.parent is blocks[i - 1].element.parent
            edges.append((i - 1, i, unit["next" if near else "far"]))
        at, capacity, e = i, unit["element"], b.element.parent
        while e is not None:
            known = e.node >= 0
            if not known:
                e.node = len(terminals)
                terminals.append(0)
                holders.append(e)
            edges.append((at, e.node, capacity))
            if known:
                break
            at, capacity, e = e.node, unit["around"], e.parent
    return cut(terminals, edges)[: len(blocks)]


def main_text(page: str | None) -> str:
    """The text of a page: its blocks of content in page order, joined by empty lines."""
    blocks = blocks_of(page) if page else []
    return "\n\n".join(b.text for b, kept in zip(blocks, labels(blocks), strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, the code points of text, for every row of pages."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def block_labels(pages: DataFrame) -> DataFrame:
    """page_id, position, element, score, content and text of every block: what the cut decided, for a look at a page."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, page in zip(b["page_id"], b["html"], strict=True):
                found = blocks_of(page) if page else []
                somewhere = any(x.element.inside for x in found)
                rows += [(page_id, i, x.element.name, log_odds(x, somewhere), kept, x.text) for i, (x, kept) in enumerate(zip(found, labels(found), strict=True))]
            yield pd.DataFrame(rows, columns=["page_id", "position", "element", "score", "content", "text"]).astype({"page_id": "Int64"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, position long, element string, score double, content boolean, text string")
