"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree of its block-level elements, with the runs of text as
leaves. Every node has one of three states: boilerplate, content, or mixed (an
element that holds both). Potentials on nodes come from their tag, class and id
words, text length and share of link text; potentials on edges connect the
states of parent and child. Both are counts from labelled pages, which
:func:`labelled_pages` writes from templates. Sum-product messages run upward
and downward, and the leaves whose marginal favours content are the text.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

BOILERPLATE, CONTENT, MIXED = 0, 1, 2
#: Elements that break a line of text; all others are inline.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
RAW = frozenset("script style template noscript iframe noframes noembed svg math object audio video canvas title textarea xmp".split())
#: Of these, those whose content is text up to their end tag, or to the end of the page.
TEXT_ONLY = frozenset("script style noscript iframe noframes noembed title textarea xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes, and the elements beyond which it does not look.
_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}), "body": ({"head"}, {"html"})}
_P_BOUNDS = frozenset("td th button li div section article".split())
_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
#: The rest of a tag; no way back into it, so that its cost is its length.
_REST = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Tree:
    """Nodes in page order, parents first. A leaf has tag ``#text``."""

    def __init__(self) -> None:
        self.tag, self.parent, self.words, self.mark = ["#page"], [-1], [()], [None]
        self.text: list[str | None] = [None]
        self.size, self.linked = [0], [0]

    def add(self, tag: str, parent: int, words=(), mark=None, text=None, size=0, linked=0) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.words, words), (self.mark, mark), (self.text, text), (self.size, size), (self.linked, linked)):
            column.append(value)
        return len(self.tag) - 1


class Scanner:
    """Tags of a page one after the other, in time that is linear in the page.

    A tag ends at the first ``>`` outside of quotes. If a quote stays open to the
    end of the page, that tag and all later ones end at their first ``>``. A tag
    or declaration without any ``>`` behind it ends the page; an open comment too."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes = page, True

    def next(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """From ``at``: start and end of the next tag, comment or declaration, and
        a tag's name (None for others), whether it closes, and its attributes."""
        page = self.page
        m = _START.search(page, at)
        if m is None:
            return len(page), len(page), None, False, ""
        start, end = m.start(), m.end()
        if m[1]:
            if page.startswith((">", "->"), end):
                return start, page.index(">", end) + 1, None, False, ""
            close = _COMMENT_END.search(page, end)
            return start, close.end() if close else len(page), None, False, ""
        if self.quotes and m[3]:
            rest = _REST.match(page, end)
            if rest:
                return start, rest.end(), m[3].lower(), bool(m[2]), rest[1]
            self.quotes = False
        stop = page.find(">", end)
        if stop < 0:
            return start, len(page), None, False, ""
        return start, stop + 1, m[3].lower() if m[3] else None, bool(m[2]), page[end:stop] if m[3] else ""


class Open:
    """The open elements, and the heights at which each tag is open."""

    def __init__(self, tree: Tree) -> None:
        self.tree, self.stack = tree, [0]
        self.at: dict[str, list[int]] = {}

    def push(self, node: int) -> None:
        self.at.setdefault(self.tree.tag[node], []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, height: int) -> None:
        """Close all elements from ``height`` on."""
        for node in reversed(self.stack[height:]):
            self.at[self.tree.tag[node]].pop()
        del self.stack[height:]

    def last(self, tags) -> int:
        """Height of the topmost element with one of the tags; 0: none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def lowest(self, tags, above: int) -> int:
        """Height of the lowest such element above a height; 0: none."""
        found = [h[k] for t in tags if (h := self.at.get(t)) and (k := bisect_right(h, above)) < len(h)]
        return min(found, default=0)


def parse(page: str) -> Tree:
    """Tree of a page, closed or not, with character references decoded and white
    space in each leaf turned into one space. The cost is linear in the page."""
    tree = Tree()
    open_ = Open(tree)
    stack = open_.stack
    run: list[str] = []
    linked = 0
    link = 0  # stack height at which a link opened
    endless: set[str] = set()  # raw elements without an end tag in the rest of the page

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                tree.add("#text", stack[-1], text=text, size=len(text), linked=min(linked, len(text)))
        linked = 0

    at, end = 0, len(page)
    scan, unescape = Scanner(page).next, html.unescape
    while at < end:
        stop, after, name, closing, attrs = scan(at)
        if stop > at:
            part = page[at:stop]
            if "&" in part:
                part = unescape(part)
            run.append(part)
            if link:
                linked += len(part)
        at = after
        if not name:
            continue
        if closing:
            if name == "a":
                link = 0
            elif name == "br":
                run.append(" ")
            elif name in BLOCK:
                height = open_.last((name,))
                if height:
                    flush()
                    open_.cut(height)
                    if link > len(stack):
                        link = 0
                elif name == "p":
                    flush()
            continue
        if name in RAW:
            if attrs.endswith("/") and name in ("svg", "math"):
                continue
            close = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if close:
                at = close.start()
            elif name in TEXT_ONLY:
                at = end
            else:  # left open: the tag alone is left out
                endless.add(name)
            continue
        if name == "a":
            link = len(stack)
        elif name == "br":
            run.append(" ")
        if name not in BLOCK:
            continue
        flush()
        if name in _CLOSES:
            gone, beyond = _CLOSES[name]
            height = open_.lowest(gone, open_.last(beyond))
            if height:
                open_.cut(height)
        elif name in _P:
            height = open_.last(("p",))
            if height > open_.last(_P_BOUNDS):
                open_.cut(height)
        words, mark = (), None
        if attrs:
            found = []
            for key, a, b, c in _ATTR.findall(attrs):
                if key == "data-y":
                    mark = int(a) if a in ("0", "1") else None
                else:
                    found += _WORD.findall(a or b or c)
            words = tuple(dict.fromkeys(w.lower() for w in found))
        node = tree.add(name, stack[-1], words, mark)
        if name not in VOID:
            open_.push(node)
    flush()
    for i in range(len(tree.tag) - 1, 0, -1):
        tree.size[tree.parent[i]] += tree.size[i]
        tree.linked[tree.parent[i]] += tree.linked[i]
    return tree


#: Elements that are as good as the one around them.
_PLAIN = frozenset("p li ul ol dl dt dd div span td th tr tbody h2 h3 h4 h5 h6".split())
#: Weight of tag and size evidence against that of class and id words: tags of an
#: element and those below it tell much the same.
DAMPING = 0.5


def features(tree: Tree, i: int) -> list[str]:
    tag, parent = tree.tag[i], tree.parent[i]
    size = tree.size[i]
    share = tree.linked[i] / size if size else 0.0
    if tag == "#text":  # its tag says no more than its parent's
        return [f"lx:{int(share * 4)}", f"nx:{min(5, size.bit_length() // 2)}"]
    found = [f"t:{tag}", f"p:{tag}<{tree.tag[parent]}"] if tag not in _PLAIN or tree.tag[parent] not in _PLAIN else [f"t:{tag}"]
    found += [f"le:{int(share * 4)}", f"ne:{min(5, size.bit_length() // 2)}"]
    found += [f"c:{w}" for w in tree.words[i]]
    return found


class Model:
    """Potentials of nodes by feature, and of edges by the states at their ends."""

    def __init__(self, trees: list[Tree]) -> None:
        seen = [Counter(), Counter(), Counter()]
        total = [1.0, 1.0, 1.0]
        edges = [[1.0] * 3 for _ in range(3)]
        for tree in trees:
            state = states(tree)
            for i in range(1, len(tree.tag)):
                seen[state[i]].update(set(features(tree, i)))
                total[state[i]] += 1
                edges[state[tree.parent[i]]][state[i]] += 1
        names = set().union(*seen)
        self.known = {}
        for f in names:
            p = [(seen[s][f] + 0.3) / (total[s] + 1) for s in range(3)]
            mean = sum(p) / 3
            weight = 1.0 if f[:2] == "c:" else DAMPING
            self.known[f] = tuple(weight * math.log(x / mean) for x in p)
        self.edges = [[x / sum(row) for x in row] for row in edges]

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of each node by one upward and one downward pass."""
        n = len(tree.tag)
        parent, known = tree.parent, self.known
        (e00, e01, e02), (e10, e11, e12), (e20, e21, e22) = self.edges
        up = [[0.0, 0.0, 0.0] for _ in range(n)]
        sent: list = [None] * n
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):
            a, b, c = up[i]
            for f in features(tree, i):
                w = known.get(f)
                if w:
                    a += w[0]
                    b += w[1]
                    c += w[2]
            if tree.tag[i] == "#text":
                c = -60.0 + max(a, b)
            top = max(a, b, c)
            x, y, z = exp(a - top), exp(b - top), exp(c - top)
            up[i][:] = a - top, b - top, c - top
            m = log(e00 * x + e01 * y + e02 * z), log(e10 * x + e11 * y + e12 * z), log(e20 * x + e21 * y + e22 * z)
            sent[i] = m
            u = up[parent[i]]
            u[0] += m[0]
            u[1] += m[1]
            u[2] += m[2]
        out = [0.0] * n
        belief: list = [None] * n
        for i in range(n):
            a, b, c = up[i]
            if i == 0:
                b = -60.0 + max(a, c)  # the page itself is never all content
            else:
                p, m = belief[parent[i]], sent[i]
                x, y, z = p[0] - m[0], p[1] - m[1], p[2] - m[2]
                top = max(x, y, z)
                x, y, z = exp(x - top), exp(y - top), exp(z - top)
                a += log(x * e00 + y * e10 + z * e20)
                b += log(x * e01 + y * e11 + z * e21)
                c += log(x * e02 + y * e12 + z * e22)
            top = max(a, b, c)
            a, b, c = a - top, b - top, c - top
            belief[i] = a, b, c
            out[i] = exp(b) / (exp(a) + exp(b) + exp(c))
        return out

    def extract(self, page: str) -> str:
        """The main text. A page without any block-level element is text as a whole."""
        tree = parse(page)
        if all(t == "#text" for t in tree.tag[1:]):
            return "\n".join(tree.text[1:])
        found = self.marginals(tree)
        return "\n".join(t for t, p in zip(tree.text, found) if t is not None and p > 0.5)


def states(tree: Tree) -> list[int]:
    """States of a labelled tree: of leaves by the nearest mark above, of elements
    by the leaves below."""
    n = len(tree.tag)
    mark = [0] * n
    below = [set() for _ in range(n)]
    for i in range(1, n):
        mark[i] = mark[tree.parent[i]] if tree.mark[i] is None else tree.mark[i]
    for i in range(n - 1, 0, -1):
        if tree.tag[i] == "#text":
            below[i] = {mark[i]}
        below[tree.parent[i]] |= below[i]
    return [MIXED if len(b) == 2 else next(iter(b)) if b else mark[i] for i, b in enumerate(below)]


_NOISE = {
    "nav": ["nav", "menu", "navbar", "navigation", "main-menu", "top-nav", "breadcrumb", "breadcrumbs", "site-nav", "pagination", "pager", "toc", "skip-links", "tabs"],
    "header": ["header", "site-header", "masthead", "page-header", "top-bar", "topbar", "branding", "logo", "hero-banner", "banner"],
    "footer": ["footer", "site-footer", "page-footer", "bottom", "copyright", "legal", "colophon", "credits", "foot"],
    "aside": ["sidebar", "side", "right-column", "widget", "widgets", "related", "related-posts", "recommended", "more-stories", "trending", "popular", "rail", "secondary", "tags", "teaser", "promo-box"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "ad-slot", "ad-banner", "adsbox", "promotion", "partner", "affiliate"],
    "notice": ["cookie", "cookie-banner", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "banner-message", "paywall", "privacy-notice", "newsletter", "subscribe", "signup", "announcement", "message"],
    "form": ["search-form", "login", "contact-form", "newsletter-form", "signup-form", "search", "subscribe-form", "form"],
    "comments": ["comments", "comment-list", "comment", "discussion", "responses", "replies", "reply", "disqus", "comment-section", "user-comments", "reader-comments", "respond"],
    "share": ["share", "social", "share-buttons", "social-links", "sharing", "follow"],
}
_BODY = ["content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "main-content", "text", "body", "article-content", "story-body", "page-content", "prose", "markdown"]
_WRAP = ["container", "wrapper", "page", "site", "layout", "row", "columns", "wrap", "outer", "inner", "grid"]


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Pages from templates; ``data-y`` marks content (1) and boilerplate (0)."""
    rng = random.Random(seed)
    pick, chance = rng.choice, rng.random

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(pick("aeioubcdfglmnprst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi)))

    def name(kinds: list[str]) -> str:
        if chance() < 0.2:
            return ""
        value = pick(kinds) + (" " + pick(kinds) if chance() < 0.25 else "")
        return f' {pick(["class", "class", "id"])}="{value}"'

    def links(lo: int, hi: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/x'>{words(1, 4)}</a></{tag}>" for _ in range(rng.randint(lo, hi)))

    def paragraph() -> str:
        size = pick([(1, 1), (1, 4), (3, 15), (10, 60), (30, 120)])
        body = words(*size)
        if chance() < 0.2:
            body += f" <a href='/y'>{words(1, 3)}</a> {words(0, 8)}"
        if chance() < 0.2:
            body = f"<b>{body}</b>" if chance() < 0.5 else f"<b>{body}<br>"
        return f"<p>{body}" + ("</p>" if chance() < 0.85 else "")

    def body_part() -> str:
        x = chance()
        if x < 0.62:
            return paragraph()
        if x < 0.72:
            return f"<h{(k := rng.randint(2, 4))}>{words(1, 9)}</h{k}>"
        if x < 0.80:
            return f"<{(k := pick(['ul', 'ol']))}>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(rng.randint(1, 6))) + f"</{k}>"
        if x < 0.85:
            return f"<blockquote>{paragraph() if chance() < 0.6 else words(5, 40)}</blockquote>"
        if x < 0.88:
            return f"<pre>{words(3, 40)}</pre>"
        if x < 0.91:
            return "<table>" + "".join(f"<tr><th>{words(1, 2)}</th><td>{words(1, 6)}</td></tr>" for _ in range(rng.randint(1, 5))) + "</table>"
        if x < 0.94:
            return f"<figure><img src='i'><figcaption>{words(2, 15)}</figcaption></figure>"
        if x < 0.97:
            return f"<div>{paragraph() if chance() < 0.5 else words(4, 60)}</div>"
        return noise(pick(["ad", "aside", "notice", "form", "share"]))

    def noise(kind: str) -> str:
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and chance() < 0.6 else pick(["div", "div", "div", "section", "aside"] if kind in ("ad", "notice", "comments", "share", "aside") else ["div"])
        attr = name(_NOISE[kind])
        if tag in ("div", "section") and not attr:
            attr = f' class="{pick(_NOISE[kind])}"'
        if tag in ("nav", "header", "footer", "aside", "form") and chance() < 0.4:
            attr = ""
        if kind == "nav":
            inner = f"<ul>{links(2, 9)}</ul>" if chance() < 0.7 else links(2, 9, "span")
        elif kind == "header":
            inner = f"<a href='/'>{words(1, 3)}</a>" + (f"<p>{words(2, 8)}</p>" if chance() < 0.4 else "") + (noise("nav") if chance() < 0.4 else "") + (f"<h1>{words(1, 3)}</h1>" if chance() < 0.15 else "")
        elif kind == "footer":
            inner = f"&copy; {words(1, 3)} &middot; {words(0, 30)}" if chance() < 0.5 else f"<p>&copy; {words(1, 6)}</p><ul>{links(0, 6)}</ul>" if chance() < 0.6 else f"<p>{words(3, 40)}</p>"
        elif kind == "aside":
            inner = f"<h3>{words(1, 3)}</h3>" + (f"<ul>{links(2, 8)}</ul>" if chance() < 0.6 else f"<p>{words(3, 40)}</p>" * rng.randint(1, 3))
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name='q'><button>{words(1, 2)}</button>" + (f"<p>{words(3, 15)}</p>" if chance() < 0.4 else "") + (f"<select><option>{words(1, 1)}<option>{words(1, 2)}</select><textarea>x</textarea>" if chance() < 0.3 else "")
        elif kind == "comments":
            one = lambda: f'<div class="{pick(["comment", "reply", "comment-body"])}"><b>{words(1, 2)}</b><p>{words(2, 60)}</p></div>' if chance() < 0.6 else f"<li><p>{words(2, 50)}</p></li>" if chance() < 0.5 else f"<p>{words(2, 50)}</p>" if chance() < 0.5 else f"<article class='comment'><p>{words(2, 50)}</p></article>"
            inner = (f"<h3>{words(1, 2)}</h3>" if chance() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 5))) + (noise("form") if chance() < 0.3 else "")
        elif kind == "share":
            inner = links(2, 5, "span")
        else:
            inner = words(1, 60) if chance() < 0.5 else f"<p>{words(3, 60)}</p>" + (f"<button>{words(1, 2)}</button>" if kind == "notice" and chance() < 0.5 else "") + (f"<a href='/z'>{words(1, 4)}</a>" if chance() < 0.4 else "")
        return f'<{tag}{attr} data-y="0">{inner}</{tag}>'

    def main() -> str:
        parts = "".join(body_part() for _ in range(rng.randint(1, 14)))
        title = f"<h1>{words(1, 12)}</h1>" if chance() < 0.85 else ""
        if title and chance() < 0.15:
            title = f"<header>{title}" + (f"<p>{words(2, 12)}</p>" if chance() < 0.4 else "") + "</header>"
        x = chance()
        if x < 0.55:
            out = f'<article{name(_BODY) if chance() < 0.4 else ""} data-y="1">{title}{parts}</article>'
        elif x < 0.8:
            out = f'<div class="{pick(_BODY)}" data-y="1">{title}{parts}</div>'
        elif x < 0.9:
            out = f'<section{name(_BODY)} data-y="1">{title}{parts}</section>'
        else:
            out = f'<main data-y="1">{title}{parts}</main>'
        if chance() < 0.25 and "<main" not in out:
            out = f"<main{name(_BODY)}>{out}</main>"
        return out

    pages = []
    for _ in range(n):
        first = [noise(k) for k in ("header", "nav", "notice", "ad", "form") if chance() < 0.45]
        rng.shuffle(first)
        last = [noise(k) for k in ("share", "comments", "aside", "ad", "form", "nav") if chance() < 0.35]
        rng.shuffle(last)
        middle = main()
        if chance() < 0.4:
            k = rng.randint(0, len(last))
            middle, last = f'<div{name(_WRAP)}>{middle}{"".join(last[:k])}</div>', last[k:]
        page = "".join(first) + middle + "".join(last) + (noise("footer") if chance() < 0.8 else "") + (noise("notice") if chance() < 0.15 else "")
        if chance() < 0.3:
            page = f"<div{name(_WRAP)}>{page}</div>"
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>")
    return pages


def train(pages: list[str] | None = None) -> Model:
    return Model([parse(p) for p in pages or labelled_pages()])


def _texts(model):
    def run(batches):
        m = model.value
        for batch in batches:
            texts = [m.extract(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, page: str = "html", key: str = "page_id", url: str = "url", model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text).

    Null and empty pages have an empty text; a page without any block-level element
    is text as a whole; repeated rows repeat; tags may be left open; other columns are not looked at."""
    spark = pages.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model or train())  # a few hundred features
    source = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return source.mapInArrow(_texts(sent), "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
