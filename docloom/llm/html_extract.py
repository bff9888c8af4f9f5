"""Main text of web pages: boosted trees over DOM nodes with hierarchical decoding.

A page is parsed into a tree of block elements; runs of text and inline elements between block
boundaries are its leaves. Every node gets features: its tag, tokens of class, id and role by
family, the same of its ancestors, text, link and sentence density of its subtree, depth, place
among its siblings, and its neighbours' text. Boosted trees give each node the probability of
being on the way to article text.

Decoding chooses labels for the whole tree at once: a node can be kept only if its parent is, so
dropping a node drops its subtree. One pass from the leaves up sums the log-probabilities of the
best choice under either label, one pass down picks; ancestor and descendant never disagree.

The trees are trained here, on pages written by a seeded generator of several layouts whose
article leaves are known. No table of the data is used for training.

Defined cases: a null or empty page has empty text; unclosed and stray tags, truncated pages and
unknown entities are read as far as they go; `br` is white space; rows equal in all columns give
equal results; pages of any length and depth are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import hgb

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script style noscript template iframe svg math object canvas audio video select textarea title head".split()
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",),
}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ()}
TAGS = {
    "article": 0, "main": 1, "section": 2, "div": 3, "p": 4, "h1": 5, "h2": 6, "h3": 6, "h4": 6, "h5": 6, "h6": 6, "li": 7, "ul": 8, "ol": 8,
    "nav": 9, "menu": 9, "header": 10, "footer": 11, "aside": 12, "form": 13, "fieldset": 13, "button": 13, "table": 14, "tbody": 14, "tr": 14, "td": 14, "th": 14,
    "blockquote": 15, "pre": 15, "figure": 15, "figcaption": 15, "body": 16, "html": 16, "#text": 17,
}
# Families of attribute tokens.
FAMILIES = [
    "article content main post entry story body text prose markdown",
    "nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "header banner masthead topbar logo branding hero",
    "footer copyright legal colophon bottom credits",
    "sidebar aside widget related recommended rail trending popular archive tags",
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner300 outbrain taboola dfp",
    "comment comments reply replies discussion respond disqus thread feedback",
    "notice cookie cookies consent gdpr alert newsletter subscribe subscription popup modal overlay paywall message warning",
    "form search login signup signin register contact input",
    "share sharing social follow twitter facebook buttons tools toolbar byline meta author date",
    "hidden none invisible screenreader visuallyhidden offscreen",
]
_FAMILY = {w: i for i, ws in enumerate(FAMILIES) for w in ws.split()}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(SKIPPED) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|(?=<body[\s>])|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"'<]++|\"[^\"]*+\"|'[^']*+')*+)/?>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*+>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|\d+")
_SENTENCE = re.compile(r"[.!?…](?=\s|$)|[,;:](?=\s)")


class Page:
    """Nodes in document order: parent, tag, families of its own attributes; leaves also hold text."""

    def __init__(self):
        self.parent, self.tag, self.family, self.text, self.linked = [], [], [], [], []

    def node(self, parent: int, tag: str, family: int, text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.family.append(family)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


@lru_cache(maxsize=20_000)
def _families(attrs: str) -> int:
    """Bits of the families of class, id and role tokens."""
    bits = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                bits |= 1 << (len(FAMILIES) - 1)
            continue
        if name in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                bits |= 1 << (len(FAMILIES) - 1)
            continue
        for w in _PART.findall(value):
            k = _FAMILY.get(w.lower())
            if k is not None:
                bits |= 1 << k
    return bits


class OpenElements:
    """The stack of open elements, with the places of each name and of all blocks, so that nothing is found by going down the
    stack: what is asked costs no more for deep pages. An inline element has the node of its block."""

    def __init__(self, root: int):
        self.names, self.nodes = ["html"], [root]
        self.places: dict[str, list[int]] = defaultdict(list)  # without the root
        self.blocks = [0]

    def push(self, name: str, node: int) -> None:
        self.places[name].append(len(self.names))
        if name in BLOCK:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def close(self, i: int) -> None:
        """Close the elements from place i on."""
        while len(self.names) > i:
            name = self.names.pop()
            self.nodes.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name, 0 if there is none."""
        held = self.places.get(name)
        return held[-1] if held else 0

    def first_above(self, name: str, i: int) -> int | None:
        """Place of the outermost open element of a name above place i."""
        held = self.places.get(name, ())
        k = bisect_right(held, i)
        return held[k] if k < len(held) else None

    def make_room(self, tag: str) -> None:
        """Close what cannot hold a block: its own kind up to the list or table it belongs to, or a paragraph."""
        closes = CLOSES.get(tag, ())
        if not closes:
            if self.names[self.blocks[-1]] == "p":
                self.close(self.blocks[-1])
            return
        fence = max(map(self.last, FENCE[tag]))
        found = [x for name in (*closes, "p") if (x := self.first_above(name, fence)) is not None]
        if found:
            self.close(min(found))


def parse(page: str) -> Page:
    out = Page()
    held = OpenElements(out.node(-1, "html", 0))
    run: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.node(held.nodes[-1], "#text", 0, text, min(linked, len(text)))
            run.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
            if held.last("a"):
                linked += m.start() - at
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            i = held.last(tag)
            if tag in BLOCK:
                if i or tag == "p":  # an end without its paragraph still parts texts
                    flush()
                if i:
                    held.close(i)
            elif i > held.blocks[-1]:  # an inline end does not close a block
                held.close(i)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append(" ")
            continue
        if tag == "html" or tag == "body" and held.last("body"):
            continue
        if tag in BLOCK:
            flush()
            held.make_room(tag)
            held.push(tag, out.node(held.nodes[-1], tag, _families(m["attrs"] or "")))
        else:
            held.push(tag, held.nodes[-1])
    if at < len(page):
        run.append(page[at:])
    flush()
    return out


N_TAGS = 19
_SELF, _ABOVE = N_TAGS, N_TAGS + len(FAMILIES)
N_FEATURES = N_TAGS + 2 * len(FAMILIES) + 28
_TEXT = TAGS["#text"]


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    parent = np.array(page.parent)
    tag = np.array([TAGS.get(t, 18) for t in page.tag])
    family = np.array(page.family)
    own = np.array([[len(t), len(_SENTENCE.findall(t)), t.count(" ") + 1 if t else 0] for t in page.text], np.float64).reshape(n, 3)
    size = np.stack([own[:, 0], np.array(page.linked, np.float64), own[:, 1], own[:, 2], (tag == TAGS["p"]).astype(float), (tag == TAGS["li"]).astype(float), (tag == 13).astype(float), np.ones(n), ((tag == 5) | (tag == 6)).astype(float), (tag == _TEXT).astype(float)], axis=1)
    before = np.concatenate([[0.0], np.cumsum(own[:, 0])[:-1]])
    total = max(1.0, own[:, 0].sum())
    depth, above, above_tag = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    index, count = np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    left, right = np.full(n, -1), np.full(n, -1)
    for v in range(1, n):
        p = page.parent[v]
        depth[v] = depth[p] + 1
        above[v] = above[p] | family[p]
        above_tag[v] = above_tag[p] | (1 << int(tag[p]))
        index[v] = count[p]
        count[p] += 1
        if p in last:
            left[v], right[last[p]] = last[p], v
        last[p] = v
    for v in range(n - 1, 0, -1):
        size[page.parent[v]] += size[v]
    children = count[np.maximum(parent, 0)]
    x = np.zeros((n, N_FEATURES), np.float32)
    x[np.arange(n), tag] = 1
    for i in range(len(FAMILIES)):
        x[:, _SELF + i] = family >> i & 1
        x[:, _ABOVE + i] = above >> i & 1
    length = size[:, 0]
    at = N_TAGS + 2 * len(FAMILIES)
    near = lambda who, what: np.where(who >= 0, what[np.maximum(who, 0)], -1.0)
    density = size[:, 1] / np.maximum(1, length)
    around = np.maximum(parent, 0)
    columns = [
        np.log1p(length), density, size[:, 2] / np.maximum(1, size[:, 3]), np.log1p(size[:, 3]), np.log1p(size[:, 4]), np.log1p(size[:, 5]), size[:, 6], size[:, 7] / np.maximum(1, length / 20), size[:, 8],
        length / total, depth, index, children, index / np.maximum(1, children), before / total,
        near(left, np.log1p(length)), near(right, np.log1p(length)), near(left, density), near(right, density), length / np.maximum(1, size[:, 9]),
        np.log1p(length[around]), density[around], size[around, 2] / np.maximum(1, size[around, 3]), tag[around].astype(float),
        (above_tag & (1 << 0 | 1 << 1) > 0).astype(float), (above_tag & (1 << 9 | 1 << 10 | 1 << 11) > 0).astype(float), (above_tag & (1 << 12) > 0).astype(float), (above_tag & (1 << 13) > 0).astype(float),
    ]
    for i, c in enumerate(columns):
        x[:, at + i] = c
    return x


def decode(page: Page, p: np.ndarray) -> list[int]:
    """Leaves kept by the best labelling in which a kept node's parent is kept."""
    n = len(page.tag)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p).tolist(), np.log(1 - p).tolist()
    for v in range(n - 1, 0, -1):
        u = page.parent[v]
        keep[u] += max(keep[v], drop[v])
        drop[u] += drop[v]
    kept = [False] * n
    out = []
    for v in range(n):
        u = page.parent[v]
        kept[v] = keep[v] > drop[v] and (u < 0 or kept[u])
        if kept[v] and page.tag[v] == "#text":
            out.append(v)
    return out


# --- Training pages -------------------------------------------------------------------------------------------------

_MARK = "\ue000"  # begins every leaf of an article


class _Writer:
    """Random pages in several layouts; article leaves begin with a private mark."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.vocabulary = ["".join(rng.choice(["ta", "re", "on", "li", "mo", "en", "su", "ka", "di", "el", "os", "ra", "ni", "th", "er", "ou", "ç", "ä"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choice(self.vocabulary) for _ in range(self.r.randint(lo, hi)))

    def prose(self, sentences: int) -> str:
        """Sentences, now and then shouted, littered with signs or without stops, as real pages are."""
        text = " ".join(self.words(2, 18).capitalize() + self.r.choice(".... ?!") for _ in range(sentences))
        style = self.r.random()
        if style < 0.06:
            return text.upper()
        if style < 0.12:
            return " ".join(w + self.r.choice(["%%%", "***", "###", "&amp;&amp;"]) for w in text.split())
        return text.replace(".", "") if style < 0.15 else text

    def some(self, *options):
        return self.r.choice(options)

    def links(self, n: int) -> str:
        item = self.some("<li><a href='/{0}'>{1}</a></li>", "<a href=\"/{0}\">{1}</a> ", "<li class=item><a href='#'>{1}</a>", "<span><a href=/{0}>{1}</a></span> | ")
        stop = self.some("", "", ".", ",", "?")  # menus made of words of a text keep its stops
        body = "".join(item.format(i, self.words(1, self.some(1, 2, 4)) + (stop if self.r.random() < 0.5 else "")) for i in range(n))
        return f"<ul>{body}</ul>" if item.startswith("<li") else body

    def box(self, kind: str, names: str, body: str, semantic: str = "") -> str:
        """A block of page furniture: a telling element, a telling class or id, or now and then neither."""
        name = self.r.choice(names.split())
        name = self.some(name, name.title(), f"site-{name}", f"{name}-box", f"{name} wrap", f"page_{name}")
        if semantic and self.r.random() < 0.6:
            return f"<{semantic}{self.some('', f' class={name!r}')}>{body}</{semantic}>"
        return f"<div {self.some('class', 'id', 'class')}=\"{name}\">{body}</div>"

    def furniture(self) -> dict[str, str]:
        r = self.r
        para = lambda: self.some(self.prose(r.randint(1, 3)), f"<p>{self.prose(r.randint(1, 4))}</p>", f"<p>{self.words(2, 10)}</p>")
        return {
            "nav": self.box("nav", "nav menu navbar breadcrumb navigation", self.links(r.randint(2, 12)), "nav"),
            "crumbs": self.box("nav", "breadcrumb breadcrumbs pagination", self.links(r.randint(2, 4)), "nav"),
            "header": self.box("header", "header banner masthead topbar", self.some("", f"<h1><a href='/'>{self.words(1, 3)}</a></h1>", f"<a href='/'>{self.words(1, 3)}</a>") + self.some("", f"<p>{self.words(3, 9)}</p>", self.links(4)), "header"),
            "footer": self.box("footer", "footer copyright legal colophon", f"&copy; {self.words(1, 3)} &middot; {para()}" + self.some("", self.links(5)), "footer"),
            "side": self.box("side", "sidebar aside widget related recommended", f"<h3>{self.words(1, 3)}</h3>" + self.some(self.links(6), para(), self.links(3) + para()), "aside"),
            "ad": self.box("ad", "ad ads advert sponsored promo advertisement", self.some(para(), f"<a href='#'>{self.words(3, 12)}</a>", f"{self.prose(1)}")),
            "notice": self.box("notice", "cookie notice consent alert newsletter popup", para() + self.some("", "<button>OK</button>", "<a href='#'>ok</a>"), self.some("", "", "dialog")),
            "form": self.some(f"<form action='/s'><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>{self.some('', para())}</form>", self.box("form", "search login signup form", f"{self.words(2, 6)}<input><button>{self.words(1, 1)}</button>")),
            "share": self.box("share", "share social follow byline tools", self.some(self.links(4), self.words(2, 6))),
            "comments": self.box("comments", "comments comment replies discussion respond", f"<h3>{self.words(1, 3)}</h3>" + "".join(self.some("<div class=comment><b>{0}</b><p>{1}</p></div>", "<li class='reply'><p>{1}</p>", "<div><p>{1}</p></div>", "<article class='comment'><p>{1}</p></article>").format(self.words(1, 2), self.prose(r.randint(1, 5))) for _ in range(r.randint(1, 6))), self.some("", "", "section")),
            "hidden": f"<div {self.some('hidden', 'style=\"display:none\"', 'aria-hidden=true')}>{para()}</div>",
        }

    def article(self) -> str:
        r, out = self.r, []
        inline = lambda s: s if r.random() < 0.6 else self.some("<b>{}</b>", "<b>{}", "<em>{}</em>", "<span>{}</span>", "<a href='/x'>{}</a>").format(s)
        if r.random() < 0.85:
            head = f"<h1>{_MARK}{self.words(2, 10)}</h1>"
            out.append(self.some(head, head, head, f"<header>{head}</header>"))
        for _ in range(self.some(0, 1, 1, 2, 3, 5, 8, 12)):
            kind = r.random()
            if kind < 0.72:
                text = inline(self.prose(self.some(1, 2, 4, 8))) + self.some("", " " + inline(self.words(2, 6)), "<br>" + self.prose(1), "<br>")
                out.append(f"<p>{_MARK}{text}" + self.some("</p>", "</p>", ""))
            elif kind < 0.8:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{_MARK}{self.words(1, 6)}</h{level}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{_MARK}{inline(self.words(2, 15))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{_MARK}{self.prose(2)}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_MARK}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.97:
                out.append(f"<pre>{_MARK}{self.words(3, 20)}</pre>")
            else:
                out.append(f"<div>{_MARK}{self.prose(r.randint(1, 4))}</div>")
        if not out:
            out.append(self.some(f"<p>{_MARK}{self.prose(r.randint(1, 6))}</p>", f"<p>{_MARK}{self.words(1, 4)}</p>"))
        if r.random() < 0.15:  # very short articles: a heading and a word or two
            short = self.words(1, 3).capitalize() + self.some("", ".", "!")
            out = [f"<h1>{_MARK}{short}</h1>", f"<p>{_MARK}{self.some('', '<b>')}{short}{self.some('', '<br>', ' ' + self.words(1, 2))}</p>"]
        return "".join(out)

    def page(self) -> str:
        r, f = self.r, self.furniture()
        body = self.article()
        inner = [k for k in ("share", "ad", "side", "form", "notice") if r.random() < 0.12]
        for k in inner:  # furniture inside the article
            spot = body.find("<p>", r.randint(0, len(body)))
            body = body[:spot] + self.furniture()[k] + body[spot:] if spot > 0 else body + self.furniture()[k]
        wrap = self.some("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', '<div class="entry-content">{}</div>', "<section>{}</section>", "<div>{}</div>", '<div class="page"><div class="row"><div class="article-body">{}</div></div></div>', "<td>{}</td>")
        comments = f["comments"] if r.random() < 0.35 else ""
        if comments and r.random() < 0.4:
            body += comments
            comments = ""
        main = wrap.format(body)
        main = f"<table><tr><td>{f['side'] if r.random() < 0.5 else f['nav']}</td>{main}</tr></table>" if main.startswith("<td>") else main
        top = [f[k] for k in ("notice", "header", "nav", "form", "crumbs", "ad", "hidden", "share") if r.random() < 0.4]
        end = [comments] + [f[k] for k in ("side", "ad", "share", "form", "notice") if r.random() < 0.3] + ([f["footer"]] if r.random() < 0.85 else [])
        if r.random() < 0.3:
            r.shuffle(top)
        whole = "".join(top) + main + "".join(end)
        if r.random() < 0.3:
            whole = f'<div {self.some("id=wrapper", "class=container", "class=\"site\"")}>{whole}</div>'
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{whole}" + self.some("</body></html>", "")


TRAIN_PAGES = 1500


def training_set(pages: int = TRAIN_PAGES, seed: int = 11) -> tuple[np.ndarray, np.ndarray, list[Page]]:
    rng = random.Random(seed)
    xs, ys, kept = [], [], []
    for _ in range(pages):
        page = parse(_Writer(rng).page())
        y = np.array([t.startswith(_MARK) for t in page.text], float)
        page.text = [t.replace(_MARK, "") for t in page.text]
        for v in range(len(y) - 1, 0, -1):
            y[page.parent[v]] = max(y[page.parent[v]], y[v])
        xs.append(features(page))
        ys.append(y)
        kept.append(page)
    return np.concatenate(xs), np.concatenate(ys), kept


@lru_cache(maxsize=1)
def model() -> hgb.Trees:
    x, y, _ = training_set()
    return hgb.fit(x, y, trees=70, depth=5, rate=0.2, bins=32, min_rows=8)


def extract_pages(pages, trees: hgb.Trees) -> list[str]:
    """Main texts of a list of pages; the nodes of all are scored together."""
    parsed = [parse(p) if p else None for p in pages]
    xs = [features(p) for p in parsed if p is not None]
    scores = trees.score(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for p in parsed:
        if p is None:
            out.append("")
            continue
        n = len(p.tag)
        out.append("\n".join(p.text[v] for v in decode(p, scores[at : at + n])))
        at += n
    return out


def extract(pages: DataFrame, trees: hgb.Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    trees = trees or model()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = extract_pages([x.as_py() for x in part.column(2)], trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
