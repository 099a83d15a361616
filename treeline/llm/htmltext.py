"""Operator 10: main text of web pages by boosted trees over DOM nodes.

A lenient reader turns a page into its element nodes and the runs of text
between block boundaries. Gradient-boosted trees give each node a probability
of being main content from its tag, attribute words, depth, place among its
siblings and the density of its subtree. Decoding is hierarchical: dynamic
programming over the tree finds the most probable labels under the rule that
below a dropped node everything is dropped, so no choice contradicts another.

The trees are trained on pages made by ``made_page``, whose labels are known by
construction: ``TRAIN_PAGES`` pages from a fixed seed, the same for every table.
The fitted trees lie beside this module in ``main_text_trees.json``;
``python -m treeline.llm.htmltext`` fits them anew and a test holds the file
against a new fit. Pages are read whole, one at a time, and never shuffled.

Defined cases: null and empty html give ''; html without tags is a single block;
unclosed tags, comments and scripts end with the page; controls of forms
(``button``, ``select``) have no text; what ``object``, ``audio``, ``video`` and
``canvas`` hold is text of the block around them, ``noscript`` is a block of its
own; repeated rows give equal rows; white space within a block, also
non-breaking, becomes one blank.
"""

from __future__ import annotations

import functools
import html as entities
import json
import os
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

TRAIN_PAGES = 2_400
TREES, DEPTH, BINS, RATE = 140, 4, 32, 0.2
#: The fitted trees.
FITTED = os.path.join(os.path.dirname(os.path.abspath(__file__)), "main_text_trees.json")

# How HTML treats its elements.
RAW = {"script", "style", "template", "title", "textarea", "iframe", "svg", "select", "button", "noframes"}
#: Of these what is not closed runs to the page's end; of other raw elements, and of noscript, only the tag is skipped then.
ENDLESS = {"script", "style", "title", "textarea", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture", "center", "nobr", "object", "audio", "video", "canvas",
    "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mspace", "mpadded", "semantics",
}
#: What an opening tag closes if it is the innermost open element of its kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "option": {"option"}, "body": {"head"},
}
#: Elements at which the search for something to close ends.
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "html", "main", "nav", "aside", "blockquote", "form", "header", "footer", "td", "th"}

# Words of class, id and role attributes, by what they say of a node.
WORDS = {
    "content": "content article post entry story main body text page hentry prose copy",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toc pagination pager pages skip",
    "header": "header masthead banner logo branding topbar top hero site",
    "footer": "footer foot copyright legal colophon bottom imprint",
    "side": "sidebar side aside widget widgets rail secondary related recommended more popular trending tags",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp adslot affiliate",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall toast",
    "comments": "comment comments disqus respond reply replies discussion reader readers",
    "share": "share sharing social follow facebook twitter author byline meta",
    "form": "form search login signup input field contact",
}
WORD_OF: dict[str, list[int]] = {}
for _k, _v in enumerate(WORDS.values()):
    for _w in _v.split():
        WORD_OF.setdefault(_w, []).append(_k)
TAGS = "html body div section article main nav header footer aside p h1 h2 h3 ul ol li dl table tr td form blockquote pre figure figcaption fieldset noscript td".split()
TAG_OF = {t: k for k, t in enumerate(TAGS)}

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-t)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """A page's nodes in page order and its runs of text, each of a node, with the share of it in links."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attrs: list[str] = field(default_factory=lambda: [""])
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def read_page(source: str) -> Page:
    """Read tag soup: raw elements are skipped whole, inline elements are text, all others are nodes."""
    page, stack = Page(), [0]
    tags, parents, attrs, runs = page.tag, page.parent, page.attrs, page.runs
    held: list[str] = []
    unclosed: set[str] = set()
    linked = links = 0
    at, n = 0, len(source)
    #: How many elements of each name are open, so that a closing tag without one costs nothing.
    open_: dict[str, int] = {}

    def cut(k: int) -> None:
        for s in stack[k:]:
            open_[tags[s]] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                runs.append((stack[-1], text, min(linked, len(text))))
            held.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = entities.unescape(text)
        held.append(text)
        if links:
            linked += len(text)

    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            say(source[at:])
            break
        if begin > at:
            say(source[at:begin])
        m = TOKEN.match(source, begin)
        if m is None:  # a plain less-than sign
            say("<")
            at = begin + 1
            continue
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        closing = m.group(1)
        if name in RAW or name == "noscript" and not closing:
            if name == "noscript" and name in unclosed:
                continue
            if not closing and not m.group(3).endswith("/") and name not in unclosed:
                end = closing_tag(name).search(source, at)
                if end:
                    at = end.end() if name in RAW else at
                elif name in ENDLESS:
                    at = n
                else:
                    unclosed.add(name)
            if name in RAW or name in unclosed:
                continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                held.append(" ")
            continue
        flush()
        links = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1) if open_.get(name) else ():
                if tags[stack[k]] == name:
                    cut(k)
                    break
            continue
        if name == "html" or (name == "body" and open_.get("body")):
            continue
        while len(stack) > 1 and tags[stack[-1]] == "p":
            cut(len(stack) - 1)
        if name in CLOSES:
            close = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in close:
                    cut(k)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
                elif tags[stack[k]] in SCOPE:
                    break
        elif tags[stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6") and name[0] == "h" and name[1:].isdigit():
            cut(len(stack) - 1)
        parents.append(stack[-1])
        tags.append(name)
        attrs.append(m.group(3))
        stack.append(len(tags) - 1)
        open_[name] = open_.get(name, 0) + 1
    flush()
    return page


@functools.cache
def closing_tag(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.IGNORECASE)


def attribute_words(attrs: str) -> tuple[list[int], str]:
    """Kinds of words that the attributes hold, and the label of a made page."""
    found, label = [], ""
    if "=" in attrs:
        for m in ATTRIBUTE.finditer(attrs):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            if m.group(1).lower() == "data-t":
                label = value
            else:
                for w in PART.findall(value):
                    found += WORD_OF.get(w.lower(), ())
    return found, label


KINDS = len(WORDS)
NAMES = [*(f"tag {t}" for t in TAGS), *(f"word {w}" for w in WORDS), *(f"above {w}" for w in WORDS), *"""depth siblings place place_share same_siblings own_text
all_text text_share link_share own_link_share marks_per_char children nodes_below text_per_node paragraphs_below headings_below lists_below forms_below before_share
in_article in_main in_p parent_text_share parent_link_share words_per_run short_runs run_count article_below""".split()]  # fmt: skip


def node_features(page: Page) -> np.ndarray:
    """One row of numbers per node."""
    n = len(page.tag)
    x = np.zeros((n, len(NAMES)), np.float32)
    t, k, a, b = len(TAGS), KINDS, len(TAGS) + KINDS, len(TAGS) + 2 * KINDS
    parent = page.parent
    own, link, marks, runs, short = ([0] * n for _ in range(5))
    before, total = [None] * n, 0
    for node, text, linked in page.runs:
        size = len(text)
        own[node] += size
        link[node] += linked
        marks[node] += text.count(",") + text.count(".")
        runs[node] += 1
        short[node] += size < 25
        if before[node] is None:
            before[node] = total
        total += size
    all_, alink, amarks, aruns, ashort, below = own[:], link[:], marks[:], runs[:], short[:], [0] * n
    paragraphs, headings, lists, forms, articles, children = ([0] * n for _ in range(6))
    count_of: list[dict[str, int]] = [{} for _ in range(n)]
    place, depth = [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        place[i] = children[p]
        children[p] += 1
        c = count_of[p]
        c[page.tag[i]] = c.get(page.tag[i], 0) + 1
    for i in range(n - 1, 0, -1):
        p, tag = parent[i], page.tag[i]
        all_[p] += all_[i]
        alink[p] += alink[i]
        amarks[p] += amarks[i]
        aruns[p] += aruns[i]
        ashort[p] += ashort[i]
        below[p] += below[i] + 1
        paragraphs[p] += paragraphs[i] + (tag == "p")
        headings[p] += headings[i] + (tag in ("h1", "h2", "h3"))
        lists[p] += lists[i] + (tag == "li")
        forms[p] += forms[i] + (tag in ("form", "fieldset"))
        articles[p] += articles[i] + (tag in ("article", "main"))
        if before[i] is not None and (before[p] is None or before[i] < before[p]):
            before[p] = before[i]
    inside = {"article": [0] * n, "main": [0] * n, "p": [0] * n}
    for i in range(n):
        tag, p = page.tag[i], parent[i]
        if (j := TAG_OF.get(tag)) is not None:
            x[i, j] = 1
        for w in attribute_words(page.attrs[i])[0]:
            x[i, t + w] = 1
        if p >= 0:
            x[i, a:b] = np.maximum(x[p, a:b], x[p, t : t + k])
            for name, held in inside.items():
                held[i] = 1 if held[p] or page.tag[p] == name else 0
    par = np.array(parent)
    par[0] = 0
    f = lambda y: np.array(y, np.float32)
    share = lambda y, z: f(y) / np.maximum(f(z), 1)
    sib = f(children)[par]
    same = f([count_of[parent[i]].get(page.tag[i], 0) if i else 1 for i in range(n)])
    first = f([total if y is None else y for y in before])
    x[:, b:] = np.stack([
        f(depth), sib, f(place), share(place, sib), same / np.maximum(sib, 1), np.log1p(f(own)), np.log1p(f(all_)), f(all_) / max(total, 1), share(alink, all_), share(link, own),
        share(amarks, all_), f(children), f(below), np.log1p(share(all_, f(below) + 1)), np.log1p(f(paragraphs)), np.log1p(f(headings)), np.log1p(f(lists)), f(forms), first / max(total, 1),
        f(inside["article"]), f(inside["main"]), f(inside["p"]), f(all_)[par] / max(total, 1), share(alink, all_)[par], np.log1p(share(all_, aruns)), share(ashort, aruns), np.log1p(f(aruns)), f(articles),
    ], axis=1)
    return x


class Boosted:
    """Gradient-boosted trees for a probability: logistic loss, histogram splits, full trees of ``DEPTH`` levels."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.bins(x)
        n, features = b.shape
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.bias)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        leaves, inner = 1 << DEPTH, (1 << DEPTH) - 1
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            which, cut, node = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(n, np.int64)
            for level in range(DEPTH):
                first, width = (1 << level) - 1, 1 << level
                key = (node - first) * BINS
                best = np.full(width, 1e-3)
                for f in range(features):
                    if not len(self.edges[f]):
                        continue
                    k = key + b[:, f]
                    gs, hs = (np.bincount(k, w, width * BINS).reshape(width, BINS) for w in (g, h))
                    gl, hl = gs.cumsum(1), hs.cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    top = gain.argmax(1)
                    more = gain[np.arange(width), top]
                    better = more > best
                    best[better] = more[better]
                    which[first : first + width][better], cut[first : first + width][better] = f, top[better]
                node = 2 * node + 1 + (b[np.arange(n), which[node]] > cut[node])
            leaf = node - inner
            value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
            self.trees.append((which, cut, value))
            score += value[leaf]

    def as_json(self) -> str:
        trees = [[which.tolist(), cut.tolist(), [round(v, 6) for v in value.tolist()]] for which, cut, value in self.trees]
        return json.dumps({"names": NAMES, "bias": round(self.bias, 6), "edges": [[float(f"{x:.7g}") for x in e.tolist()] for e in self.edges], "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        held, out = json.loads(text), cls.__new__(cls)
        if held["names"] != NAMES:
            raise ValueError("the fitted trees are of other features: fit them anew")
        out.bias, out.edges = held["bias"], [np.array(e) for e in held["edges"]]
        out.trees = [tuple(map(np.array, t)) for t in held["trees"]]
        return out

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        score, rows = np.full(len(b), self.bias), np.arange(len(b))
        for which, cut, value in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, which[node]] > cut[node])
            score += value[node - len(which)]
        return score


def decode(parent: list[int], odds: np.ndarray) -> list[bool]:
    """Which nodes are kept: the most probable labels of which none below a dropped node is kept."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best_keep, all_drop = keep.tolist(), drop.tolist()
    for i in range(len(parent) - 1, 0, -1):
        p = parent[i]
        best_keep[p] += max(best_keep[i], all_drop[i])
        all_drop[p] += all_drop[i]
    kept = [True] * len(parent)  # the root holds whatever there is
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and best_keep[i] >= all_drop[i]
    return kept


def extract(sources: list[str], model: Boosted) -> list[str]:
    """The main text of each page."""
    pages = [read_page(s) for s in sources]
    if not pages:
        return []
    odds = model.log_odds(np.concatenate([node_features(p) for p in pages]))
    out, at = [], 0
    for page in pages:
        n = len(page.tag)
        kept = decode(page.parent, odds[at : at + n])
        at += n
        out.append("\n\n".join(text for node, text, _ in page.runs if kept[node]))
    return out


# ---- pages with known labels -------------------------------------------------------------------------------------


class Maker:
    """Makes pages of many layouts. ``data-t`` says whether a node is main content; nodes without it are as their parent."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: A page whose elements say by their names alone what they are.
        self.bare = self.r.random() < 0.3
        #: A page whose article has no element around it.
        self.alone = self.r.random() < 0.15

    def words(self, low: int, high: int) -> str:
        r, n = self.r, self.r.randint(low, high)
        out = ["".join(r.choice("aeiourstlndhcmpgéäñ") for _ in range(r.randint(1, 9))) for _ in range(n)]
        for k in range(n - 1):
            if r.random() < 0.09:
                out[k] += r.choice(",,.;")
        return " ".join(out).capitalize()

    def sentence(self, low: int = 2, high: int = 14) -> str:
        return self.words(low, high) + self.r.choice("...!?")

    def attrs(self, kind: str, keep: int | None, plain: float = 0.12) -> str:
        r = self.r
        out = "" if keep is None else f' data-t="{keep}"'
        if r.random() >= plain:
            w = r.choice(WORDS[kind].split())
            extra = r.choice(["", "", "", "-wrap", "__inner", "-box", "-area", " clearfix", " col-8", "-container", f"-{r.randint(1, 9)}"])
            before = r.choice(["", "", "", "c-", "js-", "wp-", "l-", "block-"])
            out += f' {r.choice(["class", "class", "class", "id"])}="{before}{w}{extra}"'
        return out

    def links(self, low: int, high: int) -> str:
        r = self.r
        items = [f'<a href="/{r.randint(1, 99)}">{self.words(1, 3)}</a>' for _ in range(r.randint(low, high))]
        form = r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return r.choice([" ", " | ", " &middot; "]).join(items) if form < 0.85 else "".join(f"<div>{i}</div>" for i in items)

    def box(self, kind: str, tags: list[str], inner: str) -> str:
        bare = self.bare and tags[0] in ("nav", "header", "footer", "aside")
        tag = tags[0] if bare else self.r.choice(tags)
        return f"<{tag}{self.attrs(kind, 0, 0.95 if bare else 0.04 if tag == 'div' else 0.5)}>{inner}</{tag}>"

    def bare_links(self) -> str:
        """A menu that nothing but its links gives away."""
        r, inner = self.r, self.links(2, 12)
        return inner.replace("<ul>", '<ul data-t="0">', 1) if inner.startswith("<ul>") else f'<{(t := r.choice(["p", "div", "div"]))} data-t="0">{inner}</{t}>'

    def scriptless(self) -> str:
        return f'<noscript data-t="0">{self.r.choice(["<p>{}</p>", "{}"]).format(self.sentence(3, 14))}</noscript>'

    def menu(self) -> str:
        if self.r.random() < 0.25:
            return self.bare_links()
        return self.box("menu", ["nav", "nav", "div", "ul"], self.links(2, 12))

    def advert(self) -> str:
        r = self.r
        return self.box("advert", ["div", "div", "aside", "section", "p"], r.choice([self.sentence(2, 18), self.links(1, 2), f"<p>{self.sentence(3, 25)}</p>", f"<h3>{self.words(1, 5)}</h3><p>{self.sentence(3, 20)}</p>"]))

    def notice(self) -> str:
        return self.box("notice", ["div", "div", "section", "aside"], self.r.choice(["", f"<h3>{self.words(1, 5)}</h3>"]) + f"<p>{self.sentence(5, 40)}</p>" * self.r.randint(0, 1) + self.sentence(4, 20) + f'<a href="#">{self.words(1, 2)}</a><button>{self.words(1, 1)}</button>')

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=q>" + self.r.choice(["", f"<p>{self.sentence(3, 16)}</p>", f"<h3>{self.words(1, 4)}</h3>"])
        return f"<form{self.attrs('form', 0, 0.5)}>{inner}</form>" if self.r.random() < 0.8 else self.box("form", ["div"], f"<form>{inner}</form>")

    def side(self) -> str:
        r, parts = self.r, []
        for _ in range(r.randint(1, 4)):
            parts.append(r.choice([f"<h3>{self.words(1, 4)}</h3>" + self.links(2, 9), f"<h4>{self.words(1, 4)}</h4><p>{self.sentence(4, 30)}</p>", self.sentence(3, 14), f"<div>{self.links(1, 5)}</div>"]))
        return self.box("side", ["aside", "aside", "div", "section"], "".join(parts))

    def footer(self) -> str:
        r = self.r
        inner = r.choice(["&copy; ", "", "(c) 2020 "]) + r.choice([f"{self.words(1, 2)}.com &middot; {self.sentence(2, 14)}", f"<p>{self.sentence(3, 20)}</p>", self.links(2, 8) + f"<p>{self.sentence(2, 9)}</p>", f"<div>{self.words(2, 8)}</div>" + self.links(1, 4), self.words(1, 3)])
        return self.box("footer", ["footer", "footer", "div", "section"], inner)

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 8)}</p>", f"<h2>{self.words(1, 4)}</h2><p>{self.sentence(2, 9)}</p>"]) + self.r.choice(["", self.menu()])
        return self.box("header", ["header", "header", "div"], inner)

    def comments(self) -> str:
        r, one = self.r, []
        for _ in range(r.randint(1, 6)):
            tag = r.choice(["div", "li", "article", "section"])
            one.append(f"<{tag}{self.attrs('comments', 0, 0.3)}>" + r.choice(["", f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 2)}</h4>"]) + r.choice([self.sentence(2, 50), f"<p>{self.sentence(2, 50)}</p>"]) + f"</{tag}>")
        return self.box("comments", ["section", "div", "div", "ol"], f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + "".join(one) + (self.form() if r.random() < 0.4 else ""))

    def share(self) -> str:
        return self.box("share", ["div", "ul", "p"], self.r.choice([self.links(2, 5), self.words(1, 4), self.words(1, 2) + self.links(1, 2)]))

    def paragraph(self) -> str:
        r, size = self.r, self.r.choice([1, 4, 15, 40, 90, 160])
        text = " ".join(self.sentence(1, 16) for _ in range(max(1, size // 8)))
        if r.random() < 0.25:
            text = f"<b>{text}" + r.choice(["</b>", "<br>", ""])
        if r.random() < 0.25:
            text += f' <a href="/x">{self.words(1, 6)}</a> {self.words(1, 8)}.'
        return f"<p>{text}" + ("</p>" if r.random() < 0.85 else "")

    def block(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.74:
            return self.paragraph()
        if x < 0.82:
            return f"<h{(k := r.randint(2, 4))}>{self.words(1, 8)}</h{k}>"
        if x < 0.88:
            return "<ul>" + "".join(f"<li>{self.sentence(1, 20)}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if x < 0.91:
            return f"<blockquote>{r.choice([self.sentence(5, 40), self.paragraph()])}</blockquote>"
        if x < 0.94:
            return f"<figure><img src=x><figcaption>{self.sentence(2, 14)}</figcaption></figure>"
        if x < 0.96:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>"
        if x < 0.967:
            return f"<noscript>{self.sentence(3, 20)}</noscript>"
        return f"<div>{self.sentence(5, 60)}</div>" if x < 0.98 else f"<pre>{self.words(5, 30)}</pre>"

    def article(self) -> str:
        r = self.r
        h = r.choice(["h1", "h1", "h1", "h2", "h2"])
        parts = [f"<{h}>{self.words(1, 12)}</{h}>"] if r.random() < 0.9 else []
        if parts and r.random() < 0.15:
            parts = [f'<header data-t="1">{parts[0]}</header>']
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14, 30])):
            parts.append(self.block())
            if r.random() < 0.05:
                parts.append(r.choice([self.advert, self.advert, self.share, self.side, self.form, self.notice])())
        if r.random() < 0.15:
            parts.append(self.share())
        inner = "".join(parts)
        if self.alone:  # no element of its own
            return inner
        tag = "article" if self.bare else r.choice(["article", "article", "div", "main", "section"])
        if r.random() < 0.25:
            inner = f"<div{self.attrs('content', 1, 0.4)}>{inner}</div>"
        return f"<{tag}{self.attrs('content', 1, 0.75 if tag in ('article', 'main') else 0.08)}>{inner}</{tag}>"

    def page(self) -> str:
        r, some = self.r, lambda p, *makers: [m() for m in makers if self.r.random() < p]
        middle = [*some(0.3, self.advert, self.share), self.article(), *some(0.35, self.comments), *some(0.3, self.advert, self.side, self.form)]
        if r.random() < 0.35:
            middle = [*some(0.5, self.side), *middle]
        inner = "".join(middle)
        if r.random() < 0.15:  # a table for layout
            cells = [f'<td{r.choice(["", " width=200", " valign=top"])} data-t="0">{r.choice([self.links, self.links, lambda a, b: self.side()])(2, 9)}</td>', f"<td>{inner}</td>"]
            if r.random() < 0.3:
                cells.append(f'<td data-t="0">{self.side()}</td>')
            if r.random() < 0.2:
                cells.reverse()
            rows = [*([f'<tr data-t="0"><td colspan=3>{r.choice([self.words(1, 4), self.links(2, 6)])}</td></tr>'] if r.random() < 0.4 else []), f"<tr>{''.join(cells)}</tr>"]
            if r.random() < 0.3:
                rows.append(f'<tr data-t="0"><td colspan=3>{self.sentence(2, 8)}</td></tr>')
            inner = f"<table{r.choice(['', ' border=0', ' width=100%'])}>{''.join(rows)}</table>"
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            inner = f"<{(w := r.choice(['div', 'div', 'main', 'section']))}{self.attrs('content', 1, 0.5)}>{inner}</{w}>"
        top = [*some(0.1, self.scriptless), *some(0.35, self.notice), *some(0.5, self.header), *some(0.75, self.menu), *some(0.4, self.advert)]
        if r.random() < 0.3:
            r.shuffle(top)
        end = [*some(0.15, self.notice, self.form, self.side), *some(0.8, self.footer)]
        return f'<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body data-t="1">{"".join(top)}{inner}{"".join(end)}' + ("</body></html>" if r.random() < 0.8 else "")


def made_page(seed: int) -> tuple[Page, list[int]]:
    """A made page and its nodes' labels."""
    page = read_page(Maker(seed).page())
    labels = [1]
    for i in range(1, len(page.tag)):
        said = attribute_words(page.attrs[i])[1]
        up = labels[page.parent[i]]
        labels.append(up and (int(said) if said else up))
    return page, labels


def fit(pages: int = TRAIN_PAGES) -> Boosted:
    """Fit the trees on made pages."""
    made = [made_page(seed) for seed in range(pages)]
    return Boosted(np.concatenate([node_features(p) for p, _ in made]), np.concatenate([y for _, y in made]).astype(float))


@functools.cache
def trained() -> Boosted:
    """The trees fitted before."""
    with open(FITTED, encoding="utf-8") as f:
        return Boosted.from_json(f.read())


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract(common.strings(batch.column(2)), held.value)
        return common.record(schema, batch.column(0).cast(pa.int64()), batch.column(1), texts, list(map(len, texts)))

    return common.arrow_map(common.pick(pages, "page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    with open(FITTED, "w", encoding="utf-8") as out:
        out.write(fit().as_json())
