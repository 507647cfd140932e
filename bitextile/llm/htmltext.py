"""Main text of web pages by gradient-boosted trees over DOM nodes.

A forgiving parser, linear in the page's length, builds the tree of block elements of each whole page (inline elements
belong to their block). Each node has features of its tag, its depth, its subtree's density of text, links and nodes,
its siblings, its ancestors and its attribute tokens: TOKENS hashed buckets of words of class, id, role and itemprop,
each with the log-odds of main text that the training pages show for it; boosted trees give the log-odds that its text is main text. Labels are decoded for the
whole tree at once: a node is outside (its children may begin main text), inside, or excluded with all below it, and
the consistent labelling with the largest sum of log-odds is kept, so no descendant contradicts an ancestor. What it
costs to begin main text at a node is learned on pages that neither tokens nor trees have seen. What is
never text (scripts, styles, comments, markup, form controls) is dropped by the parser.

The trees are trained when first used on PAGES pages with known labels, made here by rule in many layouts: navigation,
adverts, sidebars, notices, forms, comments and footers around and inside articles, with telling or bare attributes, or
nothing around them; articles of one line or many, with headings of one word, short lists, tables, figures, line breaks
for paragraphs, in landmarks, in plain boxes, or straight in the body.

Text of a block: character references decoded, white space made one space (a line break too), trimmed; blocks in page
order are joined by a line feed. Defined results: null, empty and text-free pages have the empty text. Unclosed and
stray tags never fail. Repeated rows are extracted alike; null page_id and url stay null; an empty table has no rows; extra columns are ignored. A "<" that
begins no tag, or after which no ">" comes, is text.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .fingerprint import slices

PAGES, TREES, DEPTH, BINS, STEP, TOKENS = 600, 60, 5, 32, 0.25, 4096
#: What it may cost, in weighted log-odds, to begin main text at a node; which of these is learned.
BEGINNINGS = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0)

# Element names by their role in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "textarea", "select", "button", "title", "audio", "video")
KINDS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl"}, {"div", "section", "center"}, {"article", "main"},
    {"nav", "menu"}, {"header", "hgroup"}, {"footer", "address"}, {"aside"}, {"form", "fieldset", "dialog"}, {"table", "tbody", "thead", "tr", "td", "th"},
    {"pre", "blockquote", "figure", "figcaption", "details"}, {"html", "body"},
]
BARRIER = frozenset("html body article main section div td th table aside nav footer header form blockquote li".split())

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]*)[\s]*(=?)[\s]*")
_BARE = re.compile(r"[^\s>]*")
TELLING = frozenset(("class", "id", "role", "itemprop"))
_WORD = re.compile(r"[a-z]+")
_RAWEND = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_KIND = {t: k for k, group in enumerate(KINDS) for t in group}


def token(word: str) -> int:
    return zlib.crc32(word.encode()) % TOKENS


class Scanner:
    """Finds tags one after the other. Positions are only looked for once: what no later text has is remembered."""

    def __init__(self, source: str):
        self.source, self.last, self.none = source, source.rfind(">"), set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        k = self.source.find(what, at)
        if k < 0:
            self.none.add(what)
        return k

    def next(self, at: int) -> tuple[int, int, str, list[tuple[str, str]]] | None:
        """The first tag at or after a place: its beginning, its end, its name with a slash for an end tag ("" for a
        comment or declaration; a slash after it stands as a last attribute), and its attributes."""
        source = self.source
        while True:
            at = source.find("<", at)
            if at < 0 or at >= self.last:
                return None
            if source.startswith("<!--", at):
                k = self.find("-->", at + 2)
                return at, len(source) if k < 0 else k + 3, "", []
            if source[at + 1] in "!?":
                return at, source.index(">", at) + 1, "", []
            m = _NAME.match(source, at + 1)
            if m is None:
                at += 1
                continue
            k, found = m.end(), []
            while k < len(source) and source[k] != ">":
                a = _ATTRIBUTE.match(source, k)
                name, k = a.group(1), a.end()
                if not a.group(2):
                    if name:
                        found.append((name, ""))
                    continue
                q = source[k] if k < len(source) else ""
                close = self.find(q, k + 1) if q and q in "\"'" else -1
                if close >= 0:
                    found.append((name, source[k + 1 : close]))
                    k = close + 1
                else:  # ends at white space or ">", whatever quotes it has
                    b = _BARE.match(source, k)
                    found.append((name, b.group()))
                    k = b.end()
            if k >= len(source):  # a quote reaches behind the last ">"
                return at, source.index(">", at) + 1, m.group(), found[:0]
            if source[k - 1] == "/" and (not found or not found[-1][1].endswith("/")):
                found.append(("/", ""))
            return at, k + 1, m.group(), found


class Page:
    """Block elements in page order (parents first) and the page's blocks of text."""

    __slots__ = ("tag", "parent", "tokens", "blocks")

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens = ["html"], [-1], [()]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        stack: list[tuple[str, int]] = [("html", 0)]
        open_: dict[str, int] = {"html": 1}
        parts: list[str] = []
        links = in_link = 0

        def flush():
            nonlocal links
            if parts:
                text = " ".join(htmllib.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1][1], text, links))
                parts.clear()
            links = 0

        def close(upto: int):
            nonlocal in_link
            while len(stack) > upto:
                name, _ = stack.pop()
                open_[name] -= 1
                if name == "a":
                    in_link -= 1

        at, end = 0, len(source)
        scanner, never = Scanner(source), set()
        for first, after, name, attributes in iter(lambda: scanner.next(at), None):
            if first > at:
                piece = source[at:first]
                parts.append(piece)
                if in_link:
                    links += len(piece)
            at = after
            if not name:
                continue
            name = name.lower()
            whole = bool(attributes) and attributes[-1][0] == "/"
            if name[0] == "/":
                name = name[1:]
                if open_.get(name):
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    if name not in INLINE:
                        flush()
                    if k:
                        close(k)
                elif name == "p":
                    flush()
                continue
            if name in _RAWEND:
                parts.append(" ")
                stop = None if name in never else _RAWEND[name].search(source, at)
                if stop is None:
                    never.add(name)
                if not whole:
                    at = stop.end() if stop else end if name in ("script", "style") else at
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                parts.append(" ")
                continue
            if name in INLINE:
                if not whole:
                    stack.append((name, stack[-1][1]))
                    open_[name] = open_.get(name, 0) + 1
                    in_link += name == "a"
                continue
            flush()
            if name in ("html", "body", "head") and open_.get(name):
                continue
            ends = "p" if open_.get("p") else None
            if name in ("li", "dd", "dt", "tr", "td", "th", "option") and open_.get(name):
                ends = name
            if ends:
                k = len(stack) - 1
                stop = BARRIER - {ends} | {"ul", "ol", "dl", "table"}
                while stack[k][0] != ends and stack[k][0] not in stop:
                    k -= 1
                if stack[k][0] == ends:
                    close(k)
            own = {token(w) for n, value in attributes if n.lower() in TELLING for w in _WORD.findall(value.lower())}
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1][1])
            self.tokens.append(tuple(sorted(own)))
            stack.append((name, node))
            open_[name] = open_.get(name, 0) + 1
        if at < end:
            parts.append(source[at:])
        flush()


NAMES = ["depth", "text", "own", "nodes", "density", "link_share", "own_links", "stops", "place", "siblings", "of_parent", "of_page", "best_token", "worst_token", "up_best", "up_worst", "before", "after", "parent_kind", "paragraphs", "parent_links", "parent_stops", "parent_text", "parent_paragraphs", "of_unlinked", "rest_links", *(f"is{k}" for k in range(len(KINDS))), *(f"under{k}" for k in range(len(KINDS)))]


def features(p: Page, odds: np.ndarray) -> np.ndarray:
    """odds: log-odds of main text of the attribute tokens."""
    n = len(p.tag)
    parent = np.array(p.parent)
    kind = np.array([_KIND.get(t, -1) for t in p.tag])
    own, links, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text, ln in p.blocks:
        own[node] += len(text)
        links[node] += ln
        stops[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
    text, link, stop, nodes, par = own.copy(), links.copy(), stops.copy(), np.ones(n), (kind == 0).astype(float)
    depth, up_best, up_worst = np.zeros(n), np.zeros(n), np.zeros(n)
    under = np.zeros((n, len(KINDS)))
    best, worst = np.zeros(n), np.zeros(n)
    for k, own_tokens in enumerate(p.tokens):
        if own_tokens:
            x = odds[list(own_tokens)]
            best[k], worst[k] = max(x.max(), 0), min(x.min(), 0)
    count, place = np.zeros(n), np.zeros(n)
    before, after, last = np.zeros(n), np.zeros(n), {}
    for k in range(n - 1, 0, -1):
        q = parent[k]
        text[q] += text[k]
        link[q] += link[k]
        stop[q] += stop[k]
        nodes[q] += nodes[k]
        par[q] += par[k]
    for k in range(1, n):
        q = parent[k]
        depth[k] = depth[q] + 1
        up_best[k] = max(up_best[q], best[q])
        up_worst[k] = min(up_worst[q], worst[q])
        under[k] = under[q]
        if kind[q] >= 0:
            under[k, kind[q]] = 1
        place[k] = count[q]
        count[q] += 1
        j = last.get(q)
        if j is not None:
            before[k], after[j] = text[j], text[k]
        last[q] = k
    siblings = np.where(parent >= 0, count[parent], 1)
    of_parent = text / np.maximum(np.where(parent >= 0, text[parent], text), 1)
    one = np.zeros((n, len(KINDS)))
    has = kind >= 0
    one[np.flatnonzero(has), kind[has]] = 1
    cols = [
        depth, np.log1p(text), np.log1p(own), np.log1p(nodes), np.log1p(text / nodes), np.minimum(link / np.maximum(text, 1), 2), np.minimum(links / np.maximum(own, 1), 2), stop / np.maximum(text, 1),
        place / np.maximum(siblings, 1), np.log1p(siblings), of_parent, text / max(text[0], 1), best, worst, up_best, up_worst, np.log1p(before), np.log1p(after), np.where(parent >= 0, kind[parent], -1), np.log1p(par),
        (link / np.maximum(text, 1))[parent], (stop / np.maximum(text, 1))[parent], np.log1p(text)[parent], np.log1p(par)[parent], np.maximum(text - link, 0) / max(text[0] - link[0], 1), (link[0] - link) / np.maximum(text[0] - text, 1),
    ]
    return np.concatenate([np.stack(cols, 1), one, under], 1).astype(np.float32)


class Boosted:
    """Gradient-boosted trees of fixed depth on binned features, with logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        rate = float((y * weight).sum() / weight.sum())
        self.bias = np.log(rate / (1 - rate))
        f = np.full(len(y), self.bias)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, value = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf, np.float32)
            for level in range(DEPTH):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                for c in range(x.shape[1]):
                    at = (node - first) * (BINS + 1) + binned[:, c]
                    gs = np.bincount(at, g, many * (BINS + 1)).reshape(many, -1)
                    hs = np.bincount(at, h, many * (BINS + 1)).reshape(many, -1)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[:, len(cuts[c]) :] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(many), k]
                    for i in np.flatnonzero(top > best):
                        best[i], feature[first + i], value[first + i] = top[i], c, cuts[c][k[i]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > value[node])
            leaf = node - (2**DEPTH - 1)
            out = STEP * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            f += out[leaf]
            self.trees.append((feature, value, out))

    def logodds(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, value, out in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            f += out[node - (2**DEPTH - 1)]
        return f


def _made(rng) -> tuple[str, set[str]]:
    """A page, and marks: each block of main text begins with a mark word."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    chance = lambda p: rng.random() < p
    bare = chance(0.35)
    serial = [0]

    def words(n):
        return " ".join("".join(pick("an", "re", "ti", "on", "er", "le", "que", "st", "ou", "en", "cion", "ung") for _ in range(int(rng.integers(1, 5)))) for _ in range(max(1, int(n))))

    def sentence(n):
        out = words(n)
        return out.capitalize() + pick(".", ".", ".", "!", "?", ",")

    def prose(main, tag="p", n=None):
        serial[0] += 1
        mark = f"{'kept' if main else 'gone'}{serial[0]}x"
        body = " ".join(sentence(rng.integers(2, 18)) for _ in range(n or int(rng.integers(1, 9) if chance(0.8) else 1)))
        if chance(0.15):
            body = re.sub(r" (\w+)", lambda m: f" <{pick('b', 'i', 'em', 'a href=x')}>{m.group(1)}</b>", body, count=1)
        if tag == "p" and chance(0.1):
            return f"<p><b>{mark} {body}<br>"
        return f"<{tag}>{mark} {body}</{tag}>" if tag != "p" or chance(0.9) else f"<p>{mark} {body}"

    def box(tag, names, inside):
        attr = "" if bare or tag not in ("div", "section", "ul") and chance(0.6) else f' {pick("class", "id")}="{pick(*names)}"'
        return f"<{tag}{attr}>{inside}</{tag}>"

    def links(n):
        serial[0] += 1
        return "<ul>" + "".join(f'<li><a href="/{k}">{f'gone{serial[0]}x ' if chance(0.3) else ''}{sentence(rng.integers(1, 4)) if chance(0.4) else words(rng.integers(1, 4))}</a></li>' for k in range(int(n))) + "</ul>"

    small = lambda: listed(False) if chance(0.08) else grid(False) if chance(0.03) else bit(False, pick("p", "div", "h4"), 4) if chance(0.12) else prose(False, pick("p", "p", "span", "h3"), int(rng.integers(1, 3)))
    advert = lambda: f'<div class="{pick("ad", "ads", "advert", "banner", "promo", "sponsored")}">' + (small() if chance(0.6) else f"gone0x {sentence(rng.integers(2, 14))}") + "</div>"

    def bit(main, tag, most=2):
        """A block of one word, or few."""
        serial[0] += 1
        more = int(rng.integers(0, most))
        mark = f"{'kept' if main else 'gone'}{serial[0]}x"
        mark = mark.replace("x", "") if chance(0.3) else mark
        return f"<{tag}>{mark}{' ' + words(more) if more else ''}</{tag}>"

    def listed(main):
        kind = pick("ul", "ul", "ol", "dl")
        if kind == "dl":
            return "<dl>" + "".join(bit(main, "dt") + bit(main, "dd", 5) for _ in range(int(rng.integers(1, 5)))) + "</dl>"
        most = pick(1, 2, 4)
        return f"<{kind}>" + "".join(bit(main, "li", most + 1) for _ in range(int(rng.integers(2, 9)))) + f"</{kind}>"

    def grid(main):
        wide = int(rng.integers(1, 5))
        row = lambda tag: "<tr>" + "".join(bit(main, tag) for _ in range(wide)) + "</tr>"
        inside = "".join(row("td") for _ in range(int(rng.integers(1, 6))))
        return "<table>" + (f"<thead>{row('th')}</thead><tbody>{inside}</tbody>" if chance(0.3) else (row("th") if chance(0.5) else "") + inside) + "</table>"

    def broken():
        """Paragraphs parted by line breaks: one block."""
        serial[0] += 1
        return f"kept{serial[0]}x " + pick("<br>", "<br><br>", "<br/>").join(" ".join(sentence(rng.integers(3, 18)) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(1, 7))))

    def article():
        out = []
        if chance(0.85):
            out.append(bit(True, "h1", pick(1, 2, 5)) if chance(0.5) else prose(True, "h1", 1))
        if chance(0.2):
            out.append(box("div", ("meta", "share", "social"), links(3) if chance(0.5) else small()))
        if chance(0.12):
            return "".join([*out, broken() if chance(0.5) else f"<div>{broken()}</div>"])
        for k in range(int(rng.integers(1, 14)) if chance(0.65) else int(rng.integers(1, 4))):
            r = rng.random()
            if k and r < 0.32:
                out.append(pick(listed, listed, grid)(True) if chance(0.6) else pick(lambda: bit(True, pick("h2", "h3", "h4"), 3), lambda: f"<figure><img src=x>{bit(True, 'figcaption', 8)}</figure>", lambda: f"<blockquote>{bit(True, 'p', 6)}</blockquote>", lambda: bit(True, "pre", 4), lambda: bit(True, "p", 4))())
            elif r < 0.78:
                out.append(prose(True))
            elif r < 0.84:
                out.append(prose(True, pick("h2", "h3")))
            elif r < 0.9:
                out.append("<ul>" + "".join(prose(True, "li", 1) for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif r < 0.94:
                out.append(f"<blockquote>{prose(True)}</blockquote>")
            elif r < 0.97:
                out.append(advert())
            else:
                out.append(prose(True, "pre", 2))
        return "".join(out)

    comments = lambda: box(pick("section", "div"), ("comments", "comment-list", "discussion"), "<h3>gone0x comments</h3>" + "".join(f'<div class="comment">{prose(False)}</div>' for _ in range(int(rng.integers(1, 6)))))
    top = [box("nav", ("nav", "menu"), links(rng.integers(2, 12))) if chance(0.8) else box(pick("div", "ul"), ("menu", "navbar", "nav"), links(rng.integers(2, 12)))]
    if chance(0.4):
        top.insert(int(rng.integers(2)), box(pick("header", "header", "div"), ("header", "masthead", "top-header"), f"<h2>gone0x {words(3)}</h2>" + (small() if chance(0.5) else "")))
    if chance(0.6):
        top.append(advert())
    if chance(0.25):
        top.append(box("div", ("cookie-notice", "notice", "consent", "alert"), small()))
    text = article()
    if chance(0.12):  # nothing around it
        alone = pick("", "", "article", "main", "div")
        text = broken() if not alone and chance(0.25) else text
        text = f"<{alone}>{text}</{alone}>" if alone else text
        return text if chance(0.4) else f"<html><head><title>x</title></head><body>{text}</body></html>"
    inner = comments() if chance(0.08) else ""
    if chance(0.15):
        text = re.sub(r"<(/?)p>", r"<\1div>", text)
    core = text + inner if chance(0.18) else f"<article>{text}{inner}</article>" if chance(0.6) else box(pick("main", "div", "section", "div"), ("content", "post", "entry-content", "article-body", "main", "story"), text + inner)
    if chance(0.2):
        core = box("div", ("container", "wrapper", "row"), core)
    bottom = []
    if chance(0.35):
        bottom.append(box(pick("aside", "div"), ("sidebar", "widget", "related"), "<h3>gone0x more</h3>" + (links(rng.integers(2, 8)) if chance(0.6) else small() + small())))
    if chance(0.3):
        bottom.append(comments())
    if chance(0.2):
        bottom.append(f"<form action=x>{small()}<label>gone0x mail</label><input name=m><button>Send</button></form>")
    if chance(0.85):
        bottom.append(box(pick("footer", "footer", "div"), ("footer", "site-footer", "copyright"), f"&copy; gone0x {words(2)} &middot; {sentence(rng.integers(2, 12))}" if chance(0.6) else small() + links(3)))
    if chance(0.3):
        side = bottom.pop(0) if bottom else ""
        top.append(side)
    return "<html><head><title>x</title><style>p{}</style></head><body>" + "".join([*top, core, *bottom]) + "</body></html>"


class Extractor:
    """The attribute tokens' log-odds, the trees and the cost of a beginning, from pages (source, whose main blocks begin
    with "kept"). Tokens are learned on the even pages, trees on the odd ones, so that trees see what tokens are worth on
    other pages; the cost on a fifth of the pages that both leave out."""

    def __init__(self, sources: list[str]):
        every = [Page(x) for x in sources]
        pages, tried = every[len(every) // 5 :], every[: len(every) // 5]
        known = []
        for p in pages:
            size, main = np.zeros(len(p.tag)), np.zeros(len(p.tag))
            for node, text, _ in p.blocks:
                k = node
                while k >= 0:
                    size[k] += len(text)
                    main[k] += len(text) * text.startswith("kept")
                    k = p.parent[k]
            known.append((size, main > 0.7 * size))
        seen = np.zeros((TOKENS, 2))
        for p, (size, y) in list(zip(pages, known))[::2]:
            for k, own in enumerate(p.tokens):
                if size[k]:
                    seen[list(own), int(y[k])] += 1
        rate = seen.sum(0) / max(seen.sum(), 1)
        near = seen + 4 * np.maximum(rate, 1e-3)
        self.odds = np.where(seen.sum(1) > 0, np.log(near[:, 1] / near[:, 0]) - np.log(max(rate[1], 1e-3) / max(rate[0], 1e-3)), 0.0)
        odd = list(zip(pages, known))[1::2]
        x = np.concatenate([features(p, self.odds) for p, _ in odd])
        y = np.concatenate([y for _, (_, y) in odd]).astype(float)
        w = np.concatenate([(size > 0) * (1 + np.log1p(size)) for _, (size, _) in odd])
        self.trees = Boosted(x[w > 0], y[w > 0], w[w > 0] / w.mean())
        scores = [(p, self.trees.logodds(features(p, self.odds))) for p in tried if p.blocks]
        self.begin = min(BEGINNINGS, key=lambda b: sum(_wrong(p, decode(p, x, b)) for p, x in scores))


def _wrong(p: Page, keep: np.ndarray) -> int:
    """Blocks of a made page on the wrong side."""
    return sum(bool(keep[node]) != text.startswith("kept") for node, text, _ in p.blocks)


_model: list[Extractor] = []


def model() -> Extractor:
    """Trained once a process."""
    if not _model:
        rng = np.random.Generator(np.random.PCG64(5))
        _model.append(Extractor([_made(rng) for _ in range(2 * PAGES)]))
    return _model[0]


def decode(p: Page, logodds: np.ndarray, begin: float) -> np.ndarray:
    """Which nodes are inside main text."""
    n = len(p.tag)
    size = np.zeros(n)
    for node, text, _ in p.blocks:
        size[node] += len(text)
    gain = logodds * np.log1p(size)
    inside, outside = gain.tolist(), [0.0] * n
    for k in range(n - 1, 0, -1):
        q = p.parent[k]
        inside[q] += max(inside[k], 0.0)
        outside[q] += max(inside[k] - begin, outside[k], 0.0)
    state = np.zeros(n, np.int8)  # 0 outside, 1 inside, 2 excluded
    state[0] = 1 if inside[0] - begin > outside[0] else 0
    for k in range(1, n):
        above = state[p.parent[k]]
        if above == 2:
            state[k] = 2
        elif above == 1:
            state[k] = 1 if inside[k] > 0 else 2
        else:
            state[k] = 1 if inside[k] - begin > 0 and inside[k] - begin >= outside[k] else 0
    return state == 1


def extract(sources: list[str | None], extractor: Extractor) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    found = [features(p, extractor.odds) for p in pages]
    scores = extractor.trees.logodds(np.concatenate(found))
    out, at = [], 0
    for p, x in zip(pages, found):
        keep = decode(p, scores[at : at + len(x)], extractor.begin)
        at += len(x)
        out.append("\n".join(text for node, text, _ in p.blocks if keep[node]))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = prepare(pages.sparkSession)
    learned = spark.sparkContext.broadcast(model())

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(2)):
                texts = extract(b.column(2).slice(lo, hi - lo).to_pylist(), learned.value)
                yield pa.RecordBatch.from_pydict({"page_id": b.column(0).slice(lo, hi - lo), "url": b.column(1).slice(lo, hi - lo), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
