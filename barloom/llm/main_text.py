"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is read as a row of tags and words. Words score by where they stand, tags score below zero, and one linear scan
finds the contiguous region with the largest sum. The weights come from labelled pages by logistic regression. Within
the region, blocks that score below zero (an advert between paragraphs) are left out; all that stands inside one
unwanted element counts at most ``FLOOR`` against a region, so that it doesn't cut an article in two.

A name speaks against an element only where what it holds doesn't speak for it: an element that has the page's heading and most
of its running text is no comment and no sidebar, whatever it is called, and words that mean little by themselves don't count
against running text within an article.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: elements by their part in a page, and name parts that mark unwanted ones
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")  # hold text only, up to their end tag
SKIPPED = ("noscript", "template", "svg", "math", "object", "select", "canvas", "audio", "video", "datalist", "rp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
).split()
CLOSED_BY = {"p": BLOCKS, "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"]}
PARTS = ("article", "main", "p", "h1", "h2", "h3", "blockquote", "pre", "table", "figure", "div", "section", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "li", "a", "address", "label", "search")
NAMES = {
    "ad": ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner", "billboard", "dfp", "outbrain", "taboola"),
    "comment": ("comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "reader"),
    "notice": ("notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "toast", "announcement"),
    "nav": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pager", "pagination", "toc", "skip", "topbar", "tabs"),
    "side": ("sidebar", "side", "aside", "widget", "widgets", "related", "recommended", "trending", "popular", "teaser", "rail", "complementary", "archive", "tags", "tagcloud"),
    "foot": ("footer", "foot", "copyright", "legal", "colophon", "contentinfo", "credits"),
    "head": ("header", "masthead", "head", "logo", "branding", "hero"),
    "share": ("share", "sharing", "social", "follow", "subscribe", "newsletter", "signup", "login", "register", "search", "form", "byline", "author", "bio", "meta"),
    "body": ("article", "content", "post", "entry", "story", "main", "body", "text"),
}
# fixed values: the same in other languages
NAMES_ABROAD = {
    "ad": ("werbung", "anzeige", "publicite", "publicidad", "reklame"),
    "comment": ("kommentar", "kommentare", "commentaire", "commentaires", "comentario", "comentarios"),
    "side": ("seitenleiste", "barra", "randspalte"),
    "foot": ("fusszeile", "pied", "impressum"),
    "head": ("kopfzeile", "entete", "cabecera"),
    "nav": ("navigationsleiste", "hauptmenu"),
}
# fixed values: those of the names that mean little by themselves
WEAK = frozenset("reader discussion respond side archive tags popular head hero meta author form follow register search tabs credits legal foot overlay alert announcement skip barra pied".split())
_NAME = {w: k for names in (NAMES, NAMES_ABROAD) for k, ws in names.items() for w in ws}
# short lines that claim rights and stand in no article
_RIGHTS = re.compile(r"^\W*(?:copyright|©|\(c\))\W*(?:©|\(c\))?\s*\d{4}", re.I)
RIGHTS_WORDS = 25
LINK_WORDS = 12  # of a block in no article and no heading that is nothing but links
PROSE = 12  # words that make running text of an element within an article
MOST = 0.5  # share of a page's running text that, with its heading, makes an element the main one
FEATURES = [*(f"in {p}" for p in PARTS), *(f"named {k}" for k in NAMES), "header in article", "hidden", "word"]
_AT = {f: i for i, f in enumerate(FEATURES)}
FLOOR = -3.0
# as the HTML tokeniser reads attributes: a quote opens a value only right after "=", and ">" ends all else
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))?+)?+")
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]++(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{re.sub(r'[(](?=[^?])', '(?:', _ATTR.pattern)})*+)(?:>|\Z)", re.S)


@dataclass(frozen=True)
class Weights:
    """Of a word's place, by feature, and of a tag."""

    place: tuple[float, ...]
    tag: float


def _marks(tag: str, attrs: str, inside_article: bool) -> tuple[frozenset[int], list[tuple[int, bool]], bool]:
    """Features of an element; those that its names speak of against it, with whether weakly; whether they speak for it as well."""
    found = {_AT[f"in {tag}"]} if tag in PARTS else set()
    if tag == "header" and inside_article:
        found = {_AT["header in article"]}
    against: dict[int, bool] = {}
    body = False
    if attrs:
        for k, a, b, c in _ATTR.findall(attrs):
            k, v = k.lower(), html.unescape(a or b or c).lower()
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v):
                found.add(_AT["hidden"])
            elif k in ("class", "id", "role"):
                for w in re.split(r"[^a-z]+", v):
                    if (kind := _NAME.get(w)) == "body":
                        body = True
                    elif kind:
                        at = _AT[f"named {kind}"]
                        against[at] = against.get(at, True) and w in WEAK
    if body and not against:  # a wrapper such as "post-content" counts as body only if nothing else is said
        found.add(_AT["named body"])
    return frozenset(found), list(against.items()), body


@dataclass
class _Named:
    """An element whose names speak against it, and what it holds."""

    tag: str
    within: bool  # an article or the main part
    weak: bool
    against: list[int]
    body: bool
    outer: list[int]  # numbers of such elements that it stands in
    words: int = 0
    linked: int = 0
    prose: int = 0
    heading: int = 0

    def holds(self, prose: int, within: bool) -> bool:
        """Whether the names stand, on a page with so many words of running text, or ``within`` a main element of another name."""
        if self.heading and self.prose >= max(2 * PROSE, MOST * prose):
            return False
        short = self.tag in ("h1", "h2", "h3") or self.words >= PROSE and 3 * self.linked <= self.words
        return not (self.weak and (self.within or within) and short)


@dataclass(frozen=True)
class _Open:
    """An open element with what holds for all that stands in it."""

    tag: str
    marks: frozenset[int]
    place: int  # number of the innermost marked element
    inside: bool  # of an article or the main part
    skipped: bool
    block: int  # index on the stack of the innermost block, -1 without


def read(page: str) -> list[tuple]:
    """A page as ``("tag",)``, ``("block",)`` and ``("text", string, marks, element)`` in order; raw elements are passed over.

    ``marks`` are the features of the open elements, ``element`` numbers the innermost one that has a mark. Each tag
    takes the same time, however deep it stands.
    """
    out: list[tuple] = []
    named: list[_Named] = []  # a mark over the number of features is one of these
    root = _Open("", frozenset([_AT["word"]]), 0, False, False, -1)
    stack: list[_Open] = []
    many: Counter = Counter()  # open elements by name
    last: dict[str, int] = {}  # raw elements without a further end tag
    counter, at, n = 0, 0, len(page)

    def drop(to: int) -> None:
        for o in stack[to:]:
            many[o.tag] -= 1
        del stack[to:]

    def text(s: str) -> None:
        top = stack[-1] if stack else root
        if s and not top.skipped:
            out.append(("text", s, top.marks, top.place))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(html.unescape(page[at:]))
            break
        text(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag, close = m[2].lower(), bool(m[1])
        if tag in RAW and not close:
            end = None if tag in last else re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = n
            else:
                last[tag] = at
            continue
        if tag == "br":
            text(" ")
            continue
        out.append(("block",) if tag in BLOCKS else ("tag",))
        if close:
            if many[tag]:
                to = len(stack) - 1
                while stack[to].tag != tag:
                    to -= 1
                drop(to)
            continue
        while stack and tag in CLOSED_BY.get(stack[-1].tag, ()):
            drop(len(stack) - 1)
        if tag in BLOCKS and stack and stack[-1].block >= 0 and stack[stack[-1].block].tag == "p":
            drop(stack[-1].block)  # a paragraph ends at the next block, whatever stands open inside it
        if tag in VOID:
            continue
        top = stack[-1] if stack else root
        if m[3].endswith("/") and (top.skipped or tag in SKIPPED):
            continue  # elements of pictures and formulas may end in themselves
        counter += 1
        own, against, body = _marks(tag, m[3], top.inside)
        if against:
            own |= {len(FEATURES) + len(named)}
            named.append(_Named(tag, top.inside or _AT["named body"] in top.marks, all(weak for _, weak in against), [at for at, _ in against], body, [x - len(FEATURES) for x in top.marks if x >= len(FEATURES)]))
        place = counter if own and tag not in ("p", "a", "li", "h1", "h2", "h3") else top.place
        stack.append(_Open(tag, top.marks | own if own else top.marks, place, top.inside or tag in ("article", "main"), top.skipped or tag in SKIPPED, len(stack) if tag in BLOCKS else top.block))
        many[tag] += 1
    return _decided(out, named) if named else out


_UNWANTED = frozenset(_AT[f] for f in ("in nav", "in footer", "in aside", "in form", "in menu", "in dialog", "in search", "hidden"))


def _decided(events: list[tuple], named: list[_Named]) -> list[tuple]:
    """Events in which marks of named elements are the features that they stand for, or nothing where they don't hold."""
    counts: Counter = Counter()
    for e in events:
        if e[0] == "text":
            counts[e[2]] += len(e[1].split())
    first, linked, par, heading = len(FEATURES), _AT["in a"], {_AT[f"in {p}"] for p in ("p", "blockquote", "pre")}, _AT["in h1"]
    prose = 0
    for marks, n in counts.items():
        running = n if par & marks and linked not in marks and not _UNWANTED & marks else 0
        prose += running
        for x in marks:
            if x >= first:
                o = named[x - first]
                o.words, o.linked, o.prose, o.heading = o.words + n, o.linked + n * (linked in marks), o.prose + running, o.heading + n * (heading in marks)
    told: list[set[int]] = []
    for o in named:
        main = {_AT["named body"]} if o.body else set()
        told.append(set(o.against) if o.holds(prose, any(_AT["named body"] in told[x] for x in o.outer)) else main)
    become = {marks: frozenset().union(*(told[x - first] if x >= first else (x,) for x in marks)) for marks in counts}
    return [(e[0], e[1], become[e[2]], e[3]) if e[0] == "text" else e for e in events]


def blocks(events: list[tuple], w: Weights) -> list[tuple[str, float, float]]:
    """``(text, score, cost)``: each block's text, the score of its words and what the tags before it cost."""
    found, parts, score, cost, within, linked = [], [], 0.0, 0.0, False, 0
    article, heads, link = {_AT["in article"], _AT["in main"]}, {_AT[f"in h{i}"] for i in (1, 2, 3)}, _AT["in a"]
    spent: dict[int, float] = {}
    sums: dict[frozenset[int], float] = {}

    def close():
        nonlocal parts, score, cost, within, linked
        # the words of a block's only text are known by now; texts that meet may share a word
        t = " ".join(parts[0][1] if len(parts) == 1 else "".join(x for x, _ in parts).split())
        if t:
            n = t.count(" ") + 1
            if score > 0 and not within and (n <= RIGHTS_WORDS and _RIGHTS.search(t) or n <= LINK_WORDS and 5 * linked >= 4 * sum(any(map(str.isalnum, x)) for x in t.split()) > 0):
                score = FLOOR
            found.append((t, score, cost))
            cost = 0.0
        parts, score, within, linked = [], 0.0, False, 0

    for e in events:
        if e[0] == "text":
            words = e[1].split()
            parts.append((e[1], words))
            within = within or not article.isdisjoint(e[2])
            linked += len(words) if link in e[2] and heads.isdisjoint(e[2]) else 0
            if n := len(words):
                if e[2] not in sums:
                    sums[e[2]] = sum(w.place[i] for i in e[2])
                s = n * sums[e[2]]
                if s < 0:  # an unwanted element's words together weigh no more than the floor
                    left = FLOOR - spent.get(e[3], 0.0)
                    s = max(s, left)
                    spent[e[3]] = spent.get(e[3], 0.0) + s
                    s = s or -1e-6
                score += s
        else:
            if e[0] == "block":
                close()
            cost += w.tag
    close()
    return found


def best_region(scores: list[float], costs: list[float]) -> tuple[int, int]:
    """First and last block of the maximum-scoring subsequence, the costs of tags between blocks included; (0, -1): none."""
    best, at, total, start = 0.0, (0, -1), 0.0, 0
    for i, (s, c) in enumerate(zip(scores, costs, strict=True)):
        if total + c <= 0:
            total, start = s, i
        else:
            total += c + s
        if total > best:
            best, at = total, (start, i)
    return at


def main_text(page: str | None, w: Weights) -> str:
    """Blocks of the best region that score above zero, joined by two line ends; null has none."""
    found = blocks(read(page or ""), w)
    lo, hi = best_region([s for _, s, _ in found], [c for _, _, c in found])
    return "\n\n".join(t for t, s, _ in found[lo : hi + 1] if s > 0)


def labelled_pages() -> list[str]:
    """Pages to learn from: words of the article are ``keep``, all others ``drop``. Every frame with every article."""
    k = lambda n: " ".join(["keep"] * n)
    d = lambda n: " ".join(["drop"] * n)
    inner = [
        f"<h1>{k(6)}</h1><p>{k(60)}</p><p>{k(3)}</p><p>{k(40)}</p>",
        f"<h1>{k(5)}</h1><div class='ad'>{d(12)}</div><p>{k(50)} <a href='x'>{k(2)}</a> {k(9)}</p><h2>{k(3)}</h2><ul><li>{k(8)}</li><li>{k(5)}</li></ul><p>{k(30)}</p>",
        f"<header><h1>{k(7)}</h1></header><p>{k(45)}</p><blockquote><p>{k(20)}</p></blockquote><aside>{d(25)}</aside><pre>{k(15)}</pre><p>{k(10)}</p>",
        f"<h2>{k(4)}</h2><p>{k(80)}</p><div class='share-buttons'><a>{d(1)}</a><a>{d(1)}</a></div><table><tr><td>{k(4)}</td><td>{k(3)}</td></tr></table><figure>{k(6)}</figure><form><label>{d(3)}</label><button>{d(1)}</button></form><p>{k(12)}</p>",
    ]
    inner.append(f"{k(50)}<br><br>{k(60)} <b>{k(3)}</b> {k(20)}<div>{k(30)}</div>")  # old pages have bare text
    holders = ["{}", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div id='content'><div class='entry'>{}</div></div>", "<div>{}</div>", "<section>{}</section>", "<main id='content'><article class='post story'><div class='body'>{}</div></article></main>"]
    before = [
        f"<nav><ul><li><a>{d(1)}</a></li><li><a>{d(2)}</a></li></ul></nav><div class='ad'>{d(9)}</div>",
        f"<header><div class='logo'>{d(2)}</div><p>{d(6)}</p></header><div id='cookie-notice'><p>{d(25)}</p></div>",
        f"<div class='topbar'><a>{d(3)}</a></div><div class='breadcrumb'><a>{d(2)}</a></div><form><label>{d(2)}</label></form>",
        f"<div role='navigation'><a>{d(8)}</a></div><div class='banner'>{d(10)}</div><menu><li>{d(4)}</li></menu><dialog>{d(12)}</dialog><search>{d(2)}</search><div hidden>{d(20)}</div>",
    ]
    after = [
        f"<footer>{d(9)}</footer>",
        f"<aside><h3>{d(3)}</h3><p>{d(30)}</p><ul><li><a>{d(6)}</a></li></ul></aside><footer><p>{d(12)}</p></footer>",
        f"<section id='comments'><h2>{d(2)}</h2><article class='comment'><p>{d(40)}</p></article><div class='comment'><p>{d(30)}</p></div></section><div class='footer'>{d(8)}</div>",
        f"<div class='related'><h3>{d(2)}</h3><p>{d(15)}</p></div><div class='newsletter'><form>{d(5)}</form></div><div class='sidebar'><p>{d(20)}</p></div><address>{d(7)}</address>",
    ]
    wraps = ["{}", "<div class='main content'>{}</div>"]  # names that say nothing, as they stand around all
    return [f"<html><body>{f.format(b + h.format(x) + a)}</body></html>" for x, h, b, a, f in itertools.product(inner, holders, before, after, wraps)]


def learn(pages: list[str] | None = None, ridge: float = 2e-3, steps: int = 1500) -> Weights:
    """Fit the weights on labelled pages: log-odds of a word's place; a tag's is the mean of tags beside kept and dropped words, below zero."""
    rows: dict[tuple[frozenset[int], bool], int] = {}
    tags = [1, 1]
    for page in pages or labelled_pages():
        last = False
        for e in read(page):
            if e[0] == "text":
                for word in e[1].split():
                    last = word == "keep"
                    rows[e[2], last] = rows.get((e[2], last), 0) + 1
            else:
                tags[last] += 1
    x = np.zeros((len(rows), len(FEATURES)))
    for i, (marks, _) in enumerate(rows):
        x[i, list(marks)] = 1
    y = np.array([keep for _, keep in rows], float)
    n = np.array(list(rows.values()), float)
    n = np.sqrt(n) / np.sqrt(n).sum()  # rare places count
    v, step = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ v)))
        step = 0.9 * step - 2.0 * (x.T @ (n * (p - y)) + ridge * v)
        v = v + step
    return Weights(tuple(float(a) for a in v), -0.02 - 0.1 * tags[0] / sum(tags))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; null html gives an empty text, and repeated rows stay apart."""
    w = weights or learn()

    def run(batches):
        for b in batches:
            for s in range(0, len(b), 200):
                part = b.slice(s, 200)
                texts = [main_text(h.as_py(), w) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
