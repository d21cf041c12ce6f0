"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes a sequence of blocks, each with the tags and class words above it and a few features
of its text. Two states, main text and rest, score features and transitions; weights are fitted to
labelled pages by gradient ascent on the likelihood, and pages are decoded by Viterbi.

Labelled pages are drawn from templates (labelled_pages): there is no labelled table, and templates
cover layouts that a given table may lack. Their number is a parameter.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, table, texts_of

PAGES, STEPS, DIMENSIONS = 2000, 90, 1 << 15

# HTML elements by how they bear on blocks.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("head title script style template noscript svg math iframe object canvas datalist".split())
CLOSES_P = BLOCKS - set("button label option optgroup legend caption td th tr tbody thead tfoot".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = set("ul ol dl table select article section div body main aside nav footer header form blockquote".split())

#: Elements that hold a part of an article rather than an article.
_SMALL = set("p li h1 h2 h3 h4 h5 h6 dt dd dl td th tr tbody thead tfoot table caption ul ol menu blockquote pre figure figcaption label button legend option optgroup summary hr address".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r"""[>"']""")
_ENDS = {"comment": re.compile(r"--!?>"), "script": re.compile(r"</script\s*+>", re.I), "style": re.compile(r"</style\s*+>", re.I)}
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^A-Za-z]+")


def _of_element(tag: str, words: str, parent: str) -> tuple[tuple[str, ...], frozenset]:
    """Class, id and role words of an element, and the features that it adds below the block-level `parent`."""
    found = () if tag in ("body", "html") else tuple(w.lower().rstrip("s") for w in _SPLIT.split(_CAMEL.sub(" ", words)) if w)
    names = [f"tag {tag}", *(f"word {w}" for w in found)]
    if tag in BLOCKS and parent:
        names.append(f"in {parent}>{tag}")
    return found, frozenset(_dim(n) for n in names)


_of_short_element = lru_cache(10_000)(_of_element)


@lru_cache(10_000)
def _of_nearest(near: tuple[str, str]) -> list[int]:
    """Features of the two nearest block-level elements."""
    return [_dim(f"leaf {near[1]}"), _dim(f"near {'>'.join(x for x in near if x)}")]


class Node:
    """A path of elements; equal paths are one node. A node holds only the features that it adds to its parent's, so that
    deep paths and long class lists take memory in proportion to the page."""

    __slots__ = ("tag", "kids", "parent", "new", "near", "namer", "own", "score")

    def __init__(self, tag: str = "", words: str = "", parent: Node | None = None, above: set[int] = frozenset()):
        self.tag, self.kids, self.parent, self.score = tag, None, parent, None
        self.namer, self.own = self, []
        if parent is None:
            self.new, self.near = frozenset(), ("", "")
            return
        self.near = (parent.near[1], tag) if tag in BLOCKS else parent.near
        found, names = (_of_element if len(words) > 1000 else _of_short_element)(tag, words, parent.near[1])
        self.new = names - above
        if found:
            self.own = [_dim(n) for n in sorted({*(f"own {w}" for w in found), *(f"both {a} {b}" for a, b in zip(found, found[1:]))})]
        else:
            self.namer = parent.namer

    def features(self) -> list[int]:
        """Of all elements above, of the nearest block-level two, and of the nearest element with class words."""
        above, node = set(), self
        while node:
            above |= node.new
            node = node.parent
        return sorted(above) + _of_nearest(self.near) + self.namer.own

    def scored(self, field: Field) -> tuple:
        """(field, score of all above, score of own class words if it has some), by way of the nearest ancestor that has one."""
        way, node = [], self
        while node and (node.score is None or node.score[0] is not field):
            way.append(node)
            node = node.parent
        sums = node.score[1] if node else np.zeros(2)
        for node in reversed(way):
            if node.new:
                sums = sums + field.weights[sorted(node.new)].sum(0)
            node.score = (field, sums, field.weights[node.own].sum(0) if node.own else np.zeros(2))
        return self.score


class Paths:
    """The nodes of a worker's pages so far. Beyond `most` (long class lists count more) no more are kept, so that memory stays bounded."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self.clear()

    def clear(self):
        self.root, self.n = Node(), 0

    def below(self, node: Node, tag: str, words: str, above: set[int]) -> Node:
        """The node of an element under `node`, whose features and its ancestors' are `above`."""
        kid = node.kids.get((tag, words)) if node.kids else None
        if kid is None:
            kid = Node(tag, words, node, above)
            if self.n < self.most:
                node.kids = node.kids or {}
                node.kids[tag, words] = kid
                self.n += 1 + len(words) // 100
        return kid


@dataclass
class Block:
    path: Node
    text: str
    linked: int
    boxes: tuple[int, int] = (0, 0)
    breaks: int = 0


def tags(source: str):
    """(from, to, kind, name, attributes) of each piece of markup, in page order, in time linear in the page.

    kind: open, close, or skip (comments, declarations, scripts and styles with what they hold). A tag ends at the first > outside
    quotes; where a quote never closes, at the first >; where there is no >, it is text. An unclosed comment, script or
    style reaches to the end of the page.
    """
    at, n = 0, len(source)
    hopeless: set[int] = set()  # quotes from which on a tag never ends
    while (lt := source.find("<", at)) >= 0:
        if source.startswith("<!--", lt):
            end = _ENDS["comment"].search(source, lt + 4)
            at = end.end() if end else n
            yield lt, at, "skip", "", ""
            continue
        closing = source.startswith("/", lt + 1)
        name = _NAME.match(source, lt + 1 + closing)
        if not name and source[lt + 1 : lt + 2] not in ("!", "?") or (first := source.find(">", lt)) < 0:
            at = lt + 1
            if name and first < 0:
                return
            continue
        if not name or closing:
            at = first + 1
            yield lt, at, "close" if name else "skip", name[0].lower() if name else "", ""
            continue
        seen, k, end = [], name.end(), None
        while (stop := _STOP.search(source, k)) and stop.start() not in hopeless:
            if stop[0] == ">":
                end = stop.start()
                break
            seen.append(stop.start())
            k = source.find(stop[0], stop.end()) + 1
            if not k:
                break
        if end is None:
            hopeless.update(seen)
            end = first
        tag, at = name[0].lower(), end + 1
        if tag in ("script", "style"):
            close = _ENDS[tag].search(source, at)
            at = close.end() if close else n
            yield lt, at, "skip", "", ""
            continue
        yield lt, at, "open", tag, source[name.end() : end]


def blocks(source: str, paths: Paths | None = None) -> list[Block]:
    """The page's blocks of text in page order: maximal runs of text that no block-level tag
    interrupts, references decoded, white space made single spaces. Signs between links count as linked. Unclosed and stray tags are borne."""
    paths = paths or Paths()
    stack: list[tuple[str, Node, int]] = [("", paths.root, 0)]
    places: dict[str, list[int]] = {}  # of each open tag, where it stands on the stack
    boxes: list[int] = [0, 0]  # open containers, by number
    above: set[int] = set()  # features of the open elements
    out: list[Block] = []
    pieces: list[str] = []
    linked = silent = links = made = breaks = plain = 0

    def flush():
        nonlocal linked, breaks, plain
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(stack[-1][1], text, len(text) if linked and not plain else linked, (boxes[-1], boxes[-2]), breaks))
            pieces.clear()
        linked = breaks = plain = 0

    def close(depth: int):
        nonlocal silent, links
        if any(stack[i][0] in BLOCKS for i in range(depth, len(stack))):
            flush()
        while len(stack) > depth:
            t, node, box = stack.pop()
            above.difference_update(node.new)
            places[t].pop()
            silent -= t in SILENT
            links -= t == "a"
            if box:
                boxes.pop()

    def last(some) -> int:
        return max((places[t][-1] for t in some if places.get(t)), default=0)

    def say(raw: str):
        nonlocal linked, plain
        if raw and not silent:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.strip())
            elif not plain:
                plain = any(map(str.isalnum, text))

    at = 0
    for start, end, kind, tag, given in tags(source):
        if start > at:
            say(source[at:start])
        at = end
        if kind == "skip":
            continue
        if kind == "close":
            if places.get(tag):
                close(places[tag][-1])
            elif tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            if tag in CLOSES_P and places.get("p"):
                close(places["p"][-1])
            if tag in _SIBLINGS:
                while (depth := last(_SIBLINGS[tag])) > last(_SCOPE):
                    close(depth)
                    if tag not in ("tr", "td", "th"):
                        break
            flush()
        if tag == "br":
            pieces.append(" ")
            breaks += not silent
        if tag in VOID or given.endswith("/"):
            continue
        words = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(given)) if given else ""
        box = 0
        if tag in BLOCKS and tag not in _SMALL:
            made += 1
            box = made
            boxes.append(box)
        places.setdefault(tag, []).append(len(stack))
        node = paths.below(stack[-1][1], tag, words, above)
        above |= node.new
        stack.append((tag, node, box))
        silent += tag in SILENT
        links += tag == "a"
    say(source[at:])
    flush()
    return out


def _dim(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


_SIGNS = re.compile(r"(©|\(c\) \d|copyright|all rights reserved)|(cookie|gdpr|consent)|(subscribe|newsletter|sign up|log ?in)|(advert|sponsored)|(repl(?:y|ies)\b|comments?\b)", re.I)


def text_features(found: list[Block]) -> list[list[str]]:
    """Of each block of a page: its length in words, links, line breaks, end and signs, those lengths of the blocks beside it, and
    how much of the page's text that isn't linked its container and the one around that hold."""
    counts = [b.text.count(" ") + 1 for b in found]
    size = [min(9, n.bit_length()) for n in counts]
    shares = [min(1.0, b.linked / max(1, len(b.text))) for b in found]
    held: dict[int, float] = {}
    for b, n, share in zip(found, counts, shares):
        for box in set(b.boxes):
            held[box] = held.get(box, 0.0) + n * (1 - share)
    most = [max((held[b.boxes[k]] for b in found), default=0.0) or 1.0 for k in (0, 1)]
    part = lambda x: 0 if x < 0.05 else 1 if x < 0.3 else 2 if x < 0.7 else 3 if x < 1 else 4
    out = []
    for i, (b, n, k, share) in enumerate(zip(found, counts, size, shares)):
        links = 0 if not share else 1 + int(share * 3)
        before, after = size[i - 1] if i else -1, size[i + 1] if i + 1 < len(found) else -1
        leaf = b.path.near[1]
        stops = min(4, b.text.count(". ") + b.text.count(", "))
        names = [f"words {k}", f"links {links}", f"breaks {min(3, b.breaks)} {links}", f"prose {k} {stops} {links}", f"end {b.text[-1] in '.!?…:;' }", f"wl {k} {links}", f"beside {before} {k}", f"beside2 {k} {after}", f"in {leaf} {k}", f"box {part(held[b.boxes[0]] / most[0])}", f"outer {part(held[b.boxes[1]] / most[1])}", f"stops {stops}"]
        if leaf[:1] == "h" and leaf[1:].isdigit():
            names.append(f"head {leaf} {after}")
        if (m := _SIGNS.search(b.text[:300])) and n < 60:
            names.append(f"sign {m.lastindex}")
        if not i:
            names.append("first")
        if i == len(found) - 1:
            names.append("last")
        out.append(names)
    return out


@dataclass
class Field:
    """Weights (features by states), transitions and first-state scores. State 1 is main text."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    paths: Paths = field(default_factory=Paths)
    texts: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.weights, self.moves, self.start

    def __setstate__(self, s):
        self.weights, self.moves, self.start = s
        self.paths, self.texts = Paths(), {}

    def blocks(self, source: str) -> list[Block]:
        if self.paths.n >= self.paths.most // 2:
            self.paths.clear()
        return blocks(source, self.paths)

    def of_path(self, node: Node) -> list[float]:
        near = self.texts.get(node.near)
        if near is None:
            near = self.texts[node.near] = self.weights[_of_nearest(node.near)].sum(0)
        return (node.scored(self)[1] + near + node.namer.scored(self)[2]).tolist()

    def main(self, found: list[Block]) -> list[bool]:
        """Viterbi: the likeliest states of a page's blocks together."""
        if not found:
            return []
        (s0, s1), ((m00, m01), (m10, m11)) = self.start.tolist(), self.moves.tolist()
        back, a, b = [], s0, s1
        for i, (block, names) in enumerate(zip(found, text_features(found))):
            e0, e1 = self.of_path(block.path)
            for name in names:
                w = self.texts.get(name)
                if w is None:
                    w = self.texts[name] = self.weights[_dim(name)].tolist()
                e0, e1 = e0 + w[0], e1 + w[1]
            if not i:
                a, b = a + e0, b + e1
                continue
            back.append((b + m10 > a + m00, b + m11 > a + m01))
            a, b = max(a + m00, b + m10) + e0, max(a + m01, b + m11) + e1
        state = b > a
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS, ridge: float = 0.02) -> Field:
    """Fits a field to labelled pages: forward and backward sums over all pages at once, Adagrad steps."""
    pages = [p for p in pages if p[0]]
    n, longest = len(pages), max(len(b) for b, _ in pages)
    feats, where, gold = [], [], np.zeros((n, longest), int)
    length = np.array([len(b) for b, _ in pages])
    for p, (found, main) in enumerate(pages):
        for i, (b, names) in enumerate(zip(found, text_features(found))):
            ids = b.path.features() + [_dim(x) for x in names]
            feats += ids
            where += [p * longest + i] * len(ids)
            gold[p, i] = main[i]
    feats, where = np.array(feats), np.array(where)
    live = np.arange(longest)[None] < length[:, None]
    truth = np.zeros((n, longest, 2))
    truth[np.arange(n)[:, None], np.arange(longest)[None], gold] = live
    pairs = np.einsum("pta,ptb->ab", truth[:, :-1], truth[:, 1:])
    w, moves, start = np.zeros((DIMENSIONS, 2)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full_like(x, 1e-3) for x in (w, moves, start)]
    lse = lambda x, axis: np.logaddexp.reduce(x, axis)
    for _ in range(steps):
        e = np.stack([np.bincount(where, w[feats, s], n * longest) for s in (0, 1)], 1).reshape(n, longest, 2)
        fore, rear = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            fore[:, t] = lse(fore[:, t - 1, :, None] + moves, 1) + e[:, t]
        for t in range(longest - 2, -1, -1):
            step = lse(moves[None] + (e[:, t + 1] + rear[:, t + 1])[:, None], 2)
            rear[:, t] = np.where(live[:, t + 1, None], step, 0)
        z = lse(fore[np.arange(n), length - 1], 1)
        each = np.exp(fore + rear - z[:, None, None]) * live[..., None]
        both = np.exp(fore[:, :-1, :, None] + moves + (e + rear)[:, 1:, None] - z[:, None, None, None]) * live[:, 1:, None, None]
        diff = (truth - each).reshape(-1, 2)
        gw = np.stack([np.bincount(feats, diff[where, s], DIMENSIONS) for s in (0, 1)], 1)
        for x, g, h in zip((w, moves, start), (gw - ridge * w, pairs - both.sum((0, 1)), (truth[:, 0] - each[:, 0]).sum(0)), seen):
            h += g * g
            x += 0.3 * g / np.sqrt(h)
    return Field(w, moves, start)


# Class and id words under which sites put what isn't the article, and the article.
REST = {
    "nav": "nav navbar navigation menu main-menu breadcrumb breadcrumbs topnav toc pagination pager site-nav".split(),
    "header": "header site-header page-header masthead topbar top-bar branding logo".split(),
    "footer": "footer site-footer page-footer bottom copyright legal colophon".split(),
    "aside": "sidebar side-bar related related-posts widget recommended popular trending more-stories most-read side".split(),
    "ad": "ad ads advert advertisement ad-slot sponsored sponsor promo promotion banner-ad adsbygoogle".split(),
    "notice": "notice cookie cookie-banner cookies consent gdpr alert modal popup overlay paywall newsletter subscribe signup disclaimer".split(),
    "form": "form search search-form login contact-form signup-form".split(),
    "comments": "comments comment-list comment comments-area disqus discussion responses replies reader-comments".split(),
}
ODD = "row col-md-8 col-md-4 col-12 container wrapper box inner outer panel block card grid cell clearfix left right center flex item unit layout".split()
BODY = "content article article-body post post-content entry entry-content story story-body text main page-content body-text article-text prose".split()


def labelled_pages(n: int = PAGES, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    """Pages drawn from templates, with the true label of each block: its text is marked when drawn."""
    r = random.Random(seed)
    letters = "a e i o u an en er in on th st re ti ou la de ch un ge ä é ñ".split()

    def words(low: int, high: int) -> str:
        made = [("".join(r.choice(letters) for _ in range(r.randint(1, 4)))) for _ in range(r.randint(low, high))]
        kind = r.random()
        tail = "" if kind < 0.2 else "."
        if kind > 0.97:
            made = [w.upper() + "!!" for w in made]
        elif kind > 0.93:
            made = [w + r.choice(["***", "###", " |", "%%%"]) for w in made]
        return " ".join(made).capitalize() + tail

    def prose(low: int, high: int) -> str:
        """Sentences, some with commas, of so many words together."""
        left, made = r.randint(low, high), []
        while left > 0:
            made.append(words(min(left, 4), min(left, 18)))
            left -= made[-1].count(" ") + 1
            if r.random() < 0.3 and left > 0:
                made[-1] = made[-1].rstrip(".") + ","
        return " ".join(made)

    def mark(text: str, main: bool) -> str:
        return ("\ue001" if main else "\ue000") + text

    def name(kind: str) -> str:
        return f' {r.choice(["class", "class", "id"])}="{" ".join(r.sample(REST[kind], r.choice([1, 1, 2])))}"'

    def link(main: bool) -> str:
        return f'<a href="/{r.randint(1, 999)}">{words(1, 5)}</a>'

    def filler(kind: str) -> str:
        some = lambda a, b: [mark(r.choice([words, prose])(a, b), False) for _ in range(r.randint(1, 4))]
        if kind in ("nav", "aside") and r.random() < 0.7:
            n = r.randint(2, 5)
            heading = f"<h{n}>{mark(words(1, 3), False)}</h{n}>" if r.random() < 0.5 else ""
            return heading + "<ul>" + "".join(f"<li>{mark('', False)}{link(False)}</li>" for _ in range(r.randint(2, 7))) + "</ul>"
        if kind == "form":
            return f"<label>{mark(words(1, 3), False)}</label><input name=q><p>{mark(words(2, 20), False)}</p><button>{mark(words(1, 2), False)}</button><select><option>{mark(words(1, 2), False)}</option></select>"
        if kind == "comments":
            shape = r.choice(["<div class=comment><p>%s</p></div>", "<li><p>%s</p></li>", "<p>%s</p>", "<article class=comment><p>%s</p></article>"])
            return f"<h3>{mark(words(1, 3), False)}</h3>" + "".join(shape % x for x in some(3, 60))
        if kind == "footer":
            return f"{mark('© ' if r.random() < 0.5 else '', False)}{words(1, 12)}" + "".join(f"<p>{x}</p>" for x in some(1, 12) if r.random() < 0.4)
        if kind == "header":
            return f"<{r.choice(['h1', 'h1', 'h1', 'h2', 'div', 'p'])}>{mark(words(1, 4), False)}</div></p>" + (f"<p>{mark(words(2, 10), False)}</p>" if r.random() < 0.5 else "")
        if r.random() < 0.45:
            return mark(r.choice([words, prose])(1, 40), False)
        n = r.randint(1, 4)
        heading = f"<h{n}>{mark(words(1, 4), False)}</h{n}>" if r.random() < 0.45 else ""
        return heading + "".join(f"<p>{x}</p>" for x in some(1, 40))

    def rest(kind: str, bare: bool = True) -> str:
        native = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = native if native and r.random() < 0.6 else r.choice(["div", "section", "div"])
        attributes = name(kind) if tag != native or r.random() < 0.5 else ""
        return f"<{tag}{attributes}>{filler(kind)}</{tag}>"

    def article() -> str:
        def leaf() -> str:
            k = r.random()
            t = mark(r.choice([words, prose])(1, 70) if r.random() < 0.75 else r.choice([words, prose])(1, 12), True)
            if k < 0.62:
                return f"<p>{t}</p>" if r.random() < 0.7 else f"<p><b>{t}<br>"
            if k < 0.7:
                return f"<h{r.randint(2, 4)}>{t}</h3>"
            if k < 0.78:
                return "<ul>" + "".join(f"<li>{mark(words(1, 20), True)}{link(True) if r.random() < 0.3 else ''}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
            if k < 0.83:
                return f"<blockquote><p>{t}</p></blockquote>"
            if k < 0.87:
                return f"<table><tr><th>{mark(words(1, 3), True)}</th><td>{mark(words(1, 9), True)}</td></tr></table>"
            if k < 0.9:
                return f"<figure><img src=x><figcaption>{t}</figcaption></figure>"
            if k < 0.93:
                return f"<pre>{t}</pre>"
            return f"<div>{t}</div>"

        body = [leaf() for _ in range(r.randint(0, 12))]
        for kind in ("ad", "aside", "notice", "form", "comments"):
            if r.random() < 0.15:
                body.insert(r.randint(0, len(body)), rest(kind))
        title = f"<h1>{mark(words(2, 12), True)}</h1>"
        k = r.random()
        if k < 0.25:
            title = f"<header>{title}{'<p>' + mark(words(2, 9), True) + '</p>' if r.random() < 0.5 else ''}</header>"
        inner = title + "".join(body)
        if r.random() < 0.2:
            stem = r.choice(["post", "entry", "article", "story", "content"])
            inner = f'<div class="{stem}-{r.choice(["header", "title", "head"])}">{title}</div><div class="{stem}-{r.choice(["body", "content", "text"])}">{mark(words(3, 40), True)}<br><br>{mark(words(3, 40), True)}{"".join(body)}</div>'
        k = r.random()
        cls = f' {r.choice(["class", "id"])}="{" ".join(r.sample(BODY, r.choice([1, 2])))}"'
        if k < 0.35:
            return f"<article{cls if r.random() < 0.4 else ''}>{inner}</article>"
        if k < 0.5:
            return f"<main>{'<article>' if r.random() < 0.5 else ''}{inner}</main>"
        if k < 0.75:
            return f"<div{cls}>{inner}</div>"
        if k < 0.88:
            return f"<section{cls}><div>{inner}</div></section>"
        return inner if k < 0.95 else f"<div>{inner}</div>"

    def odd() -> str:
        """A class that says nothing of what the element holds."""
        k = r.random()
        if k < 0.35:
            return ""
        return f' class="{r.choice([r.choice(ODD), r.choice(ODD) + " " + r.choice(ODD), "c" + str(r.randint(1, 99)), "css-" + "".join(r.choice("bcdfgk") for _ in range(5))])}"'

    def foreign() -> str:
        """A page of unknown class words and no elements that name their role: only texts, links and places tell."""
        tag = r.choice(["div", "div", "td", "section", "center"])
        wrap = lambda x: f"<{tag}{odd()}>{x}</{tag}>"
        some = lambda a, b, main: mark(words(a, b), main)
        ref = lambda: f"<a href=/{r.randint(1, 99)}>{some(1, 4, False)}</a>"

        def menu() -> str:
            n = r.randint(2, 9)
            k = r.random()
            if k < 0.5:
                return wrap("<ul>" + "".join(f"<li>{ref()}</li>" for _ in range(n)) + "</ul>")
            return wrap(r.choice([" | ", " ", "<br>"]).join(ref() for _ in range(n))) if k < 0.8 else "".join(wrap(ref()) for _ in range(n))

        def side() -> str:
            k = r.random()
            head = f"<h{r.randint(2, 4)}>{some(1, 3, False)}</h3>"
            if k < 0.6:
                return wrap(head + "<ul>" + "".join(f"<li>{ref()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            return wrap(head + "".join(f"<p>{some(1, 9, False)} {ref()}</p>" for _ in range(r.randint(1, 4))))

        def foot() -> str:
            lead = f"{mark('', False)}{r.choice(['©', 'Copyright', '(c)'])} 2{r.randint(10, 99)} {words(1, 6)}"
            return wrap(lead + ("" if r.random() < 0.5 else " " + " ".join(ref() for _ in range(r.randint(1, 4)))))

        def top() -> str:
            return wrap(r.choice([some(1, 3, False), f"<a href=/>{some(1, 3, False)}</a>", f"<h1>{some(1, 3, False)}</h1>"]) + (f"<p>{some(2, 8, False)}</p>" if r.random() < 0.3 else ""))

        def replies() -> str:
            one = lambda: wrap(r.choice([f"<b>{some(1, 2, False)}</b> " + words(5, 40), f"<p>{some(1, 2, False)} says:</p><p>{some(5, 40, False)}</p>", f"<p>{some(5, 40, False)}</p><a href=#>{mark('Reply', False)}</a>"]))
            return f"<h3>{mark(r.choice(['Comments', '3 comments', 'Replies', 'Leave a reply']), False)}</h3>" + r.choice(["", "<p>", "<ul><li>"]) + "".join(one() for _ in range(r.randint(1, 4)))

        def story() -> str:
            leaf = r.choice(["<p>%s</p>", "<p>%s</p>", "<p>%s", "<div>%s</div>", "%s<br><br>"])
            body = []
            for _ in range(r.randint(1, 9)):
                k = r.random()
                if k < 0.78:
                    t = r.choice([words, prose])(8, 110) + ("" if r.random() < 0.8 else f" <a href=/x>{words(1, 3)}</a> {words(3, 20)}")
                    body.append(leaf % mark(t, True))
                elif k < 0.86:
                    body.append(f"<h{r.randint(2, 3)}>{some(1, 6, True)}</h2>")
                elif k < 0.94:
                    body.append("<ul>" + "".join(f"<li>{some(2, 25, True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
                else:
                    body.append(f"<blockquote>{some(5, 40, True)}</blockquote>")
            if not any(len(x) > 150 for x in body):
                body.append(leaf % some(40, 110, True))
            title = f"<h{r.choice([1, 1, 1, 2])}>{some(2, 10, True)}</h1>" if r.random() < 0.85 else ""
            if title and r.random() < 0.3:
                title = wrap(title)
            inner = title + "".join(body) if r.random() < 0.6 else title + wrap("".join(body))
            for _ in range(r.randint(0, 2)):
                inner = wrap(inner)
            return inner

        before = [f() for f in r.sample([top, menu, side, menu], r.randint(0, 3))]
        after = [f() for f in r.sample([side, foot, menu, replies, foot], r.randint(0, 3))]
        page = before + [story()] + after
        if tag == "td":
            return "<table>" + "".join(f"<tr>{x if x.startswith('<td') else '<td>' + x + '</td>'}</tr>" if r.random() < 0.6 else x if x.startswith("<td") else f"<td>{x}</td>" for x in page) + "</table>"
        return "".join(page) if r.random() < 0.6 else wrap("".join(page))

    def old() -> str:
        """A page laid out by cells, fonts and line breaks, its text often a single block."""
        some = lambda a, b, main: mark(words(a, b), main)
        ref = lambda: f"<a href=/{r.randint(1, 99)}>{some(1, 3, False)}</a>"
        face = lambda x: r.choice(["%s", "%s", "%s", "<font>%s</font>", "<span>%s</span>", "<b>%s</b>"]) % x
        menu = lambda: face(r.choice(["<br>", "<br>", "<br><br>", " | ", " ", " - ", "<p>"]).join(ref() for _ in range(r.randint(1, 7))))
        note = lambda: r.choice([lambda: f"{mark('', False)}{r.choice(['©', 'Copyright', '(c)'])} 2{r.randint(10, 99)} {words(1, 6)}", lambda: some(1, 6, False), lambda: f"{some(1, 5, False)} {ref()}"])()
        ad = lambda: r.choice([lambda: note(), lambda: menu() + "<br><br>" + some(2, 12, False), lambda: f"<b>{some(1, 3, False)}</b><br>" + prose(3, 14)])()

        def story() -> str:
            brk = r.choice(["<br><br>", "<br><br>", "<br><br>\n", "<br>", "<p>"])
            parts = [prose(15, 70) for _ in range(r.randint(1, 5))]
            k = r.random()
            title = words(1, 8).rstrip(".")
            if k < 0.25:
                head, parts[0] = "", f"<b>{title}</b><br>{parts[0]}" if r.random() < 0.5 else f"{title}<br>{parts[0]}"
            elif k < 0.75:
                n = r.choice([1, 1, 2, 3, 3, 4])
                head = r.choice([f"<h{n}>%s</h{n}>", f"<h{n}>%s</h{n}>", "<center><b>%s</b></center>", f"<center><h{n}>%s</h{n}></center>", "<p><b>%s</b><p>", "<div><font>%s</font></div>", "<tr><td><font>%s</font></td></tr><tr><td>", "<tr><td><b>%s</b></td></tr><tr><td>"]) % mark(title, True)
            else:
                head = ""
            text = brk.join(mark(x, True) for x in parts)
            text = r.choice(["%s", "%s", "%s", "<font>%s</font>", "<font>%s</font>", "<span>%s</span>", "<blockquote>%s</blockquote>"]) % text
            return head + text if r.random() < 0.85 else f"<font>{head}{text}</font>"

        k = r.random()
        if k < 0.45:  # cells in a row, or the story in rows of its own
            cell = lambda x: f"<td>{x}</td>"
            if r.random() < 0.25:
                cell = lambda x: f"<td><table><tr><td>{x}</td></tr></table></td>"
            row = [cell(menu()) for _ in range(r.choice([0, 1, 1, 1]))] + [cell(story())] + [cell(ad()) for _ in range(r.choice([0, 0, 1]))]
            rows = ([f"<tr><td>{r.choice([note, menu])()}</td></tr>"] if r.random() < 0.4 else []) + [f"<tr>{''.join(row)}</tr>"] + ([f"<tr><td>{r.choice([note, menu])()}</td></tr>"] if r.random() < 0.4 else [])
            page = f"<table>{''.join(rows)}</table>"
            return r.choice(["%s", "%s", "<center>%s</center>", "<div>%s</div>"]) % page
        if k < 0.75:  # pieces one after another, parted by rules, centred or boxed
            tag = r.choice(["", "", "center", "div", "div", "p"])
            box = lambda x: f"<{tag}>{x}</{tag}>" if tag else x + "<hr>"
            text = story()
            if r.random() < 0.6:
                text = f"<{(t := r.choice(['div', 'center', 'td', 'div']))}>{text}</{t}>"
            return "".join([*(box(r.choice([menu, note, menu])()) for _ in range(r.randint(0, 2))), text, "" if tag else "<hr>", *(box(r.choice([menu, note, ad])()) for _ in range(r.randint(0, 2)))])
        if k < 0.9:  # tables of links around the story
            links = lambda: "<table><tr>" + "".join(f"<{(t := r.choice(['td', 'th']))}>{ref()}</{t}>" for _ in range(r.randint(1, 4))) + "</tr></table>"
            return (links() if r.random() < 0.7 else "") + story() + (links() if r.random() < 0.7 else "")
        return r.choice(["%s", "<center>%s</center>", "<table><tr><td>%s</td></tr></table>", "<div>%s</div>", "<td>%s</td>"]) % story()

    out = []
    for _ in range(n):
        if (k := r.random()) < 0.5:
            found = blocks(f"<html><body>{old() if k < 0.14 else foreign()}</body></html>")
            marks = [next((c == "\ue001" for c in b.text if c in "\ue000\ue001"), False) for b in found]
            for b in found:
                b.text = b.text.translate({0xE000: None, 0xE001: None}).strip() or "x"
            out.append((found, marks))
            continue
        if r.random() < 0.08:  # a page that is nothing but its text
            only = "".join(f"<p>{mark(words(1, 60), True)}</p>" for _ in range(r.randint(1, 6))) if r.random() < 0.6 else mark(words(1, 80), True)
            found = blocks(only if r.random() < 0.5 else f"<html><body>{only}</body></html>")
            out.append((found, [True] * len(found)))
            for b in found:
                b.text = b.text.replace("\ue001", "").strip() or "x"
            continue
        before = [rest(k) for k in r.sample(["nav", "header", "ad", "notice", "form", "aside"], r.randint(0, 4))]
        after = [rest(k) for k in r.sample(["aside", "comments", "footer", "ad", "notice", "form", "footer", "nav"], r.randint(0, 5))]
        page = f"<html><head><title>x</title></head><body>{''.join(before)}{article()}{''.join(after)}</body></html>"
        found = blocks(page)
        marks = [next((c == "\ue001" for c in b.text if c in "\ue000\ue001"), False) for b in found]
        for b in found:
            b.text = b.text.translate({0xE000: None, 0xE001: None}).strip() or "x"
        out.append((found, marks))
    return out


@lru_cache(1)
def trained(n: int = PAGES) -> Field:
    """The same field in every run: pages and steps are fixed by a seed."""
    return train(labelled_pages(n))


def main_text(source: str, field: Field) -> str:
    found = field.blocks(source)
    return "\n\n".join(b.text for b, main in zip(found, field.main(found)) if main)


def extract(pages: DataFrame, model: Field, html: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of pages with the page's main text and its length in code points, row for row.

    Null and empty pages, and pages without main text, have an empty text and length 0. Equal pages
    have equal texts. Pages are taken whole, whatever their length. Other columns don't matter.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for b in slices(whole, "__html"):
                texts = [main_text(t, shared.value) for t in texts_of(b, "__html")]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    read = pages.select(*keep, F.col(html).cast("string").alias("__html"))
    kinds = dict(read.dtypes)
    return read.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "text string", "n_chars bigint"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained())
