"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is read as browsers read it where it matters here: raw-text elements, comments, void and inline elements, implied
ends of paragraphs and items, and ends that were never written. A leaf block is the text between two block tags. Its
features are the tags and the class, id and role words of its ancestors, and its text: length, share of links, ending, and
words that notices use. The field's labels are main and other; node and transition weights are trained by gradient descent
on the log-likelihood (forward-backward) of labelled pages, and pages are decoded by Viterbi.

No labelled pages come with the data, so `labelled_pages` makes them: pages of made-up words in varied layouts, whose
blocks are labelled because the generator knows what it wrote. `train` takes any others.

Defined results: a null or empty html has no blocks and an empty text. Repeated rows give repeated rows. White space in a
block, a line break element included, is one space; blocks are joined by two line feeds.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import in_batches, release, text_rows

#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select option datalist".split())
#: Of these, the ones whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript".split())
#: An element of the key is ended by the start of one of the values.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li summary".split())
IMPLIED_END = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option"]), "head": frozenset(["body"])}
#: An implied end does not reach beyond these.
_WALLS = frozenset("html body table ul ol dl div section article aside nav main header footer form td th".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_SPECIAL = re.compile("[>\"']")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_LONG_NUMBER = re.compile("&#(?:[xX]0*([0-9a-fA-F]+)|0*([0-9]+));?")
#: By the tag that starts: the open elements that it may end.
_ENDED_BY: dict[str, tuple[str, ...]] = {t: tuple(k for k, ends in IMPLIED_END.items() if t in ends) for t in frozenset().union(*IMPLIED_END.values())}


class Path:
    """An open element and those around it. fresh: the features that it has and none around it."""

    __slots__ = ("around", "fresh", "named", "near", "tag", "total")

    def __init__(self, around: Path | None, tag: str, fresh: tuple[str, ...], near: str, named: bool):
        self.around, self.tag, self.fresh, self.near, self.named = around, tag, fresh, near, named
        self.total: float | None = None


@dataclass(slots=True)
class Block:
    text: str
    path: Path | None
    linked: int  # characters in links


def _words(attributes: str) -> list[str]:
    """Class, id and role words."""
    if "=" not in attributes:
        return []
    return list(dict.fromkeys(w for m in _NAMED.finditer(attributes) for w in _WORD.findall(m[1].lower())))


def _unescaped(text: str) -> str:
    """Character references decoded; a number beyond Unicode, however long, is U+FFFD."""
    if "&#" in text:
        text = _LONG_NUMBER.sub(lambda m: "\ufffd" if len(m[1] or m[2]) > 7 else m[0], text)
    return entities.unescape(text)


class _Tokens:
    """Tags of a page in order, each in time that its own length bounds, taken over the page.

    A tag ends at the first > outside quotes, or at the first > if there is none. The pattern finds most; once one is
    not closed outside quotes, where each tag ends is looked up in a table that one pass from the end has made.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">") + 1  # no tag begins beyond
        self.at: list[int] | None = None
        self.ends: list[int] = []

    def table(self) -> None:
        found = [(m.start(), m[0]) for m in _SPECIAL.finditer(self.page)]
        n = len(found)
        ends, after = [-1] * (n + 1), {'"': -1, "'": -1}
        for k in range(n - 1, -1, -1):
            i, c = found[k]
            if c == ">":
                ends[k] = i
            else:
                ends[k] = ends[after[c] + 1] if after[c] >= 0 else -1
                after[c] = k
        self.at, self.ends = [i for i, _ in found], ends

    def next(self, at: int) -> tuple[int, int, str | None, str, str] | None:
        """Start and end of the next tag or comment, its name (None for others), a slash if it is an end tag, attributes."""
        page = self.page
        if self.at is None:
            m = _TOKEN.search(page, at, self.last)
            if not m:
                return self.open_comment(max(at, self.last))
            if m[5] is None:
                end = len(page) if m[0].startswith("<!--") and not (len(m[0]) > 6 and m[0].endswith("-->")) else m.end()
                return m.start(), end, m[2], m[1] or "", m[3] or ""
            self.table()
            at = m.start()
        while 0 <= (start := page.find("<", at)) < self.last:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), None, "", ""
            if m := _START.match(page, start):
                end = self.ends[bisect_left(self.at, m.end())] if m[2] else -1
                end = end if end >= 0 else page.find(">", m.end())
                if end >= 0:
                    return start, end + 1, m[2], m[1] or "", page[m.end() : end]
            at = start + 1
        return self.open_comment(max(at, self.last))

    def open_comment(self, at: int) -> tuple[int, int, None, str, str] | None:
        start = self.page.find("<!--", at)
        return None if start < 0 else (start, len(self.page), None, "", "")


def blocks(page: str) -> list[Block]:
    """Leaf blocks that have text, in page order."""
    out: list[Block] = []
    tags: list[str] = []
    paths: list[Path] = []
    nodes: list[tuple[str, ...]] = []  # features of each open element
    seen: dict[str, int] = {}  # features of all of them
    open_: dict[str, int] = {}
    ending: dict[str, list[int]] = {k: [] for k in IMPLIED_END}  # places of the open elements that may be ended
    walls: list[int] = []
    held: list[str] = []
    linked, link_depth, hidden = 0, 0, 0
    at, tokens = 0, _Tokens(page)
    known: dict[tuple[str, str], tuple[tuple[str, ...], bool]] = {}

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, paths[-1] if paths else None, min(linked, len(text))))
            held.clear()
        linked = 0

    def push(tag: str, attributes: str) -> None:
        nonlocal hidden
        found = known.get((tag, attributes))
        if found is None:
            words = _words(attributes)
            found = known[(tag, attributes)] = (tuple(["t:" + tag, *("c:" + w for w in words)]), bool(words))
        features, named = found
        around = paths[-1] if paths else None
        fresh = tuple(f for f in features if not seen.get(f))
        near, near_named = (tag, named) if tag in _HOLDERS else (around.near, around.named) if around else ("none", False)
        for f in features:
            seen[f] = seen.get(f, 0) + 1
        if tag in ending:
            ending[tag].append(len(tags))
        if tag in _WALLS:
            walls.append(len(tags))
        tags.append(tag)
        nodes.append(features)
        paths.append(Path(around, tag, fresh, near, near_named))
        open_[tag] = open_.get(tag, 0) + 1
        hidden += tag in HIDDEN

    def pop() -> str:
        nonlocal hidden
        tag = tags.pop()
        paths.pop()
        for f in nodes.pop():
            seen[f] -= 1
        if tag in ending:
            ending[tag].pop()
        if tag in _WALLS:
            walls.pop()
        open_[tag] -= 1
        hidden -= tag in HIDDEN
        return tag

    while True:
        found = tokens.next(at)
        end = found[0] if found else len(page)
        if end > at and not hidden:
            part = page[at:end]
            if "&" in part:
                part = _unescaped(part)
            held.append(part)
            if link_depth:
                linked += len(part)
        if not found:
            break
        _, at, name, ends, attributes = found
        if name is None:
            continue
        tag = name.lower()
        if tag in INLINE:
            if tag == "a":
                link_depth = max(0, link_depth + (-1 if ends else 1))
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if not hidden:
            close()
            link_depth = 0
        if ends:
            if open_.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = m.end() if m else len(page)
            continue
        # The nearest open element that this one ends, if no wall is nearer.
        k = max((ending[e][-1] for e in _ENDED_BY.get(tag, ()) if ending[e]), default=-1)
        if k >= 0 and (not walls or walls[-1] <= k):
            while len(tags) > k:
                pop()
        if not attributes.endswith("/") or tag not in HIDDEN:
            push(tag, attributes)
    close()
    return out


_HOLDERS = frozenset("article main section div aside nav header footer form body ol ul ins".split())

#: Words of notices, in the languages of most pages; a block that has one gets the feature.
CUES = frozenset("cookie cookies copyright rights reserved subscribe newsletter advertisement sponsored login comments reply privacy consent".split())


def _last(path: Path | None) -> tuple[str, ...]:
    """Features of the innermost element alone. The nearest ancestor that holds several blocks says most."""
    if path is None:
        return "own:none", "near:none", "named:False"
    return "own:" + path.tag, "near:" + path.near, f"named:{path.named}"


def path_features(path: Path | None) -> list[str]:
    found = set(_last(path))
    while path is not None:
        found.update(path.fresh)
        path = path.around
    return sorted(found)


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    found = ["bias", f"len:{min(n.bit_length(), 10)}", f"links:{round(4 * b.linked / n)}", "end:" + ("stop" if b.text[-1] in ".!?:;\"'”»…" else "word")]
    if "©" in b.text:
        found.append("sign")
    if not CUES.isdisjoint(_WORD.findall(b.text.lower())):
        found.append("cue")
    return found


@dataclass
class Model:
    weights: dict[str, float]  # of a feature, for main over other
    first: float  # of a first block being main
    moves: list[list[float]]  # of a label after a label

    def path_score(self, path: Path | None) -> float:
        """Each element's score is kept with it, so a block costs only the elements that are new with it."""
        get, up = self.weights.get, []
        at = path
        while at is not None and at.total is None:
            up.append(at)
            at = at.around
        total = at.total if at is not None else 0.0
        for p in reversed(up):
            total = p.total = total + sum(get(f, 0.0) for f in p.fresh)
        return total + sum(get(f, 0.0) for f in _last(path))

    def scores(self, page: list[Block]) -> list[float]:
        get = self.weights.get
        return [self.path_score(b.path) + sum(get(f, 0.0) for f in text_features(b)) for b in page]

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi; of equally likely ones, other."""
        if not page:
            return []
        (oo, om), (mo, mm) = self.moves
        back = []
        other = main = 0.0
        for k, s in enumerate(self.scores(page)):
            if not k:
                other, main = 0.0, s + self.first
                continue
            back.append((1 if main + mo > other + oo else 0, 1 if main + mm > other + om else 0))
            other, main = max(other + oo, main + mo), max(other + om, main + mm) + s
        label = int(main > other)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def extract(self, page: str) -> str:
        found = blocks(page)
        return "\n\n".join(b.text for b, y in zip(found, self.decode(found), strict=True) if y)


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 20, rate: float = 0.3, seed: int = 5) -> Model:
    """Learns from blocks and their labels (1 main). Adagrad on the log-likelihood, with a small pull to zero."""
    names: dict[str, int] = {}
    data = []
    for page, labels in pages:
        if page:
            rows = [[names.setdefault(f, len(names)) for f in path_features(b.path) + text_features(b)] for b in page]
            at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            data.append((np.concatenate(rows), at, np.array(labels)))
    w, first, moves = np.zeros(len(names)), 0.0, np.zeros((2, 2))
    sq_w, sq_first, sq_moves = np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            idx, at, y = data[k]
            n = len(y)
            node = np.zeros((n, 2))
            node[:, 1] = np.bincount(at, w[idx], n)
            node[0, 1] += first
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = node[0]
            for i in range(1, n):
                forward[i] = node[i] + np.logaddexp(forward[i - 1, 0] + moves[0], forward[i - 1, 1] + moves[1])
            for i in range(n - 2, -1, -1):
                after = node[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(moves[:, 0] + after[0], moves[:, 1] + after[1])
            z = np.logaddexp(*forward[-1])
            p = np.exp(forward[:, 1] + backward[:, 1] - z)
            miss = p - y
            grad = np.bincount(idx, miss[at], len(w)) + 1e-3 * w
            pair = np.exp(forward[:-1, :, None] + moves[None] + (node + backward)[1:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
            np.subtract.at(pair, (y[:-1], y[1:]), 1.0)
            sq_w += grad * grad
            sq_moves += pair * pair
            sq_first += miss[0] ** 2
            w -= rate * grad / np.sqrt(sq_w)
            moves -= rate * pair / np.sqrt(sq_moves)
            first -= rate * miss[0] / math.sqrt(sq_first)
    return Model({f: float(w[i]) for f, i in names.items()}, float(first), moves.tolist())


#: Layouts of the made-up pages: what holds each kind of block. A page picks one of each kind it has.
MAIN = ("article", "main", "main|article", 'div class="content"', 'div id="main-content"', 'div class="post"|div class="entry"', 'section class="article body"', 'div class="story text"', "div", "section")
OTHERS = {
    "menu": ("nav", 'nav class="main"', 'div class="menu"', 'ul class="nav navbar"', 'div id="navigation"', 'div role="navigation"', 'div class="breadcrumb"'),
    "header": ("header", 'header class="site"', 'div id="header"', 'div class="masthead banner"', 'div role="banner"'),
    "footer": ("footer", 'div class="footer"', 'div id="footer"', 'div role="contentinfo"', 'div class="copyright"'),
    "sidebar": ("aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget related"', 'div role="complementary"', 'div class="widget"'),
    "notice": ('div class="notice"', 'div class="cookie banner"', 'div class="alert"', 'div id="consent"', 'section class="message popup"', 'div role="alert"', 'div class="notification"'),
    "advert": ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'aside class="promo"', 'div class="sponsored"', 'div id="ad slot"', 'ins class="adsbygoogle"|div'),
    "form": ("form", 'form class="search"', 'div class="newsletter subscribe"', 'form id="login"', 'div class="signup"|form'),
    "comments": ('section class="comments"', 'div id="comments"', 'ol class="comment list"', 'div class="comment thread"', 'div class="replies"', 'section id="responses"|article class="comment"', 'div class="reader comments"'),
    "share": ('div class="share social"', 'ul class="tags"', 'div class="meta byline"', 'div class="pagination"', 'div class="related"'),
}
_SYLLABLES = "an ar be ci da de en er est fo ga he ier in ja ko la lo ment mi na nou on or pa que ra re ros sa se ta te ti tion un ve vi wa zu".split()


def labelled_pages(n: int = 600, seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of n made-up pages. Each block ends with a mark that tells its label and is cut off again."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        out = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(out).capitalize()

    def sentence(low: int = 4, high: int = 18) -> str:
        return words(low, high) + rng.choice((".", ".", "!", "?", "", " |", "***", ","))

    def link(text: str) -> str:
        return f'<a href="/{text.lower()}">{text}</a>'

    def wrap(holder: str, inner: str) -> str:
        for part in reversed(holder.split("|")):
            inner = f"<{part}>{inner}" + ("" if rng.random() < 0.03 else f"</{part.split(' ')[0]}>")
        return inner

    def main() -> str:
        out = [f"<h1>{words(2, 9)}\x01</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((0, 1, 2, 4, 8, 14, 30))):
            kind = rng.random()
            text = sentence(1, 2) if rng.random() < 0.2 else " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5))))
            if kind < 0.08:
                out.append(f"<h{rng.randint(2, 4)}>{words(1, 6)}\x01</h2>")
            elif kind < 0.16:
                out.append("<ul>" + "".join(f"<li>{sentence(2, 10)}\x01</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.2:
                out.append(f"<blockquote><p>{text}\x01</blockquote>")
            elif kind < 0.24:
                out.append(f"<figure><img src='x'><figcaption>{sentence()}\x01</figcaption></figure>")
            elif kind < 0.27:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}\x01</td><td>{rng.randint(1, 999)}\x01</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.3:
                out.append(f"<pre>{words(3, 12)}\x01</pre>")
            elif kind < 0.36:
                out.append(f"<div>{text}\x01</div>")
            else:
                if rng.random() < 0.2:
                    text += " " + link(words(1, 3)) + " " + sentence()
                out.append(f"<p>{'<b>' if rng.random() < 0.2 else ''}{text}{'<br>' if rng.random() < 0.1 else ''}\x01" + rng.choice(("</p>", "</p>", "</p>", "")))
        return "".join(out)

    def other(kind: str) -> str:
        holder = rng.choice(OTHERS[kind])
        if kind in ("menu", "share"):
            inner = "".join(f"<li>{link(words(1, 2)) if rng.random() < 0.9 else words(1, 3)}\x02</li>" for _ in range(rng.randint(2, 8)))
            inner = inner if holder.startswith("ul") else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<label>{words(1, 3)}\x02</label><input name=q><button>{words(1, 2)}\x02</button>" + (f"<p>{sentence()}\x02</p>" if rng.random() < 0.5 else "")
        elif kind == "comments":
            inner = (f"<h3>{words(1, 3)}\x02</h3>" if rng.random() < 0.6 else "") + "".join(f"<div{rng.choice(('', ' class=comment', ' class=body'))}><p>{' '.join(sentence() for _ in range(rng.choice((1, 2, 4))))}\x02</p></div>" for _ in range(rng.randint(1, 6)))
        elif kind == "footer":
            inner = rng.choice((f"&copy; {words(1, 2)} &middot; {sentence()}\x02", f"<p>{sentence()}\x02</p>", f"<p>&copy; {rng.randint(1999, 2025)} {words(1, 3)}\x02</p><ul><li>{link(words(1, 1))}\x02</li></ul>"))
        elif kind == "header":
            inner = rng.choice((f"{words(1, 4)}\x02", f"<h1>{words(1, 3)}\x02</h1>", f"<p>{sentence(2, 6)}\x02</p>", f"<div>{link(words(1, 2))}\x02</div>"))
        else:
            inner = rng.choice((f"{sentence()}\x02", f"<p>{sentence()} {sentence()}\x02</p>", f"<h4>{words(1, 4)}\x02</h4><p>{sentence()}\x02</p>", f"<ul><li>{link(words(1, 3))}\x02</li><li>{link(words(1, 3))}\x02</li></ul>"))
        return wrap(holder, inner)

    out = []
    for _ in range(n):
        middle = main()
        for _ in range(rng.choice((0, 0, 1, 2))):  # something else within the article
            cuts = [m.end() for m in re.finditer("</p>|</h1>", middle)]
            if cuts:
                cut = rng.choice(cuts)
                middle = middle[:cut] + other(rng.choice(("advert", "advert", "share", "notice", "form", "comments", "sidebar"))) + middle[cut:]
        if rng.random() < 0.15:
            middle = f"<header>{middle[:middle.find('</h1>') + 5]}</header>{middle[middle.find('</h1>') + 5:]}" if "</h1>" in middle else middle
        parts = [other(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if rng.random() < 0.5]
        rng.shuffle(parts)
        tail = [other(k) for k in ("share", "comments", "advert", "sidebar", "form", "notice", "menu", "footer") if rng.random() < 0.5]
        body = "".join(parts) + wrap(rng.choice(MAIN), middle) + "".join(tail)
        if rng.random() < 0.25:
            body = wrap(rng.choice(('div class="wrapper"', 'div id="page"', 'div class="container"')), body)
        found = [b for b in blocks(f"<html><head><title>x</title></head><body>{body}</body></html>") if b.text[-1] in "\x01\x02"]
        labels = [int(b.text[-1] == "\x01") for b in found]
        for b in found:
            b.text = b.text[:-1].rstrip() or "x"
        out.append((found, labels))
    return out


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; no shuffle."""

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url, page in given:
            text = model.extract(page) if page else ""
            yield page_id, url, text, len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from in_batches(rows(text_rows(batches)), TEXTS, 256)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
