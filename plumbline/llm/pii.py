"""Personal data: base patterns, and a skip-chain conditional random field that adds what the patterns miss.

Base spans are the leftmost non-overlapping matches of one pattern per kind. The field's nodes are the document's
entity-shaped tokens (runs without white space that hold a digit or an @); every other token is O. Neighbouring nodes with
one white-space character between them share a chain potential. Tokens that are far apart share a skip potential if they
are equal, or similar (the same digits in the same order, or the same letters around an @); each occurrence is joined to
the next one of its group, by a skip edge unless a chain edge joins them, so a group of n tokens has n - 1 edges. Marginals come from loopy sum-product messages,
damped, until they settle, with rounds enough to cross the document; labels thereby agree within a document. Runs of tokens whose marginal passes
`sure` and that touch no base span are added spans; base spans always stay.

The weights are trained piecewise: node potentials as a softmax regression and edge potentials as a softmax over the label
pairs of observed edges, on tokens labelled by the base patterns in a bounded sample of documents. The features that
restate a pattern in full are dropped at random in training, so that shape and neighbours carry weight of their own.

Defined results: a null or empty text has no spans; repeated rows give repeated rows; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_batches, release, text_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
BUCKETS = 1 << 12

#: The part of an address from the @ on; the part before it is the run of its characters that ends there.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A digit run is tried once, at its first digit: where that fails, later digits of the run fail too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_MARK = re.compile(r"[0-9@]")
_NODE = re.compile(r"[0-9@]\S*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed; code points, end exclusive."""
    if not _MARK.search(text):
        return []
    out = []
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end(), "email"))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def nodes(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that hold a digit or an @."""
    out = []
    done = 0
    for m in _NODE.finditer(text):
        start, end = m.span()
        while start > done and not text[start - 1].isspace():
            start -= 1
        out.append((start, end))
        done = end
    return out


def _group(token: str) -> str | None:
    """What equal and similar tokens have in common."""
    if "@" in token:
        return "@" + "".join(c for c in token.lower() if c.isalnum() or c == "@")
    digits = _DIGITS.sub("", token)
    return digits if len(digits) >= 4 else None


def _shape(token: str) -> str:
    out = []
    for c in token:
        k = "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def words_before(text: str, start: int) -> list[str]:
    """The last two words before `start`, whole, in lower case."""
    size = 64
    while True:
        found = text[max(0, start - size) : start].split()
        if len(found) > 2 or size >= start:  # the first of them may be cut
            return [w.lower() for w in found[-2:]]
        size *= 2


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def features(text: str, spans: list[tuple[int, int]], shapes: list[str], at: int, kinds: set[str]) -> list[int]:
    """Feature buckets of one node: shape, counts, the words before, neighbours' shapes, and the base kinds over it."""
    start, end = spans[at]
    token = text[start:end]
    digits = sum(c.isdigit() for c in token)
    found = ["bias", "s:" + shapes[at], f"d:{min(digits, 20)}", f"l:{min(len(token), 40) // 2}", f"dot:{min(token.count('.'), 4)}", f"at:{'@' in token}", f"plus:{token[0] == '+'}", *("w:" + w for w in words_before(text, start))]
    if at and spans[at - 1][1] + 1 == start:
        found.append("p:" + shapes[at - 1])
    if at + 1 < len(spans) and spans[at + 1][0] - 1 == end:
        found.append("n:" + shapes[at + 1])
    found += ["base:" + k for k in sorted(kinds)]
    return [_bucket(f) for f in found]


@dataclass
class Graph:
    """Nodes of one document with their features, and its chain and skip edges."""

    spans: list[tuple[int, int]]
    kinds: list[set[str]]
    buckets: list[list[int]]
    edges: list[tuple[int, int, int]]  # node, later node, 0 chain or 1 skip


def graph(text: str, base: list[tuple[int, int, str]]) -> Graph:
    spans = nodes(text)
    kinds: list[set[str]] = [set() for _ in spans]
    first = 0
    for start, end, kind in base:
        while first < len(spans) and spans[first][1] <= start:
            first += 1
        i = first
        while i < len(spans) and spans[i][0] < end:
            kinds[i].add(kind)
            i += 1
    edges, last = [], {}
    for i, (start, end) in enumerate(spans):
        if i and spans[i - 1][1] + 1 == start:
            edges.append((i - 1, i, 0))
        if (g := _group(text[start:end])) is not None:
            if g in last and spans[last[g]][1] + 1 != start:  # else the chain edge joins them
                edges.append((last[g], i, 1))
            last[g] = i
    shapes = [_shape(text[start:end]) for start, end in spans]
    return Graph(spans, kinds, [features(text, spans, shapes, i, k) for i, k in enumerate(kinds)], edges)


@dataclass
class Model:
    node: np.ndarray  # BUCKETS x labels
    edge: np.ndarray  # 2 x labels x labels, log potentials


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _label(kinds: set[str]) -> int:
    return next((i for i, k in enumerate(LABELS) if k in kinds), 0)


def train(texts: list[str], epochs: int = 6, seed: int = 7) -> Model:
    """Piecewise training on base-labelled tokens; texts without nodes teach nothing. No nodes: every node is O."""
    rng = np.random.default_rng(seed)
    node, total = np.zeros((BUCKETS, len(LABELS))), np.full((BUCKETS, 1), 1e-8)
    pairs = np.ones((2, len(LABELS), len(LABELS)))
    pairs[1] += 25 * np.eye(len(LABELS))  # the prior of a skip edge: its ends agree
    data = []
    restated = {_bucket("base:" + k) for k in KINDS}
    for text in texts:
        g = graph(text, base_spans(text))
        labels = [_label(k) for k in g.kinds]
        data += zip(g.buckets, labels, strict=True)
        for i, j, skip in g.edges:
            pairs[skip, labels[i], labels[j]] += 1
    for epoch in range(epochs if data else 0):
        for k in rng.permutation(len(data)):
            buckets, y = data[k]
            b = np.array([x for x in buckets if x not in restated or rng.random() < 0.5])
            grad = _softmax(node[b].sum(axis=0))
            grad[y] -= 1
            total[b] += (grad * grad).sum()
            node[b] -= 0.3 * grad / np.sqrt(total[b])
        node *= 1 - 0.02 / (epoch + 1)
    if not data:
        node[_bucket("bias"), 0] = 4.0
    # Pointwise mutual information of the labels at an edge's ends: what the edge says beyond its nodes.
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    edge = np.log(joint) - np.log(joint.sum(axis=2, keepdims=True)) - np.log(joint.sum(axis=1, keepdims=True))
    return Model(node, np.clip(edge, -3, 3))


def marginals(g: Graph, model: Model, rounds: int | None = None, damping: float = 0.3, least: float = 1e-8) -> np.ndarray:
    """Label marginals of the nodes by damped loopy sum-product messages.

    They go on until none changes by `least`; one that has settled is computed anew only when one it depends on changes.
    As messages in cycles may never settle, rounds are bounded: by 100 and 4 for each edge of the longest path, if not given.
    """
    unary = np.array([model.node[b].sum(axis=0) for b in g.buckets])
    for i, kinds in enumerate(g.kinds):  # base spans are evidence
        for k in kinds:
            unary[i, LABELS.index(k)] += 8
    if not g.edges:
        return _softmax(unary)
    e = np.array(g.edges)
    src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    pot = np.concatenate([model.edge[e[:, 2]], model.edge[e[:, 2]].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
    if rounds is None:
        hops = [0] * len(unary)  # edges come by their later node
        for i, j, _ in g.edges:
            hops[j] = max(hops[j], hops[i] + 1)
        rounds = 100 + 4 * max(hops)
    message = np.zeros((len(src), len(LABELS)))
    belief = unary.copy()
    now = np.arange(len(src))
    for _ in range(rounds):
        out = (belief[src[now]] - message[back[now]])[:, :, None] + pot[now]
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        step = (1 - damping) * (new - message[now])
        message[now] += step
        np.add.at(belief, dst[now], step)
        moved = now[np.abs(step).max(axis=1) >= least]
        if not len(moved):
            break
        again, reached = np.zeros(len(src), bool), np.zeros(len(unary), bool)
        again[moved] = reached[dst[moved]] = True
        now = np.flatnonzero(again | reached[src])
    return _softmax(belief)


_TRIM = " \t\r\n.,;:!?()[]{}<>\"'*#$%&|"


def added_spans(text: str, base: list[tuple[int, int, str]], model: Model, sure: float) -> list[tuple[int, int, str]]:
    """Spans that the field finds and no base span touches."""
    g = graph(text, base)
    if not g.spans:
        return []
    p = marginals(g, model)
    best = p.argmax(axis=1)
    out: list[tuple[int, int, str]] = []
    run: list[int] = []

    def close() -> None:
        if run:
            start, end = g.spans[run[0]][0], g.spans[run[-1]][1]
            while start < end and text[start] in _TRIM:
                start += 1
            while end > start and text[end - 1] in _TRIM:
                end -= 1
            if start < end:
                out.append((start, end, LABELS[best[run[0]]]))
            run.clear()

    for i, k in enumerate(best):
        keep = k and p[i, k] >= sure and not g.kinds[i]
        if run and not (keep and k == best[run[0]] and g.spans[i][0] == g.spans[run[-1]][1] + 1):
            close()
        if keep:
            run.append(i)
    close()
    return out


def find(text: str, model: Model, sure: float = 0.95) -> tuple[list, list]:
    """Base spans, and all spans by start."""
    if not _MARK.search(text):
        return [], []
    base = base_spans(text)
    every = sorted(base + added_spans(text, base, model, sure), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return base, every


def fit(documents: DataFrame, most: int = 4000) -> Model:
    """Trains on the mentions in at most `most` documents, those with the smallest hashes of their ids.

    Only ids take part in the choice. Of rows that share an id the smallest text counts; null ids are not chosen.
    """
    chosen = documents.select(F.col("doc_id").alias("id")).where(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").where(F.col("text").rlike("[0-9@]"))
    return train([r.text for r in sorted(rows.groupBy("id").agg(F.min("text").alias("text")).collect())])


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
SPANS_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(documents: DataFrame, model: Model, sure: float = 0.95) -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, all spans, and how many were added; no shuffle."""

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in given:
            base, every = find(text or "", model, sure)
            counts = [sum(s[2] == k for s in base) for k in KINDS]
            yield doc_id, *counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(every), len(every) - len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from in_batches(rows(text_rows(batches)), SPANS)

    return documents.select("doc_id", "text").mapInArrow(run, SPANS_DDL)


def redacted(text: str | None, model: Model, sure: float = 0.95) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    if not text:
        return text
    _, spans = find(text, model, sure)
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(documents: DataFrame, model: Model, sure: float = 0.95) -> DataFrame:
    """The documents with personal data replaced in text, and n_chars set to the new length where it is there."""
    at, columns = documents.columns.index("text"), documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = pa.array([redacted(t, model, sure) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in columns else out
