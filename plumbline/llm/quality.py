"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each word, character n-gram of a word (with word ends) and word
pair, all hashed into one table, and one for the document itself (so that short texts lean on the prior). A softmax layer
gives the label. A pair of equal neighbours is hashed as such, whatever the word, so that stuttering texts share vectors.
Trained by numpy stochastic gradient descent (linearly falling rate) on a bounded sample of labelled documents.

As the score is linear in the vectors, each bucket's margin (vector times the difference of the output rows) is computed
once; scoring a document sums margins, with those of frequent words kept.

Defined results: a null or empty text is scored from the document vector alone. Repeated rows score alike.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import in_batches, no_cycles, release, remainder_of, text_rows

BUCKETS = 1 << 17
LEAST, MOST = 2, 4
#: Longest word that is kept in tables, with its n-grams; those of longer ones are taken in blocks of so many starts.
WORD, BLOCK = 64, 4096


def _hash(data: bytes) -> int:
    return zlib.crc32(data) % BUCKETS


_DOCUMENT, _REPEAT = _hash(b"\x00document"), _hash(b"\x00repeat")


def parts(word: str) -> Iterator[list[str]]:
    """The word, told apart from n-grams by a mark, and its character n-grams, in lists of bounded length."""
    w = f"<{word}>"
    out = ["\x00" + word]
    for at in range(0, len(w), BLOCK):
        for n in range(LEAST, MOST + 1):
            out += [w[i : i + n] for i in range(at, min(at + BLOCK, len(w) - n + 1))]
        yield out
        out = []


def word_buckets(word: str) -> Iterator[int]:
    """Buckets of a word and its character n-grams."""
    for block in parts(word):
        for p in block:
            yield _hash(p.encode("utf-8", "surrogatepass"))


def features(text: str, known: dict[str, list[int]]) -> Counter:
    """How often each bucket occurs in a text."""
    words = text.split()
    out = Counter({_DOCUMENT: 1})
    for w, n in Counter(words).items():
        found = known.get(w)
        if found is None:
            found = word_buckets(w)
            if len(w) <= WORD:
                found = known[w] = list(found)
        for b in found:
            out[b] += n
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    if repeats:
        out[_REPEAT] += 8 * repeats
    return out


class Margins(dict):
    """Margins of n-grams; the table is dropped when it is full."""

    def __init__(self, margins: np.ndarray):
        super().__init__()
        self.margins = margins

    def __missing__(self, gram: str) -> float:
        if len(self) >= 200_000:
            self.clear()
        m = self[gram] = float(self.margins[_hash(gram.encode("utf-8", "surrogatepass"))])
        return m


@dataclass
class Model:
    margins: np.ndarray  # of each bucket, for label 1 over label 0
    known: dict[str, tuple[float, int]] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        self.grams = Margins(self.margins)

    def __getstate__(self):
        return self.margins.tobytes()

    def __setstate__(self, state):
        self.margins, self.known = np.frombuffer(state, np.float32), {}
        self.grams = Margins(self.margins)

    def word(self, word: str) -> tuple[float, int]:
        if len(word) > WORD:
            margins, total, n = self.margins, 0.0, 0
            for block in parts(word):
                total += float(margins[[_hash(p.encode("utf-8", "surrogatepass")) for p in block]].sum(dtype=np.float64))
                n += len(block)
            return total, n
        if len(self.known) >= 300_000:
            self.known.clear()
        ((whole, *grams),) = parts(word)
        own = float(self.margins[_hash(whole.encode("utf-8", "surrogatepass"))])
        found = self.known[word] = (own + sum(map(self.grams.__getitem__, grams)), 1 + len(grams))
        return found

    def score(self, text: str) -> float:
        words = text.split()
        known, word = self.known, self.word
        total, n = float(self.margins[_DOCUMENT]), 1
        last, repeats = None, 0
        for w in words:
            found = known.get(w)
            if found is None:
                found = word(w)
            total += found[0]
            n += found[1]
            if w == last:
                repeats += 1
            last = w
        if repeats:
            total += 8 * repeats * float(self.margins[_REPEAT])
            n += 8 * repeats
        z = total / n
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def train(rows: list[tuple[str, int]], dims: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 11) -> Model:
    """Learns from (text, 0 or 1). Without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, dims), np.float32)
    output = rng.normal(0, 1, (2, dims)).astype(np.float32)
    known: dict[str, list[int]] = {}
    data = []
    for text, y in rows:
        f = features(text, known)
        idx = np.fromiter(f, np.int64, len(f))
        n = np.fromiter(f.values(), np.float32, len(f))
        data.append((idx, n / n.sum(), y))
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            idx, share, y = data[k]
            now = rate * (1 - done / steps)
            done += 1
            own = vectors[idx]
            mean = share @ own
            z = output @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            # A vector's step is scaled by its share of the document against an even share.
            vectors[idx] = own - now * np.outer(np.minimum(share * len(share), 4.0), p @ output)
            output -= 0.1 * now * np.outer(p, mean)
    return Model((vectors @ (output[1] - output[0])).astype(np.float32))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
SCORES_DDL = "doc_id long, held_out boolean, score double, predicted int"


def score(documents: DataFrame, model: Model, threshold: float = 0.7, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; no shuffle. A null id is not held out."""

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in given:
            p = model.score(text or "")
            yield doc_id, remainder_of(doc_id, modulus) == held_out, p, int(p >= threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        with no_cycles():
            yield from in_batches(rows(text_rows(batches)), SCORES)

    return documents.select("doc_id", "text").mapInArrow(run, SCORES_DDL)


def keep(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least the threshold, unchanged."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield batch.filter(pa.array([model.score(t or "") >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
