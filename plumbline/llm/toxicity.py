"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is the logistic of a bias and the weights of its distinct
words, each the sum of the weights of the word and of its beginnings of 4 and 6 letters (hashed); the document's is their noisy-or, 1 - prod(1 - p). Only documents have labels; the gradient of the
document's loss shares each label out among its sentences, so that the sentences which explain it are learned; scoring
names those that are likely by themselves.

Training is numpy gradient descent (Adagrad with an L1 proximal step) on a bounded sample of labelled documents. A weight
needs evidence of `least` documents. Scoring keeps the words of non-zero weight only.

Defined results: a null or empty text has no sentences, scores 0.0 (predicted 0) and has no offending ones. Ties and repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import in_batches, no_cycles, release, remainder_of, text_rows

BUCKETS = 1 << 20
BEGINNINGS = (4, 6)
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
_SPLIT = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")


def buckets(word: str) -> list[int]:
    """Of the word and of its beginnings."""
    parts = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def sentence_words(text: str) -> list[set[str]]:
    return [w for s in _SPLIT.split(text.lower()) if (w := set(_WORD.findall(s)))]


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


@dataclass
class Model:
    bias: float
    weights: dict[int, float]
    known: dict[str, float] = field(default_factory=dict, compare=False)

    def __getstate__(self):
        return self.bias, self.weights

    def __setstate__(self, state):
        self.bias, self.weights = state
        self.known = {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= 400_000:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(b, 0.0) for b in buckets(word))
        return w

    def logit(self, words: set[str]) -> float:
        known = self.known
        total = self.bias
        for w in words:
            v = known.get(w)
            total += self.weight(w) if v is None else v
        return total

    def score(self, text: str) -> float:
        """Noisy-or of the sentences."""
        return self.judge(text)[0]

    def judge(self, text: str, at_least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and its offending sentences."""
        clean = np.logaddexp(0.0, self.bias)
        log_none, plain, most = 0.0, 0, -np.inf
        for words in sentence_words(text):
            z = self.logit(words)
            most = max(most, z)
            if z == self.bias:
                plain += 1
            else:
                log_none -= float(np.logaddexp(0.0, z))
        p = float(-np.expm1(log_none - plain * clean)) + 0.0
        return p, self.locate(text, at_least) if _logistic(most) >= at_least else []

    def locate(self, text: str, at_least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the offending sentences; code points, end exclusive."""
        out = []
        for m in _SENTENCE.finditer(text):
            words = set(_WORD.findall(m[0].lower()))
            if words and (p := _logistic(self.logit(words))) >= at_least:
                lead = len(m[0]) - len(m[0].lstrip())
                out.append((m.start() + lead, m.end(), float(p)))
        return out


def train(rows: list[tuple[str, int]], least: int = 8, rounds: int = 120, l1: float = 1e-3) -> Model:
    """Learns from (text, 0 or 1). Without both labels there is nothing to tell apart: a model that scores 0.5 or less."""
    words: list[int] = []
    ends, bags, labels = [], [], []
    known: dict[str, list[int]] = {}
    for text, y in rows:
        sentences = sentence_words(text)
        if not sentences:
            continue
        for s in sentences:
            for w in s:
                if (b := known.get(w)) is None:
                    b = known[w] = buckets(w)
                words += b
            ends.append(len(words))
            bags.append(len(labels))
        labels.append(y)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(-12.0, {})
    idx, ends, bag = np.array(words, np.int64), np.array(ends), np.array(bags)
    sentence = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    # Words of too few documents get no weight.
    docs = np.unique(np.stack([idx, bag[sentence]]), axis=1)[0]
    names, seen = np.unique(docs, return_counts=True)
    names = names[seen >= least]
    at = np.searchsorted(names, idx)
    keep = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == idx) if len(names) else np.zeros(len(idx), bool)
    at, sentence = at[keep], sentence[keep]

    def descend(n: int, at: np.ndarray, sentence: np.ndarray, rounds: int, l1: float) -> tuple[np.ndarray, float]:
        """Weights of n words, whose occurrences are in `at`, and the bias."""
        theta, bias = np.zeros(n), -6.0
        square, square_bias = np.full(n, 1e-6), 1e-6
        for _ in range(rounds):
            z = bias + np.bincount(sentence, theta[at], len(ends))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            log_none = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
            whole = np.clip(-np.expm1(log_none), 1e-9, 1.0)
            share = np.where(y == 1, -(1 - whole) / whole, 1.0)  # d loss / d log(1 - p), times -1
            slope = share[bag] * p
            grad = np.bincount(at, slope[sentence], n) / len(y)
            grad_bias = slope.sum() / len(y)
            square += grad * grad
            square_bias += grad_bias**2
            rate = 0.5 / np.sqrt(square)
            theta -= rate * grad
            theta = np.sign(theta) * np.maximum(np.abs(theta) - rate * l1, 0)
            bias = min(max(bias - 0.1 / np.sqrt(square_bias) * grad_bias, -14.0), 0.0)
        return theta, float(bias)

    # First which words matter, then how much: the penalty that selects would also shrink what it keeps.
    theta, _ = descend(len(names), at, sentence, rounds // 2, l1)
    chosen = np.flatnonzero(np.abs(theta) > 0.1)
    names = names[chosen]
    to = np.full(len(theta), -1)
    to[chosen] = np.arange(len(chosen))
    keep = to[at] >= 0
    theta, bias = descend(len(names), to[at][keep], sentence[keep], 2 * rounds, l1 / 100)
    return Model(bias, {int(b): float(w) for b, w in zip(names, theta, strict=True) if abs(w) > 1e-3})


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("sentences", _SPANS)])
SCORES_DDL = "doc_id long, held_out boolean, score double, predicted int, sentences array<struct<start: long, end: long, probability: double>>"


def score(documents: DataFrame, model: Model, threshold: float = 0.7, modulus: int = 3, held_out: int = 1, at_least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every document, which are those of a probability
    of `at_least` (code points, end exclusive, in order); no shuffle. A null id is not held out."""

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in given:
            p, found = model.judge(text, at_least) if text else (0.0, [])
            yield doc_id, remainder_of(doc_id, modulus) == held_out, p, int(p >= threshold), [{"start": s, "end": e, "probability": q} for s, e, q in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        with no_cycles():
            yield from in_batches(rows(text_rows(batches)), SCORES)

    return documents.select("doc_id", "text").mapInArrow(run, SCORES_DDL)
