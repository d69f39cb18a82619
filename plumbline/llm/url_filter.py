"""URL filters by a Bloom filter cascade: exact membership over the corpus's own keys, without joins.

A rule is a host and a path prefix (`example.com/en/7`); it fits its host and all subdomains where the url's path starts
with the prefix. A url's keys are its host suffixes with its path prefixes, of just those (labels, prefix length) shapes
that some rule has; the distinct keys of all urls are the universe. Level 1 of the cascade encodes the listed keys; the
universe's keys that pass it although they are not listed are encoded by level 2; the listed keys that pass that by level
3, and so on until a level passes nothing wrongly. A key is listed if the first level it fails is an even one. Level 1's
rate is chosen from the sizes of list and universe so that about 0.7 unlisted keys pass for each listed one: what the
driver gathers is bounded by the list, whatever the corpus. If more pass, level 1 is built anew at a lower rate.

Defined results: a null url and one without `://` have empty host and path, no rule, and the default verdict. The longest
fitting rule wins (host and path together; of equally long ones that with the longer host). Repeated urls count once in
the universe and give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_batches, release, text_rows, written

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = _HOST_END.search(rest)
    at = m.start() if m else len(rest)
    return rest[:at].translate(_LOWER), _PATH_END.split(rest[at:], maxsplit=1)[0]


def shape_of(rule: str) -> tuple[int, int]:
    """Labels of the rule's host, and characters of its path."""
    host, _, path = rule.partition("/")
    return host.count(".") + 1, len(path) + 1


def keys_of(host: str, path: str, shapes: Iterable[tuple[int, int]]) -> list[str]:
    """The url's keys of the given shapes."""
    if not host:
        return []
    most = host.count(".") + 1
    return [host.split(".", most - labels)[-1] + path[:n] for labels, n in shapes if labels <= most and n <= len(path)]


@dataclass
class Bloom:
    bits: np.ndarray  # bytes
    size: int
    hashes: int
    seed: int

    @classmethod
    def of(cls, keys: Iterable[str], rate: float, seed: int) -> Bloom:
        keys = list(keys)
        size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        b = cls(np.zeros(size // 8 + 1, np.uint8), size, max(1, round(size / max(1, len(keys)) * math.log(2))) if keys else 1, seed)
        b.hashes = min(b.hashes, 40)
        for k in keys:
            for at in b._places(k):
                b.bits[at >> 3] |= 1 << (at & 7)
        return b

    def _places(self, key: str) -> Iterator[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.seed)
        step, at = (h >> 64) | 1, h & (1 << 64) - 1
        for _ in range(self.hashes):
            yield at % self.size
            at += step

    def __contains__(self, key: str) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._places(key))


@dataclass
class Cascade:
    """Exact for the keys it was built over: the listed ones, and the universe's others."""

    levels: list[Bloom]

    def __contains__(self, key: str) -> bool:
        for k, level in enumerate(self.levels):
            if key not in level:
                return k % 2 == 1
        return len(self.levels) % 2 == 1

    @classmethod
    def finish(cls, first: Bloom, listed: set[str], passed: set[str]) -> Cascade:
        """The other levels. passed: the unlisted keys of the universe that pass the first."""
        levels, inside, outside = [first], passed, listed
        while inside:
            level = Bloom.of(inside, 0.5, len(levels) + 1)
            levels.append(level)
            inside, outside = {k for k in outside if k in level}, inside
        return cls(levels)


def first_rate(listed: int, universe: int) -> float:
    """So that about 0.7 unlisted keys pass for each listed one."""
    return min(0.5, max(1e-9, max(1, listed) * math.sqrt(0.5) / max(1, universe - listed)))


def universe(pages: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """The distinct keys of all urls. Spark counts each task's keys once before the shuffle, so no host is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        schema = pa.schema([("key", pa.string())])
        yield from in_batches(((k,) for (url,) in text_rows(batches) for k in keys_of(*split_url(url), shapes)), schema)

    return pages.select("url").mapInArrow(run, "key string").distinct()


def build(keys: DataFrame, n_keys: int, listed: set[str]) -> Cascade:
    """A cascade for the listed keys over the universe `keys`, of which there are n_keys."""
    rate = first_rate(len(listed), n_keys)
    bound = 8 * len(listed) + 1000
    while True:
        first = Bloom.of(listed, rate, 1)

        def run(batches: Iterator[pa.RecordBatch], first: Bloom = first) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                yield batch.filter(pa.array([k in first and k not in listed for k in batch.column(0).to_pylist()], pa.bool_()))

        passed = [r.key for r in keys.mapInArrow(run, "key string").limit(bound + 1).collect()]
        if len(passed) <= bound:
            return Cascade.finish(first, listed, set(passed))
        rate /= 16


VERDICTS = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def judge(pages: DataFrame, rules: dict[str, str], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page. rules: rule to `allow` or `block`."""
    if bad := {v for v in rules.values()} - {"allow", "block"}:
        raise ValueError(f"a verdict is allow or block, not {sorted(bad)}")
    # Longest rules first, then longest hosts.
    shapes = sorted({shape_of(r) for r in rules})
    blocked, allowed = ({r for r, v in rules.items() if v == verdict} for verdict in ("block", "allow"))
    keys = written(universe(pages, shapes), "url-keys")
    n_keys = keys.count()
    block, allow = build(keys, n_keys, blocked), build(keys, n_keys, allowed)

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url in given:
            host, path = split_url(url)
            fit = ((k, "block" if k in block else "allow") for k in keys_of(host, path, shapes) if k in block or k in allow)
            rule, verdict = max(fit, key=lambda f: (len(f[0]), f[0].index("/")), default=(None, default))
            yield page_id, host, path, rule, verdict

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from in_batches(rows(text_rows(batches)), VERDICTS)

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
