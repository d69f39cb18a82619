"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item (or all of a shorter item); a document's words inside an
occurrence of a window are hit. Windows are sets of positioned shingles of SHINGLE words (one shingle for shorter windows).

1. Shingles are ordered by rarity: one pass counts how often the documents hold each shingle of the benchmark.
2. An occurrence holds all of a window's shingles, so the prefix that must be joined is its single rarest one. A second
   pass meets the documents with these prefixes only. A bit filter of bounded size passes every position that holds
   one, and few others; rows are made for those positions alone.
3. Length and positional bounds give the window's one possible place, which must lie within the document; there the
   document's words are compared with the window's, all of them in order, which is exact containment.

Up to BROADCAST_ROWS prefixes of BROADCAST_BYTES in all are broadcast, and a position brings the words around it. Beyond
that positions are shuffled as (document, place, hash), frequent hashes apart, and only documents that hold a prefix fetch
their words. Work is proportional to a document's words, however many they are.

Defined results: a null or empty text has no words, no hits, and is not contaminated. Items without words have no windows.
Rows of one item id are one item; an item without id hits words but is not counted or listed. Repeated documents are
judged alike, one row each.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lookup_by_hot_key, written

WINDOW = 13
SHINGLE = 5
#: A word is hit if it lies in an occurrence; a document is contaminated if one in SHARE words is hit.
SHARE = 20
#: Prefixes that are broadcast with their windows, at most, and the bytes of those windows.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 64 << 20
#: Logarithms of the filter's size: 32 bits a prefix within these bounds, so 512 kB at most.
FILTER_BITS = (16, 22)
#: What separates words, once A-Z are lower-cased.
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LONG = "array<bigint>"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null. lower() is the same, and faster, where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(plain, _SEPARATOR), "")


def _hashes(wh: Column, n: Column, size: int) -> Column:
    """Hashes of the shingles of a size, from the hashes of the n words; an empty array if there are none."""
    each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(wh, i + j) for j in range(size)]))
    return F.when(n >= size, each).otherwise(F.array().cast(_LONG))


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, len and words of each window of an item, once."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0").withColumn("len", F.least(F.lit(WINDOW), F.col("n")))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("len")), lambda s: F.slice("w", s + 1, F.col("len"))))
    return w.select("item_id", "len", each.alias("words")).distinct()


def distinct_windows(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows (wid, set_id, len, k, words, and hs, the hashes of their shingles of k words), and the members
    (set_id, item_id) of their sets of items. Windows of the same items share a set, so that copies of an item are listed
    once; sets are told apart by their sizes and two sums of hashes."""
    wins = written(listed.select("len", "words").distinct().withColumn("wid", F.monotonically_increasing_id()), "distinct-windows")
    owned = written(listed.join(wins, ["len", "words"]).select("wid", "item_id"), "window-items")
    sums = [F.sum(F.xxhash64(F.lit(seed), "item_id").cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    signed = owned.groupBy("wid").agg(F.count(F.lit(1)).alias("size"), *sums)
    same = written(signed.join(signed.groupBy("size", "s1", "s2").agg(F.min("wid").alias("set_id")), ["size", "s1", "s2"]).select("wid", "set_id"), "window-sets")
    members = owned.where("item_id IS NOT NULL").join(same.where("wid = set_id"), "wid").select("set_id", "item_id")
    wh = F.transform("words", lambda x: F.xxhash64(x))
    wins = wins.join(same, "wid").select("*", F.least(F.lit(SHINGLE), F.col("len")).alias("k"), wh.alias("wh"))
    hs = F.array().cast(_LONG)
    for k in range(1, SHINGLE + 1):
        hs = F.when(F.col("k") == k, _hashes(F.col("wh"), F.col("len"), k)).otherwise(hs)
    return written(wins.select("wid", "set_id", "len", "k", "words", hs.alias("hs")), "windows"), members


class Filter:
    """Which hashes may be listed: a table of one row with an array of bits, which each hash sets two of. Documents are
    tested with it where they are read. However many hashes there are, it has at most 2 ** FILTER_BITS[1] bits; where it is
    full it passes more, never less."""

    def __init__(self, hashes: DataFrame, n: int):
        """hashes: h."""
        self.bits = min(max((32 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
        slots = hashes.select(F.explode(F.array(*self.slots(F.col("h")))).alias("s"))
        words = slots.groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("set"))
        every = hashes.sparkSession.range(1 << self.bits - 6).select(F.col("id").cast("int").alias("word"))
        listed = F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))))
        self.row = written(every.join(F.broadcast(words), "word", "left").agg(listed.getField("set").alias("slots")), "filter")

    def slots(self, h: Column) -> list[Column]:
        mask = F.lit((1 << self.bits) - 1)
        return [h.bitwiseAND(mask).cast("int"), F.shiftrightunsigned(h, 64 - self.bits).cast("int")]

    def passes(self, h: Column) -> Column:
        """Of rows that were joined to the table."""
        word = lambda s: F.get(F.col("slots"), F.shiftright(s, 6))
        first, second = (F.call_function("shiftright", word(s), s.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1 for s in self.slots(h))
        return first & second


def positions(documents: DataFrame, sizes: list[int], keep: Filter) -> DataFrame:
    """doc_id, uid, th (text hash), n, w (words) and, for each size k of shingles, hs_k (their hashes) and at_k (the places
    whose hash passes)."""
    out = documents.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    out = out.select("*", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    out = out.select("*", *[_hashes(F.col("wh"), F.col("n"), k).alias(f"hs_{k}") for k in sizes]).drop("wh")
    out = out.join(F.broadcast(keep.row))  # one row
    return out.select("*", *[F.array_compact(F.transform(f"hs_{k}", lambda h, i: F.when(keep.passes(h), i))).alias(f"at_{k}") for k in sizes]).drop("slots")


def places(sizes: list[int], around: bool) -> Column:
    """From positions: the places that pass, as k, i and h; around: with lo and words, the words that any window of the
    shingle may cover and where they begin."""

    def of(k: int) -> Column:
        place = lambda i: [F.lit(k).alias("k"), i.alias("i"), F.get(F.col(f"hs_{k}"), i).alias("h")]
        return F.transform(f"at_{k}", lambda i: F.struct(*place(i), *(_around(i) if around else ())))

    return F.concat(*map(of, sizes))


def _around(i: Column) -> list[Column]:
    lo = F.greatest(i - (WINDOW - 1), F.lit(0))
    return [lo.alias("lo"), F.slice("w", lo + 1, i - lo + WINDOW).alias("words")]


def prefixes(documents: DataFrame, wins: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """set_id, len, k, words, h and o: each window with its rarest shingle and its offset; written. A window with a shingle
    that no document has cannot occur and is left out."""
    shingles = written(wins.select("wid", "k", F.posexplode("hs").alias("o", "h")), "shingles")
    n = shingles.select("h").distinct().count()
    keep = Filter(shingles.select("h").distinct(), n)
    held = positions(documents, sizes, keep).select(F.explode(places(sizes, False)).alias("p"))
    counted = held.groupBy(F.col("p.h").alias("h")).agg(F.count(F.lit(1)).alias("df"))
    listed = shingles.select("h").distinct()
    rarity = written(counted.join(F.broadcast(listed) if n <= most else listed, "h", "left_semi"), "rarity")
    rarest = shingles.join(F.broadcast(rarity) if n <= most else rarity, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "o")).alias("p"))
    return written(wins.join(rarest.where("p.df > 0"), "wid").select("set_id", "len", "k", "words", F.col("p.h").alias("h"), F.col("p.o").alias("o")), "prefixes")


def occurrences(rows: DataFrame, prefix: DataFrame) -> DataFrame:
    """uid, start, len and set_id of each occurrence of a window. rows: uid, n and p, a place of `places` with its words."""
    each = rows.select("uid", "n", F.col("p.k").alias("k"), F.col("p.i").alias("i"), F.col("p.h").alias("h"), F.col("p.lo").alias("lo"), F.col("p.words").alias("own"))
    start = F.col("i") - F.col("o")
    met = each.join(prefix, ["k", "h"]).where((start >= 0) & (start + F.col("len") <= F.col("n")))
    return met.where(F.slice("own", start - F.col("lo") + 1, F.col("len")) == F.col("words")).select("uid", start.alias("start"), "len", "set_id")


def judge(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    wins, members = distinct_windows(written(windows(benchmark), "item-windows"))
    sizes = sorted(r.k for r in wins.select("k").distinct().collect()) or [SHINGLE]
    prefix = prefixes(documents, wins, sizes, BROADCAST_ROWS)
    n, size = prefix.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0))).first()
    small = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    found = positions(documents, sizes, Filter(prefix.select("h").distinct(), n))
    found = found.select("doc_id", "uid", "th", "n", places(sizes, small).alias("at"), *([] if small else ["w"]))
    docs = written(found, "positions")
    if small:
        rows, met = docs.select("uid", "n", F.explode("at").alias("p")), F.broadcast(prefix)
    else:
        hashed = docs.select("uid", F.explode("at").alias("p")).select("uid", "p.k", "p.i", "p.h")
        counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(prefix.select("h").distinct(), "h", "left_semi")
        hits = lookup_by_hot_key(hashed, counts, "h").groupBy("uid").agg(F.collect_list(F.struct("k", "i", "h")).alias("hits"))
        placed = F.transform("hits", lambda p: F.struct(p["k"].alias("k"), p["i"].alias("i"), p["h"].alias("h"), *_around(p["i"])))
        rows, met = docs.select("uid", "n", "w").join(hits, "uid").select("uid", "n", F.explode(placed).alias("p")), prefix.hint("merge")
    hit = written(occurrences(rows, met), "occurrences")
    spans = hit.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"))
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", state, lambda acc, s: F.struct(F.greatest(acc["end"], s["start"] + s["len"]).alias("end"), (acc["n"] + F.greatest(s["start"] + s["len"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n")))
    listed = hit.select("uid", "set_id").distinct().join(members, "set_id").select("uid", F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = docs.select("uid", "doc_id", "th", F.col("n").cast("long").alias("n_words")).join(spans.select("uid", covered["n"].alias("n_hit")).join(listed, "uid", "left"), "uid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, unchanged. They meet the contaminated ones by id and text hash."""
    bad = written(judge(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad.hint("merge")
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_th")), "left_anti")
