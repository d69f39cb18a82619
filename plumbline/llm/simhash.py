"""SimHash near-duplicates: exact links of 64-bit fingerprints by sharded vantage-point trees, and their components.

Two fingerprints link if they differ in at most RADIUS bits. Finding the links takes three steps.

1. Sharding by vantage points. The 64 bits are cut into b blocks; RADIUS differing bits leave b - RADIUS blocks untouched,
   so linked fingerprints have Hamming distance 0 on the bits of at least one choice of b - RADIUS blocks. There is a tree
   for each choice. Its top partitions fingerprints by their Hamming distances, on the tree's bits, to fixed vantage
   points. By the triangle inequality a partner at distance 0 on those bits has the same distances, so all other shards
   are pruned, and a fingerprint's ball overlaps just one shard of each tree: that is where it is sent.
2. In each shard a vantage-point tree in the full metric, built while it is joined with itself: a vantage point's
   distances split the set at their median, partners on the other side lie within RADIUS of the boundary, pairs that are
   already in one component need no test, and all points within RADIUS of a vantage point are linked with it. What comes
   out are links to the smallest member of each of the shard's components: no more than one for each fingerprint.
3. Components of those links, by alternating large-star and small-star rounds until nothing changes.

Copies cost nothing after their fingerprints are counted. A shard of more than LARGE points, at any size of the input, is
not sent to one task. About HUBS of its points become hubs, which every task compares its own points with; only points
outside the hubs' main component are then compared with the rest of the shard, in pairs of chunks of at most CHUNK. So a
dense cluster, such as a third of all rows being near copies, costs one pass. Where more than FEW chunks are left, the
shard is no cluster: its points are sharded again by further vantage points, on the bits that its tree leaves free, cut
into RADIUS + 1 blocks as before. After LEVELS of that so few bits are free that no crowd of unlike points is left.

Defined results: texts without words (null, empty, white space) have fingerprint zero and link as any other. Null ids take
part, but a component's id is its smallest non-null one, or null. Repeated rows are rows of one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import HOT, in_batches, lookup_by_hot_key, release, text_rows, written

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Vantage points of each tree's top.
VANTAGES = 8
#: A shard of more points than this is split.
LARGE = 1 << 14
CHUNK = 2048
HUBS = 64
#: Chunks outside the hubs' main component that are compared with the whole of a large shard.
FEW = 4
#: How often large shards are sharded again.
LEVELS = 3
#: Sets of no more points than this are compared directly.
LEAF = 48


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of the text's shingles, as a signed number."""
    joined = text.encode("utf-8", "surrogatepass").lower()
    words = joined.split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        part = hashes[lo : lo + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from in_batches(((doc_id, fingerprint(text or "")) for doc_id, text in text_rows(batches)), PRINTS)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def trees(n: int) -> list[int]:
    """Bit masks of the trees for n fingerprints: more and finer trees for more of them."""
    blocks = RADIUS + 1 + (n > 1 << 21) + (n > 1 << 29)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(own, blocks - RADIUS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shard(mask: Column, vantages: np.ndarray) -> Column:
    """The distances to the vantage points on the mask's bits, packed."""
    shard = F.lit(0).cast("long")
    for v in vantages:
        shell = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(int(v)))).bitwiseAND(mask)).cast("long")
        shard = F.shiftleft(shard, 7).bitwiseOR(shell)
    return shard


def sharded(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fp, tree and shard: the distances on the tree's bits to its vantage points, packed."""
    rng = np.random.default_rng(20)
    options = [F.struct(F.lit(k).alias("tree"), _shard(F.lit(signed(mask)), rng.integers(0, 1 << 64, VANTAGES, np.uint64)).alias("shard")) for k, mask in enumerate(masks)]
    return fps.select("fp", F.inline(F.array(*options)))


def finer(points: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
    """points (tree, shard, fp) sharded again, RADIUS + 1 shards for each, by a block of the bits that their tree leaves
    free; and the masks of the new trees. Points that were in different shards stay apart."""
    blocks = RADIUS + 1
    free = [[b for b in range(64) if not mask >> b & 1] for mask in masks]
    cut = [[sum(1 << b for b in bits[len(bits) * j // blocks : len(bits) * (j + 1) // blocks]) for j in range(blocks)] for bits in free]
    rng = np.random.default_rng(21)
    options = []
    for j in range(blocks):
        own = F.get(F.array(*[F.lit(signed(c[j])) for c in cut]), F.col("tree"))
        inner = _shard(own, rng.integers(0, 1 << 64, VANTAGES, np.uint64))
        options.append(F.struct((F.col("tree") * blocks + j).alias("tree"), F.xxhash64("shard", inner).alias("shard")))
    return points.select("fp", F.inline(F.array(*options))), [mask | c for mask, own in zip(masks, cut, strict=True) for c in own]


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


class Linker:
    """Components of a set of points under links within RADIUS."""

    def __init__(self, points: np.ndarray, known: np.ndarray | None = None):
        """known: indices of points that are in one component for other reasons."""
        self.x, self.parent = points, np.arange(len(points))
        if known is not None and len(known):
            self.parent[known] = known.min()

    def roots(self, idx: np.ndarray) -> np.ndarray:
        r = self.parent[idx]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[idx] = r
                return r
            r = up

    def join(self, idx: np.ndarray) -> None:
        """All of idx are in one component."""
        r = np.unique(self.roots(idx))
        self.parent[r] = r[0]

    def _direct(self, a: np.ndarray, b: np.ndarray) -> None:
        for lo in range(0, len(a), 256):
            part = a[lo : lo + 256]
            near = np.bitwise_count(self.x[part][:, None] ^ self.x[b][None, :]) <= RADIUS
            for i in np.flatnonzero(near.any(axis=1)):
                self.join(np.append(b[near[i]], part[i]))

    def _one(self, *sets: np.ndarray) -> bool:
        first = self.roots(sets[0][:1])[0]
        return all((self.roots(s) == first).all() for s in sets)

    def inside(self, idx: np.ndarray, tries: int = 0) -> None:
        """Links among idx."""
        if len(idx) < 2 or self._one(idx):
            return
        if len(idx) <= LEAF or tries == 4:
            return self._direct(idx, idx)
        vantage = idx[(len(idx) * (2 * tries + 1)) // 9]
        d = distances(self.x[idx], self.x[vantage])
        self.join(idx[d <= RADIUS])
        mid = np.partition(d, len(d) // 2)[len(d) // 2]
        near = d < mid if mid == d.max() else d <= mid
        if near.all() or not near.any():
            return self.inside(idx, tries + 1)
        edge = d[near].max()
        self.inside(idx[near])
        self.inside(idx[~near])
        # A partner on the other side is no farther from the boundary than RADIUS.
        out = d[~near].min()
        self.across(idx[near & (d >= out.astype(int) - RADIUS)], idx[~near & (d <= edge.astype(int) + RADIUS)])

    def across(self, a: np.ndarray, b: np.ndarray, tries: int = 0) -> None:
        """Links between a and b."""
        if not len(a) or not len(b) or self._one(a, b):
            return
        if len(a) * len(b) <= LEAF * LEAF or tries == 4:
            return self._direct(*((a, b) if len(a) <= len(b) else (b, a)))
        larger = a if len(a) >= len(b) else b
        vantage = larger[(len(larger) * (2 * tries + 1)) // 9]
        da, db = distances(self.x[a], self.x[vantage]).astype(int), distances(self.x[b], self.x[vantage]).astype(int)
        self.join(np.concatenate([a[da <= RADIUS], b[db <= RADIUS], [vantage]]))
        both = np.concatenate([da, db])
        mid = int(np.partition(both, len(both) // 2)[len(both) // 2])
        cut = mid - 1 if mid == both.max() else mid
        na, nb = da <= cut, db <= cut
        low, high = cut + 1 - RADIUS, cut + RADIUS
        parts = [(na, nb), (~na, ~nb), (na & (da >= low), ~nb & (db <= high)), (~na & (da <= high), nb & (db >= low))]
        if sum(int(p.sum()) * int(q.sum()) for p, q in parts) > 0.8 * len(a) * len(b):  # this vantage point prunes little
            return self.across(a, b, tries + 1)
        for p, q in parts:
            self.across(a[p], b[q])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each point that is not its component's smallest, and that smallest one."""
        r = self.roots(np.arange(len(self.x)))
        signed_x = self.x.view(np.int64)
        order = np.lexsort((signed_x, r))
        first = np.r_[True, r[order][1:] != r[order][:-1]]
        least = signed_x[order][np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))]
        keep = least != signed_x[order]
        return signed_x[order][keep], least[keep]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Rows of equal first columns, from batches sorted by them, as arrays with a row for each column."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        cuts = np.flatnonzero((part[:keys, 1:] != part[:keys, :-1]).any(axis=0)) + 1
        for k, piece in enumerate(np.split(part, cuts, axis=1)):
            if held and (k or (held[-1][:keys, -1] != piece[:keys, 0]).any()):
                yield np.concatenate(held, axis=1)
                held = []
            held.append(piece)
    if held:
        yield np.concatenate(held, axis=1)


def _emit(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    a, b, n = [], [], 0
    for x, y in found:
        if len(x):
            a.append(x)
            b.append(y)
            n += len(x)
        if n >= 1 << 15:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=LINKS)
            a, b, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=LINKS)


def cold_links(points: DataFrame) -> DataFrame:
    """Links within shards, of points (tree, shard, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for g in _groups(batches, 2):
                if g.shape[1] > 1:
                    linker = Linker(np.ascontiguousarray(g[2]).view(np.uint64))
                    linker.inside(np.arange(g.shape[1]))
                    yield linker.links()

        yield from _emit(found())

    dealt = points.select("tree", "shard", "fp").repartition("tree", "shard").sortWithinPartitions("tree", "shard", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def large_links(points: DataFrame, large: DataFrame, most: int | None) -> tuple[list[DataFrame], DataFrame]:
    """Links within large shards, of points (tree, shard, fp), and the large shards (tree, shard) that are yet to be
    searched: those with more than `most` chunks outside the hubs' main component. large: tree, shard and n, a row each;
    about HOT of them."""
    near = points.join(F.broadcast(large), ["tree", "shard"])
    # About HUBS points of each large shard, by a hash: no more than HOT * HUBS in all, give or take their root.
    share = F.pmod(F.xxhash64("fp", "tree"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = near.where(share < F.lit(float(HUBS)) / F.col("n")).select("tree", "shard", "fp").collect()
    hubs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    given: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        given.setdefault((r.tree, r.shard), []).append(r.fp)
    for key, fps in given.items():
        x = np.array(sorted(fps), np.int64).view(np.uint64)
        linker = Linker(x)
        linker.inside(np.arange(len(x)))
        hubs[key] = (x, x.view(np.int64)[linker.roots(np.arange(len(x)))])
    schema = pa.schema([("tree", pa.int32()), ("shard", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("hubs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def rows() -> Iterator[tuple]:
            for tree, shard, fp, n in text_rows(batches):
                x, component = hubs.get((tree, shard), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                linked = component[np.bitwise_count(x ^ np.int64(fp).view(np.uint64)) <= RADIUS]
                yield tree, shard, fp, n, np.unique(linked)

        yield from in_batches(rows(), schema)

    seen = written(near.select("tree", "shard", "fp", "n").mapInArrow(run, "tree int, shard long, fp long, n long, hubs array<long>"), "large-points")
    to_hubs = seen.select(F.col("fp").alias("a"), F.explode("hubs").alias("b")).where("a <> b")
    between = [(int(f), int(c)) for x, component in hubs.values() for f, c in zip(x.view(np.int64), component, strict=True) if f != c]
    counts = seen.where(F.size("hubs") > 0).groupBy("tree", "shard", F.element_at("hubs", 1).alias("hub")).count()
    main = counts.groupBy("tree", "shard").agg(F.max(F.struct("count", "hub")).getField("hub").alias("main"))
    seen = seen.join(F.broadcast(main), ["tree", "shard"], "left").withColumn("rest", ~F.coalesce(F.array_contains("hubs", F.col("main")), F.lit(False)))
    sizes = written(seen.groupBy("tree", "shard").agg(F.ceil(F.sum(F.col("rest").cast("long")) / CHUNK).alias("rest_chunks"), F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")), "large-sizes")
    again = sizes.where(F.lit(False) if most is None else F.col("rest_chunks") > most).select("tree", "shard")
    seen = seen.join(F.broadcast(sizes.join(again, ["tree", "shard"], "left_anti")), ["tree", "shard"]).where("rest_chunks > 0").withColumn("h", F.xxhash64("fp"))
    # Each chunk of the rest meets each chunk of the whole shard.
    rest = seen.where("rest").select("tree", "shard", F.pmod("h", "rest_chunks").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("j"), "fp", F.lit(1).alias("role"))
    whole = seen.select("tree", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_chunks") - 1)).alias("i"), F.pmod("h", "chunks").alias("j"), "fp", F.when(F.col("rest"), 0).otherwise(2).alias("role"))
    keys = ["tree", "shard", "i", "j"]
    pairs = rest.unionByName(whole).repartition(*keys).sortWithinPartitions(*keys, "fp", "role")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for g in _groups(batches, 4):
                role = g[5]
                linker = Linker(np.ascontiguousarray(g[4]).view(np.uint64), np.flatnonzero(role == 2))
                linker.across(np.flatnonzero(role == 1), np.flatnonzero(role != 1))
                yield linker.links()

        yield from _emit(found())

    out = [to_hubs, pairs.select(*keys, "fp", "role").mapInArrow(cross, "a long, b long")]
    if between:
        out.append(points.sparkSession.createDataFrame(between, "a long, b long"))
    return out, again


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a > b: distinct links whose components are those of all links within RADIUS. fps: distinct fp."""
    masks = trees(fps.count())
    points = sharded(fps, masks)
    parts = []
    for level in range(LEVELS + 1):
        large = written(points.groupBy("tree", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE), "large-shards")
        n = large.count()
        if not n:
            parts.append(cold_links(points))
            break
        # Large shards hold LARGE points each, so there are few to the points; beyond HOT they are taken in turns.
        parts.append(cold_links(points.join(F.broadcast(large) if n <= HOT else large, ["tree", "shard"], "left_anti")))
        turns = -(-n // HOT)
        left = []
        for turn in range(turns):
            found, again = large_links(points, large.where(F.pmod(F.xxhash64("tree", "shard"), F.lit(turns)) == turn), FEW if level < LEVELS else None)
            parts += found
            left.append(again)
        again = reduce(DataFrame.unionByName, left)
        if level == LEVELS or again.isEmpty():
            break
        points, masks = finer(points.join(F.broadcast(again) if n <= HOT else again, ["tree", "shard"], "left_semi"), masks)
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _smallest(rows: DataFrame) -> DataFrame:
    """rows (u, v), each with m, the smallest of u and all its v."""
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return lookup_by_hot_key(rows, least, "u")


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component. edges: (a, b) with a > b."""
    edges = written(edges, "links")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    before = state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = written(_smallest(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        down = _smallest(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(small.distinct(), "small-star")
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    if before[0]:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id and root (the smallest fp of the component) of every row of prints (doc_id, fp)."""
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fps")
    labels = stars(links(fps.select("fp")))
    rooted = written(fps.join(labels, fps.fp == labels.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    whole = lookup_by_hot_key(rooted.select("fp", "root", F.col("n").alias("rows")), ids, "root").select("fp", "root", "component_id", F.col("rows").alias("n"))
    return lookup_by_hot_key(prints, whole, "fp").select("doc_id", "fp", "component_id", "root")


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every document."""
    found = components(written(fingerprints(documents), "fingerprints"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component: the one with its id; of rows that repeat id and fingerprint, any one."""
    at = documents.columns.index("text")
    name = next(n for n in ("fp", *(f"fp_{i}" for i in range(len(documents.columns) + 1))) if n not in documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fps = pa.array([fingerprint(t or "") for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], schema=batch.schema.append(pa.field(name, pa.int64())))

    schema = f"{documents._jdf.schema().toDDL()}, {name} long"
    wide = written(documents.mapInArrow(run, schema), "documents-fp")
    found = written(components(wide.select("doc_id", F.col(name).alias("fp"))), "components")
    # Of a component one fingerprint with its id, and how many rows have both.
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", F.col("fp").alias("keep_fp"), F.col("doc_id").alias("keep_id")).agg(F.count(F.lit(1)).alias("n"))
    kept = written(own.groupBy("root").agg(F.min(F.struct("keep_fp", "keep_id", "n")).alias("k")).select("k.*"), "kept")
    match = (F.col(name) == F.col("keep_fp")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = wide.join(kept.where("n = 1"), match, "left_semi").drop(name)
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(wide.join(repeated, match, "left_semi").dropDuplicates([name, "doc_id"]).drop(name))
    return out
