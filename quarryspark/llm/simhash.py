"""SimHash near-dedup: fingerprints, a vantage-point tree over them, and connected components.

Tree. A level of the tree has a vantage point; a node's children are the Hamming distances to it. The triangle
bound says that two fingerprints' distances to a vantage point differ by at most their own distance, so a
query only enters children whose distances differ from its own by the radius at most, and prunes exactly. At
the top levels the distances are taken within disjoint blocks of the bits, around a fixed word: what
one level uses up of the radius is no longer there for the next, so a query with radius r enters
children whose distances differ from its own by r in total. This prunes far better than whole-word vantage points,
around which random fingerprints all lie at 32 +- 4.

Shards are the nodes at the tree's top levels. A fingerprint is a member of one shard and
visits those others that its radius overlaps (one of each pair of shards, so that no pair is
looked at twice). A shard whose members and visitors make more than ``PAIRS`` pairs is split on: its vantage point is
a fingerprint of its own, the distances are those of the whole word, and again members visit the rings
that their radius overlaps, until every shard is small enough for a task or ``DEEPEST`` levels are reached.
The tasks compare what is left, in blocks. They return spanning links to the smallest member, not pairs, so their
output is linear in what they read, and no group of copies or near copies is expanded: equal fingerprints
are one row from the start.

Wide radii (near copies by similarity). Where r is a large part of the distance between random
fingerprints, no exact triangle bound prunes. ``similar_groups`` then shards 512-bit
fingerprints by a forest: each tree takes its own random block of all the bits and descends one
bit at a time (a vantage point on one bit), without overlap; the number of trees is chosen so that
a pair at the wanted similarity meets in some shard with probability ``recall``, as the mean over
how many of its bits may differ. The limit on differing bits is apart from that: at ``slack`` 2 it
passes 0.973 of the pairs at exactly the wanted similarity, so 0.96 of them are linked in all.

Edge cases: null and empty texts have fingerprint 0, linked like any other; texts of fewer
words than a shingle hash as a whole; repeated rows share fingerprints; long texts are hashed
whole; an empty table gives an empty result; other columns are ignored, and passed on by
``drop_near_copies``. Rows without a doc_id link others like any row; a component of such rows only
has a null name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.common import hex64, keep_one, meet, released, short_batches, sized, spill, text_sha
from quarryspark.llm.components import components

#: Vantage points of the tree's levels (the digits of an arbitrary fixed word).
VANTAGE = 0x9E3779B97F4A7C15
#: Bits of a block of the tree's top levels; levels that make up a shard's key. The same at every size, so that the
#: shards that a fingerprint visits (65 of them with radius 3) don't grow with the table.
BLOCK, LEVELS = 16, 4
#: Pairs of a member and a visitor in a shard, at most, before it is split by a fingerprint of its own; such levels, at most.
PAIRS, DEEPEST = 1 << 26, 6


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it has fewer words; none if it has none."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six white-space bytes
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    n = len(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, n)
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255  # 255 ones fit a byte
        counts += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
        if whole:
            counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 3, seeds: tuple[int, ...] = (42,), sha: bool = False, distinct: bool = False) -> DataFrame:
    """doc_id, sha (of the text, if asked for) and fp0, fp1, ... (longs, one per seed) of each row's whole text.

    distinct: a shingle votes once however often it stands in the text, as similarity of sets asks.
    """
    import pyarrow as pa

    short_batches(df.sparkSession)
    names = [f"fp{i}" for i in range(len(seeds))]
    kept = ["doc_id", "sha"] if sha else ["doc_id"]
    rng = np.random.default_rng(seeds[0])
    mixes = [(int(a) | 1, int(b)) for a, b in rng.integers(1, 1 << 62, (len(seeds), 2))]

    def run(batches):
        for batch in batches:
            cols: list[list[int]] = [[] for _ in names]
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, words, seeds[0])
                h = np.unique(h) if distinct else h
                for i, col in enumerate(cols):
                    # further words of a wide fingerprint come from the same hashes, mixed anew
                    x = h if not i else (h ^ (h >> np.uint64(29))) * np.uint64(mixes[i][0]) + np.uint64(mixes[i][1])
                    col.append(majority(x if not i else x ^ (x >> np.uint64(32))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(pa.array(np.array(c, np.uint64).astype(np.int64)) for c in cols)], [*kept, *names])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([text_sha(F.col("text")).alias("sha")] if sha else [])).mapInArrow(released(run), "doc_id long, " + "sha binary, " * sha + ", ".join(f"{n} long" for n in names))


def ring(fp: Column, level: int) -> Column:
    """Hamming distance to the level's vantage point within the level's block."""
    mask = ((1 << BLOCK) - 1) << (BLOCK * level)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    return F.bit_count(fp.bitwiseXOR(F.lit(signed(VANTAGE))).bitwiseAND(F.lit(signed(mask)))).cast("int")


def offsets(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of shard keys within the radius: the half of them that is 0 or lexicographically positive."""
    found = [()]
    for _ in range(levels):
        found = [(*f, d) for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return [f for f in found if f >= (0,) * levels]


class Labels:
    """Smallest label of what is linked, over the rows of one shard."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while len(a):
            x, y = of[a], of[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
            while True:  # pointers to roots
                up = of[of]
                if (up == of).all():
                    break
                of[:] = up


def linked(fps: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int, labels: Labels, pairs: int = 1 << 18) -> None:
    """Link those pairs of rows that are within the radius over all words; pairs that already share a label are passed over."""
    for at in range(0, len(i), pairs):
        x, y = i[at : at + pairs], j[at : at + pairs]
        apart = labels.of[x] != labels.of[y]
        x, y = x[apart], y[apart]
        near = np.bitwise_count(fps[x] ^ fps[y]).sum(1, dtype=np.int32) <= radius
        labels.link(x[near], y[near])


def compare(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, labels: Labels, cells: int = 1 << 22, narrow: tuple[int, int] | None = None) -> None:
    """Link rows a with rows b where their fingerprints (n x words) are within the radius. a is b: each pair once.

    narrow: (words, radius) of a first comparison that pairs must pass before all of their words are looked at.
    """
    same = a is b
    step = max(1, cells // max(1, len(b)))
    for at in range(0, len(a), step):
        own, other = a[at : at + step], b[at:] if same else b
        if not len(other):
            break
        words, most = narrow or (fps.shape[1], radius)
        dist = np.bitwise_count(fps[own, 0][:, None] ^ fps[other, 0][None, :])
        for w in range(1, words):
            dist = dist + np.bitwise_count(fps[own, w][:, None] ^ fps[other, w][None, :])
        i, j = np.nonzero(dist <= most)
        if narrow:
            linked(fps, own[i], other[j], radius, labels)
        else:
            labels.link(own[i], other[j])


def shard_links(df: DataFrame, radius: int, words: int, narrow: tuple[int, int] | None = None) -> DataFrame:
    """a, b: spanning links. df: shard, member, rep, fp0.. , with the rows of a shard in one partition, next to each other."""
    import pyarrow as pa

    names = [f"fp{i}" for i in range(words)]

    def links(parts):
        rep = np.concatenate([p[1] for p in parts])
        member = np.concatenate([p[0] for p in parts])
        fps = np.concatenate([p[2] for p in parts])
        if len(rep) < 2:
            return None
        order = np.argsort(rep, kind="stable")  # so that the smallest label is the smallest rep
        rep, member, fps = rep[order], member[order], fps[order]
        labels = Labels(len(rep))
        own, visits = np.flatnonzero(member), np.flatnonzero(~member)
        compare(fps, own, own, radius, labels, narrow=narrow)
        if len(visits) and len(own):
            compare(fps, own, visits, radius, labels, narrow=narrow)
        moved = np.flatnonzero(labels.of != np.arange(len(rep)))
        return (rep[moved], rep[labels.of[moved]]) if len(moved) else None

    def run(batches):
        held, shard, found, size = [], None, [], 0
        for batch in batches:
            key = batch.column("shard").to_numpy(zero_copy_only=False)
            member = batch.column("member").to_numpy(zero_copy_only=False).astype(bool)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            fps = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).view(np.uint64)
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if key[x] != shard:
                    if held and (out := links(held)):
                        found.append(out)
                        size += len(out[0])
                    held, shard = [], key[x]
                held.append((member[x:y], rep[x:y], fps[x:y]))
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])
                found, size = [], 0
        if held and (out := links(held)):
            found.append(out)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    short_batches(df.sparkSession)
    return df.mapInArrow(released(run), "a long, b long")


def tree_links(nodes: DataFrame, radius: int = 3, levels: int = LEVELS, pairs: int = PAIRS) -> DataFrame:
    """All links within the radius among (rep, fp0), as spanning links. Exact for any radius and numbers of levels and pairs."""
    base = 2 * BLOCK + 2 * radius + 2
    code = lambda parts: sum(p * base ** (levels - 1 - i) for i, p in enumerate(parts))
    steps = [code(o) for o in offsets(levels, radius)]
    keyed = nodes.withColumn("own", code([ring(F.col("fp0"), i) for i in range(levels)]).cast("long"))
    shards = sized(keyed.select(F.col("own").alias("shard")).distinct(), (BLOCK + 1) ** levels)  # no more can be shards
    visits = keyed.select("rep", "fp0", "own", F.explode(F.lit(steps).cast("array<long>")).alias("step")).select((F.col("own") + F.col("step")).alias("shard"), (F.col("step") == 0).alias("member"), "rep", "fp0")
    visits = visits.join(shards, "shard", "left_semi")
    links = lambda rows: shard_links(_together(rows), radius, 1)
    out = None
    for _ in range(DEEPEST):
        own = F.when(F.col("member"), F.col("rep"))
        sizes = visits.groupBy("shard").agg(F.count(own).alias("members"), F.count(F.lit(1)).alias("all"), F.min_by("fp0", own).alias("vantage"))
        over = spill(sizes.where(F.col("members") * F.col("all") > pairs).select("shard", "vantage"), "over", dealt=True)
        if over.isEmpty():
            break
        large = sized(over)
        part = links(visits.join(large, "shard", "left_anti"))
        out = part if out is None else out.unionByName(part)
        visits = spill(_rings(visits.join(large, "shard"), radius), "visits")
    return links(visits) if out is None else out.unionByName(links(visits))


def _together(rows: DataFrame) -> DataFrame:
    """The rows of a shard in one partition, next to each other.

    Dealt by a hash of the shard, not by the shard itself: after a join on the shard the planner leaves a repartition by
    it out, and adaptive execution may then read the join's own shuffle task by task, which tears shards apart.
    """
    return rows.repartition(F.xxhash64("shard")).sortWithinPartitions("shard")


def _rings(visits: DataFrame, radius: int) -> DataFrame:
    """The members and visitors of shards by their distance to the shard's vantage point: again shard, member, rep, fp0."""
    away = F.bit_count(F.col("fp0").bitwiseXOR(F.col("vantage"))).cast("int")
    low = F.when(F.col("member"), 0).otherwise(-radius)
    steps = visits.select("shard", "member", "rep", "fp0", away.alias("away"), F.explode(F.sequence(low, F.lit(radius))).alias("step"))
    rings = steps.select(F.xxhash64("shard", F.col("away") + F.col("step")).alias("shard"), (F.col("member") & (F.col("step") == 0)).alias("member"), "rep", "fp0")
    return rings.join(rings.where("member").select("shard").distinct(), "shard", "left_semi")


def named_components(fps: DataFrame, names: list[str], links) -> DataFrame:
    """The columns of fps and ``first``: the row that stands first in what is reachable over ``links(nodes)``.

    first: (none, doc_id and sha, if fps has it); none: that there is no doc_id. A node is a distinct fingerprint with an
    ordinal, so rows without a doc_id link others like any row, but come after all that have one.
    """
    own = fps.groupBy(*names).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *(["sha"] if "sha" in fps.columns else []))).alias("first"), F.count(F.lit(1)).alias("n"))
    total = fps.count()
    nodes = spill(own.select(F.monotonically_increasing_id().alias("rep"), *names, "first", "n"), "nodes")
    roots = components(links(nodes.drop("first", "n")), total)
    rooted = nodes.join(roots, nodes.rep == roots.node, "left").select(*names, "first", "n", F.coalesce("root", "rep").alias("root"))
    named = spill(rooted.drop("first").join(rooted.groupBy("root").agg(F.min("first").alias("first")), "root").select(*names, "first", "n"), "named", total)
    return meet(fps, named, names)


def near_components(df: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of (doc_id, text)."""
    fps = spill(fingerprints(df, words), "fingerprints")
    named = named_components(fps, ["fp0"], lambda nodes: tree_links(nodes, radius))
    return named.select("doc_id", hex64(F.col("fp0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def bits_apart(similarity: float) -> float:
    """Expected share of differing SimHash bits of two shingle sets with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def forest_trees(p: float, width: int, depth: int, recall: float) -> int:
    """Trees of ``depth`` of ``width`` bits so that a pair whose bits differ with chance p shares a shard with chance ``recall``.

    The trees draw on the same bits, so a pair that differs in more of them than expected misses most trees together:
    the mean over the number of differing bits counts, not the chance at the expected number.
    """
    differ = range(width + 1)
    chance = np.array([math.comb(width, d) * p**d * (1 - p) ** (width - d) for d in differ])
    parted = np.array([1 - math.comb(width - d, depth) / math.comb(width, depth) for d in differ])
    trees = 1
    while chance @ parted**trees > 1 - recall:
        trees += 1
    return trees


def similar_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.99, slack: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sha, component_id, first; fingerprints): rows whose shingle sets' similarity, as 512-bit fingerprints tell it, reaches ``similarity``.

    A pair is taken up to ``slack`` standard deviations beyond the expected number of differing bits, so that few
    pairs at the threshold itself are missed. The first 128 bits rule most pairs out before all bits are compared,
    with one standard deviation more.
    """
    p, width, wide = bits_apart(similarity), 128, 512
    most = lambda bits, s: math.floor(bits * p + s * math.sqrt(bits * p * (1 - p)))
    names = [f"fp{i}" for i in range(wide // 64)]
    fps = spill(fingerprints(df, words, tuple(range(42, 42 + len(names))), sha=True, distinct=True), "fingerprints")

    def links(nodes: DataFrame) -> DataFrame:
        depth = max(12, math.ceil(math.log2(max(2, nodes.count()) / 64)))
        trees = forest_trees(p, wide, depth, recall)
        rng = np.random.default_rng(7)
        masks = np.zeros((trees, wide), np.uint8)  # the bits that a tree descends by
        for row in masks:
            row[rng.choice(wide, depth, replace=False)] = 1
        masks = np.packbits(masks, axis=1, bitorder="little").view("<i8")
        visits = nodes.select(F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), "rep", *names)
        # a shard is a tree and the values of its bits; the hash of both stands for it, and meets at worst more pairs
        own = (F.col(n).bitwiseAND(F.element_at(F.lit(masks[:, i].tolist()).cast("array<long>"), F.col("tree"))) for i, n in enumerate(names))
        visits = visits.select(F.xxhash64("tree", *own).alias("shard"), F.lit(True).alias("member"), "rep", *names)
        return shard_links(visits.repartition("shard").sortWithinPartitions("shard"), most(wide, slack), len(names), (width // 64, most(width, slack + 1)))

    return named_components(fps, names, links).select("doc_id", "sha", F.col("first.doc_id").alias("component_id"), "first"), fps


def drop_near_copies(df: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay, one of each group of similar texts: that with the smallest doc_id, a null one coming last.

    Of rows of the group that share that doc_id, or have none, that with the smallest hash of its text.
    """
    groups, fps = similar_groups(df, words, similarity)
    keep = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    return keep_one(df, groups.select("doc_id", "sha", keep.alias("keep")), text_sha(df["text"]), fps.count())
