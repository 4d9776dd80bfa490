"""SimHash near-duplicates through vantage-point trees.

Rows are reduced to distinct fingerprints first, so groups of exact copies cost one
row. Two fingerprints that differ in at most DISTANCE of 64 bits differ in at most
DISTANCE // BANDS bits in one of BANDS bands of the bits; so each band has a
vantage-point tree over its own Hamming distance, searched with that radius. Every
fingerprint is stored in the one leaf (shard) that its distances to the vantage
points lead to, and also visits each later leaf that the triangle bound
|d(v, x) - d(v, y)| <= radius doesn't exclude: the shards that it overlaps. Within a
leaf all 64 bits are compared exactly, so the result is exact, whatever the trees.

The trees come from a sample of SAMPLE fingerprints, and only balance the work; leaves
stop getting more numerous at about 50 million different fingerprints. A leaf that holds
more than SHARD fingerprints is dealt out over several tasks. A leaf returns a
spanning forest of its links, not the pairs, and components are found from those in
Spark by least labels with pointer jumping, each round stored in the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any
other; rows that repeat a doc_id stand for that id each; a null doc_id is larger
than every other and names a component only if the component has no other id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, salted_join, ship, stored

#: Words in a shingle, and the hash's seed (fixed values of the contract).
SHINGLE, SEED = 4, 42
#: Bits in which linked fingerprints may differ.
DISTANCE = 4
BANDS = 3
#: Fingerprints to fit the trees, and how many each leaf should hold.
SAMPLE, LEAF = 1 << 20, 256
#: Stored fingerprints of a leaf that one task compares.
SHARD = 2048
#: Parts that a hot key is joined in, and the rows from which on a key may be one.
SALTS, HOT_FLOOR = 64, 64
_LANE = np.uint64(0x0101010101010101)
_LAST = (1 << 63) - 1


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The hash of every run of that many words, or of all words if there are fewer."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    cut = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    xx = xxhash.xxh64_intdigest
    return np.array([xx(norm[a:b], SEED) for a, b in cut], np.uint64)


def voted(h: np.ndarray) -> int:
    """64 bits; a bit is set if more than half of the hashes set it."""
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for j in range(8):  # byte lanes, summed before any of them can overflow
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANE, np.arange(0, len(h), 255))
        count[j::8] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * count > len(h)).tolist()))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The vote of the shingle hashes."""
    return voted(shingles(text, shingle))


def fingerprints(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Columns `keep`, then fp: the fingerprint as a signed 64-bit integer."""

    def work(texts):
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, keep, [("fp", "bigint", pa.int64())], lambda: work, text)


def band_masks() -> list[np.uint64]:
    cut = [round(64 * i / BANDS) for i in range(BANDS + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(cut, cut[1:])]


class Tree:
    """A vantage-point tree over the masked Hamming distance: distance <= cut goes left."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, leaves: int, seed: int):
        self.mask = mask
        rng = np.random.default_rng(seed)
        point, cut, left, right = [], [], [], []

        def grow(own: np.ndarray, wanted: float) -> int:
            k = len(point)
            point.append(0), cut.append(0), left.append(-1), right.append(-1)
            if wanted < 1.5 or len(own) < 8:
                return k
            best = None
            for v in rng.choice(own, min(4, len(own)), replace=False):
                d = np.bitwise_count((own ^ v) & mask)
                for c in {int(np.median(d)) - 1, int(np.median(d))}:
                    inside = int((d <= c).sum())
                    cost = abs(2 * inside - len(own)) + int((d == c).sum() + (d == c + 1).sum())
                    if 0 < inside < len(own) and (best is None or cost < best[0]):
                        best = cost, v, c, d <= c
            if best is None:
                return k
            point[k], cut[k] = best[1], best[2]
            left[k] = grow(own[best[3]], wanted * best[3].mean())
            right[k] = grow(own[~best[3]], wanted * (1 - best[3].mean()))
            return k

        grow(sample, leaves)
        self.point, self.cut = np.array(point, np.uint64), np.array(cut, np.int64)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def reach(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a ball of that radius around each fingerprint may meet."""
        row, node, rows, leaves = np.arange(len(fps)), np.zeros(len(fps), np.int64), [], []
        while len(row):
            done = self.left[node] < 0
            rows.append(row[done])
            leaves.append(node[done])
            row, node = row[~done], node[~done]
            d = np.bitwise_count((fps[row] ^ self.point[node]) & self.mask).astype(np.int64)
            a, b = d - radius <= self.cut[node], d + radius > self.cut[node]
            row, node = np.concatenate([row[a], row[b]]), np.concatenate([self.left[node[a]], self.right[node[b]]])
        return np.concatenate(rows), np.concatenate(leaves)


def grow_forest(fps: DataFrame, n: int) -> list[Tree]:
    got = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow().column("fp").to_numpy().view(np.uint64)
    return [Tree(got, m, max(1, n // LEAF), i) for i, m in enumerate(band_masks())]


def _members(batches, trees):
    for b in batches:
        fps = b.column(0).to_numpy().view(np.uint64)
        for k, tree in enumerate(trees):
            row, leaf = tree.reach(fps, 0)
            yield k, fps[row], leaf


def leaf_counts(fps: DataFrame, trees) -> dict[tuple[int, int], int]:
    """Fingerprints stored in each leaf; there are at most SAMPLE / 4 leaves a tree."""

    def run(batches):
        for k, _, leaf in _members(batches, trees.value):
            own, n = np.unique(leaf, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own.astype(np.int32)), pa.array(n)], ["tree", "leaf", "n"])

    out = fps.mapInArrow(run, "tree int, leaf int, n bigint").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    return {(r["tree"], r["leaf"]): r["n"] for r in out.collect()}


def dealt(fps: DataFrame, trees, shards, radius: int) -> DataFrame:
    """tree, leaf, part, visits, fp: where each fingerprint is stored (visits false) or is only compared."""
    names = ["tree", "leaf", "part", "visits", "fp"]

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for k, (tree, parts) in enumerate(zip(trees.value, shards.value, strict=True)):
                row, leaf = tree.reach(fps, radius)
                own = np.zeros(len(fps), np.int64)
                r0, l0 = tree.reach(fps, 0)
                own[r0] = l0
                part = (fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % parts[own]
                use = leaf >= own[row]  # the earlier leaf's fingerprints visit the later ones
                row, leaf = row[use], leaf[use]
                many = np.where(leaf == own[row], parts[leaf] - part[row], parts[leaf])
                at = np.repeat(np.arange(len(row)), many)
                step = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                row, leaf = row[at], leaf[at]
                home = leaf == own[row]
                to = np.where(home, part[row] + step, step)
                visits = ~(home & (to == part[row]))
                for a in range(0, len(row), 1 << 16):
                    c = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row[c]), k, np.int32)), pa.array(leaf[c].astype(np.int32)), pa.array(to[c].astype(np.int32)), pa.array(visits[c]), pa.array(fps[row[c]].view(np.int64))], names)

    return fps.mapInArrow(run, "tree int, leaf int, part int, visits boolean, fp bigint")


class Forest:
    """Least-root union of numbered rows."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        while (up := self.root[i]).tobytes() != i.tobytes():
            i = up
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            a, b = np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])
            np.minimum.at(self.root, b, a)


def _forest(stored_: np.ndarray) -> np.ndarray:
    """The root of each stored fingerprint by the links among them."""
    forest = Forest(len(stored_))
    for a in range(0, len(stored_), 256):
        i, j = np.nonzero(np.bitwise_count(stored_[a : a + 256, None] ^ stored_[None, a:]) <= DISTANCE)
        forest.join(i + a, j + a)
    return forest.roots(np.arange(len(stored_)))


def _visited(stored_: np.ndarray, root: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each visitor to each of the shard's components that it is near."""
    left, right = [visitors[:0]], [visitors[:0]]
    for a in range(0, len(visitors) if len(stored_) else 0, 256):
        w = visitors[a : a + 256]
        i, j = np.nonzero(np.bitwise_count(w[:, None] ^ stored_[None]) <= DISTANCE)
        if len(i):
            pair = np.unique(np.stack([i, root[j]]), axis=1)
            left.append(w[pair[0]])
            right.append(stored_[pair[1]])
    return np.concatenate(left), np.concatenate(right)


def _links(batches):
    """Batches sorted by tree, leaf, part, visits: a shard's stored fingerprints come before its visitors, which stream by."""
    key, held, shard, root = None, [], None, None

    def close():
        """Compare what the shard stores, once all of it is there."""
        nonlocal held, shard, root
        shard = np.concatenate(held) if held else np.zeros(0, np.uint64)
        held, root = [], _forest(shard)
        own = np.flatnonzero(root != np.arange(len(shard)))
        return shard[root[own]], shard[own]

    def out(found):
        a, b = found
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        t, leaf, part, visits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        fps = batch.column(4).to_numpy().view(np.uint64)
        if not len(fps):
            continue
        breaks = np.flatnonzero((t[1:] != t[:-1]) | (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *breaks], [*breaks, len(fps)]):
            now = (t[a], leaf[a], part[a])
            if now != key:
                if shard is None and key is not None:
                    yield from out(close())
                key, held, shard = now, [], None
            held.append(fps[a:b][~visits[a:b]])
            if len(come := fps[a:b][visits[a:b]]):
                if shard is None:
                    yield from out(close())
                yield from out(_visited(shard, root, come))
    if key is not None and shard is None:
        yield from out(close())


def links(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """a, b: links between distinct fingerprints whose connected components are those of all links."""
    spark = fps.sparkSession
    ship(spark)
    trees = spark.sparkContext.broadcast(grow_forest(fps, n))
    counts = leaf_counts(fps, trees)
    parts = [np.ones(len(t.left), np.int64) for t in trees.value]
    for (k, leaf), c in counts.items():
        parts[k][leaf] = -(-c // SHARD)
    rows = dealt(fps, trees, spark.sparkContext.broadcast(parts), distance // BANDS)
    shards = rows.repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part", "visits")
    return shards.mapInArrow(_links, "a bigint, b bigint").distinct()


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """Keys that hold more than a 256th of all rows (and HOT_FLOOR at least): under 256 of them."""
    return [r[0] for r in counts.filter(F.col(n) > max(HOT_FLOOR, total // 256)).select(key).collect()]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key, least, head: for every key that has edges, the least `id` in its component and the key that has it. nodes: key, id; edges: a, b.

    A key with very many links, as the least member of a large group has, is joined in SALTS parts.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "links")
    degrees = both.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n"))
    ends = both.count()
    hot = hot_keys(degrees, "key", "n", ends)

    def salted(key: str, other: Column) -> Column:
        return F.when(F.col(key).isin(hot), other).otherwise(F.lit(0)) if hot else F.lit(0)

    both = both.withColumn("salt", salted("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")))
    label = F.struct("id", "key").alias("label")
    now = stored(nodes.join(degrees.select("key"), "key").select("key", label), "labels")
    while True:
        spread = now.withColumn("salt", F.explode(F.sequence(F.lit(0), salted("key", F.lit(SALTS - 1)))))
        near = both.join(spread, (both["a"] == spread["key"]) & (both["salt"] == spread["salt"])).groupBy("b").agg(F.min("label").alias("near"))
        step = now.join(near, now["key"] == near["b"], "left").select("key", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # many keys may share one label, so the labels of labels are looked up for distinct ones
        asked = step.select(F.col("label.key").alias("k")).distinct()
        up = asked.join(now.select(F.col("key").alias("k"), F.col("label").alias("up")), "k")
        heads = hot_keys(step.groupBy(F.col("label.key").alias("k")).agg(F.count("*").alias("n")), "k", "n", ends) if hot else []
        part = F.when(F.col("label.key").isin(heads), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)) if heads else F.lit(0)
        many = F.when(F.col("k").isin(heads), F.lit(SALTS - 1)).otherwise(F.lit(0)) if heads else F.lit(0)
        up = up.withColumn("part", F.explode(F.sequence(F.lit(0), many)))
        step = step.withColumn("part", part)
        jump = step.join(up, (F.col("label.key") == F.col("k")) & (step["part"] == up["part"]), "left").select("key", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = stored(jump, "labels")
        if new.filter(F.col("label") < F.col("old")).isEmpty():
            return new.select("key", F.col("label.id").alias("least"), F.col("label.key").alias("head"))
        now = new.select("key", "label")


def extended(nodes: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    """As components of all edges, those behind `found` and further ones: components meet as their heads, so no link is followed twice."""
    heads = found.select("key", "head")
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(heads.withColumnRenamed("key", end), end, "left").withColumn(end, F.coalesce("head", end)).drop("head")
    across = stored(ends.filter("a <> b").distinct(), "across")
    if across.isEmpty():
        return found
    now = components(nodes, across).select(F.col("key").alias("head"), F.col("least").alias("to"), F.col("head").alias("to_head"))
    # the members of a large component share its head
    old = salted_join(found, now, "head", "key", "left").select("key", F.coalesce("to", "least").alias("least"), F.coalesce("to_head", "head").alias("head"))
    new = now.select(F.col("head").alias("key"), F.col("to").alias("least"), F.col("to_head").alias("head")).join(heads.select("key"), "key", "left_anti")
    return stored(old.union(new), "labels")


def named(rows: DataFrame, groups: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """doc_id, key, component_id of every row (doc_id, key). groups: key, id, n; found: as from components."""
    named = groups.join(found, "key", "left").select("key", F.coalesce("least", "id").alias("least"))
    # A key with more than a hundredth of the rows is joined in 64 parts; there are under 100 of them.
    hot = [r["key"] for r in groups.filter(F.col("n") > max(1000, total // 100)).select("key").collect()]
    salted = F.col("key").isin(hot) if hot else F.lit(False)
    rows = rows.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("doc_id"), F.lit(64))).otherwise(F.lit(0)).cast("int"))
    many = F.when(salted, F.lit(63)).otherwise(F.lit(0))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), many)))
    return rows.join(named, ["key", "salt"]).select("doc_id", "key", F.when(F.col("least") < _LAST, F.col("least")).alias("component_id"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id of every row."""
    spark = docs.sparkSession
    rows = stored(fingerprints(docs, {"doc_id": F.col(doc_id)}, text), "fingerprints")
    groups = stored(rows.groupBy(F.col("fp").alias("key")).agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).alias("id"), F.count("*").alias("n")), "groups")
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    fps = groups.select(F.col("key").alias("fp"))
    found = components(groups.select("key", "id"), links(fps, n))
    return named(rows.withColumnRenamed("fp", "key"), groups, found, total).withColumnRenamed("key", "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least doc_id; rows with a null doc_id stay.

    Components are those of jaccard.classes (five-word shingles, similarity of 0.8 or more), not op8's.
    The ids that go have no bound, so they are merged with the documents at every size.
    """
    from . import jaccard

    ids = stored(jaccard.classes(docs), "classes")
    gone = ids.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    again = ids.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count().filter("count > 1").select("doc_id")
    every = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(every)
    once = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return docs.join(gone.union(again).hint("merge"), "doc_id", "left_anti").select(every).unionByName(once.select(every))
