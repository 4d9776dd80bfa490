"""The near-duplicate stage: SimHash links first, then every pair of Jaccard similarity SIMILAR or more.

Texts are reduced to distinct sets of shingle hashes, so groups of exact copies cost one
row. Links come from four sources, each checked by the exact similarity of the two sets:

1. fingerprints of the shingles that op8's vantage-point trees link (4 bits), and sets of
   one fingerprint. At a similarity of 0.8, fingerprints lie about 9 bits apart, so this
   finds the closer copies alone; hence
2. prefixes: in any order of all hashes, two sets of similarity SIMILAR or more share one
   of the first |x| - ceil(SIMILAR |x|) + 1 hashes of each. The sets behind one hash are
   compared with the smallest of them, and each set's two best pairs are checked,
3. a spanning forest of the likely pairs behind one hash that lie in different components,
4. all likely pairs that still do.

So no pair is missed, a large group of near copies takes about a check a member, and the
components are those of all links. Pairs are likely unless their sizes or parities rule
the similarity out: parities of a set on fixed places, and finer ones on six to
twelve times as many places as it has hashes.

Hashes that are common in a bounded sample come last in the order of hashes; this only
balances the work. No group is collected whole: stars are joins, and a hash with many
sets is cut into blocks. Texts are not shuffled: a bitmap of bounded size picks those
whose sets are asked for.

Defined results: null and empty texts are alike, and like no other; a text of fewer
words than a shingle is one shingle; ids as in simhash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, released, slices, stored, texts_of
from .simhash import _LAST, SEED, components, extended, named, shingles, voted
from .simhash import links as tree_links

#: Words in a shingle.
SHINGLE = 5
#: Least similarity of near-duplicates, as a fraction.
SIMILAR = 4, 5
#: Texts to learn common hashes from, characters of each that are read, and sets that make a hash common.
SAMPLE, SAMPLE_CHARS, COMMON = 32_768, 16_384, 3
#: Parities of a set in its groups, and the least number of finer ones.
PLACES, FINE_PLACES = 512, 2048
#: Keys that a task remembers, to leave out repeated prefixes.
MET = 1 << 18
#: Sets in a block of a group, and the binary logarithm of the bits in a bitmap of ids.
BLOCK, BITMAP = 1024, 26


def own_hashes(text: bytes | None) -> tuple[np.ndarray, int]:
    """The distinct shingle hashes of a text, in order, and its fingerprint, in which repeats count."""
    every = shingles(text, SHINGLE)
    return np.unique(every), voted(every)


def key_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def _spread(own: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
    """token, key: a row for each hash of each set."""
    token = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(np.array(keys, np.int64), [len(x) for x in own]))], ["token", "key"])


def common(docs: DataFrame, text: str) -> np.ndarray:
    """The hashes that are common in a sample of the sets, in order; Spark counts them."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    few = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    few = few.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct().limit(2 * SAMPLE)

    def run(batches):
        for b in batches:
            own = [own_hashes(t)[0] for t in texts_of(b.column(0))]
            yield _spread(own, [key_of(x) for x in own])

    rows = few.mapInArrow(run, "token bigint, key bigint")
    # of texts that differ in their blanks or case alone, one counts
    counts = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).filter((F.col("n") >= COMMON) & (F.col("a") < F.col("b")))
    return np.sort(counts.select("token").toArrow().column(0).to_numpy().view(np.uint64))


def prefix(own: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first hashes of a set, the late ones coming last: near-duplicates share one."""
    if not len(own):
        return own
    if len(late):
        at = np.minimum(np.searchsorted(late, own), len(late) - 1)
        own = own[np.argsort(late[at] == own, kind="stable")]
    return own[: len(own) + (-SIMILAR[0] * len(own) // SIMILAR[1]) + 1]


def parities(own: np.ndarray, places: int) -> np.ndarray:
    """Bit i: whether an odd number of hashes leave i on division by places (a power of two)."""
    return np.packbits(np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1 > 0)


def fine(own: np.ndarray) -> bytes:
    """Parities on six to twelve times as many places as the set has hashes."""
    return parities(own, max(FINE_PLACES, 1 << int(6 * len(own)).bit_length())).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many hashes two sets differ at least; the longer parities are folded to the length of the shorter."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) if len(b) > len(a) else b
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def reduced(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, key, fp, size, odd, fine, first: a hash of each text's set, its fingerprint, size, parities and prefix.

    first and fine are null where the task has met the key before.
    """
    last = docs.sparkSession.sparkContext.broadcast(common(docs, text))

    def make():
        late, met = last.value, set()

        def work(texts):
            sets, fps = zip(*(own_hashes(t) for t in texts), strict=True) if texts else ((), ())
            keys, first, finer = [key_of(x) for x in sets], [], []
            for k, x in zip(keys, sets, strict=True):
                first.append(None if k in met else prefix(x, late).tobytes())
                finer.append(None if k in met else fine(x))
                met.add(k)
            if len(met) > MET:
                met.clear()
            odd = [parities(x, PLACES).tobytes() for x in sets]
            return [keys, np.array(fps, np.uint64).view(np.int64), [len(x) for x in sets], odd, finer, first]

        return work

    fields = [("key", "bigint", pa.int64()), ("fp", "bigint", pa.int64()), ("size", "int", pa.int32())]
    fields += [(c, "binary", pa.binary()) for c in ("odd", "fine", "first")]
    return map_texts(docs, {"doc_id": F.col(doc_id)}, fields, make, text)


def tokens(rows: DataFrame) -> DataFrame:
    """token, key: a row for each hash of the prefix of each different set."""

    def run(batches):
        for b in batches:
            if len(b):
                yield _spread([np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()], b.column(0).to_pylist())

    once = rows.filter(F.col("first").isNotNull()).groupBy("key").agg(F.first("first").alias("first"))
    return once.mapInArrow(run, "token bigint, key bigint").repartition("token")


def sharing(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, key, size, odd: the sets behind each shared hash; of hashes with the same sets one is kept."""
    every = tokens(rows)
    sign = [F.bit_xor(F.xxhash64("key")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("t")]
    groups = every.groupBy("token").agg(F.count("*").alias("n"), *sign).filter("n > 1")
    kept = groups.groupBy("n", "s", "t").agg(F.min("token").alias("token")).select("token")
    flat = stored(every.join(kept.hint("shuffle_hash"), "token").select(F.col("token").alias("id"), "key"), "sharing")
    return stored(flat.join(nodes.select("key", "size", "odd"), "key"), "sharing")


def bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Bits that are set for hashes of the ids, 1 << BITMAP at most, and their number. ids: id."""
    bits = 1 << min(BITMAP, max(6, int(32 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("x")).toArrow()
    held = np.zeros(bits >> 6, np.int64)
    held[words.column("w").to_numpy().astype(np.int64)] = words.column("x").to_numpy()
    return held, bits


def sets(docs: DataFrame, seen: DataFrame, text: str, doc_id: str) -> DataFrame:
    """key, own: the sets of `seen` (key, id), from the texts that have these ids; ids that rows repeat are told apart by key.

    A bitmap of the ids picks these texts and a few others, which go by their key; so texts are not shuffled.
    """
    held, bits = bitmap(seen.select("id").distinct())
    mask = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        held = mask.value
        for b in batches:
            at = b.column(1).to_numpy()
            few = b.column(0).filter(pa.array((held[at >> 6] >> (at & 63)) & 1 > 0))
            for i, j in slices(pc.fill_null(pc.binary_length(few), 0).to_pylist()):
                own = [own_hashes(t)[0] for t in texts_of(few.slice(i, j - i))]
                yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["key", "own"])
        released()

    slot = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))), F.lit(bits))
    out = docs.select(F.col(text).cast("string").alias("text"), slot.alias("slot")).mapInArrow(run, "key bigint, own binary")
    return out.join(seen.select("key").hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"])


def _enough(both, x, y):
    return SIMILAR[1] * both >= SIMILAR[0] * (x + y - both)


def likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """a, b, far: the pairs of known sets that their fine parities don't rule out, and in how many hashes they differ at least."""

    def run(batches):
        for b in batches:
            x, y, p, q = (b.column(i).to_pylist() for i in range(2, 6))
            far = np.array([differing(*z) for z in zip(p, q, strict=True)], np.int64)
            x, y = np.array(x, np.int64), np.array(y, np.int64)
            keep = pa.array(_enough(np.minimum(np.minimum(x, y), (x + y - far) // 2), x, y), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(far).filter(keep)], ["a", "b", "far"])

    x = known.select(F.col("key").alias("a"), F.col("size").alias("x"), F.col("fine").alias("p"))
    y = known.select(F.col("key").alias("b"), F.col("size").alias("y"), F.col("fine").alias("q"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "p", "q").mapInArrow(run, "a bigint, b bigint, far bigint")


def alike(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar enough."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(bool(_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = held.select(F.col("key").alias("a"), F.col("own").alias("x"))
    y = held.select(F.col("key").alias("b"), F.col("own").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def best(found: DataFrame) -> DataFrame:
    """Of each set's likely pairs the one that differs least and the one with the least partner."""
    ends = found.select(F.explode(F.array(*[F.struct(F.col(x).alias("key"), F.col(y).alias("other"), "far") for x, y in ("ab", "ba")])).alias("e")).select("e.*")
    two = ends.groupBy("key").agg(F.array(F.min(F.struct("far", "other"))["other"], F.min("other")).alias("others"))
    other = two.select("key", F.explode("others").alias("other"))
    return other.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def _may(size, part, odd, i_size, i_part, i_odd) -> np.ndarray:
    """Which sets may be similar to another in a different component, by sizes and parities."""
    # |x & y| is at most the smaller size, and half of what the sizes leave after the differences
    apart = np.bitwise_count(odd ^ i_odd).sum(1, dtype=np.int64)
    both = np.minimum(np.minimum(size, i_size), (size + i_size - apart) // 2)
    return (part != i_part) & _enough(both, size, i_size)


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).view(np.uint64)


def _spokes(batches):
    for b in batches:
        if not len(b):
            continue
        key, size, part, odd, key2, size2, part2, odd2 = (b.column(i) if i % 4 == 3 else b.column(i).to_numpy().astype(np.int64) for i in range(8))
        use = _may(size, part, _bits(odd), size2, part2, _bits(odd2))
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(f(key[use], key2[use])) for f in (np.minimum, np.maximum)], ["a", "b"])


def stars(flat: DataFrame) -> DataFrame:
    """a, b: in every group, each set with the smallest one."""
    four = ["key", "size", "part", "odd"]
    hub = F.min(F.struct("size", *[F.col(c).alias(f"hub_{c}") for c in four])).alias("hub")
    hubs = flat.groupBy("id").agg(hub, F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
    both = flat.join(hubs.select("id", *[f"hub.hub_{c}" for c in four]), "id").filter("part <> hub_part")
    return both.select(*four, *[f"hub_{c}" for c in four]).mapInArrow(_spokes, "a bigint, b bigint").distinct()


def _met(batches):
    """The groups of batches sorted by id, x, y: whether two blocks meet, then size, key, part, block, odd and fine of the members.

    A group may stand in several batches; one is held at a time.
    """
    held, now = [], None

    def group():
        return now[1] != now[2], *(np.concatenate(c) for c in list(zip(*held))[:-1]), [f for piece in held for f in piece[-1]]

    for batch in batches:
        if not len(batch):
            continue
        names = batch.column("id"), batch.column("x"), batch.column("y")
        names = np.stack([c.to_numpy() for c in names])
        columns = [batch.column(c).to_numpy().astype(np.int64) for c in ("size", "key", "part", "block")]
        columns += [_bits(batch.column("odd")), batch.column("fine").to_pylist()]
        breaks = (np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist()
        for i, j in zip([0, *breaks], [*breaks, len(batch)], strict=True):
            own = tuple(names[:, i].tolist())
            if own != now and held:
                yield group()
                held = []
            now = own
            held.append([c[i:j] for c in columns])
    if held:
        yield group()


def _blocks(forest: bool):
    """Likely pairs of sets in a block of a group, or between two blocks; or a spanning forest of them."""

    def pairs(two, size, key, part, block, odd, finer):
        for i in range(len(key)):
            use = _may(size, part, odd, size[i], part[i], odd[i])
            use[: i + 1] = False
            if two:
                use &= block != block[i]
            for j in np.flatnonzero(use).tolist():
                if forest and part[j] == part[i]:
                    continue
                far = differing(finer[i], finer[j])
                if _enough(min(size[i], size[j], (size[i] + size[j] - far) // 2), size[i], size[j]):
                    yield min(key[i], key[j]), max(key[i], key[j])
                    if forest:
                        part[part == part[j]] = part[i]

    def run(batches):
        held = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*held)], ["a", "b"])

        for group in _met(batches):
            for pair in pairs(*group):
                held.append(pair)
                if len(held) == 1 << 16:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def every(flat: DataFrame, known: DataFrame, forest: bool) -> DataFrame:
    """a, b: likely pairs, or a spanning forest of them, within groups that lie in several components; a group of many sets is cut into blocks of about BLOCK.

    Members go to Python row by row, sorted by group: lists of them would make Arrow batches of any size.
    """
    groups = flat.groupBy("id").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
    rows = flat.join(groups.select("id", F.ceil(F.col("n") / BLOCK).alias("blocks")), "id").join(known.select("key", "fine"), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("id", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "size", "key", "part", "block", "odd", "fine")
    met = rows.repartition("id", "x", "y").sortWithinPartitions("id", "x", "y", "key")
    return met.mapInArrow(_blocks(forest), "a bigint, b bigint").distinct()


def close(nodes: DataFrame) -> DataFrame:
    """a, b: pairs of sets whose fingerprints the vantage-point trees link, and of those with one fingerprint."""
    heads = nodes.groupBy("fp").agg(F.min("key").alias("head"))
    same = nodes.join(heads, "fp").filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    fps = stored(heads, "heads")
    found = tree_links(fps.select("fp"), fps.count())
    x, y = (fps.select(F.col("fp").alias(k), F.col("head").alias(h)) for k, h in (("a", "x"), ("b", "y")))
    across = found.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(across)


def linked(docs: DataFrame, flat: DataFrame, known: DataFrame, nodes: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Components of all similar sets, as from simhash.components. flat: id of a group, key, size, odd; known: key, size, fine of those; nodes: key, id, fp.

    Each step's links only extend the components of the step before.
    """
    own, found = nodes.select("key", "id"), None
    for step in range(3):
        now = flat.withColumn("part", F.col("key"))
        if found is not None:
            now = flat.join(found.select("key", F.col("head").alias("part")), "key", "left").withColumn("part", F.coalesce("part", "key"))
        pairs = (lambda: stars(now), lambda: every(now, known, True), lambda: every(now, known, False))[step]()
        if step == 0:
            pairs = best(likely(pairs, known)).union(likely(close(nodes), known).select("a", "b")).distinct()
        pairs = stored(pairs.select("a", "b"), "pairs")
        seen = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        seen = stored(nodes.select("key", "id").join(seen, "key"), "seen")
        new = stored(alike(pairs, stored(sets(docs, seen, text, doc_id), "held")), "alike")
        found = components(own, new) if found is None else extended(own, found, new)
    return found


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, component_id of every row."""
    rows = stored(reduced(docs, text, doc_id), "reduced")
    least = F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).alias("id")
    nodes = stored(rows.groupBy("key").agg(least, F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("fp", "size", "odd")]), "nodes")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    flat = sharing(rows, nodes)
    finer = rows.filter(F.col("fine").isNotNull()).select("key", "size", "fine")
    known = stored(finer.join(flat.select("key").distinct().hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"]), "known")
    found = linked(docs, flat, known, nodes, text, doc_id)
    return named(rows.select("doc_id", "key"), nodes, found, total).select("doc_id", "component_id")
