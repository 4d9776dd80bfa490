"""Maximum inner product search with score-aware (anisotropic) quantisation.

A quantiser splits vectors into pairs of dimensions with 16 centres each (four bits).
Its loss weighs the part of the residual along the vector more than the part across
it, as only the first moves large inner products; codes and centres are found by
coordinate descent on that loss. A query's table has its inner products with all
centres; scanning adds up table entries by code, two codes at a byte. The best RERANK
of each block are scored again on the original vectors in double precision; then so is
every other row that may be among the nearest: a table sum is off by at most the query's
length times that of the row's residual, so a row goes only if its sum with that bound
stays below the nearest found so far. Nothing is cut off by number, and dense groups of
near-equal vectors are scored whole; what is found is exact.

The quantiser is fitted on SAMPLE vectors; every vector is indexed. Equal vectors are
one index row with their smallest ids, as many as can be asked for, so copies cost
nothing and ties are exact. Queries are broadcast in blocks of about QUERIES.

Defined results: rows with a null id or vector, a null or non-finite component, or only
zeros take no part; nor do vectors whose length is not the most common one (the
smaller of two equally common). Repeated rows are one candidate; a query id with
several vectors uses the first in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

NEAREST, EVERY = 20, 20
#: Vectors that the quantiser is fitted on; vectors in an index block; queries in a broadcast.
SAMPLE, BLOCK, QUERIES = 8192, 4096, 4096
#: Vectors of a block that are scored exactly first, to know what the others must reach.
RERANK = 96
#: Inner products from this share of the norms on matter; sets the weight of the parallel part.
THRESHOLD = 0.2
ROUNDS = 6


def loss_ratio(d: int) -> float:
    """Weight of the parallel against the orthogonal residual."""
    t = THRESHOLD**2
    return max(1.0, (d - 1) * t / (1 - t))


class Quantiser:
    """centres: (subspaces, 16, 2)."""

    def __init__(self, centres: np.ndarray, d: int):
        self.centres, self.d = centres, d

    @staticmethod
    def halves(x: np.ndarray) -> np.ndarray:
        """(n, d) as (n, subspaces, 2), with a zero dimension if d is odd and a zero pair for an even number of pairs."""
        n, d = x.shape
        out = np.zeros((n, -(-d // 4) * 4))
        out[:, :d] = x
        return out.reshape(n, out.shape[1] // 2, 2)

    @classmethod
    def fit(cls, x: np.ndarray) -> Quantiser:
        n, d = x.shape
        parts = cls.halves(x)
        rng = np.random.default_rng(7)
        m = parts.shape[1]
        centres = np.zeros((m, 16, 2))
        for s in range(m):
            c = parts[rng.choice(n, 16, replace=n < 16), s]
            for _ in range(8):
                near = ((parts[:, s, None] - c[None]) ** 2).sum(-1).argmin(1)
                for j in range(16):
                    if (own := near == j).any():
                        c[j] = parts[own, s].mean(0)
            centres[s] = c
        q = cls(centres, d)
        unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
        extra = loss_ratio(d) - 1
        for _ in range(ROUNDS):
            codes = q.encode(x, 1)
            rest = parts - centres[np.arange(m), codes]
            along = (rest * unit).sum(-1)  # each subspace's share of the parallel residual
            total = along.sum(1)
            for s in range(m):
                p = total - along[:, s]
                u = unit[:, s]
                a = np.eye(2)[None] + extra * u[:, :, None] * u[:, None]
                b = parts[:, s] + extra * u * (p + (parts[:, s] * u).sum(-1))[:, None]
                for j in range(16):
                    if (own := codes[:, s] == j).any():
                        centres[s, j] = np.linalg.solve(a[own].sum(0) + 1e-9 * np.eye(2), b[own].sum(0))
                along[:, s] = ((parts[:, s] - centres[s, codes[:, s]]) * u).sum(-1)
                total = p + along[:, s]
        return q

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """(n, subspaces) codes, by coordinate descent on the anisotropic loss."""
        parts = self.halves(x)
        n, m, _ = parts.shape
        unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
        extra = loss_ratio(self.d) - 1
        codes = np.zeros((n, m), np.uint8)
        along = np.zeros((n, m))
        for s in range(m):
            gap = parts[:, s, None] - self.centres[s][None]
            codes[:, s] = (gap**2).sum(-1).argmin(1)
            along[:, s] = (gap[np.arange(n), codes[:, s]] * unit[:, s]).sum(-1)
        total = along.sum(1)
        for _ in range(passes):
            for s in range(m):
                gap = parts[:, s, None] - self.centres[s][None]
                par = (gap * unit[:, s, None]).sum(-1)
                p = (total - along[:, s])[:, None]
                codes[:, s] = ((gap**2).sum(-1) + extra * (p + par) ** 2).argmin(1)
                along[:, s] = par[np.arange(n), codes[:, s]]
                total = p[:, 0] + along[:, s]
        return codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): inner products with the centres of two subspaces at a time."""
        t = np.einsum("qsk,sck->scq", self.halves(q), self.centres).astype(np.float32)
        return (t[0::2, None, :] + t[1::2, :, None]).reshape(t.shape[0] // 2, 256, -1)


def packed(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, vec (array of doubles) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (common["d"] if common else 0))


def _block(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return (column.flatten().to_numpy() + 0.0).reshape(len(column), -1)


def grouped(rows: DataFrame, most: int) -> DataFrame:
    """vec (bytes), ids: each different vector with its smallest ids."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _block(b.column(1)), b.column(0).to_numpy()
            keys = [v.tobytes() for v in x]
            by: dict[bytes, set] = {}
            for k, i in zip(keys, ids.tolist(), strict=True):
                by.setdefault(k, set()).add(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.binary()), pa.array([sorted(v)[:most] for v in by.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    parts = rows.select("id", "vec").mapInArrow(run, "vec binary, ids array<bigint>")
    halfway = parts.groupBy("vec", F.spark_partition_id().alias("part")).agg(least)
    return halfway.groupBy("vec").agg(least)


def indexed(rows: DataFrame, model, d: int) -> DataFrame:
    """n, vecs, codes, ids, ends, rests: blocks of up to BLOCK different vectors; rests are the lengths of their residuals."""
    most = BLOCK

    def run(batches):
        held: list[tuple[bytes, list[int]]] = []

        def out():
            x = np.frombuffer(b"".join(v for v, _ in held)).reshape(-1, d)
            q = model.value
            plain = q.encode(x)
            rest = np.linalg.norm((q.halves(x) - q.centres[np.arange(plain.shape[1]), plain]).reshape(len(x), -1), axis=1)
            ids = np.array([i for _, own in held for i in own], np.int64)
            ends = np.cumsum([len(own) for _, own in held]).astype(np.int64)
            cols = [pa.array([len(held)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (x, np.ascontiguousarray(packed(plain).T), ids, ends, rest))]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["n", "vecs", "codes", "ids", "ends", "rests"])

        for b in batches:
            for v, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((v, own))
                if len(held) == most:
                    yield out()
        if held:
            yield out()

    return rows.mapInArrow(run, "n int, vecs binary, codes binary, ids binary, ends binary, rests binary")


def scanned(x: np.ndarray, codes: np.ndarray, rests: np.ndarray, q: np.ndarray, tables: np.ndarray, rerank: int, nearest: int, reached) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the rows that may be among its nearest, and their exact inner products. reached(i): a score that query i has `nearest` times already."""
    sizes = np.linalg.norm(q, axis=1)
    slack = 1e-5 * (1 + np.linalg.norm(x, axis=1).max(initial=0.0))  # of single-precision sums
    for a in range(0, len(q), 64):
        t = tables[:, :, a : a + 64]
        s = np.zeros((len(x), t.shape[2]), np.float32)
        for table, code in zip(t, codes, strict=True):
            s += table[code]
        s = np.ascontiguousarray(s.T)
        k = min(rerank, len(x))
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(len(x)), (len(s), 1))
        for i, rows in enumerate(best):
            own = q[a + i]
            score = x[rows] @ own
            if k < len(x):
                least = np.partition(score, len(score) - nearest)[len(score) - nearest] if len(score) >= nearest else -np.inf
                may = s[i] + sizes[a + i] * (rests + slack) >= max(least, reached(a + i))
                may[rows] = False
                more = np.flatnonzero(may)
                rows, score = np.concatenate([rows, more]), np.concatenate([score, x[more] @ own])
            yield a + i, rows, score


def searched(index: DataFrame, model, queries, d: int, nearest: int, rerank: int) -> DataFrame:
    """query_id, found (array of far = -score, vec_id): each task's nearest."""

    def run(batches):
        qids, q = queries.value
        tables = model.value.tables(q)
        best: list[list[tuple[float, int]]] = [[] for _ in qids]
        any_ = False
        for batch in batches:
            for n, vecs, codes, ids, ends, rests in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                any_ = True
                x, code = np.frombuffer(vecs).reshape(n, d), np.frombuffer(codes, np.uint8).reshape(-1, n)
                ids, ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                reached = lambda i: -best[i][-1][0] if len(best[i]) == nearest else -np.inf
                for i, rows, score in scanned(x, code, np.frombuffer(rests), q, tables, rerank, nearest + 1, reached):
                    top = np.lexsort([ids[starts[rows]], -score])[: nearest + 1]
                    own, far = best[i], -score[top]
                    if len(own) == nearest and far[0] > own[-1][0]:
                        continue
                    for f, r in zip(far.tolist(), rows[top].tolist(), strict=True):
                        own += [(f, v) for v in ids[starts[r] : ends[r]].tolist() if v != qids[i]]
                    best[i] = sorted(own)[:nearest]
        if any_:
            kind = pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))
            for a in range(0, len(qids), 1024):
                found = [[{"far": f, "vec_id": v} for f, v in x] for x in best[a : a + 1024]]
                yield pa.RecordBatch.from_arrays([pa.array(qids[a : a + 1024], pa.int64()), pa.array(found, kind)], ["query_id", "found"])

    return index.mapInArrow(run, "query_id bigint, found array<struct<far:double,vec_id:bigint>>")


def search(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", nearest: int = NEAREST, every: int = EVERY, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query, largest inner product first."""
    spark = vectors.sparkSession
    ship(spark)
    sc = spark.sparkContext
    rows = stored(usable(vectors, vec_id, embedding), "vectors")
    sample = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).select("vec").toPandas()["vec"]
    d = len(sample.iloc[0]) if len(sample) else 1
    x = np.array([np.asarray(v) for v in sample]) if len(sample) else np.ones((1, 1))
    model = sc.broadcast(Quantiser.fit(x))
    index = stored(indexed(grouped(rows, nearest + 1), model, d), "index")
    asked = stored(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    parts = []
    for k in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id").toPandas()
        if len(got) or not parts:
            q = np.array([np.asarray(v) for v in got["vec"]]) if len(got) else np.zeros((0, d))
            queries = sc.broadcast((got["id"].tolist(), q))
            found = searched(index, model, queries, d, nearest, rerank).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, nearest).alias("found"))  # one array a task
            parts.append(stored(found, "found") if blocks > 1 else found)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.select("query_id", F.posexplode("found").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
