"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; all rows of the training fold, whatever their
label, are the unlabelled set. A linear model on the presence of words minimises

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))

whose second part, an estimate of the risk on clean text, is kept from going
negative: while it does, the step goes the other way. The prior is the share of
toxic rows among all labelled rows of the training fold. Scores are then scaled
to probabilities on labelled training rows.

Features are words and word beginnings, each that stands once, twice or four times in a
text. Those that positives hold surely more often than WARM unlabelled rows are counted
over all training texts, and kept if that holds there too; there is no limit to their
number. The weights start from a fit on the WARM rows; then PASSES over all rows follow:
each task sums its rows' part of risk and gradient, and the sums alone reach the driver.

The bounded samples are of labelled rows, POSITIVES and LABELLED of them, and of the
warm start; all are drawn by a hash of doc_id.

Defined results: null and empty texts have no words and get the score of no words;
several labels of a document count as toxic if one is; without a toxic training row
all scores are 0; repeated rows count, and are scored, each; equal z-scores order
features by name. A null doc_id counts as a training row without a label.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, fresh, held_out, map_texts, released, ship, stored, texts_of

#: Labelled rows that the model is fitted and scaled on: toxic and clean; and unlabelled rows of the warm start.
POSITIVES, LABELLED, WARM = 3000, 6000, 6000
#: Least z-score of a feature, and positives that hold it at least.
LEAST_Z, LEAST_P = 3.5, 3
#: Features held in a counting task before they are handed on.
HELD = 500_000
#: Lengths of word beginnings, in characters, and the counts that make features of their own.
BEGINNINGS, COUNTS = range(4, 9), (1, 2, 4)
STEPS, RATE, RIDGE = 400, 0.05, 1e-3
#: Passes over all unlabelled rows, and their rate.
PASSES, SLOW = 8, 0.01
THRESHOLD = 0.3


def forms(word: bytes) -> tuple[str, ...]:
    """The word, and its beginnings marked as such."""
    w = word.decode()
    return (w, *(w[:n] + "-" for n in BEGINNINGS if n <= len(w)))


def words_of(text: bytes | None) -> Counter:
    return Counter(text.translate(WORD_TABLE).split()) if text else Counter()


def features(text: bytes | None, shape=forms) -> list[str]:
    """Forms that stand once, twice or four times in a text, as form#count."""
    n: Counter = Counter()
    for w, c in words_of(text).items():
        for f in shape(w):
            n[f] += c
    return [f"{f}#{k}" for f, c in n.items() for k in COUNTS if c >= k]


def _picked(rows: DataFrame, n: int, kind: int) -> DataFrame:
    return rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("kind", F.lit(kind))


def samples(docs: DataFrame, labels: DataFrame, label: str) -> tuple[float, DataFrame | None]:
    """The class prior, and stored texts with their kinds: 0 of the warm start, 1 toxic, 2 labelled clean."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    n, pos = known.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    if not pos:
        return 0.0, None
    train = training(docs)
    ids = _picked(train, WARM, 0).union(_picked(known.filter("y = 1"), POSITIVES, 1)).union(_picked(known.filter("y <> 1"), LABELLED, 2))
    ids = ids.groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))  # bounded by the three limits
    rows = train.join(F.broadcast(ids), "doc_id")
    return pos / n, stored(rows.select("kinds", "text"), "sample")


def training(docs: DataFrame) -> DataFrame:
    """doc_id, text of the training fold."""
    return docs.filter(~held_out()).select("doc_id", F.col("text").cast("string").alias("text"))


def _counted(batches):
    seen: dict[str, list[int]] = {}

    def out():
        rows = list(seen)
        cols = [pa.array(rows, pa.string()), *(pa.array([seen[f][i] for f in rows], pa.int64()) for i in (0, 1))]
        seen.clear()
        return pa.RecordBatch.from_arrays(cols, ["feature", "u", "p"])

    for batch in batches:
        for kinds, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            own = [k for k in kinds if k < 2]
            for f in features(t) if own else ():
                n = seen.setdefault(f, [0, 0])
                for k in own:
                    n[k] += 1
            if len(seen) > HELD:
                yield out()
    yield out()


def candidates(rows: DataFrame, n: int, k: int) -> dict[str, int]:
    """Features that n positives hold surely more often than the k rows of the warm start, with how many positives."""
    sums = rows.mapInArrow(_counted, "feature string, u bigint, p bigint").groupBy("feature").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    a, b, both = F.col("p") / n, F.col("u") / k, (F.col("p") + F.col("u")) / (n + k)
    z = (a - b) / F.sqrt(both * (1 - both) * (1 / n + 1 / k) + 1e-12)
    got = sums.filter(F.col("p") >= LEAST_P).filter(z >= LEAST_Z).orderBy("feature").select("feature", "p").toArrow()
    return dict(zip(got.column("feature").to_pylist(), got.column("p").to_pylist(), strict=True))


def counted(owned: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """In how many rows each feature stands, and how many rows there are. owned: own (feature numbers)."""

    def run(batches):
        sums, n = np.zeros(width, np.int64), 0
        for b in batches:
            rows = Rows(b.column(0), width)
            sums, n = sums + np.bincount(rows.own, minlength=width), n + rows.n
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["sums", "n"])

    got = owned.mapInArrow(run, "sums binary, n bigint").collect()  # a row a task
    return sum((np.frombuffer(r["sums"], np.int64) for r in got), np.zeros(width, np.int64)), sum(r["n"] for r in got)


def surely(p: np.ndarray, n: int, u: np.ndarray, k: int) -> np.ndarray:
    """Which features n positives hold surely more often than k rows."""
    a, b, both = p / n, u / max(1, k), (p + u) / (n + k)
    return (a - b) / np.sqrt(both * (1 - both) * (1 / n + 1 / max(1, k)) + 1e-12) >= LEAST_Z


def _selected(index: dict[str, int]):
    """A function from texts to the numbers of the chosen features in them."""
    stems = {f.rpartition("#")[0] for f in index}
    shape = lru_cache(1 << 17)(lambda w: tuple(f for f in forms(w) if f in stems))
    return lambda t: [index[f] for f in features(t, shape) if f in index]


class Rows:
    """Rows of feature numbers, with a last feature that each row has."""

    def __init__(self, rows: list[list[int]] | pa.ListArray, width: int):
        lists = rows if isinstance(rows, pa.ListArray) else pa.array(rows, pa.list_(pa.int32()))
        self.n, self.width = len(lists), width + 1
        self.at = np.repeat(np.arange(self.n), lists.value_lengths().to_numpy(zero_copy_only=False))
        self.own = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.own], self.n) + w[-1]

    def back(self, v: np.ndarray) -> np.ndarray:
        out = np.bincount(self.own, v[self.at], self.width)
        out[-1] += v.sum()
        return out


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Descent:
    """Adam on the non-negative risk with the logistic loss; the last weight is the bias."""

    def __init__(self, p: Rows, prior: float):
        self.p, self.prior, self.t = p, prior, 0
        self.free = np.ones(p.width)  # 0 for features that stay out
        self.w = np.zeros(p.width)
        self.w[-1] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def step(self, loss: float, grad: np.ndarray, rate: float) -> None:
        """loss, grad: mean over unlabelled rows of the loss of calling them clean, and its gradient."""
        g, ridge = self.p.dot(self.w), np.full(len(self.w), RIDGE)
        ridge[-1] = 0
        clean = loss - self.prior * _soft(g).mean()
        d_clean = grad - self.prior * self.p.back(_sigmoid(g)) / self.p.n
        d_toxic = -self.prior * self.p.back(_sigmoid(-g)) / self.p.n
        d = d_toxic + d_clean + ridge * self.w if clean >= 0 else -d_clean
        d, self.t = d * self.free, self.t + 1
        self.m, self.v = 0.9 * self.m + 0.1 * d, 0.999 * self.v + 0.001 * d**2
        self.w = self.w - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def unlabelled_risk(u: Rows, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over rows of the loss of calling them clean, and of its gradient."""
    g = u.dot(w)
    return float(_soft(g).sum()), u.back(_sigmoid(g))


def nnpu(p: Rows, u: Rows, prior: float, free: np.ndarray | None = None) -> Descent:
    """The warm start: the risk's descent on rows at hand."""
    out = Descent(p, prior)
    if free is not None:
        out.free[:-1] = free
    for _ in range(STEPS):
        loss, grad = unlabelled_risk(u, out.w)
        out.step(loss / u.n, grad / u.n, RATE)
    return out


def passed(owned: DataFrame, descent: Descent) -> None:
    """PASSES steps over all unlabelled rows. owned: own (feature numbers)."""
    sc, width = owned.sparkSession.sparkContext, descent.p.width
    for _ in range(PASSES):
        now = sc.broadcast(descent.w)

        def run(batches):
            loss, grad, n = 0.0, np.zeros(width), 0
            for b in batches:
                rows = Rows(b.column(0), width - 1)
                x, g = unlabelled_risk(rows, now.value)
                loss, grad, n = loss + x, grad + g, n + rows.n
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["loss", "grad", "n"])

        got = owned.mapInArrow(run, "loss double, grad binary, n bigint").collect()  # a row a task
        got.sort(key=lambda r: (r["n"], r["loss"]))
        n = sum(r["n"] for r in got)
        if n:
            descent.step(sum(r["loss"] for r in got) / n, sum(np.frombuffer(r["grad"]) for r in got) / n, SLOW)
        now.unpersist()


def calibrate(g: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a g + b), by Newton's method with a little ridge; a stays positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * g + b)
        r, h = weight * (q - y), weight * q * (1 - q) + 1e-9
        grad = np.array([(r * g).sum() + 1e-4 * (a - 1), r.sum()])
        hess = np.array([[(h * g * g).sum() + 1e-4, (h * g).sum()], [(h * g).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = max(1e-3, a - step[0]), b - step[1]
    return a, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[dict[str, float], float] | None:
    """Weights by feature and the bias, scaled to log odds; None without a toxic training row."""
    ship(docs.sparkSession)
    prior, rows = samples(docs, labels, label)
    if rows is None:
        return None
    n, k = (rows.filter(F.array_contains("kinds", i)).count() for i in (1, 0))
    if not n:
        return None
    found = candidates(rows, n, max(1, k))
    index = {f: j for j, f in enumerate(found)}
    table = docs.sparkSession.sparkContext.broadcast(index)

    def numbered(texts: DataFrame, *keep: str) -> DataFrame:
        def run(batches):
            own = _selected(table.value)
            for b in batches:
                found = pa.array([sorted(own(t)) for t in texts_of(b.column(len(keep)))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], found], [*keep, "own"])
            released()

        return texts.select(*keep, "text").mapInArrow(run, ", ".join([*(f"{k} array<int>" for k in keep), "own array<int>"]))

    by: dict[int, list] = {0: [], 1: [], 2: []}
    for r in numbered(rows, "kinds").toLocalIterator():  # a row a sampled text
        for kind in r["kinds"]:
            by[kind].append(list(r["own"]))
    for own in by.values():
        own.sort()
    p, u, clean = (Rows(by[i], len(index)) for i in (1, 0, 2))
    owned = stored(numbered(training(docs)), "unlabelled")
    free = surely(np.fromiter(found.values(), np.float64, len(found)), n, *counted(owned, len(index)))
    descent = nnpu(p, u if u.n else p, min(max(prior, 1e-6), 1 - 1e-6), free)
    passed(owned, descent)
    w, a, b = descent.w, 1.0, 0.0
    if clean.n:
        g, y = np.concatenate([p.dot(w), clean.dot(w)]), np.concatenate([np.ones(p.n), np.zeros(clean.n)])
        a, b = calibrate(g, y, np.concatenate([np.full(p.n, prior / p.n), np.full(clean.n, (1 - prior) / clean.n)]))
    released()
    return {f: float(a * w[j]) for f, j in index.items() if free[j]}, float(a * w[-1] + b)


def score(docs: DataFrame, model: tuple[dict[str, float], float] | None, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Columns `keep`, then score and predicted."""

    def make():
        if model is None:
            return lambda texts: [[0.0] * len(texts), [0] * len(texts)]
        weights, bias = np.array([*model[0].values()], np.float64), model[1]
        own = _selected({f: j for j, f in enumerate(model[0])})

        def work(texts):
            g = [bias + float(weights[sorted(own(t))].sum()) for t in texts]
            s = _sigmoid(np.array(g, np.float64))
            return [s.tolist(), (s >= THRESHOLD).astype(int).tolist()]

        return work

    return map_texts(docs, keep, [("score", "double", pa.float64()), ("predicted", "int", pa.int32())], make, text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels), {"doc_id": F.col("doc_id"), "held_out": held_out()})


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below THRESHOLD, with all their columns."""
    row = fresh(docs, "_row")[0]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col("text").alias("text"))
    return score(kept, fit(docs, labels), {row: F.col(row)}).filter("predicted = 0").select(f"{row}.*")
