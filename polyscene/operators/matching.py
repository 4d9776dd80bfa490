"""The best matches of evidence in its sample, counted from an inverted index instead of over all pairs of token lists.

A sample is cut into blocks of some BLOCK rows and TOKENS tokens, and every two of its blocks (and each with itself)
meet in one group, so a sample with a large share of all rows is many groups of bounded size; most samples are one
block. In a group, tokens point to the rows that have them: tokens of few rows add to their pairs' counts one by one,
tokens of many rows by a product of 0-1 matrices; both for a stripe of rows and a bounded number of tokens at a time.
Of each row and other modality only the best match of a stripe leaves the group, so what is shuffled after grows with
rows and blocks, not with pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.store import shipped

#: Rows and tokens of a block on average, rows of a stripe, pairs that are counted at once, and tokens of a matrix.
BLOCK, TOKENS, STRIPE, PAIRS, WIDE = 4096, 1 << 22, 1024, 1 << 21, 2048


def shared(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int, m: int) -> np.ndarray:
    """How many tokens each two rows share. left, right: rows and tokens, a pair a token of a row, by token; n, m rows."""
    out = np.zeros(n * m, np.float64)
    tokens = np.intersect1d(left[1], right[1])  # in order, each once
    (la, lb), (ra, rb) = ([np.searchsorted(x[1], tokens, side) for side in ("left", "right")] for x in (left, right))
    many = (lb - la) * (rb - ra)
    often = many * 64 > n * m
    for k in range(0, int(often.sum()), WIDE):
        at = np.flatnonzero(often)[k : k + WIDE]
        sides = []
        for (rows, _), a, b, size in ((left, la[at], lb[at], n), (right, ra[at], rb[at], m)):
            own = np.zeros((size, len(at)), np.float32)
            length = b - a
            take = np.repeat(a - (np.cumsum(length) - length), length) + np.arange(length.sum())
            own[rows[take], np.repeat(np.arange(len(at)), length)] = 1
            sides.append(own)
        out += (sides[0] @ sides[1].T).ravel()
    at = np.flatnonzero(~often)
    for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(many[at]) // PAIRS)) + 1):
        size = many[part]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(rb[part] - ra[part], size)
        i = left[0][np.repeat(la[part], size) + k // np.maximum(wide, 1)]
        j = right[0][np.repeat(ra[part], size) + k % np.maximum(wide, 1)]
        out += np.bincount(i * m + j, minlength=n * m)
    return out.reshape(n, m)


class Side:
    """Rows of one block: what they are, and their tokens' rows."""

    def __init__(self, batch: pa.RecordBatch):
        self.modality = np.array(batch.column("modality").to_pylist(), object)
        lists = batch.column("tokens")
        self.size = np.array(lists.value_lengths().fill_null(0), np.int64)
        token, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(token, kind="stable")
        self.index = row[order], token[order]

    def __len__(self) -> int:
        return len(self.size)


def best(score: np.ndarray, left: Side, right: Side) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left and the first of right that scores best, of each modality but the row's own; no scores of 0."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for m in sorted({x for x in right.modality if x is not None}):
        of, rows = np.flatnonzero(right.modality == m), np.flatnonzero(left.modality != m)
        rows = rows[[left.modality[r] is not None for r in rows]] if len(rows) else rows
        if not len(of) or not len(rows):
            continue
        own = score[np.ix_(rows, of)]
        at = own.argmax(axis=1)
        there = own[np.arange(len(rows)), at] > 0
        out.append((rows[there], of[at[there]]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def found(left: pa.RecordBatch, right: pa.RecordBatch | None):
    """Arrow columns of the best matches of a group, stripe by stripe; right is null if the block meets itself."""
    other = left if right is None else right
    b = Side(other)
    for at in range(0, len(left), STRIPE):
        stripe = left.slice(at, STRIPE)
        a = Side(stripe)
        count = shared(a.index, b.index, len(a), len(b))
        whole = a.size[:, None] + b.size[None, :] - count
        score = np.divide(count, whole, out=np.zeros_like(count), where=whole > 0)
        for mine, theirs, s, x, y in [(stripe, other, score, a, b), *([] if right is None else [(other, stripe, score.T, b, a)])]:
            i, j = best(s, x, y)
            rows, to = pa.array(i), pa.array(j)
            yield [mine.column("sample_id").take(rows), mine.column("evidence_id").take(rows), mine.column("modality").take(rows), theirs.column("evidence_id").take(to), theirs.column("modality").take(to), pa.array(s[i, j], pa.float64())]


def best_pairs(evidence: DataFrame) -> DataFrame:
    """The best other of each evidence and modality in its sample by the Jaccard score of tokens: the rows that matter of
    support.pairs, with its columns, for evidence without vectors. The smaller id wins ties; scores of 0 match nothing.

    evidence: sample_id, evidence_id, modality, tokens. Rows without a sample or a modality match nothing.
    """
    shipped(evidence.sparkSession)
    rows = evidence.select("sample_id", "evidence_id", "modality", text.token_keys(F.col("tokens")).alias("tokens")).filter("sample_id is not null")
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("tokens")) / TOKENS))
    large = rows.groupBy("sample_id").agg(size.cast("int").alias("_blocks")).filter("_blocks > 1")
    rows = rows.join(large, "sample_id", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_block", F.pmod(F.xxhash64("evidence_id"), F.col("_blocks")).cast("int"))
    # a row goes to the groups of its block with every block; the lower number comes first
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("sample_id", "evidence_id", "modality", "tokens", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), (F.col("_block") > F.col("_other")).alias("_second"))
    met = rows.repartition("sample_id", "_low", "_high").sortWithinPartitions("sample_id", "_low", "_high", "_second", "evidence_id")
    kind = lambda c: rows.schema[c].dataType
    names = ["sample_id", "evidence_id", "modality", "other_evidence_id", "other_modality", "score"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [kind("sample_id"), kind("evidence_id"), kind("modality"), kind("evidence_id"), kind("modality"), T.DoubleType()], strict=True)])

    def groups(batches):
        """Rows of one group, which may stand in several batches."""
        held, key = [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("sample_id", "_low", "_high")), strict=True))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if s == e:
                    continue
                if keys[s] != key and held:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                key = keys[s]
                held.append(b.slice(s, e - s))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        for group in groups(batches):
            whole = group.to_batches()[0]
            second = int(np.count_nonzero(whole.column("_second").to_numpy(zero_copy_only=False)))
            same = whole.column("_low")[0].as_py() == whole.column("_high")[0].as_py()
            if not same and second in (0, len(whole)):
                continue  # one of the blocks has no rows
            split = len(whole) - second
            for columns in found(whole if same else whole.slice(0, split), None if same else whole.slice(split)):
                yield pa.RecordBatch.from_arrays(columns, names)

    out = met.mapInArrow(run, schema)
    order = F.struct((-F.col("score")).alias("far"), "other_evidence_id")
    out = out.groupBy("sample_id", "evidence_id", "modality", "other_modality").agg(F.min_by(F.struct("other_evidence_id", "score"), order).alias("b"))
    score = F.col("b.score")
    return out.select("sample_id", "evidence_id", "modality", "b.other_evidence_id", "other_modality", score.alias("score"), score.alias("lexical"), F.lit(None).cast("double").alias("cosine"), F.lit(0.0).alias("semantic"))
