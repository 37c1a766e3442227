"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document's severity grade y is 0 .. GRADES - 1. One weight vector is shared
by all thresholds: P(y > k) = sigmoid(w . x - t_k) with t_0 < t_1 < ...; the
thresholds' order is kept by fitting the logarithms of their distances. The
output is the expected severity, the sum of P(y > k) over k. A document is
rejected when P(y > 0) is at least REJECT.

The labels say only whether a document is toxic. The grade of a toxic document
of the sample is the tercile of its log odds under a scorer that was fitted
without it: the sample is halved by hash, and each half is scored by the other
half's model.

Features are words and, of words longer than STEM, the character n-gram they
begin with: all that two documents of the sample have, hashed, as
log(1 + count). Weights have both signs; an L1 term sets those to zero that
tell nothing, so the model is sparse without a limit on the number of words.
The model is fitted on at most TRAIN_TOXIC toxic and TRAIN_CLEAN clean labelled documents; each row is
weighted by its class's share, so that probabilities hold for the whole.
Prediction reads every word of every text.

Defined results: null and empty texts score as no words; documents without a
label are scored like others; without labels of both kinds nothing is
rejected; rows that share a doc_id are scored one by one, and in the sample
each counts; columns of any name are kept as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.common import documents, fresh, map_arrow
from groundline.llm.samples import smallest_hashes

GRADES = 4
BUCKETS = 1 << 31
STEM = 5
TRAIN_TOXIC = 3000
TRAIN_CLEAN = 6000
REJECT = 0.5
STEPS = 150
#: The L1 penalty is this over the square root of the rows, as the noise of the gradient is.
L1 = 0.027
L2 = 1e-5
CACHE = 400_000
_SPACES = {i: " " for i in range(128) if not chr(i).isalnum()}


def words(text: str) -> list[str]:
    return text.lower().translate(_SPACES).split()


def bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & (BUCKETS - 1)


def named(word: str) -> list[int]:
    """The features of a word: itself, and its first characters."""
    return [bucket(word), bucket("^" + word[:STEM])] if len(word) > STEM else [bucket(word)]


def counted(text: str) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(words(text)).items():
        for b in named(word):
            found[b] += n
    return found


class Model:
    """slots: feature bucket -> index in weights, of weights that aren't 0; thresholds: GRADES - 1 of them, rising."""

    def __init__(self, slots: dict[int, int], weights: np.ndarray, thresholds: np.ndarray):
        self.slots, self.weights, self.thresholds = slots, weights, thresholds
        self.seen: dict[str, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def line(self, text: str) -> float:
        """The linear term: weights times logarithmic counts."""
        seen, hits = self.seen, []
        for word in words(text):
            at = seen.get(word)
            if at is None:
                if len(seen) >= CACHE:
                    seen.clear()
                at = seen[word] = tuple(self.slots[b] for b in named(word) if b in self.slots)
            hits.extend(at)
        if not hits:
            return 0.0
        at, counts = np.unique(hits, return_counts=True)
        return float(np.log1p(counts) @ self.weights[at])

    def score(self, text: str | None) -> tuple[float, int, float]:
        """(expected severity, likeliest grade, probability of any toxicity)."""
        p = sigmoid(self.line(text or "") - self.thresholds)
        each = -np.diff(np.concatenate([[1.0], p, [0.0]]))
        return float(p.sum()), int(each.argmax()), float(p[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """A sparse matrix by rows."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * v[self.rows], self.shape[1])

    def only(self, which: np.ndarray) -> Rows:
        keep, place = which[self.rows], np.cumsum(which) - 1
        return Rows(place[self.rows[keep]], self.columns[keep], self.values[keep], (int(which.sum()), self.shape[1]))


def fit_cumulative(x: Rows, y: np.ndarray, share: np.ndarray, grades: int = GRADES, steps: int = STEPS, rate: float = 0.1, noise: float = L1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the weighted likelihood less the penalties, by Adam on all rows with soft thresholding."""
    rows, n = x.shape
    at, l1 = np.arange(rows), noise / rows**0.5
    params = np.concatenate([np.zeros(n), [1.0], np.zeros(grades - 2)])  # weights, first threshold, log distances
    m, v = np.zeros_like(params), np.zeros_like(params)
    share = share / share.sum()
    for step in range(1, steps + 1):
        w, gaps = params[:n], np.exp(params[n + 1 :])
        t = params[n] + np.concatenate([[0.0], np.cumsum(gaps)])
        p = np.concatenate([np.ones((rows, 1)), sigmoid(x.times(w)[:, None] - t), np.zeros((rows, 1))], 1)
        slope = p * (1 - p)
        likely = np.maximum(p[at, y] - p[at, y + 1], 1e-12)
        # the derivative of log(p_y - p_{y+1}) by the linear term and by each threshold
        upper, lower = slope[at, y], slope[at, y + 1]
        by_line = -share * (upper - lower) / likely
        by_t = np.bincount(y, share * upper / likely, grades + 1) + np.bincount(y + 1, -share * lower / likely, grades + 1)
        by_t = by_t[1:grades]
        tails = np.cumsum(by_t[::-1])[::-1]
        grad = np.concatenate([x.back(by_line) + L2 * w, [by_t.sum()], tails[1:] * gaps + 1e-4 * params[n + 1 :]])
        # a weight at 0 moves only if the likelihood gains more than the penalty
        sign = np.where(w != 0, np.sign(w), -np.sign(grad[:n]))
        grad[:n] = np.where((w == 0) & (np.abs(grad[:n]) <= l1), 0, grad[:n] + l1 * sign)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        after = params - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        crossed = (after[:n] * w < 0) | ((w == 0) & (grad[:n] == 0))
        after[:n][crossed], m[:n][crossed] = 0, 0
        params = after
    return params[:n], params[n] + np.concatenate([[0.0], np.cumsum(np.exp(params[n + 1 :]))])


def fit(rows: list[tuple[int, int, bytes, bytes]], toxic_share: float) -> Model:
    """rows: (doc_id, toxic, word buckets, counts), both packed. toxic_share: of all labelled documents."""
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[3]))
    toxic = np.array([r[1] for r in rows], int)
    if not len(rows) or toxic.min() == toxic.max():
        return Model({}, np.zeros(0), np.array([30.0 + k for k in range(GRADES - 1)]))
    buckets, counts = [np.frombuffer(r[2], "<i4") for r in rows], [np.frombuffer(r[3], "<i4") for r in rows]
    sizes = [len(b) for b in buckets]
    names, columns, documents_ = np.unique(np.concatenate(buckets), return_inverse=True, return_counts=True)
    common = documents_ > 1
    keep, place = common[columns], np.cumsum(common) - 1
    names = names[common]
    x = Rows(np.repeat(np.arange(len(rows)), sizes)[keep], place[columns[keep]], np.log1p(np.concatenate(counts)[keep]), (len(rows), len(names)))
    share = np.where(toxic == 1, toxic_share / toxic.sum(), (1 - toxic_share) / (1 - toxic).sum())
    half = np.array([xxhash.xxh3_64_intdigest(str(r[0])) & 1 for r in rows], bool)
    odds = np.zeros(len(rows))
    for side in (half, ~half):
        if len(set(toxic[~side].tolist())) == 2:
            weights, thresholds = fit_cumulative(x.only(~side), toxic[~side], share[~side], 2, STEPS // 2)
            odds[side] = x.only(side).times(weights) - thresholds[0]
    cuts = np.quantile(odds[toxic == 1], [i / (GRADES - 1) for i in range(1, GRADES - 1)])
    y = np.where(toxic == 1, 1 + np.searchsorted(cuts, odds, side="left"), 0)
    weights, thresholds = fit_cumulative(x, y, share)
    chosen = np.flatnonzero(weights)
    return Model({int(names[i]): k for k, i in enumerate(chosen)}, weights[chosen], thresholds)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, toxic, buckets, counts) of labelled documents: distinct words, hashed, packed as 32-bit numbers."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = [], []
            for text in batch["text"]:
                found = counted(text.as_py() or "")
                order = sorted(found)
                at.append(np.array(order, "<i4").tobytes()), counts.append(np.array([found[b] for b in order], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "toxic", "buckets", "counts"])

    return map_arrow(docs.select("doc_id", "toxic", "text"), kernel, "doc_id long, toxic int, buckets binary, counts binary")


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN) -> Model:
    """Fit on a bounded sample of the labelled documents. A doc_id with several labels counts as toxic if one says so."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = [smallest_hashes(known.where(F.col("toxic") == k), n).withColumn("toxic", F.lit(k)) for k, n in ((1, toxic_rows), (0, clean_rows))]
    chosen = ids[0].unionByName(ids[1])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    return fit([tuple(r) for r in features(sample).collect()], share)


def score(docs: DataFrame, model: Model, names: tuple[str, ...] = ("severity", "grade", "p_toxic", "rejected")) -> DataFrame:
    """The documents' columns with expected severity, grade, probability and decision after them, under names that are free."""
    kinds = [pa.float64(), pa.int32(), pa.float64()]
    names = fresh(docs, *names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            found = [model.score(x.as_py()) for x in batch.column(at)]
            extra = [pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names[:3]])

    schema = docs.schema
    for name, kind in zip(names, ("double", "integer", "double")):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return map_arrow(docs, kernel, schema).withColumn(names[3], F.col(names[2]) >= REJECT)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    found = score(docs, model)
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score(docs.select("doc_id", "text"), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", F.col("severity").alias("expected_severity"), "grade", "p_toxic", "rejected")
