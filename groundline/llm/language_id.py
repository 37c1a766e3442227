"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its character n-grams (2 to 4 code points, lower case,
runs of non-letters as one boundary), hashed into BUCKETS rows of an embedding
table. A text is the mean of its n-grams' embeddings; a linear layer and a
softmax give the languages' probabilities. As both steps are linear, the two
are multiplied once into a table of BUCKETS x languages for prediction.

A temperature is fitted on a fifth of the sample that isn't trained on, and on
the same rows the lowest probability at which accepted predictions are right
in TARGET_PRECISION of cases: below it a prediction is marked `rejected`.

The model learns from at most TRAIN_ROWS documents whose CRC-32 of doc_id (as
text) isn't divisible by 5, drawn over all languages, and besides from
RARE_ROWS, or all there are, of each language that would get fewer. Only their n-gram counts reach the driver.

Defined results: null texts and texts without a letter are `und` with score 1;
without any labelled row every text is `und` with score 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.llm.common import documents, map_arrow
from groundline.llm.samples import rows_of, smallest_hashes

BUCKETS = 1 << 16
DIM = 16
ORDERS = (2, 3, 4)
TRAIN_ROWS = 4000
RARE_ROWS = 50
EPOCHS = 6
RATE = 2.0
TARGET_PRECISION = 0.995
BLOCK = 1 << 18


@cache
def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text with each run of non-letters as one 0, and a 0 at both ends; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint32)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    return codes if codes.any() else codes[:0]


def gram_buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, in blocks."""
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK + max(ORDERS) - 1].astype(np.uint32)
        for n in ORDERS:
            m = min(BLOCK, len(part) - n + 1)
            if m > 0:
                h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for i in range(n):
                    h = (h ^ part[i : i + m]) * np.uint32(0x85EBCA6B)
                    h ^= h >> np.uint32(15)
                yield h & np.uint32(BUCKETS - 1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, buckets, counts): each text's distinct n-gram buckets, BUCKETS at most, as packed 16-bit and 32-bit numbers."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, at, counts = [], [], [], []
            for doc, lang, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "lang", "text"))):
                total = np.zeros(BUCKETS, np.int64)
                for part in gram_buckets(letters_only(text or "")):
                    total += np.bincount(part, minlength=BUCKETS)
                found = np.flatnonzero(total)
                if len(found):
                    ids.append(doc), langs.append(lang), at.append(found.astype(np.uint16).tobytes()), counts.append(total[found].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "lang", "buckets", "counts"],
            )

    return map_arrow(docs.select("doc_id", "lang", "text"), kernel, "doc_id long, lang string, buckets binary, counts binary")


class Model:
    """languages, table (BUCKETS x languages), bias, temperature and threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def logits(self, text: str) -> np.ndarray | None:
        codes = letters_only(text)
        if not len(codes):
            return None
        total, n = np.zeros(len(self.languages)), 0
        for part in gram_buckets(codes):
            total += self.table[part].sum(0, dtype=np.float64)
            n += len(part)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        found = self.logits(text) if text is not None else None
        if found is None:
            return "und", 1.0, False
        if not self.languages:
            return "und", 0.0, True
        p = softmax(found / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list, seed: int = 7) -> Model:
    """rows: those of features(), in any order."""
    rows = sorted(rows, key=lambda r: r[0])
    languages = sorted({r[1] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    of = {x: i for i, x in enumerate(languages)}
    data = []
    for _, lang, buckets, counts in rows:
        share = np.frombuffer(counts, np.float32)
        data.append((np.frombuffer(buckets, np.uint16), share / share.sum(), of[lang]))
    mixed = rng.permutation(len(data))
    checks, trains = ([data[i] for i in mixed[: len(data) // 5]], [data[i] for i in mixed[len(data) // 5 :]]) if len(data) >= 10 else (data, data)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(trains)):
            at, share, y = trains[i]
            mean = share @ table[at]
            error = softmax(mean @ weights + bias)
            error[y] -= 1
            down = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            # the step on an n-gram is its share of the text, made independent of the text's length
            table[at] -= rate * np.outer(share / np.sqrt(share @ share), down)
    folded = (table @ weights).astype(np.float32)
    scores = np.stack([share @ folded[at] + bias for at, share, _ in checks])
    gold = np.array([y for *_, y in checks])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(scores / t)[np.arange(len(gold)), gold] + 1e-12).mean())
    p = softmax(scores / temperature)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum(p.argmax(1)[order] == gold[order]) / np.arange(1, len(gold) + 1)
    good = np.flatnonzero(right >= TARGET_PRECISION)
    threshold = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return Model(languages, folded, bias, float(temperature), threshold)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    usable = docs.where(~held_out() & F.col("lang").isNotNull())
    # a bounded fact: a count for each language
    counts = {r["lang"]: r["count"] for r in usable.where("doc_id IS NOT NULL").groupBy("lang").count().collect()}
    rare = [x for x, n in counts.items() if n * rows < RARE_ROWS * sum(counts.values())]
    ids = smallest_hashes(usable, rows)
    if rare:
        # each of them has a small share of the rows, and only ids are sorted
        order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
        few = usable.where(F.col("lang").isin(rare) & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct().withColumn("_n", F.row_number().over(order))
        ids = ids.unionByName(few.where(F.col("_n") <= RARE_ROWS).select("doc_id")).distinct()
    sample = rows_of(usable.select("doc_id", "lang", "text"), ids)
    return fit([tuple(r) for r in features(sample).collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch["text"]]
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"),
        kernel,
        "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean",
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs))
