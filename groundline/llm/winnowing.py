"""Document fingerprints by winnowing.

Rolling hashes of all k-grams (code points) of a text; in each window of w
consecutive k-grams the smallest hash is chosen, the rightmost on ties, and
kept with its position. Any passage of at least k + w - 1 code points that two
texts share yields a hash they share (the match guarantee), and the positions
tell where.

Defined results: null is the empty text, whose fingerprint is empty; a text
shorter than k is one gram; a text with fewer than w grams is one window;
equal texts have equal fingerprints. Likeness is the Jaccard index of the hash
sets; two empty fingerprints have likeness 1, one empty fingerprint 0. A row
without doc_id has no place in the order of documents and is its own next one;
rows that share a doc_id are ordered by text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.common import documents, map_arrow

K = 16
WINDOW = 64
#: Code points hashed at once; longer texts go through in overlapping blocks.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose high bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams, from prefix sums of code * base**i."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * _power(_INVERSE, n - k + 1))


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w keys, by doubling."""
    width = 1
    while 2 * width <= w:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return keys if width == w else np.minimum(keys[: len(keys) - (w - width)], keys[w - width :])


def winnow(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text's fingerprint in order of position; hashes have 32 bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    k = min(k, len(codes))
    w = min(w, len(codes) - k + 1)
    found = []
    for at in range(0, len(codes) - k - w + 2, BLOCK):
        hashes = gram_hashes(codes[at : at + BLOCK + k + w - 2], k) >> np.uint64(32)
        place = np.arange(at, at + len(hashes), dtype=np.uint64)
        # the larger position has the smaller key: rightmost on ties
        found.append(np.unique(window_minima((hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - place), w)))
    keys = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    positions = (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.uint32)
    order = np.argsort(positions, kind="stable")
    return (keys >> np.uint64(32)).astype(np.uint32)[order], positions[order]


def encoded(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Base64 of the pairs (hash, position), both little-endian 32-bit."""
    return base64.b64encode(np.stack([hashes, positions], 1).astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """(doc_id, hash, position) of every text: the general operator, one row for each chosen k-gram."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                hashes, positions = winnow(text.as_py() or "", k, w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(hashes), pa.int64()), pa.array(hashes.astype(np.int64)), pa.array(positions.astype(np.int64))],
                    ["doc_id", "hash", "position"],
                )

    return map_arrow(docs.select("doc_id", "text"), kernel, "doc_id long, hash long, position long")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first code points of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """Deal documents out so that each row meets its successor in descending doc_id.

    Ranges of doc_id form buckets. The first document of each bucket is also
    sent, as a copy, to the bucket before it, where it follows the last row.
    Only bucket bounds and heads (a few numbers for each partition) reach the
    driver; they go to the workers as sorted arrays that are searched.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    wanted = 4 * parts  # buckets are dealt by hash: several for each partition even out
    bounds = np.array(sorted({int(x) for x in ids.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.2 / wanted)}), np.int64)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["doc_id"].to_numpy()
            if len(found):
                found = np.sort(found)
                at = np.searchsorted(bounds, found, "right")
                last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
                yield pa.RecordBatch.from_arrays([pa.array(at[last], pa.int32()), pa.array(found[last], pa.int64())], ["b", "m"])

    tops = {r["b"]: r["m"] for r in map_arrow(ids, heads, "b int, m long", 1 << 16).groupBy("b").agg(F.max("m").alias("m")).collect()}
    used = np.array(sorted(tops), np.int32)
    head = np.full(len(bounds) + 1, np.iinfo(np.int64).min)
    before = np.full(len(bounds) + 1, -1, np.int32)
    if len(used):
        head[used] = [tops[b] for b in used.tolist()]
        before[used] = np.roll(used, -1)  # the highest bucket comes first, so the lowest is before it
    sent = spark.sparkContext.broadcast((bounds, head, before))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, head, before = sent.value
        for batch in batches:
            known = np.array(batch["doc_id"].is_valid())
            found = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, found, "right").astype(np.int32)
            copies = np.flatnonzero(known & (found == head[at]))
            own = np.where(known, at, -1 - np.arange(len(at)) % parts).astype(np.int32)
            rows = np.concatenate([np.arange(len(at)), copies])
            to = np.concatenate([own, before[at[copies]]])
            flag = np.repeat(np.array([0, 1], np.int32), [len(at), len(copies)])
            wide = pa.Table.from_batches([batch]).take(pa.array(rows)) if len(copies) else pa.Table.from_batches([batch])
            for part in wide.append_column("_b", pa.array(to, pa.int32())).append_column("_copy", pa.array(flag, pa.int32())).to_batches():
                yield part

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), deal, "doc_id long, text string, _b int, _copy int")
    return rows.repartition(parts, "_b").sortWithinPartitions(F.asc("_b"), F.asc("_copy"), F.desc("doc_id"), F.asc("text"))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[tuple] = []
    held = None  # (bucket, doc_id, text, fingerprint) of the row that waits for its successor

    def settle(text: str, mark: tuple) -> None:
        _, doc, own, print_ = held
        changed = edited(own, text)
        other = winnow(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc, len(own), digest, encoded(*print_), encoded(*other), likeness(print_[0], other[0]), likeness(print_[0], mark[0])))

    for batch in batches:
        for doc, text, bucket, copy in zip(*(batch[c] for c in ("doc_id", "text", "_b", "_copy"))):
            doc, text, bucket, copy = doc.as_py(), text.as_py() or "", bucket.as_py(), copy.as_py()
            if held is not None and held[0] != bucket:
                held = None  # can't be: a copy ends each bucket
            mark = winnow(text) if not copy or held is not None else None
            if bucket < 0:
                held = (bucket, doc, text, mark)
                settle(text, mark)
                held = None
                continue
            if held is not None:
                settle(text, mark)
            held = None if copy else (bucket, doc, text, mark)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()


def compared(docs: DataFrame) -> DataFrame:
    return map_arrow(in_order(docs), _kernel, SCHEMA)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
