"""Best-fit packing of token sequences, by hierarchical residual packing.

Every partition cuts its documents into pieces of at most CAPACITY tokens and
packs the pieces by best fit, longest first. Bins that are nearly full are
emitted. An underfull bin is taken apart into its pieces, each of which is an
underfull bin of its own from here on and an item of the next round: FAN
neighbouring partitions send theirs to one group, which packs by best fit
again, emits what is nearly full, and hands up the rest, until one group is
left, which emits all.

Items of the same length are alike, so what moves up the tree is how many
there are of each length (at most CAPACITY numbers from a group), and a group
packs whole classes of bins at a time: its work and memory are bounded by
CAPACITY and FAN, whatever the number of items, and nothing is capped. An
item is known by its rank in its partition among items of its length. A group
gives ranges of ranks their place in bins; ranges are carried down the tree to
the partitions, where each item finds its own.

Defined results: null text is empty and is packed as its end-of-document id
alone; repeated rows are packed once for each row; an empty table packs into
nothing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.common import documents, map_arrow, materialize
from groundline.llm.vocab import WORD_BPE, in_slices, vocabulary, word_encoder

CAPACITY = 2048
END_OF_DOCUMENT = 0
#: A bin with at least this fill is emitted below the root.
NEARLY_FULL = CAPACITY - 2
FAN = 8
#: Pieces that a partition packs at once.
BLOCK = 100_000

#: Bins that are alike: how many, their fill, and what each holds as (length, how often), longest first.
Bins = tuple[int, int, tuple[tuple[int, int], ...]]


def fit_classes(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Best fit, longest first, of counts[length] items of each length.

    Items of one length go to the tightest open bin that takes them, and on
    into the same bin as long as they fit, as it is then tighter still; so all
    open bins that are alike take the same and are handled as one.
    """
    open_: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    full: list[Bins] = []
    mask = 0
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fitting = mask >> size
            if fitting:
                space = size + (fitting & -fitting).bit_length() - 1
                n, held = open_[space].pop()
                if not open_[space]:
                    mask &= ~(1 << space)
            else:
                space, held = capacity, ()
                n = -(-left // (space // size))
            each = space // size
            whole = min(n, left // each)
            some = left - whole * each if whole < n else 0
            left -= whole * each + some
            for bins, take in ((whole, each), (min(some, 1), some), (n - whole - min(some, 1), 0)):
                if not bins:
                    continue
                free, now = space - take * size, (*held, (size, take)) if take else held
                if free:
                    open_[free].append((bins, now))
                    mask |= 1 << free
                else:
                    full.append((bins, capacity, now))
    return full + [(n, capacity - free, held) for free, groups in sorted(open_.items()) for n, held in groups]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, sequence_id long, offset long, rank long"


def named(level: int, node: int, bin_: int) -> int:
    """The number of a sequence: unique over the levels and groups of the tree."""
    return (level << 58) + (node << 34) + bin_


def local_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Encode, cut and pack within partitions. Pieces of emitted bins have their place, all others their rank among those of their length."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, next_bin = TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 7]
        waiting: list[tuple] = []
        ranks: dict[int, int] = defaultdict(int)

        def pack() -> pa.RecordBatch:
            nonlocal next_bin
            sizes = np.array([p[3] for p in waiting])
            order = np.argsort(sizes, kind="stable")
            lengths, first, counts = np.unique(sizes[order], return_index=True, return_counts=True)
            at, left = dict(zip(lengths.tolist(), first.tolist())), dict(zip(lengths.tolist(), counts.tolist()))
            sequence, offset, rank = (np.full(len(sizes), -1) for _ in range(3))
            for n, fill, held in fit_classes(left.copy(), capacity):
                if fill < nearly_full:
                    continue
                place = 0
                for size, each in held:
                    who = order[at[size] : at[size] + n * each]
                    at[size], left[size] = at[size] + n * each, left[size] - n * each
                    k = np.arange(n * each)
                    sequence[who], offset[who] = named(0, task, next_bin) + k // each, place + k % each * size
                    place += size * each
                next_bin += n
            for size, n in left.items():
                rank[order[at[size] : at[size] + n]] = ranks[size] + np.arange(n)
                ranks[size] += n
            own = [pa.array(c, t) for c, t in zip(zip(*waiting), types)]
            waiting.clear()
            placed = [pa.array(c, pa.int64(), mask=c < 0) for c in (sequence, offset, rank)]
            return pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(sizes), task)), *placed], names)

        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), ["" if x is None else x for x in batch["text"].to_pylist()]
            for a, b in in_slices(texts):
                for doc, tokens in zip(ids[a:b], word_encoder(path).encode(texts[a:b])):
                    tokens = np.append(tokens, END_OF_DOCUMENT).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), capacity)):
                        part = tokens[start : start + capacity]
                        waiting.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
            if len(waiting) >= BLOCK:
                yield pack()
        if waiting:
            yield pack()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, PIECES)


MOVES = "kind string, node long, child long, length long, low long, n long, each long, bin long, skip long, at long"


def _merge(level: int, last: bool, capacity: int, nearly_full: int):
    """Pack what the children of a node hand up.

    Rows out: `place`, a range of a child's ranks and where it goes; `input`,
    where a child's ranks begin among those the node hands up (below 0: they
    were placed); `up`, how many items of a length the node hands up.
    """

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        node = int(group["node"].iloc[0])
        children: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        total: dict[int, int] = defaultdict(int)
        for child, size, n in sorted(zip(group["child"].tolist(), group["length"].tolist(), group["n"].tolist())):
            children[size].append((child, total[size], n))
            total[size] += n
        used: dict[int, int] = defaultdict(int)
        out, next_bin = [], 0
        for n, fill, held in fit_classes(dict(total), capacity):
            if fill < nearly_full and not last:
                continue
            place = 0
            for size, each in held:
                low, high = used[size], used[size] + n * each
                used[size] = high
                for child, start, count in children[size]:
                    a, b = max(low, start), min(high, start + count)
                    if a < b:
                        out.append(("place", node, child, size, a - start, b - a, each, named(level, node, next_bin), a - low, place))
                place += size * each
            next_bin += n
        for size, parts in children.items():
            out.extend(("input", node, child, size, start - used[size], count, 0, 0, 0, 0) for child, start, count in parts)
            if total[size] > used[size]:
                out.append(("up", node, node, size, 0, total[size] - used[size], 0, 0, 0, 0))
        return pd.DataFrame(out, columns=[x.split()[0] for x in MOVES.split(", ")])

    return kernel


def _down(ranges: DataFrame, inputs: DataFrame) -> DataFrame:
    """Ranges of a node's ranks as ranges of its children's."""
    i = inputs.select(F.col("node").alias("_node"), F.col("length").alias("_length"), F.col("child").alias("_child"), F.col("low").alias("_low"), F.col("n").alias("_n"))
    a, b = F.greatest("low", "_low"), F.least(F.col("low") + F.col("n"), F.col("_low") + F.col("_n"))
    joined = ranges.join(i, (F.col("child") == F.col("_node")) & (F.col("length") == F.col("_length"))).where(a < b)
    return joined.select(
        F.col("_child").alias("child"), "length", (a - F.col("_low")).alias("low"), (b - a).alias("n"), "each", "bin", (F.col("skip") + a - F.col("low")).alias("skip"), "at"
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, fan: int = FAN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = materialize(local_pieces(docs, path, capacity, nearly_full), "pieces")
    width = (pieces.agg(F.max("task")).first()[0] or 0) + 1
    items = pieces.where("rank IS NOT NULL").groupBy(F.col("task").alias("child"), "length").agg(F.count(F.lit(1)).alias("n"))
    levels: list[DataFrame] = []
    while not levels or width > 1:
        width = -(-width // fan)
        step = _merge(len(levels) + 1, width == 1, capacity, nearly_full)
        grouped = items.withColumn("node", F.floor(F.col("child") / fan).cast("long")).groupBy("node")
        levels.append(materialize(grouped.applyInPandas(step, MOVES), "moves"))
        items = levels[-1].where("kind = 'up'").select("child", "length", "n")
    ranges = None
    for level in reversed(levels):  # at most FAN times CAPACITY ranges come from a node's input
        own = level.where("kind = 'place'").select("child", "length", "low", "n", "each", "bin", "skip", "at")
        ranges = own if ranges is None else own.unionByName(_down(ranges, level.where("kind = 'input'")))
    k = F.col("skip") + F.col("_rank") - F.col("low")
    places = ranges.withColumn("_rank", F.explode(F.sequence("low", F.col("low") + F.col("n") - 1))).select(
        F.col("child").alias("_task"), F.col("length").alias("_length"), "_rank", (F.col("bin") + F.floor(k / F.col("each"))).alias("_bin"), (F.col("at") + k % F.col("each") * F.col("length")).alias("_at")
    )
    settled = pieces.where("rank IS NULL")
    moved = pieces.where("rank IS NOT NULL").join(places, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length")) & (F.col("rank") == F.col("_rank")))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return settled.select(*own, "sequence_id", "offset").unionByName(moved.select(*own, F.col("_bin").cast("long").alias("sequence_id"), F.col("_at").cast("long").alias("offset")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary(WORD_BPE))
