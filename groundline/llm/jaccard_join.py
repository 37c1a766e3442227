"""Exact Jaccard self-join of documents on word shingles, by vertical partitioning.

Shingles have one global order: those that many documents have come last, in
order of how many, all others before them by their 64-bit hash. A pair's
overlap is the sum of partial overlaps that are counted apart.

1. Every text becomes its set of shingles. Equal sets (by a 128-bit digest and
   size) are one vertex. The same pass counts common shingles for the order; at
   most COMMON of them are told from the rest. The order changes only the work,
   never the result.
2. Candidates. Two sets that link share at least l of their first
   a - ceil(t a) + l shingles (a: the set's size, t: the threshold; l = lead(a)
   here, the smaller set's l for a pair). These leading shingles are dealt out
   by hash, each hash being counted by itself, and the partial overlaps are
   summed for each pair. A hash with more than HOT sets makes no pairs:
   a pair's sum may then lack as many hits as both sets have hot hashes, and
   pairs that could reach l by hot hashes alone are kept together by linking
   each such set to the hash's first one. Connected candidates are a block.
3. Whole sets, of vertices in blocks only, are sent to their block, once. The
   hash order is cut into FRAGMENTS fragments; each keeps its own postings, and
   a set's partial overlaps with all sets that it isn't connected with yet are
   counted fragment by fragment and summed for each pair. Sets once reached by
   a link need no further test, so a group of copies costs its size and not
   its square, and only links that connect leave the task. A block with more
   than BLOCK_SHINGLES is cut into chunks and each pair of chunks is one task,
   so no task grows with a block.
4. Summing the fragments' counts for each pair between tasks instead was tried
   and given up: it emits every pair of a group of near copies (README).
5. The links found connect vertices into components.

Nothing is approximate but for collisions: of shingles' 64-bit hashes, and of
digests of 128 bits.

Defined results: null, empty and wordless texts have an empty set and link
with nothing; a text with fewer than 5 words has its whole sequence as its one
shingle; rows that share a doc_id each count with their own text; rows
without doc_id link with nothing and have no component; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.llm.common import discard, documents, fresh, map_arrow, materialize, text_or_empty
from groundline.llm.components import components
from groundline.llm.winnowing import _BASE, _INVERSE, _power, mixed

WORDS = 5
THRESHOLD = 80  # of 100
HOT = 48
FRAGMENTS = 4
#: How many common shingles the order tells apart, and how many a task reports.
COMMON = 1 << 16
COMMON_IN_TASK = 1 << 12
BLOCK_SHINGLES = 3_000_000
#: Fixed size of the filter that spares texts outside blocks their way through a shuffle.
FILTER_BITS = 1 << 24
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_PLACE = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(_INVERSE)) | np.uint64(1)
_SPAN = 1 << 22


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8; A to Z count as lower case."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (codes != 32) & ((codes < 9) | (codes > 13)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    out = []
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _SPAN)))
        low, high = int(starts[first]), int(ends[last - 1])
        part = codes[low:high]
        part = np.where((part >= 65) & (part <= 90), part + 32, part)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _power(_BASE, len(part)), out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out.append(mixed((sums[b] - sums[a]) * _power(_INVERSE, len(part))[a] + (b - a).astype(np.uint64)))
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes."""
    words = word_hashes(text.encode())
    if not len(words):
        return words
    n = min(WORDS, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total += words[i : i + len(total)] * _PLACE[i]
    return np.unique(mixed(total))


def digest(found: np.ndarray) -> tuple[int, int]:
    """The key of a set, as two signed 64-bit numbers."""
    whole = xxhash.xxh3_128_intdigest(found.tobytes())
    return (whole & ((1 << 64) - 1)) - (1 << 63), (whole >> 64) - (1 << 63)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def least_overlap(size: int, threshold: int = THRESHOLD) -> int:
    return -(-threshold * size // 100)


def lead(size: int, threshold: int = THRESHOLD) -> int:
    """How many leading shingles a set of this size shares with any set that it links to."""
    return min(least_overlap(size, threshold), 4 + size // 20)


def lead_column(size: Column, threshold: int = THRESHOLD) -> Column:
    return F.least(F.ceil(size * threshold / 100.0), 4 + F.floor(size / 20)).cast("long")


class Common:
    """Counts the shingles of a task's sets and keeps the most frequent ones."""

    def __init__(self, limit: int = COMMON_IN_TASK):
        self.limit, self.seen = limit, set()
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, sets: list[np.ndarray]) -> None:
        if sets:
            found, counts = np.unique(np.concatenate(sets), return_counts=True)
            many = counts > 1
            self.hashes, at = np.unique(np.concatenate([self.hashes, found[many]]), return_inverse=True)
            self.counts = np.bincount(at, np.concatenate([self.counts, counts[many]]), len(self.hashes)).astype(np.int64)
            if len(self.hashes) > 8 * self.limit:
                self._cut(4 * self.limit)

    def _cut(self, most: int) -> None:
        keep = np.sort(np.argsort(-self.counts, kind="stable")[:most])
        self.hashes, self.counts = self.hashes[keep], self.counts[keep]

    def most(self) -> tuple[np.ndarray, np.ndarray]:
        self._cut(self.limit)
        return self.hashes, self.counts


NODES = "doc_id long, mark string, node long, check long, n_shingles long, common boolean"


def nodes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, check, n_shingles) of every row: the text's MD5, the set's digest (null for an empty set) and size.

    Rows with `common` tell of shingles: node is the hash, n_shingles how many of a task's sets have it.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common()
        names = [x.split()[0] for x in NODES.split(", ")]
        for batch in batches:
            keys, sizes, new = [], [], []
            for text in batch["text"]:
                found = shingles(text.as_py() or "")
                key = digest(found) if len(found) else (None, None)
                keys.append(key), sizes.append(len(found))
                if len(found) and key[0] not in common.seen:
                    if len(common.seen) >= 500_000:
                        common.seen.clear()
                    common.seen.add(key[0])
                    new.append(found)
            common.add(new)
            node, check = zip(*keys) if keys else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["mark"], pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(sizes, pa.int64()), pa.array([False] * len(sizes), pa.bool_())], names
            )
        hashes, counts = common.most()
        none = pa.nulls(len(hashes), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(hashes), pa.string()), pa.array(signed(hashes)), none, pa.array(counts), pa.array([True] * len(hashes), pa.bool_())], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(text_or_empty()).alias("mark")), kernel, NODES)


def common_shingles(nodes: DataFrame, limit: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in rising order, and each one's place in the order of frequency; at most `limit`."""
    rows = nodes.where("common").groupBy("node").agg(F.sum("n_shingles").alias("n")).orderBy(F.desc("n"), "node").limit(limit).collect()
    hashes = np.array([r["node"] for r in reversed(rows)], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def in_global_order(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    hashes, rank = common
    if not len(hashes):
        return found
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    last = hashes[at] == found
    return np.concatenate([found[~last], found[last][np.argsort(rank[at[last]])]])


def leading(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], threshold: int = THRESHOLD) -> DataFrame:
    """(h, node, size) of each set's leading shingles; a task emits a set once as long as it remembers it."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            hashes, nodes, sizes = [], [], []
            for text in batch["text"]:
                found = shingles(text.as_py() or "")
                a = len(found)
                if not a or (node := digest(found)[0]) in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(node)
                hashes.append(in_global_order(found, sent.value)[: a - least_overlap(a, threshold) + lead(a, threshold)])
                nodes.append(node)
                sizes.append(a)
            if hashes:
                counts = [len(x) for x in hashes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(hashes))), pa.array(np.repeat(np.array(nodes, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))],
                    ["h", "node", "size"],
                )

    return map_arrow(docs.where("doc_id IS NOT NULL").select("text"), kernel, "h long, node long, size int")


def candidate_links(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(u, v): nodes that must be compared; every pair that links is connected by these."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leading(docs, common, threshold).repartition(parts, "h").groupBy("h", "node").agg(F.min("size").alias("size"))
    by_hash = Window.partitionBy("h")
    shared = materialize(dealt.withColumn("n", F.count(F.lit(1)).over(by_hash)).where("n > 1"), "leading")
    hits = shared.withColumn("hot", F.count_if(F.col("n") > hot).over(Window.partitionBy("node")))
    low = hits.where(F.col("n") <= hot)
    a, b = low.alias("a"), low.alias("b")
    near = (F.col("a.size") * 100 >= F.col("b.size") * threshold) & (F.col("b.size") * 100 >= F.col("a.size") * threshold)
    sums = (
        a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.node") < F.col("b.node")) & near)
        .groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
        .agg(
            F.count(F.lit(1)).alias("partial"),
            F.min(F.least("a.size", "b.size")).alias("size"),
            F.min(F.least("a.hot", "b.hot")).alias("hot"),
        )
    )
    pairs = sums.where(F.col("partial") + F.col("hot") >= lead_column(F.col("size"), threshold)).select("u", "v")
    high = hits.where((F.col("n") > hot) & (F.col("hot") >= lead_column(F.ceil(F.col("size") * threshold / 100.0), threshold)))
    stars = high.withColumn("v", F.min("node").over(by_hash)).select(F.col("node").alias("u"), "v").where("u <> v")
    found = materialize(pairs.union(stars).distinct(), "candidates")
    discard(docs.sparkSession, shared)
    return found


def linked_sets(ids: list[int], sets: list[np.ndarray], threshold: int = THRESHOLD, fragments: int = FRAGMENTS) -> list[tuple[int, int]]:
    """(id, smallest id of its component) within one block, for all that link with another.

    The order of shingles is cut into fragments; each keeps its own postings.
    A set's overlap with every set not yet reached is the sum of what the
    fragments count; a pair's cost is the shingles it shares.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    n = len(ids)
    root = np.full(n, -1)
    terms = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    width = int(terms.max()) + 1 if len(terms) else 0
    cut = [width * f // fragments for f in range(fragments + 1)]
    open_ = np.ones(n, bool)

    def postings() -> list[tuple[np.ndarray, np.ndarray]]:
        """For each fragment: where each of its terms' postings begin, and the sets not yet reached."""
        keep = np.repeat(open_, sizes)
        t, o = terms[keep], np.repeat(np.arange(n), sizes)[keep]
        by = np.argsort(t, kind="stable")
        t, o = t[by], o[by]
        out = []
        for f in range(fragments):
            low, high = np.searchsorted(t, [cut[f], cut[f + 1]])
            out.append((np.searchsorted(t[low:high], np.arange(cut[f], cut[f + 1] + 1)), o[low:high]))
        return out

    index, held, left = postings(), n, n
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], open_[first] = first, False
        left -= 1
        queue = [first]
        while queue and left:
            x = queue.pop()
            if left < held / 2:
                index, held = postings(), left
            own = terms[bounds[x] : bounds[x + 1]]
            met = []
            for f, (starts, owners) in enumerate(index):
                mine = own[(own >= cut[f]) & (own < cut[f + 1])] - cut[f]
                low, count = starts[mine], starts[mine + 1] - starts[mine]
                total = int(count.sum())
                if total:
                    hit = owners[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)]
                    met.append(np.unique(hit[open_[hit]], return_counts=True))
            if not met:
                continue
            # the fragments' partial overlaps, summed for each pair
            hit, at = np.unique(np.concatenate([m[0] for m in met]), return_inverse=True)
            overlap = np.bincount(at, np.concatenate([m[1] for m in met])).astype(np.int64)
            new = hit[100 * overlap >= threshold * (sizes[hit] + sizes[x] - overlap)]
            root[new], open_[new] = first, False
            left -= len(new)
            queue.extend(new.tolist())
    return [(ids[i], ids[r]) for i, r in enumerate(root.tolist()) if i != r]


def _grouped(kernel: Callable[[list, list], list[tuple[int, int]]]):
    """Run `kernel` on each run of rows with equal (block, i, j); rows come sorted."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, out = None, {}, []

        def settle():
            if len(sets) > 1:
                out.extend(kernel(list(sets), list(sets.values())))
            sets.clear()

        for batch in batches:
            values = batch["shingles"].flatten().to_numpy().view(np.uint64)
            offsets = np.asarray(batch["shingles"].offsets) - batch["shingles"].offsets[0].as_py()
            for row, (*at, vertex) in enumerate(zip(*(batch[c].to_pylist() for c in ("block", "i", "j", "vertex")))):
                if at != key:
                    settle()
                    key = at
                sets[vertex] = values[offsets[row] : offsets[row + 1]].copy()
            if len(out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])
                out.clear()
        settle()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])

    return over


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, node, check, shingles) of the documents in `wanted` (doc_id), and of a few more that the fixed-size filter lets through."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1
    bits = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.collect():  # FILTER_BITS / 32768 rows at most
        part = np.frombuffer(r["bits"], np.uint8)
        table[(r["b"] - 1) * 4096 :][: len(part)] = part
    passes = docs.sparkSession.sparkContext.broadcast(table)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = passes.value
        for batch in batches:
            places = batch["p"].to_numpy() - 1
            hit = np.flatnonzero(table[places >> 3] >> (places & 7).astype(np.uint8) & 1)
            for part in np.array_split(hit, len(hit) // 64 + 1):
                found = [shingles(batch["text"][i].as_py() or "") for i in part.tolist()]
                keep = [k for k, s in enumerate(found) if len(s)]
                if keep:
                    ids = [batch["doc_id"][int(part[k])].as_py() for k in keep]
                    node, check = zip(*(digest(found[k]) for k in keep))
                    lists = [signed(found[k]) for k in keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "node", "check", "shingles"]
                    )

    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("p"))
    return map_arrow(ids, kernel, "doc_id long, node long, check long, shingles array<long>")


def links(docs: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int = THRESHOLD, hot: int = HOT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(u, v) of vertices: edges that connect each component. nodes: from nodes_of(); sets: from vertices()."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = components(candidate_links(docs, common_shingles(nodes), threshold, hot), "blocks")
    found = sets.join(blocks.withColumnRenamed("root", "block").withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
    load = found.groupBy(F.col("block").alias("_block")).agg(F.ceil(F.sum("size") / block_shingles).cast("int").alias("chunks"))
    members = found.join(load, F.col("block") == F.col("_block"))
    members = materialize(members.withColumn("chunk", F.pmod(F.xxhash64("vertex"), F.col("chunks").cast("long")).cast("int")), "members")
    spread = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "vertex", F.col("doc_id").alias("_id"), F.col("node").alias("_node"), F.col("check").alias("_check"), "block", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j")
    )
    same = (F.col("doc_id") == F.col("_id")) & (F.col("node") == F.col("_node")) & (F.col("check") == F.col("_check"))
    dealt = sets_of(docs, members.select("doc_id")).join(spread, same).select("block", "i", "j", "vertex", "shingles")
    dealt = dealt.repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j", "vertex")
    return map_arrow(dealt, _grouped(lambda ids, found: linked_sets(ids, found, threshold)), "u long, v long")


def vertices(nodes: DataFrame) -> DataFrame:
    """(vertex, doc_id, node, check, size): the distinct sets, numbered, with their smallest doc_id."""
    known = nodes.where("NOT common AND doc_id IS NOT NULL AND node IS NOT NULL")
    sets = known.groupBy("node", "check", F.col("n_shingles").alias("size")).agg(F.min("doc_id").alias("doc_id"))
    return materialize(sets.withColumn("vertex", F.monotonically_increasing_id()), "vertices")


def grouped(docs: DataFrame, threshold: int = THRESHOLD, hot: int = HOT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, mark, n_shingles, class) of every row; class is the component's smallest vertex, null for rows without doc_id or shingles."""
    nodes = materialize(nodes_of(docs), "nodes")
    sets = vertices(nodes)
    roots = components(links(docs, nodes, sets, threshold, hot, block_shingles), "links")
    named = sets.join(roots.withColumnRenamed("node", "_vertex"), F.col("vertex") == F.col("_vertex"), "left")
    named = named.select(F.col("node").alias("_node"), F.col("check").alias("_check"), F.col("size").alias("_size"), F.coalesce("root", "vertex").alias("class"))
    same = (F.col("node") == F.col("_node")) & (F.col("check") == F.col("_check")) & (F.col("n_shingles") == F.col("_size")) & F.col("doc_id").isNotNull()
    return nodes.where("NOT common").join(named, same, "left").select("doc_id", "mark", "n_shingles", "class")


def classes(docs: DataFrame, threshold: int = THRESHOLD, hot: int = HOT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = materialize(grouped(docs, threshold, hot, block_shingles), "classes")
    least = rows.where("class IS NOT NULL").groupBy(F.col("class").alias("_class")).agg(F.min("doc_id").alias("_least"))
    return rows.join(least, F.col("class") == F.col("_class"), "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, and of several with that id the one with the smallest MD5 of its text.

    A row that repeats doc_id and text is the same document; rows without
    doc_id stay, and so do documents without shingles.
    """
    rows = materialize(grouped(docs), "classes")
    first = rows.where("class IS NOT NULL").groupBy(F.col("class").alias("_class")).agg(F.min(F.struct("doc_id", "mark")).alias("_first"))
    lost = rows.join(first, F.col("class") == F.col("_class")).where(F.struct("doc_id", "mark") != F.col("_first"))
    mark, gone, gone_mark = fresh(docs, "mark", "gone", "gone_mark")
    lost = lost.select(F.col("doc_id").alias(gone), F.col("mark").alias(gone_mark)).distinct()
    named = docs.where("doc_id IS NOT NULL").withColumn(mark, F.md5(text_or_empty()))
    kept = named.join(lost, (F.col("doc_id") == F.col(gone)) & (F.col(mark) == F.col(gone_mark)), "left_anti").dropDuplicates(["doc_id", mark])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL").select(*docs.columns))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
