"""Sharding along a Hilbert curve, with DataFrame operations only.

Each row's metadata (language, source, length, doc_id) is quantised to a grid
of DIMS dimensions with BITS bits each. The cell's index on the Hilbert curve
orders the rows; the order is cut into runs, which become shards. Rows that
are near in several dimensions share a shard, so that a reader can skip files
by the ranges of any of these columns.

The law is `rows`: shard s of S takes the ranks r with floor(r * S / N) = s,
so row counts differ by one at most. Ranks are global: rows are range-sorted,
each partition's count is summed over the preceding partitions (a table with
one row for each partition), and no task ever holds more than one partition.

Rows with equal texts form a group: all of them take the cell of the group's
row with the smallest doc_id and are neighbours in the order, so a group is
together in a shard unless the law's cut by rank goes through it.

Defined results: nulls take cell 0 of their dimension; ties are ordered by the
text's size and hashes, then doc_id; equal rows are dealt in any order; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.llm.common import documents, materialize, text_or_empty

SHARDS = 40
BITS = 5
DIMS = 4


def _rotl(x: Column, by: Column, n: int) -> Column:
    mask = (1 << n) - 1
    return _lookup([[((v << k) | (v >> (n - k))) & mask for k in range(n)] for v in range(1 << n)], x, by)


def _rotr(x: Column, by: Column, n: int) -> Column:
    mask = (1 << n) - 1
    return _lookup([[((v >> k) | (v << (n - k))) & mask for k in range(n)] for v in range(1 << n)], x, by)


def _lookup(table: list[list[int]] | list[int], *at: Column) -> Column:
    """An entry of a small constant table."""
    if isinstance(table[0], list):
        width = len(table[0])
        return F.get(F.array(*(F.lit(v) for row in table for v in row)), at[0] * width + at[1])
    return F.get(F.array(*(F.lit(v) for v in table)), at[0])


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _trailing_ones(i: int) -> int:
    n = 0
    while i & 1:
        i, n = i >> 1, n + 1
    return n


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The index of a grid cell on the Hilbert curve: one step for each bit, highest first.

    A step takes one bit of each coordinate, turns it into the current
    sub-cube's own frame (entry corner e, direction d) and reads off the
    sub-cube's place w by the inverse Gray code; w decides the next frame.
    """
    n = len(cells)
    size = 1 << n
    place = [0] * size
    for i in range(size):
        place[_gray(i)] = i
    entry = [0 if w == 0 else _gray(2 * ((w - 1) // 2)) for w in range(size)]
    turn = [0 if w == 0 else (_trailing_ones(w - 1) if w % 2 == 0 else _trailing_ones(w)) % n for w in range(size)]

    packed = F.array(
        *(
            sum((F.shiftright(c, b).bitwiseAND(1) * (1 << i) for i, c in enumerate(cells)), F.lit(0)).cast("int")
            for b in range(bits - 1, -1, -1)
        )
    )

    def step(state: Column, corner: Column) -> Column:
        w = _lookup(place, _rotr(corner.bitwiseXOR(state["e"]), (state["d"] + 1) % n, n))
        return F.struct(
            (F.shiftleft(state["h"], n) + w).cast("long").alias("h"),
            state["e"].bitwiseXOR(_rotl(_lookup(entry, w), (state["d"] + 1) % n, n)).cast("int").alias("e"),
            ((state["d"] + _lookup(turn, w) + 1) % n).cast("int").alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(packed, start, step, lambda state: state["h"])


def quantised(bits: int, low: int, high: int) -> list[Column]:
    """The grid cell of a group: hashed names, logarithmic length, and doc_id between its bounds."""
    top = (1 << bits) - 1
    width = max(1, (high - low) // (top + 1) + 1)
    return [
        F.coalesce(F.pmod(F.xxhash64("lang"), F.lit(top + 1)).cast("int"), F.lit(0)),
        F.coalesce(F.pmod(F.xxhash64("source"), F.lit(top + 1)).cast("int"), F.lit(0)),
        F.least(F.lit(top), F.floor(F.log2(F.col("n") + 1.0) * 1.5)).cast("int"),
        F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(0)).cast("int"),
    ]


def curve_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, curve_index, and each row's shard and slot under the law `rows`."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = text_or_empty()
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.struct("doc_id", "lang", "source", F.length(text).alias("n")).alias("meta"),
        ),
        "metadata",
    )
    bound = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    text_key = ["size", "text_crc32", "h"]
    first = F.min_by("meta", F.struct(F.col("doc_id").isNull(), "doc_id", "meta.lang", "meta.source"))
    groups = rows.groupBy(*text_key).agg(first.alias("g"), F.count(F.lit(1)).alias("copies"))
    own = [*text_key, "g.doc_id", "g.lang", "g.source", "g.n"]
    shared = groups.where("copies > 1").select(*own).withColumn("curve_index", hilbert_index(quantised(bits, bound["a"] or 0, bound["b"] or 0), bits))
    # the groups' side has one row for each text that has copies; hot groups are on the other side, where Spark can split them
    theirs = shared.select(*(F.col(c).alias(f"_{c}") for c in text_key), F.col("curve_index").alias("_index"))
    same = (F.col("size") == F.col("_size")) & (F.col("text_crc32") == F.col("_text_crc32")) & (F.col("h") == F.col("_h"))
    alone = rows.select("doc_id", *text_key, "meta.lang", "meta.source", "meta.n").withColumn("curve_index", hilbert_index(quantised(bits, bound["a"] or 0, bound["b"] or 0), bits))
    keys = alone.join(theirs, same, "left").select("doc_id", *text_key, F.coalesce("_index", "curve_index").alias("curve_index"))
    order = ["curve_index", *text_key, "doc_id"]
    placed = materialize(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "curve")
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over one row for each partition
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("_part", (F.sum("_n").over(running) - F.col("_n")).alias("_start"), F.sum("_n").over(every).alias("_total"))
    ranked = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return ranked.withColumn("shard", F.expr(f"cast(_rank * {shards} div _total as int)")).select(
        "doc_id",
        "size",
        "text_crc32",
        "curve_index",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"_rank - (cast(shard as bigint) * _total + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_shards(documents(spark, sf_dir))
