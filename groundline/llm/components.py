"""Connected components of a distributed edge table, by alternating large and small stars.

No step gathers a component: every round is a few hash aggregations and joins
over edges, written to the shared folder. A round links each node's larger
neighbours to its smallest one (large star), then its smaller ones (small
star); the edges end as one star for each component. A hub's edges are dealt
over SALTS tasks, to each of which goes a copy of every node's smallest
neighbour (SALTS rows for a node).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.common import discard, materialize


SALTS = 8


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge (u, v) with u's smallest neighbour m, salted by v."""
    spread = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, (F.col("u") == F.col("_u")) & (F.col("salt") == F.col("_salt")))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return _met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
    linked = _met(down, least).select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is its component's smallest node. edges: (u, v) of longs."""
    now = materialize(edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct(), name)
    state = _state(now)
    while state[0]:
        then = materialize(_small(_large(now)), name)
        discard(then.sparkSession, now)
        now, before, state = then, state, _state(then)
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
