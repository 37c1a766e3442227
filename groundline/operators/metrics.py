"""Exact evaluation metrics and costs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.batches import tuples
from groundline.operators.change import total_or_null
from groundline.plans.overlay import Graph

MATCHED = pa.schema([("doc", pa.int64()), ("type", pa.string()), ("gold", pa.int64()), ("pred", pa.int64()), ("iou", pa.float64())])


def candidate_edges(g: Graph, tenths: int = 3) -> DataFrame:
    """Pairs of a base's clause and an amendment's of equal type with intersection over union of at least tenths/10, exactly."""
    owner = g.obligation.select(F.col("id").alias("_o"), F.col("agreement_id").alias("_oa"), "type", "base_agreement_id")
    rows = g.clause_ref.where("ref_id = obligation_id").join(owner, (F.col("agreement_id") == F.col("_oa")) & (F.col("obligation_id") == F.col("_o")))
    gold = rows.where("base_agreement_id IS NULL").select(F.col("agreement_id").alias("doc"), "type", F.col("ref_id").alias("gold"), F.col("char_start").alias("s"), F.col("char_end").alias("e"))
    pred = rows.where("base_agreement_id IS NOT NULL").select(F.col("base_agreement_id").alias("_d"), F.col("type").alias("_t"), F.col("ref_id").alias("pred"), "char_start", "char_end")
    met = gold.join(pred, (F.col("doc") == F.col("_d")) & (F.col("type") == F.col("_t")) & (F.col("s") < F.col("char_end")) & (F.col("char_start") < F.col("e")))
    inter = F.least("e", "char_end") - F.greatest("s", "char_start")
    union = F.greatest("e", "char_end") - F.least("s", "char_start")
    return met.select("doc", "type", "gold", "pred", inter.alias("inter"), union.alias("union")).where(F.col("inter") * 10 >= F.col("union") * tenths)


def matched(edges: DataFrame) -> DataFrame:
    """A matching of most pairs, then most overlap, then smallest ids, for each document and type.

    Augmenting paths of least cost over exact integers; a group is one
    document's clauses of one type.
    """

    def best(edges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, float]]:
        scale = math.lcm(*{u for *_, u in edges})
        worth = {(a, b): i * (scale // u) for a, b, i, u in edges}
        if len(worth) == 1:
            return [(*k, w / scale) for k, w in worth.items()]
        gold, pred = sorted({a for a, _ in worth}), sorted({b for _, b in worth})
        # a tie is broken by the sum of ranks, scaled below any difference in overlap
        ranks = {(a, b): i for i, (a, b) in enumerate(sorted(worth))}
        small = len(ranks) * (len(ranks) + 1)
        cost = {k: -(w * small) + ranks[k] for k, w in worth.items()}
        of_gold: dict = {}
        of_pred: dict = {}
        while True:
            far = {("g", x): (0, None) for x in gold if x not in of_gold}
            for _ in range(2 * (len(gold) + len(pred))):
                moved = False
                for (a, b), c in cost.items():
                    if of_gold.get(a) != b and ("g", a) in far and far["g", a][0] + c < far.get(("p", b), (math.inf,))[0]:
                        far["p", b] = (far["g", a][0] + c, a)
                        moved = True
                    if of_gold.get(a) == b and ("p", b) in far and far["p", b][0] - c < far.get(("g", a), (math.inf,))[0]:
                        far["g", a] = (far["p", b][0] - c, b)
                        moved = True
                if not moved:
                    break
            ends = [(far["p", b][0], b) for b in pred if b not in of_pred and ("p", b) in far]
            if not ends:
                break
            b = min(ends)[1]
            while True:
                a = far["p", b][1]
                step = of_gold.get(a)
                of_gold[a], of_pred[b] = b, a
                if step is None:
                    break
                b = step
        return [(a, b, worth[a, b] / scale) for a, b in sorted(of_gold.items())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, type_, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tuples(batch.column(2))):
                out += [(doc, type_, *found) for found in best(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * len(MATCHED), MATCHED.types)], schema=MATCHED)

    groups = edges.groupBy("doc", "type").agg(F.collect_list(F.struct("gold", "pred", "inter", "union")).alias("edges"))
    return groups.mapInArrow(kernel, "doc long, type string, gold long, pred long, iou double")


def scores(tp: Column, n_pred: Column, n_gold: Column) -> list[Column]:
    """Precision, recall and F1; without predictions precision is 1 only if there is no gold either, without gold recall is 1."""
    p = F.when(n_pred == 0, F.when(n_gold == 0, 1.0).otherwise(0.0)).otherwise(tp / n_pred)
    r = F.when(n_gold == 0, 1.0).otherwise(tp / n_gold)
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")]


def label_scores(g: Graph) -> DataFrame:
    """A length rule against the quality labels, for each language and in all (null)."""
    rows = g.table("labels").join(g.table("documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", (F.col("quality") == 1).alias("gold"), (F.col("n_chars") > 900).alias("pred"))
    counts = rows.rollup("lang").agg(F.count_if(F.col("gold") & F.col("pred")).alias("tp"), F.count_if("pred").alias("n_pred"), F.count_if("gold").alias("n_gold"))
    return counts.select("lang", "tp", "n_pred", "n_gold", *scores(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def macro_scores(g: Graph) -> DataFrame:
    """Means over the languages that have gold."""
    rows = label_scores(g).where("lang IS NOT NULL AND n_gold > 0")
    return rows.agg(F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("f1"), 4).alias("f1"))


def field_accuracy(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """For each field of pairs (gold_x, pred_x): how often known, and right where known. Texts compare without case and spacing."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", " ")))
    parts = F.array(*(F.struct(F.lit(x).alias("field"), norm(f"gold_{x}").alias("g"), norm(f"pred_{x}").alias("p")) for x in fields))
    rows = pairs.select(F.explode(parts).alias("f")).select("f.*")
    known = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull())
    return rows.groupBy("field").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.try_divide(known, F.count_if(F.col("g").isNotNull())), 6).alias("coverage"),
        F.round(F.try_divide(F.count_if(F.col("g") == F.col("p")), known), 6).alias("accuracy"),
    )


def multiset_matches(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """I-th with i-th of equal keys; matched is the size of the multisets' intersection."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    a, b = gold.withColumn("_n", at), pred.withColumn("_n", at)
    hits = a.join(b.select(*key, "_n"), [*key, "_n"], "left_semi").agg(F.count(F.lit(1)).alias("matched"))
    sizes = gold.agg(F.count(F.lit(1)).alias("n_gold")).crossJoin(pred.agg(F.count(F.lit(1)).alias("n_pred")))
    return hits.crossJoin(sizes).select("matched", "n_gold", "n_pred")  # three one-row frames


def gate_metrics(decisions: DataFrame, reference: DataFrame) -> DataFrame:
    """Skips against a reference (run_id, category, positive): misses, safe skips and rates."""
    rows = decisions.join(reference, ["run_id", "category"])
    return rows.agg(
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(F.col("run_check") & F.col("positive")).alias("caught"),
        F.count_if(~F.col("run_check") & F.col("positive")).alias("missed"),
        F.count_if(~F.col("run_check") & ~F.col("positive")).alias("safe_skips"),
        F.round(F.try_divide(F.count_if(F.col("run_check") & F.col("positive")), F.count_if("positive")), 6).alias("recall"),
    )


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population deviation, least and greatest."""
    v = F.col(value)
    return rows.groupBy(key).agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))


def costs(attempts: DataFrame, tariff: DataFrame) -> DataFrame:
    """Cost of each run in millionths; one attempt at an unknown model leaves its run without a price."""
    rows = attempts.join(F.broadcast(tariff), "model", "left")
    return rows.groupBy("run").agg(total_or_null(F.col("tokens") * F.col("price")).alias("cost"), F.count(F.lit(1)).alias("attempts"))


def admitted(requests: DataFrame, limit: int) -> DataFrame:
    """Requests are let through in order while their sum stays within the limit; the first that doesn't fit stops all later ones."""
    upto = Window.partitionBy("account").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("amount").over(upto)
    rows = requests.withColumn("_t", total).withColumn("admitted", F.max((F.col("_t") > limit).cast("int")).over(upto) == 0)
    return rows.select("account", "at", "amount", "admitted")
