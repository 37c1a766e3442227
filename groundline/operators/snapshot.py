"""Versioned snapshots of a graph: dictionaries, merges, resolution, replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions.text import merge_key


def party_dictionary(names: DataFrame) -> DataFrame:
    """One id for each exact name, the same in every run."""
    return names.select("name").where("name IS NOT NULL").distinct().select("name", F.xxhash64("name").alias("party_id"))


def merged_events(proposed: DataFrame, declared: DataFrame) -> DataFrame:
    """Events (agreement_id, name, date) by normalised name: declared dates win, equal dates fold, different ones leave none."""

    def folded(frame: DataFrame, tag: str) -> DataFrame:
        rows = frame.groupBy("agreement_id", merge_key(F.col("name")).alias("key"))
        return rows.agg(F.count_distinct("date").alias(f"{tag}_n"), F.min("date").alias(f"{tag}_date"), F.min("name").alias(f"{tag}_name"))

    both = folded(declared, "d").join(folded(proposed, "p"), ["agreement_id", "key"], "full_outer")
    date = F.when(F.coalesce("d_n", F.lit(0)) > 0, F.when(F.col("d_n") == 1, F.col("d_date"))).when(F.col("p_n") == 1, F.col("p_date"))
    return both.select("agreement_id", "key", F.coalesce("d_name", "p_name").alias("name"), date.alias("date"))


def resolved_parties(mentions: DataFrame, bindings: DataFrame) -> DataFrame:
    """A mention (id, agreement_id, role, name) by a role only one party has, else by a name only one has, else not at all."""
    by_role = bindings.groupBy(F.col("agreement_id").alias("_a1"), F.col("role").alias("_r")).agg(F.count_distinct("party_id").alias("_n1"), F.min("party_id").alias("_p1")).where("_n1 = 1")
    by_name = bindings.groupBy(F.col("agreement_id").alias("_a2"), F.col("name").alias("_m")).agg(F.count_distinct("party_id").alias("_n2"), F.min("party_id").alias("_p2")).where("_n2 = 1")
    rows = mentions.join(by_role, (F.col("agreement_id") == F.col("_a1")) & (F.col("role") == F.col("_r")), "left").join(by_name, (F.col("agreement_id") == F.col("_a2")) & (F.col("name") == F.col("_m")), "left")
    return rows.select("id", F.coalesce("_p1", "_p2").alias("party_id"))


def resolved_anchors(wanted: DataFrame, events: DataFrame) -> DataFrame:
    """An anchor name (id, agreement_id, base_agreement_id, key) by the only event of that name in the agreement, else in its base."""
    one = events.groupBy(F.col("agreement_id").alias("_a"), F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min("event_id").alias("event_id")).where("_n = 1").drop("_n")
    own = one.select(F.col("_a").alias("_a1"), F.col("_k").alias("_k1"), F.col("event_id").alias("_e1"))
    base = one.select(F.col("_a").alias("_a2"), F.col("_k").alias("_k2"), F.col("event_id").alias("_e2"))
    rows = wanted.join(own, (F.col("agreement_id") == F.col("_a1")) & (F.col("key") == F.col("_k1")), "left").join(base, (F.col("base_agreement_id") == F.col("_a2")) & (F.col("key") == F.col("_k2")), "left")
    return rows.select("id", F.coalesce("_e1", "_e2").alias("event_id"))


def replaced(stored: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """The stored rows with those of every key in the snapshot replaced by the snapshot's."""
    return stored.join(snapshot.select(key).distinct(), key, "left_anti").unionByName(snapshot)


def write_snapshot(spark: SparkSession, rows: DataFrame, table: str, key: str) -> None:
    """Replace whole partitions of a table in one commit; other partitions stay as they are."""
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy(key).parquet(table)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def change_run_faults(chain: DataFrame, current: DataFrame, findings: DataFrame, texts: DataFrame) -> DataFrame:
    """What speaks against storing runs (run_id, fault, n): members whose extraction has moved, and spans that aren't slices of their document.

    chain: (run_id, agreement_id, text_hash); current: (agreement_id,
    text_hash, complete); findings: (run_id, agreement_id, char_start,
    char_end, span_text), a row for each cited side; texts: (doc_id, text).
    """
    now = current.where("complete").select(F.col("agreement_id").alias("_a"), F.col("text_hash").alias("_h"))
    moved = chain.join(now, (F.col("agreement_id") == F.col("_a")) & (F.col("text_hash") == F.col("_h")), "left_anti").select("run_id", F.lit("stale_snapshot").alias("fault"))
    told = texts.select(F.col("doc_id").alias("_d"), "text")
    slice_ = F.expr("substring(text, char_start + 1, char_end - char_start)")
    wrong = findings.join(told, F.col("agreement_id") == F.col("_d"), "left").where(~slice_.eqNullSafe(F.col("span_text"))).select("run_id", F.lit("span_mismatch").alias("fault"))
    members = chain.select(F.col("run_id").alias("_r"), F.col("agreement_id").alias("_m"))
    foreign = findings.join(members, (F.col("run_id") == F.col("_r")) & (F.col("agreement_id") == F.col("_m")), "left_anti").select("run_id", F.lit("not_in_chain").alias("fault"))
    return moved.unionByName(wrong).unionByName(foreign).groupBy("run_id", "fault").agg(F.count(F.lit(1)).alias("n"))


def replaced_runs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored runs (run_id, change_order, mode) after new ones: one for each order and mode; a new ungated run drops the gated one that was paired with the old."""
    same = new.select(F.col("change_order").alias("_c"), F.col("mode").alias("_m")).distinct()
    dropped = same.unionByName(same.where("_m = 'ungated'").select("_c", F.lit("gated").alias("_m"))).distinct()
    return stored.join(dropped, (F.col("change_order") == F.col("_c")) & (F.col("mode") == F.col("_m")), "left_anti").unionByName(new)


def missing_outcomes(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Of a gated run's checks (change_order, category, fingerprint) those whose baseline stored no outcome for the same request."""
    return wanted.join(stored, ["change_order", "category", "fingerprint"], "left_anti")


def precondition_faults(snapshot: DataFrame, pins: DataFrame) -> DataFrame:
    """Rows whose digest isn't the pinned one, or that have no pin."""
    rows = snapshot.join(pins.select(F.col("doc").alias("_d"), "pin"), F.col("doc") == F.col("_d"), "left")
    fault = F.when(F.col("pin").isNull(), "no_pin").when(F.col("pin") != F.col("digest"), "pin_mismatch")
    return rows.select("doc", fault.alias("fault")).where("fault IS NOT NULL")


def fingerprint(*parts: F.Column) -> F.Column:
    """SHA-256 of the parts with a NUL between them."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests with their recorded answers; a strict replay has no row without one."""
    return requests.join(recorded, "fingerprint", "left").select("id", "fingerprint", "answer", F.col("answer").isNull().alias("miss"))


def log_mismatches(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Current runs without a log record of the same run."""
    latest = log.groupBy("agreement_id").agg(F.max("run").alias("run"))
    return runs.select("agreement_id", "run").join(latest, ["agreement_id", "run"], "left_anti")


def validation_errors(gold: DataFrame) -> DataFrame:
    """The first rule that a gold row breaks."""
    error = (
        F.when(F.col("span_end") <= F.col("span_start"), "empty_span")
        .when(~F.col("status").isin("active", "redacted", "blank"), "bad_enum:status")
        .when(F.col("due_date").isNotNull() & ~F.col("due_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "bad_date")
        .when(F.col("anchor").isNull() != F.col("offset_days").isNull(), "anchor_iff_offset")
    )
    return gold.select("id", error.alias("error")).where("error IS NOT NULL")
