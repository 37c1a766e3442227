"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to its
distinct digests, anti-joined with the index by a sort-merge join in which the
index side needs no shuffle, and what is new is appended. Within a batch the
row with the largest doc_id stays.

The query feeds one index in BATCHES batches by falling doc_id, so that of
equal texts the one with the largest doc_id is indexed first and the later
batches' copies are found by the anti-join.

Defined results: null text counts as empty; rows that repeat (doc_id, text)
are one document and share their flags; a null doc_id never wins over another
id; an empty table appends nothing; columns of any name are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.common import discard, documents, fresh, materialize, text_or_empty

BUCKETS = 24
#: Batches by doc_id that the query ingests one after the other.
BATCHES = 3


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """The hexadecimal SHA-256 of each text in UTF-8, as `text_sha256`."""
    return docs.withColumn("text_sha256", F.sha2(text_or_empty(text), 256))


class DigestIndex:
    """Digests seen so far: (digest, keep_id, group_size), bucketed and sorted by digest.

    `table` names a table of the session's catalog whose files are in the
    warehouse. With `location` the same files can be opened by a later session.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS, location: str | None = None):
        self.spark, self.table, self.buckets = spark, table, buckets
        where = f"LOCATION '{location}'" if location else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {where}"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest isn't in the index."""
        return groups.repartition(self.buckets, "digest").join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add groups; each bucket gets one more sorted file."""
        (
            groups.select("digest", "keep_id", "group_size")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .saveAsTable(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def batch_groups(docs: DataFrame) -> DataFrame:
    """One row for each distinct text of a batch; counted before the shuffle, so that hot texts don't gather."""
    return (
        with_digest(docs)
        .groupBy(F.col("text_sha256").alias("digest"))
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )


def ingest(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Append a batch's new texts to the index; return the groups that were new."""
    new = materialize(index.unseen(batch_groups(docs)), "new-digests")
    index.append(new)
    return new


def batches(docs: DataFrame, number: int = BATCHES) -> list[DataFrame]:
    """The documents by falling ranges of doc_id of equal width; rows without doc_id come last."""
    bound = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if bound["a"] is None:
        return [docs]
    cuts = [bound["a"] + (bound["b"] - bound["a"]) * i // number for i in range(number - 1, 0, -1)]
    out = []
    for above, low in zip([None, *cuts], [*cuts, None]):
        wanted = F.lit(True) if above is None else F.col("doc_id") < above
        out.append(docs.where(wanted & (F.col("doc_id") >= low)) if low is not None else docs.where(wanted | F.col("doc_id").isNull()))
    return out


def decisions(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The decision on each row. Both sides are shuffled, so that Spark can split a hot digest."""
    rows = with_digest(docs).select("doc_id", "text_sha256")
    return rows.join(groups.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left").select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", F.lit(0)).cast("long").alias("group_size"),
        (F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"digests_{uuid.uuid4().hex}")


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents whose text is new to the index, one row for each text, with all their columns."""
    own = index is None
    index = index or new_index(docs.sparkSession)
    digest, id_ = fresh(docs, "digest", "keep_id")
    new = ingest(docs, index).select(F.col("digest").alias(digest), F.col("keep_id").alias(id_))
    if own:
        index.drop()  # `new` is in the shared folder
    rows = docs.withColumn(digest, F.sha2(text_or_empty(), 256))
    kept = rows.join(new, (rows[digest] == new[digest]) & rows["doc_id"].eqNullSafe(new[id_]), "left_semi")
    return kept.dropDuplicates([digest]).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = new_index(spark)
    parts = batches(docs)
    for part in parts:
        discard(spark, ingest(part, index))
    # what the index keeps, and how many documents have each text over all batches
    sizes = with_digest(docs).groupBy(F.col("text_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    groups = index.rows().select("digest", "keep_id").join(sizes, "digest").select("digest", "keep_id", F.col("n").alias("group_size"))
    found = materialize(decisions(docs, groups), "decisions")
    index.drop()
    return found


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
