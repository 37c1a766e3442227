"""Bounded training samples, chosen by hash of doc_id so that every run and every partitioning finds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(ids: DataFrame, rows: int) -> DataFrame:
    """At most `rows` distinct doc_ids: those with the smallest hash. Only ids and hashes are sorted."""
    return ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a bounded set of ids; the set is small by construction, so it's broadcast."""
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")
