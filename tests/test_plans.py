"""What plans must not have: nulls that meet in one task, work done twice, and a Python call for each group."""

import pytest

from groundline.functions import text as T
from groundline.operators import findings, metrics, proposals
from groundline.plans import registry
from pyspark.sql import functions as F
from test_findings import book


@pytest.fixture
def unbroadcast(spark):
    """Joins as they are for tables of any size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_without_a_reference_are_dealt_out(unbroadcast):
    spark = unbroadcast
    raw = spark.createDataFrame([], findings.FINDING)
    chain = spark.createDataFrame([], "run_id long, agreement_id long, role string, text_hash string")
    aliases = spark.createDataFrame([], "base_id long, alias string, doc long")
    entries = spark.createDataFrame([], "doc long, text_hash string, kind string, part string, qualifier string, parent string, first_segment string, last_segment string")
    found = plan(findings.verified_findings(raw, chain, book(spark), aliases, entries))
    assert "hashpartitioning(coalesce(cast(ref_doc" in found and "hashpartitioning(ref_doc" not in found


def test_proposals_are_located_once(unbroadcast):
    found = plan(proposals.verified(unbroadcast.createDataFrame([], proposals.PROPOSAL), book(unbroadcast), ("t1",)))
    assert found.count("MapInArrow") == 1


def test_groups_are_matched_in_batches(spark):
    edges = spark.createDataFrame([(1, "a", 1, 5, 3, 4), (1, "a", 1, 6, 2, 4), (1, "a", 2, 5, 3, 4), (2, "a", 3, 7, 1, 2)], "doc long, type string, gold long, pred long, inter long, union long")
    found = metrics.matched(edges)
    assert "FlatMapGroups" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1, 6, 0.5), (1, "a", 2, 5, 0.75), (2, "a", 3, 7, 0.5)]


def test_occurrences_of_texts_with_marks_of_their_own(spark):
    df = spark.createDataFrame([("\ue000a\U0001f600 ab a",), ("none",), ("",), (None,)], "t string")
    found = [r[0] if r[0] is None else [tuple(o) for o in r[0]] for r in df.select(T.occurrences(F.col("t"), r"\ba\b|ab")).collect()]
    assert found == [[(1, "a"), (4, "ab"), (7, "a")], [], [], None]


@pytest.mark.parametrize(("name", "most"), [("d05_visible_obligation", 12), ("d07_visible_guarantees", 0), ("d04_visible_timing", 2)])
def test_obligations_stay_in_their_buckets(unbroadcast, name, most):
    found = plan(registry.queries()[name](unbroadcast, "/root/testdata/sf0.001"))
    assert found.count("Exchange hashpartitioning") <= most
    assert "Exchange hashpartitioning(id" not in found
