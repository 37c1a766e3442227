import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundline.functions import stats
from groundline.functions import text as T
from groundline.operators import change, ingest, metrics, read, rules, snapshot, timing


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("pay $1,500.00 now", [150000]), ("-$20.00", [-2000]), ("($3,000)", [-300000]), ("$1,50 or $1.234", []), ("$5 and $7.50", [500, 750]), ("none", [])],
)
def test_money(spark, text, want):
    assert one(spark, text, T.money) == want


def test_dates_and_cues(spark):
    found = one(spark, "due by March 5, 2011, not February 31, 2020 or 2012-06-01", T.dates)
    assert [(r["start"], r["date"]) for r in found] == [(7, dt.date(2011, 3, 5)), (47, dt.date(2012, 6, 1))]
    assert one(spark, "due by March 5, 2011", lambda t: T.has_due_cue(t, F.lit(7)))
    assert not one(spark, "on the day March 5, 2011", lambda t: T.has_due_cue(t, F.lit(11)))


def test_day_offsets(spark):
    assert one(spark, "10 days after it, 5 days before that", T.day_offsets) == [10, -5]
    assert one(spark, "10 days", T.day_offsets) == []


@pytest.mark.parametrize(("text", "want"), [("a [***] b", "redacted"), ("[REDACTED]", "redacted"), ("____", "blank"), ("[ ]", "blank"), ("[*]", "active"), ("**", "active"), ("[●] ***", "redacted")])
def test_markers(spark, text, want):
    assert one(spark, text, T.status_of) == want


def test_occurrences_have_code_point_offsets(spark):
    found = one(spark, "😀ab😀 ab", lambda t: T.occurrences(t, "ab"))
    assert [(r["start"], r["match"]) for r in found] == [(1, "ab"), (5, "ab")]


def test_timing_precedence(spark):
    rows = [
        (1, "within 10 days after the Commencement Date", "within_after", 10, "defined_event", None),
        (2, "no later than 30 business days after notice", "no_later_than_after", 30, "notice", "business_days"),
        (3, "at least five (5) months prior to delivery", "count_prior_to", -5, "completion", "unsupported_unit"),
        (4, "upon the Commencement Date Extension Date", "upon", None, "other_event", None),
        (5, "no words of time", None, None, None, None),
        (6, "upon .", None, None, None, None),
        (7, "within [***] days after notice", "within_after", None, "notice", "redacted_offset"),
        (8, "Pay promptly", None, None, None, "anchor_not_found"),
        (9, "WITHIN ONE HUNDRED\u00a0TWENTY DAYS OF DEMAND", "within_after", 120, "demand", None),
        (10, "2.1 If it rains, pay upon demand, not before", "upon", None, "demand", None),
        (11, "If it rains upon demand, pay", "upon", None, "demand", "conditional_or_compound"),
    ]
    frame = spark.createDataFrame([(i, q, 1) for i, q, *_ in rows], "id long, quote string, agreement_id long")
    found = {r["id"]: r for r in timing.parsed(frame).collect()}
    for i, quote, construction, offset, kind, reason in rows:
        r = found[i]
        assert (r["construction"], r["offset"], r["trigger_kind"], r["reason"]) == (construction, offset, kind, reason), i
        assert construction is None or quote[r["trigger_start"] : r["trigger_end"]].strip(), i
    assert quote_of(found[1]) == rows[0][1] and found[10]["trigger_start"] == 21


def quote_of(r):
    return r["quote"][r["trigger_start"] : r["trigger_end"]]


def test_anchors_of_the_base_count(spark):
    agreements = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "agreement_id long, base_agreement_id long")
    events = spark.createDataFrame([(1, "Start  Date", dt.date(2020, 1, 1)), (2, "Start Date", dt.date(2020, 2, 1)), (3, "End Date", None)], "agreement_id long, name string, date date")
    rows = spark.createDataFrame([(a, a, "upon the Start Date", None) for a in (1, 2, 3)] + [(4, 3, "upon the Start Date", dt.date(2020, 1, 2)), (5, 3, "upon the End Date", None)], "id long, agreement_id long, quote string, legacy_due date")
    found = {r["id"]: (r["kind"], r["why"], r["bound"]) for r in timing.resolved(timing.parsed(rows), timing.anchor_candidates(events, agreements)).collect()}
    day = dt.date(2020, 1, 1)
    assert found == {1: ("scheduled", None, day), 2: ("unresolved", "conflicting_dates", None), 3: ("scheduled", None, day), 4: ("unresolved", "conflicting_dates", None), 5: ("unresolved", "anchor_without_date", None)}


@pytest.mark.parametrize(("text", "want"), [("30 days of receipt", [30]), ("thirty (30) days after", [30]), ("10 calendar days after", [10]), ("10 business days after", []), ("1,000 days after", []), ("5 days prior\n to it", [-5])])
def test_day_forms(spark, text, want):
    assert one(spark, text, T.day_offsets) == want


def test_needles_are_found_by_their_words(spark):
    frame = spark.createDataFrame([("a  Rent\u00a0is\nDUE \\E now", " rent is due \\E "), ("x", None), ("x", " ")], "t string, n string")
    found = [r[0] for r in frame.select(T.first_at(F.col("t"), F.col("n"), True).alias("x")).collect()]
    assert (found[0]["start"], found[0]["end"]) == (3, 17) and found[1] is None and found[2] is None
    assert not frame.select(T.holds(F.col("t"), F.col("n")).alias("x")).first()["x"]


def test_grounding_nearest_and_ties(spark):
    docs = spark.createDataFrame([(1, "ab x ab y ab aaaa"), (2, "zzz")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, 1, "ab", 6), (2, 1, "ab", 2), (3, 1, "ab", 100), (4, 2, "ab", 0), (5, 1, "aa", 14), (6, 1, "(", 0)], "claim long, doc_id long, span string, claimed_start long")
    found = {r["claim"]: (r["char_start"], r["failure"]) for r in rules.grounded(claims, docs).collect()}
    # claim 2 lies between the hits at 0 and 5: 0 is nearer; claim 3 takes the last; overlapping hits count
    assert found == {1: (5, None), 2: (0, None), 3: (10, None), 4: (None, "not_found"), 5: (14, None), 6: (None, "not_found")}


def test_html_lines(spark):
    html = (
        "<html><head><title>no</title></head><body><p>One  <b>two</b>\nthree</p><script>x</script><table><tr><td>a</td><td></td><td>b</td></tr></table>"
        '<div style="page-break-before: always">Next</div>x<br>y&nbsp;z<hr>last</body></html>'
    )
    rows = ingest.html_lines(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("line").collect()
    assert [(r["span"], r["page"]) for r in rows] == [("One two three", 1), ("a | b", 1), ("Next", 2), ("x", 2), ("y\xa0z", 2), ("last", 3)]


def test_html_without_an_end_of_head(spark):
    pages = [(1, "<html><head><title>no</title><meta charset=x><p>One</p><script>x</script>two"), (2, "<head> <style>s</style>text<br>more"), (3, "<head><title>t</title></head><body>x")]
    rows = ingest.html_lines(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id", "line").collect()
    assert [(r["page_id"], r["span"]) for r in rows] == [(1, "One"), (1, "two"), (2, "text"), (2, "more"), (3, "x")]


def test_matching_prefers_more_pairs(spark):
    # the best single overlap (1, 11) would leave 2 alone
    edges = [(1, "t", 1, 11, 9, 10), (1, "t", 1, 12, 5, 10), (1, "t", 2, 11, 4, 10), (2, "t", 5, 6, 1, 3)]
    found = metrics.matched(spark.createDataFrame(edges, 'doc long, type string, gold long, pred long, inter long, union long')).collect()
    assert sorted((r["doc"], r["gold"], r["pred"]) for r in found) == [(1, 1, 12), (1, 2, 11), (2, 5, 6)]


def test_miss_bound(spark):
    rows = spark.createDataFrame([(0, 5), (0, 3), (0, 0), (1, 10), (10, 10)], "k long, n long").select("k", "n", stats.miss_bound(F.col("k"), F.col("n")).alias("b")).collect()
    got = {(r["k"], r["n"]): r["b"] for r in rows}
    assert abs(got[0, 5] - 0.4507) < 1e-4 and abs(got[0, 3] - 0.6316) < 1e-4 and got[0, 0] is None
    assert abs(got[1, 10] - 0.39416) < 1e-4 and got[10, 10] == 1.0


def test_votes(spark):
    for samples, want in (([True, False, None], True), ([False, False, False], False), ([None, None, None], None), ([True, True, False], True)):
        frame = spark.createDataFrame([(samples,)], "s array<boolean>")
        assert frame.select(change.vote(F.col("s"))[0].alias("a")).first()["a"] == want


def test_null_poisons_sums(spark):
    frame = spark.createDataFrame([(1, 2), (1, None), (2, 3)], "k int, v int")
    assert {r["k"]: r["x"] for r in frame.groupBy("k").agg(change.total_or_null(F.col("v")).alias("x")).collect()} == {1: None, 2: 3}


def test_page_bounds():
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            read.check_page(limit, offset)


def test_write_snapshot_replaces_partitions(spark, tmp_path):
    table = str(tmp_path / "t")
    snapshot.write_snapshot(spark, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), table, "k")
    snapshot.write_snapshot(spark, spark.createDataFrame([(2, "c")], "k int, v string"), table, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(table).collect()) == [(1, "a"), (2, "c")]
