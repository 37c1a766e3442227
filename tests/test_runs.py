from groundline.operators import snapshot


def test_change_runs_are_checked_before_they_are_stored(spark):
    chain = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 10, "a"), (2, 12, "old"), (3, 13, "x")], "run_id long, agreement_id long, text_hash string")
    current = spark.createDataFrame([(10, "a", True), (11, "b", True), (12, "new", True), (13, "x", False)], "agreement_id long, text_hash string, complete boolean")
    texts = spark.createDataFrame([(10, "one two"), (11, "three")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 10, 4, 7, "two"), (1, 11, 0, 3, "thr"), (1, 11, 0, 3, "THR"), (2, 11, 0, 5, "three"), (1, 99, 0, 1, "x")], "run_id long, agreement_id long, char_start long, char_end long, span_text string")
    faults = {(r["run_id"], r["fault"]): r["n"] for r in snapshot.change_run_faults(chain, current, found, texts).collect()}
    assert faults == {(2, "stale_snapshot"): 1, (3, "stale_snapshot"): 1, (1, "span_mismatch"): 2, (1, "not_in_chain"): 1, (2, "not_in_chain"): 1}


def test_a_new_ungated_run_drops_its_gated_pair(spark):
    schema = "run_id long, change_order long, mode string"
    stored = spark.createDataFrame([(1, 5, "ungated"), (2, 5, "gated"), (3, 6, "ungated"), (4, 6, "gated")], schema)
    new = spark.createDataFrame([(7, 5, "ungated"), (8, 6, "gated")], schema)
    assert sorted(r["run_id"] for r in snapshot.replaced_runs(stored, new).collect()) == [3, 7, 8]


def test_outcomes_must_be_of_the_same_request(spark):
    schema = "change_order long, category string, fingerprint string"
    wanted = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], schema)
    stored = spark.createDataFrame([(1, "a", "x"), (1, "b", "z")], schema)
    assert [r["category"] for r in snapshot.missing_outcomes(wanted, stored).collect()] == ["b"]
