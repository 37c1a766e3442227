from pyspark.sql import functions as F

from groundline.llm import exact_dedup as x

SCHEMA = "doc_id long, text string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_decisions_and_index(spark):
    docs = frame(spark, [(1, "a", ""), (5, "a", ""), (2, "b", None), (3, None, ""), (4, "", ""), (None, "b", ""), (9, "z" * 200000, "")])
    index = x.new_index(spark)
    rows = {(r["doc_id"], r["text_sha256"][:4]): r for r in x.decisions(docs.drop("keep_id"), x.ingest(docs, index)).collect()}
    assert len(rows) == 7
    kept = sorted(r["doc_id"] for r in rows.values() if r["kept"])
    assert kept == [2, 4, 5, 9]
    assert {r["group_size"] for r in rows.values() if r["doc_id"] in (1, 5)} == {2}
    # a later batch: what the index has is dropped, what is new is appended
    later = frame(spark, [(20, "a", "k"), (21, "new", "k"), (22, "new", "k")])
    assert [tuple(r) for r in x.drop_copies(later, index).collect()] == [(22, "new", "k")]
    assert index.rows().where(F.col("keep_id") == 22).count() == 1
    assert x.drop_copies(later, index).count() == 0


def test_anti_join_does_not_shuffle_the_index(spark):
    index = x.new_index(spark)
    docs = frame(spark, [(i, str(i), "") for i in range(50)])
    x.ingest(docs, index)
    plan = index.unseen(x.batch_groups(docs))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_empty_and_repeated(spark):
    assert x.drop_copies(frame(spark, [])).count() == 0
    same = frame(spark, [(1, "a", "p"), (1, "a", "p")])
    assert x.drop_copies(same).count() == 1


def test_batches_by_falling_id_meet_in_one_index(spark, tmp_path):
    rows = [(i, "abcdefg"[i % 7] * (i % 3 + 1), "") for i in range(200)] + [(None, "a", ""), (None, None, ""), (7, "other", ""), (199, "other", "")]
    docs = frame(spark, rows)
    parts = x.batches(docs, 4)
    assert sum(p.count() for p in parts) == len(rows)
    index = x.new_index(spark)
    new = [x.ingest(p, index).count() for p in parts]
    assert new[0] > 0 and sum(new) == index.rows().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    index.drop()
    assert not spark.catalog.tableExists(index.table)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = len(spark.catalog.listTables())
    found = {(r["doc_id"], r["text_sha256"]): r for r in x.op9_exact_dedup(spark, str(tmp_path)).collect()}
    assert len(spark.catalog.listTables()) == before
    for doc, text, _ in rows:
        import hashlib

        r = found[doc, hashlib.sha256((text or "").encode()).hexdigest()]
        same = [d for d, t, _ in rows if (t or "") == (text or "")]
        assert r["group_size"] == len(same) and r["keep_id"] == max((d for d in same if d is not None), default=None)
        assert r["kept"] == (doc == r["keep_id"])
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert x.op9_exact_dedup(spark, f"{tmp_path}/none").count() == 0


def test_columns_with_the_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "a", "mine", "too"), (2, "a", "keep", "this")], "doc_id long, text string, digest string, _digest string")
    assert [tuple(r) for r in x.drop_copies(docs).collect()] == [(2, "a", "keep", "this")]
