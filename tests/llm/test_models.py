import numpy as np
from pyspark.sql import functions as F

from groundline.llm import language_id, toxicity, winnowing


def test_winnow_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 15, 16, 17, 79, 80, 400):
        text = "".join(rng.choice(list("abé😀"), n))
        k, w = min(winnowing.K, n), 0
        hashes, positions = winnowing.winnow(text)
        if not n:
            assert not len(hashes)
            continue
        codes = np.array([ord(c) for c in text], np.uint32)
        own = (winnowing.gram_hashes(codes, k) >> np.uint64(32)).tolist()
        w = min(winnowing.WINDOW, len(own))
        want = sorted({max(range(i, i + w), key=lambda j: (-own[j], j)) for i in range(len(own) - w + 1)})
        assert positions.tolist() == want
        assert hashes.tolist() == [own[j] for j in want]
        back = winnowing.decoded(winnowing.encoded(hashes, positions))
        assert back[1].tolist() == want
    for i in (3, 9):  # equal grams have equal hashes wherever they are
        assert (winnowing.gram_hashes(np.array([1, 2, 3] * i), 3)[::3] == winnowing.gram_hashes(np.array([1, 2, 3]), 3)[0]).all()


def test_blocks_change_nothing(monkeypatch):
    text = "".join(np.random.default_rng(2).choice(list("abc "), 5000))
    whole = winnowing.winnow(text)
    monkeypatch.setattr(winnowing, "BLOCK", 100)
    parts = winnowing.winnow(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_shared_passage_is_found():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    shared = word(winnowing.K + winnowing.WINDOW - 1)
    a, b = winnowing.winnow(word(300) + shared + word(200)), winnowing.winnow(word(123) + shared + word(50))
    assert len(np.intersect1d(a[0], b[0]))


def test_next_document_in_descending_order(spark):
    import hashlib

    rows = [(i * 3, f"text {i} " * (i % 50), "x") for i in range(200)] + [(None, "lost", ""), (9, "again", ""), (1000, None, "")]
    out = winnowing.compared(spark.createDataFrame(rows, "doc_id long, text string, _b string").repartition(5)).collect()
    assert len(out) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    want = []
    for i, (doc, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        want.append((doc, len(text), hashlib.sha256(winnowing.edited(text, after).encode()).hexdigest()))
    have = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out if r["doc_id"] is not None)
    assert have == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    one = winnowing.compared(spark.createDataFrame([(1, "abcd" * 40)], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
    assert winnowing.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def dense(x):
    return toxicity.Rows(np.repeat(np.arange(x.shape[0]), x.shape[1]), np.tile(np.arange(x.shape[1]), x.shape[0]), x.ravel(), x.shape)


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    line = x @ np.array([2.0, -1.0, 0.0, 0.0]) + rng.logistic(size=3000)
    y = np.searchsorted([-1.0, 0.5, 2.0], line)
    w, t = toxicity.fit_cumulative(dense(x), y, np.ones(3000), noise=0.0)
    assert np.allclose(w, [2, -1, 0, 0], atol=0.3) and np.allclose(t, [-1, 0.5, 2], atol=0.3)
    w, _ = toxicity.fit_cumulative(dense(x), y, np.ones(3000), noise=0.03 * 3000**0.5)
    assert w[2] == w[3] == 0 and w[0] > 1 and w[1] < -0.4


def test_score_is_the_sum_over_thresholds():
    model = toxicity.Model({toxicity.bucket("scum"): 0, toxicity.bucket("^wonde"): 1}, np.array([2.0, -1.0]), np.array([1.0, 2.0, 4.0]))
    line = 2 * np.log1p(2) - np.log1p(1)
    above = [1 / (1 + np.exp(t - line)) for t in (1, 2, 4)]
    severity, grade, p = model.score("Scum, wonderful SCUM!")
    assert np.isclose(severity, sum(above)) and np.isclose(p, above[0])
    assert grade == int(np.argmax([1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]))
    assert model.score(None) == model.score("")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs.where("doc_id % 4 > 0"), labels.where("doc_id % 4 > 0"))
    found = toxicity.score(docs.where("doc_id % 4 = 0"), model).join(labels, "doc_id").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert toxic.rejected.mean() > 0.75
    assert clean.rejected.mean() < 0.02
    assert toxic.severity.mean() > 5 * clean.severity.mean()


def test_toxicity_edges(spark):
    schema = "doc_id long, text string, Severity string"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, "a"), (None, "", None), (2, "idiot " * 50000, "")], schema)
    assert toxicity.clean(docs, toxicity.train(docs, none)).count() == 3
    assert toxicity.clean(docs.limit(0), toxicity.train(docs, none)).count() == 0
    assert {tuple(r) for r in toxicity.clean(docs, toxicity.train(docs, none)).collect()} == {tuple(r) for r in docs.collect()}
    texts = ["you scum idiot", "a kind word", None, "", "scum scum", "kind", "idiot scum", "the word"] * 6
    rows = [(i // 2, t, "") for i, t in enumerate(texts)]  # a doc_id with two texts, repeated texts
    mixed = spark.createDataFrame([*rows, rows[0]], schema)
    labels = spark.createDataFrame([(i // 2, 1, int("scum" in (t or ""))) for i, t in enumerate(texts)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score(mixed, toxicity.train(mixed, labels))
    assert found.columns == ["doc_id", "text", "Severity", "severity_", "grade", "p_toxic", "rejected"] and found.count() == len(rows) + 1


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.train(docs)).join(docs, "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97
    assert (found.lang_pred == found.lang)[~found.rejected].mean() > 0.98


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (4, "the", None), (None, "und", "de"), (6, "the and of " * 20, "en"), (7, "der die das " * 20, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert found[None]["lang_pred"] in ("en", "de")
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.predict(nothing, language_id.train(nothing)).collect()} == {"und"}
