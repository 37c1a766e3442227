import itertools

from pyspark.sql import functions as F

from groundline.llm.hilbert import curve_shards, hilbert_index


def test_curve_is_a_path_through_every_cell(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = list(itertools.product(range(1 << bits), repeat=dims))
        frame = spark.createDataFrame(cells, [f"c{i}" for i in range(dims)])
        frame = frame.select(*(F.col(c).cast("int") for c in frame.columns))
        rows = frame.withColumn("h", hilbert_index([F.col(c) for c in frame.columns], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(len(cells)))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(x - y) for x, y in zip(a[:-1], b[:-1])) == 1


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_law_and_slots(spark):
    rows = [(i, "x" * (i % 7), None if i % 5 == 0 else "en", f"s{i % 3}", None) for i in range(101)] + [(7, None, None, None, None)] * 3
    out = curve_shards(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert len(out) == 104
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(10))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_few_rows_and_none(spark):
    assert curve_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    out = curve_shards(spark.createDataFrame([(None, None, None, None, None)], SCHEMA).withColumn("shard", F.lit(1))).collect()
    assert [(r["size"], r["text_crc32"], r["slot"]) for r in out] == [(16, 0, 0)]


def test_equal_texts_stay_together(spark):
    rows = [(i * 1000, f"t{i % 40}", "en", f"s{i % 3}", None) for i in range(400)] + [(i, "", "de", None, None) for i in range(7)] + [(3, None, None, "s", None)]
    out = curve_shards(spark.createDataFrame(rows, SCHEMA).repartition(6), 12).collect()
    assert len(out) == len(rows)
    places = {}
    for r in sorted(out, key=lambda r: (r["shard"], r["slot"])):
        places.setdefault((r["size"], r["text_crc32"]), set()).add((r["shard"], r["curve_index"]))
    assert all(len({c for _, c in p}) == 1 for p in places.values())
    assert sum(len(p) - 1 for p in places.values()) <= 11  # only cuts by rank divide a group
