import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.llm import packing, token_counts, vocab

SCHEMA = "doc_id long, text string, bin string"


def docs(spark, n=300):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "of", "wordly", "x!"]) for _ in range(rng.randrange(1, 900))), "") for i in range(n)]
    return rows + [(n, None, ""), (n + 1, "", ""), (n + 2, "word " * 9000, ""), (None, "null id", ""), (3, rows[3][1], ""), (3, rows[3][1], "")]


def test_classes_are_packed_by_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randrange(1, rng.choice([9, 65])) for _ in range(rng.randrange(1, 80))]
        free = []
        for size in sorted(sizes, reverse=True):
            fit = [f for f in free if f >= size]
            if fit:
                free.remove(min(fit))
            free.append((min(fit) if fit else 64) - size)
        found = packing.fit_classes({s: sizes.count(s) for s in sizes}, 64)
        assert sorted(64 - fill for n, fill, _ in found for _ in range(n)) == sorted(free)
        assert all(fill == sum(s * k for s, k in held) <= 64 for _, fill, held in found)
        assert sorted(s for n, _, held in found for s, k in held for _ in range(n * k)) == sorted(sizes)


@pytest.mark.parametrize(("parts", "fan"), [(1, 8), (16, 8), (64, 8), (64, 2)])
def test_as_few_sequences_as_can_be(spark, parts, fan):
    found = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(parts), vocab.vocabulary(vocab.WORD_BPE), fan=fan)
    r = found.agg(F.sum("length").alias("tokens"), F.count_distinct("sequence_id").alias("n")).first()
    assert r["n"] <= -(-r["tokens"] // 2048) + 1


def test_every_token_once(spark):
    rows = docs(spark)
    path = vocab.vocabulary(vocab.WORD_BPE)
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(11), path, fan=2).collect()
    library = vocab.tokenizer(path)
    want = {}
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            key = (doc, piece, start, len(ids[start : start + 2048]), zlib.crc32(np.array(ids[start : start + 2048], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    have = {}
    by = {}
    for r in out:
        have[tuple(r[:5])] = have.get(tuple(r[:5]), 0) + 1
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == want
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n * k[3] for k, n in want.items())
    assert len(by) <= -(-total // 2048) + 1


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), vocab.vocabulary(vocab.WORD_BPE)).count() == 0


def test_scan_over_small_blocks(spark, tmp_path):
    path = vocab.vocabulary(vocab.WORD_BPE)
    end = token_counts.separator(path)
    rows = docs(spark, 40)
    folder = f"file://{tmp_path}/tokens"
    manifest = token_counts.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, path).collect()
    want = sorted((len(vocab.tokenizer(path).encode(t or "", add_special_tokens=False).ids), d or -1) for d, t, _ in rows)
    names = {(r["file"], r["ordinal"]): r["doc_id"] for r in manifest}
    for block in (1, 7, 64, 1 << 20):
        out = token_counts.count_tokens(token_counts.listed(spark, folder), end, block if block > 1 else 5).collect()
        assert sorted((r["n_tokens"], names[r["file"], r["ordinal"]] or -1) for r in out) == want
        assert all(r["terminated"] for r in out)


def test_unterminated_and_empty_documents(spark, tmp_path):
    (tmp_path / "a.u16").write_bytes(np.array([9, 9, 1, 9, 1, 1, 1], "<u2").tobytes())
    (tmp_path / "b.u16").write_bytes(np.array([9, 9], "<u2").tobytes())
    for block in (1, 2, 3, 100):
        out = token_counts.count_tokens(token_counts.listed(spark, str(tmp_path)), 9, block).collect()
        assert sorted((r["file"], r["ordinal"], r["n_tokens"], r["terminated"]) for r in out) == [
            ("a.u16", 0, 0, True), ("a.u16", 1, 0, True), ("a.u16", 2, 1, True), ("a.u16", 3, 3, False), ("b.u16", 0, 0, True), ("b.u16", 1, 0, True),
        ]


def test_no_documents(spark):
    assert token_counts.write_token_files(spark.createDataFrame([], SCHEMA), "file:///tmp/groundline-none", vocab.vocabulary(vocab.WORD_BPE)).count() == 0
    assert F is not None
