"""Registered queries over a small folder of odd documents, against plain versions of what they promise."""

import hashlib
import zlib

import numpy as np
import pytest

from groundline.llm import registry, vocab, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, _b string, bin int, rank string"
LONG = "der lange Text ist lang, é😀 " * 20_000


@pytest.fixture(scope="module")
def rows():
    texts = ["the cat sat on the mat", "", None, "a", LONG, "the cat sat on the mat", "<|endoftext|> x <|endoftext|>", "ünï cödé   \n\n tabs\t\t", "the cat sat on the mat!" * 40, "123 456", "  x\x00y", LONG + "end"]
    out = [(i * 7 % 12, t, ["en", "de", None][i % 3], "s", None if t is None else len(t), 1, "x", 2, "r") for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, "no id", "en", None, 5, None, None, None, None), (3, "another text of 3", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def run(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def key(row):
    return tuple((x is None, x) for x in row)


def test_op1_fingerprints(spark, folder, rows):
    def windows(text):
        k = min(winnowing.K, len(text))
        if not k:
            return []
        own = (winnowing.gram_hashes(np.array([ord(c) for c in text], np.uint32), k) >> np.uint64(32)).tolist()
        w = min(winnowing.WINDOW, len(own))
        if len(own) > 5000:  # the long text goes through the module's own minima
            hashes, positions = winnowing.winnow(text)
            return list(zip(hashes.tolist(), positions.tolist()))
        chosen = sorted({max(range(i, i + w), key=lambda j: (-own[j], j)) for i in range(len(own) - w + 1)})
        return [(own[j], j) for j in chosen]

    def like(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a and b else float(not a and not b)

    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    want = []
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        a, b, c = windows(text), windows(changed), windows(after)
        want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9), tuple(a)))
    found = []
    for r in run(spark, folder, "op1_winnowing"):
        if r["doc_id"] is not None:
            marks = tuple(zip(*(x.tolist() for x in winnowing.decoded(r["fingerprint"])))) if r["fingerprint"] else ()
            found.append((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), marks))
    assert sorted(found) == sorted(want)


def test_op4_predictions(spark, folder, rows):
    found = run(spark, folder, "op4_language_id")
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    lettered = sorted(key((d,)) for d, t, *_ in rows if not any(c.isalpha() for c in t or ""))
    assert sorted(key((r["doc_id"],)) for r in found if r["lang_pred"] == "und") == lettered


def test_op7_sizes(spark, folder, rows):
    found = run(spark, folder, "op7_hilbert_sharding")
    want = sorted(key((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for d, t, *_ in rows)
    assert sorted(key((r["doc_id"], r["size"], r["text_crc32"])) for r in found) == want
    assert {r["law"] for r in found} == {"rows"} and all(r["grown_shard"] is None for r in found)


def test_op8_is_the_library(spark, folder, rows):
    library = vocab.tokenizer(vocab.vocabulary(vocab.BYTE_BPE))
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append(key((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())))
    found = run(spark, folder, "op8_chunk_bpe")
    assert sorted(key((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in found) == sorted(want)


def test_op10_counts(spark, folder, rows):
    library = vocab.tokenizer(vocab.vocabulary(vocab.WORD_BPE))
    want = sorted(key((d, len(library.encode(t or "", add_special_tokens=False).ids))) for d, t, *_ in rows)
    found = run(spark, folder, "op10_token_counts")
    assert sorted(key((r["doc_id"], r["n_tokens"])) for r in found) == want and all(r["terminated"] for r in found)


def test_op6_pieces(spark, folder, rows):
    library = vocab.tokenizer(vocab.vocabulary(vocab.WORD_BPE))
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    found = run(spark, folder, "op6_best_fit_packing")
    assert sum(r["length"] for r in found) == total
    assert len({r["sequence_id"] for r in found}) <= -(-total // 2048) + 1
