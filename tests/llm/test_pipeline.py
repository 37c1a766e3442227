import subprocess
import sys
from pathlib import Path

import pytest
from test_jaccard_join import brute as near_brute
from test_suffix_dedup import brute as cut_brute

import corpus_pipeline
from groundline.llm import vocab

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 90 AND n_chars < 3000")
    odd = spark.createDataFrame([(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "idiot scum trash", "en", "s", 16), (1003, "", "en", "s", 0)], SCHEMA)
    small.unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = f"{tables}/stage{len(kept)}"
        stage(spark, kept[-1], tables).write.parquet(path)
        kept.append(spark.read.parquet(path))
    rows = [[tuple(r) for r in d.collect()] for d in kept]
    for d in kept[:-1]:
        assert d.columns == docs.columns
    assert set(rows[1]) <= set(rows[0])
    # exact dedup: the largest doc_id of each text
    best = {}
    for r in rows[1]:
        best[r[1] or ""] = max(r[0], best.get(r[1] or "", -1))
    assert sorted(r[0] for r in rows[2]) == sorted(best.values())
    # near copies: the smallest doc_id of each component
    found = near_brute([(r[0], r[1]) for r in rows[2]])
    assert sorted(r[0] for r in rows[3]) == sorted({c for _, c in found.values()})
    # repeats
    want = {d: (n - gone) for d, n, gone, *_ in cut_brute([(r[0], r[1]) for r in rows[3]], 50)}
    assert {r[0]: len((r[1] or "").encode()) for r in rows[4]} == want
    # every token is packed once
    library = vocab.tokenizer(vocab.vocabulary(vocab.WORD_BPE))
    tokens = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows[4])
    assert sum(r["length"] for r in kept[5].collect()) == tokens


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_without_the_subpackage(tmp_path):
    (tmp_path / "groundline").mkdir()
    for path in ROOT.glob("groundline/**/*.py"):
        if "llm" not in path.parts:
            target = tmp_path / path.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(path.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1] == "False"
