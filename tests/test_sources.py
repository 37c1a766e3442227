import json

import pytest

from groundline.api import Api, NotFound
from groundline.sources import files
from groundline.streaming.proposals import verify_arrivals


def test_files_and_documents(spark, tmp_path):
    import hashlib

    raw = tmp_path / "raw"
    raw.mkdir()
    for name, body in (("a.htm", b"one"), ("b.htm", b"two"), ("c.pdf", b"x"), ("d.htm", b"z")):
        (raw / name).write_bytes(body)
    pins = spark.createDataFrame([("a.htm", hashlib.sha256(b"one").hexdigest()), ("b.htm", "0")], "name string, pin string")
    found = {r["name"]: r["fault"] for r in files.raw_files(spark, str(raw), pins).collect()}
    assert found == {"a.htm": None, "b.htm": "pin_mismatch", "c.pdf": "not_supported", "d.htm": "no_pin"}

    part = lambda a, b, **k: {"char_start": a, "char_end": b, **k}
    sound = {"doc_id": "x", "text": "abcd", "pages": [part(0, 4, page=1)], "sections": [part(0, 2, id="s1"), part(2, 4, id="s2")], "segments": [part(0, 2, id="p1"), part(3, 4, id="p2")]}
    rows = [sound, sound | {"doc_id": "y", "sections": [part(0, 2, id="s1"), part(3, 4, id="s2")]}, sound | {"doc_id": "z", "segments": [part(0, 1, id="p"), part(1, 2, id="p")]}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    faults = {r["doc_id"]: r["fault"] for r in files.document_faults(files.read_documents(spark, str(tmp_path / "d.json"))).collect()}
    assert faults == {"x": None, "y": "sections_do_not_tile", "z": "segment_ids_repeat"}


def test_recorded_answers_and_log(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "f1.json").write_text('{"a": 1, "b": "x"}')
    (tmp_path / "r" / "f2.json").write_text('{"a": 1, "b": "x", "c": 0}')
    (tmp_path / "r" / "f3.json").write_text("{broken")
    rows = files.recorded_answers(spark, str(tmp_path / "r"), "a int, b string", ("a", "b")).collect()
    assert [(r["fingerprint"], r["answer"]["b"]) for r in rows] == [("f1", "x")]
    for n in (1, 2):
        files.append_log(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert files.markdown_table(spark.createDataFrame([(2, None), (1, "a")], "n int, s string")) == "| n | s |\n|---|---|\n| 1 | a |\n| 2 | - |\n"
    with pytest.raises(ValueError):
        files.markdown_table(spark.range(5), 4)
    (tmp_path / "report.md").write_text("a\n<!-- tables:start -->\n| x |\n<!-- tables:end -->\nb")
    assert not files.drifted(str(tmp_path / "report.md"), "| x |\n") and files.drifted(str(tmp_path / "report.md"), "| y |")


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i: json.dumps({"id": i, "quote": f"pay ${i}.00 within 3 days after it", "cents": i * 100})
    for name, ids in (("a", [1, 2]), ("b", [3, 7])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(line, ids)))
        verify_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = {r["id"]: (r["amount"], r["offset_days"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {1: (100, 3), 2: (200, 3), 3: (300, 3), 7: (None, 3)}


def test_api(spark):
    api = Api(spark, "/root/testdata/sf0.001")
    page = api.get_obligations(limit=5, party="landlord")
    assert len(page["items"]) == page["returned"] == 5 and page["truncated"] and all(len(i["clauses"]) >= 1 and i["owed_to_binding"]["role"] == "landlord" for i in page["items"])
    assert [(i["effective_due"] is None, str(i["effective_due"]), i["agreement_id"], i["id"]) for i in page["items"]] == sorted((i["effective_due"] is None, str(i["effective_due"]), i["agreement_id"], i["id"]) for i in page["items"])
    due = api.upcoming_deadlines("1997-01-01")
    assert due["pending"] == due["contingent"] + due["unresolved"] + due["untimed"]
    try:
        api.check_change_order(-1)
        raise AssertionError
    except NotFound:
        pass
