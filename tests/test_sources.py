import json

import pytest

from weftline.sources import readers, writers
from weftline.sources.registry import Registry


def test_inbox_layouts(spark, tmp_path):
    ok = {"id": "1", "text": "hello", "tier": "user_signal"}
    (tmp_path / "a.json").write_text(json.dumps(ok, indent=2))
    (tmp_path / "b.json").write_text(json.dumps([ok, {"id": "2"}, {"id": "3", "text": "there"}]))
    (tmp_path / "c.jsonl").write_text(json.dumps(ok) + "\n" + json.dumps({"id": "4", "text": "more"}) + "\n")
    (tmp_path / "d.txt").write_text("first\n\nsecond\n")
    d = spark.read.text(str(tmp_path), wholetext=True).selectExpr("value", "_metadata.file_path AS path")
    assert sorted(r.text for r in readers.inbox_rows(d).collect()) == ["first", "hello", "hello", "hello", "more", "second", "there"]


def test_json_lines_keep_rejects(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\nbroken\n\n{"id": "2"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path), "id string")
    assert sorted(r.id for r in good.collect()) == ["1", "2"] and [r.line for r in bad.collect()] == ["broken"]


def test_evaluation_set_and_documents(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"facts": [{"id": "f1", "content": "c"}], "items": [{"id": "i", "question": "?", "gold_fact_ids": ["f1", "f2"]}]}))
    facts, items = readers.evaluation_set(spark, str(tmp_path))
    assert facts.count() == 1 and sorted(r.gold_fact_id for r in items.collect()) == ["f1", "f2"]
    assert readers.json_documents(spark, str(tmp_path)).first().run_id == "q"
    assert readers.list_files(spark, str(tmp_path), "*.json").count() == 1


def test_snapshot_and_cache(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "i int, s string")
    writers.snapshot(d, str(tmp_path / "s"))
    assert writers.current(spark, str(tmp_path / "s")).first().s == "a"
    one = writers.cached(d, str(tmp_path / "c"), "a" * 64, "b" * 64, "train")
    assert one.count() == writers.cached(d.limit(0), str(tmp_path / "c"), "a" * 64, "b" * 64, "train").count() == 1


def test_snapshots_claim_numbers(spark, tmp_path):
    d, path = spark.range(3), str(tmp_path / "s")
    assert [writers.snapshot(d, path), writers.snapshot(d.limit(1), path)] == [1, 2]
    (tmp_path / "s" / "claims" / "000000000003").touch()  # a writer that is still at work
    assert writers.snapshot(d.limit(2), path) == 4
    assert writers.current(spark, path).count() == 2 and writers.current(spark, path, 1).count() == 3
    with pytest.raises(ValueError):
        writers.current(spark, path, 3)
    with pytest.raises(ValueError):
        writers.current(spark, str(tmp_path / "none"))


def test_registry(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "r"))
    assert reg.active("m") is None and reg.rollback("m") is None
    reg.register("m", "1", "x", "c", "t0")
    assert reg.register("m", "1", "x", "c", "t9")["created_at"] == "t0"
    with pytest.raises(ValueError):
        reg.register("m", "2", "x", "c", "t1")
    with pytest.raises(ValueError):
        reg.register("m", "2", "y", "", "t1")
    reg.register("m", "2", "y", "c", "t1")
    with pytest.raises(ValueError):
        reg.promote("m", "z")
    assert reg.active("m")["sha256"] == "y" and reg.rollback("m") is None
    reg.promote("m", "x")
    reg.promote("m", "y")
    reg.save()
    reg = Registry(spark, str(tmp_path / "r"))
    assert reg.entries["x"]["superseded_by"] == "y" and reg.rollback("m")["sha256"] == "x" and reg.rollback("m")["sha256"] == "x"


def test_telemetry_labels(spark):
    row = ",".join(["0"] * 41)
    d = spark.createDataFrame([(f"{row},normal,1",), (f"{row},smurf,2",), (f"{row},new_one,3",), (f"{row},Bad!,3",), ("1,2",), (None,), ("",)], "line string")
    got = readers.telemetry_csv(d).collect()
    assert [r.alert is not None for r in got] == [True, True, True, False, False, False, False] and [r.known for r in got[:3]] == [True, True, False]
    assert readers.telemetry_csv(d, domain=True).where("alert is not null").count() == 2
    with pytest.raises(Exception, match="malformed"):
        readers.telemetry_csv(d, strict=True).collect()
