import json

from weftline.operators.schema_drift import consistent_table, derived_columns, path_values, schema_changes

RAW = "raw_id long, feed string, file_no int, file_name string, line_no int, payload string, extra string"


def raw(spark, files):
    rows, n = [], 0
    for no, lines in files.items():
        for i, p in enumerate(lines):
            n += 1
            rows.append((n, "f", no, f"f/{no}", i, p if p is None or isinstance(p, str) else json.dumps(p), "x"))
    return spark.createDataFrame(rows, RAW)


def changes(spark, files):
    return {tuple(r) for r in schema_changes(path_values(raw(spark, files))).collect()}


def obj(i, **kw):
    return {"id": f"r{i}", **kw}


def test_four_kinds(spark):
    a = [obj(i, action=f"do {i}", hardness=i, old=1) for i in range(6)]
    b = [obj(i, act=f"do {i}", hardness=str(i), old=1) for i in range(4, 6)] + [obj(i, act=f"do {i}", hardness=str(i), new=True) for i in range(6, 10)]
    assert changes(spark, {1: a, 3: b}) == {
        ("f/3", "renamed", "action", "act"), ("f/3", "retyped", "hardness", "hardness"), ("f/3", "removed", "old", ""), ("f/3", "added", "", "new"),
    }


def test_noise_is_no_change(spark):
    a = [obj(i, x=i) for i in range(6)]
    b = [obj(i, x=i) for i in range(3, 8)] + ["{broken", None, "null", "[1]", "", obj(9, y=1, x=None), obj(10, x="odd")]
    assert changes(spark, {1: a, 2: b}) == set()


def test_case_counts(spark):
    a, b = [obj(i, name=i) for i in range(4)], [obj(i, Name=i) for i in range(3, 7)]
    assert changes(spark, {1: a, 2: b}) == {("f/2", "renamed", "name", "Name")}
    assert changes(spark, {1: a, 2: [obj(i, Name=i) for i in range(10, 14)]}) == {("f/2", "removed", "name", ""), ("f/2", "added", "", "Name")}


def test_empty(spark):
    assert changes(spark, {}) == set()


def test_table_reports_failed_casts(spark):
    r = raw(spark, {1: [obj(1, hardness=5, action="a"), obj(2, hardness="7"), obj(3, hardness="many"), obj(4, Hardness=2.5), "bad"]})
    t, bad = consistent_table(r, {"hardness": "integer", "recommended_action": "string"}, {"action": "recommended_action"})
    assert {x.record_id: x.hardness for x in t.collect()} == {"r1": 5, "r2": 7, "r3": None, "r4": None}
    assert t.where("record_id = 'r1'").first().recommended_action == "a"
    assert {(x.line_no, x.value) for x in bad.collect()} == {(2, '"many"'), (3, "2.5")}


def test_table_has_every_field_of_any_file(spark):
    a = [obj(i, confidence=i / 10, note=f"n{i}", tags=["t"]) for i in range(6)]
    b = [obj(i, conf=i / 10, note=f"n{i}", tags=["t"]) for i in range(3, 9)]
    c = [obj(i, certainty=i / 10, remark=f"n{i}", shift=i) for i in range(6, 12)]
    c[5] |= {"odd": 1, "confidence": 9.5}
    other = [(900 + i, "g", 1, "g/1", i, json.dumps(obj(i, certainty=0.5)), "x") for i in range(2)]
    r = raw(spark, {1: a, 2: b, 3: c}).union(spark.createDataFrame(other, RAW))
    cols, also = derived_columns(path_values(r), {"id": "string", "confidence": "decimal"})
    t, bad = consistent_table(r, cols, also)
    assert bad.count() == 0 and {"note", "shift", "tags"} <= set(t.columns) and not {"conf", "certainty", "remark"} & set(t.columns)
    rows = {(x.file_name, x.line_no): x for x in t.collect()}
    assert len(rows) == 20 and all(x.confidence is not None for x in rows.values())
    assert all(x.note == f"n{x.id[1:]}" for x in rows.values() if x.feed == "f")
    assert rows["f/3", 0].shift == 6 and rows["f/1", 0].tags == '["t"]'
    assert rows["f/3", 5].confidence == 9.5 and rows["f/3", 5].rest == {"odd": "1", "certainty": "1.1"} and rows["f/1", 0].rest == {}


def test_fields_of_one_file_stay_apart(spark):
    a, b = [obj(i, x=1, y=2) for i in range(4)], [obj(i, x=1, z=2) for i in range(4)]
    c, d = [obj(i, x=1, y=2, z=3) for i in range(4)], [obj(i, x=3, q=1) for i in range(4)]
    cols, _ = derived_columns(path_values(raw(spark, {1: a, 2: b, 5: c, 6: d})), {"id": "string"})
    assert {"x", "y", "z"} <= set(cols)
