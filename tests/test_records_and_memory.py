import pytest
from pyspark.sql import functions as F

from weftline.operators import memory as M
from weftline.operators import records as R

REC = "record_no long, input string, classification string, risk string, early_warning boolean, evidence array<string>, analysis string, recommended_action string, confidence double, hardness int, category string, dedup_key string, source string, synthetic boolean"
GOOD = (1, " ".join(f"word{i}" for i in range(40)), " Malicious", "high", False, ["e"], "analysis " * 8, "do this and then that and afterwards also check it", 1.5, 1, "?", None, "s", True)


def rec(**kw):
    cols = [c.split()[0] for c in REC.split(", ")]
    return tuple(kw.get(c, v) for c, v in zip(cols, GOOD))


def test_repair(spark):
    r = R.repaired(spark.createDataFrame([rec()], REC)).first()
    assert (r.reason, r.r_class, r.r_risk, r.r_early, r.r_confidence, r.r_hardness, r.r_category) == (None, "malicious", "HIGH", True, 0.97, 70, "Suspicious behavior")


@pytest.mark.parametrize("change, reason", [({"input": None}, "input_too_short"), ({"risk": None}, "bad_risk"), ({"evidence": []}, "evidence_empty"), ({"evidence": None}, "evidence_not_list"), ({"recommended_action": "None."}, "action_is_no_op"), ({"recommended_action": ""}, "no_recommended_action"), ({"confidence": None}, "bad_confidence")])
def test_reject(spark, change, reason):
    assert R.repaired(spark.createDataFrame([rec(**change)], REC)).first().reason == reason


def test_audit_counts_nulls(spark):
    d = spark.createDataFrame([rec(), tuple([2] + [None] * 13)], REC)
    got = {r.fault: r.n for r in R.audit(d).collect()}
    assert got["bad_classification"] == 2 and got["duplicate_record"] == 1 and got["input_too_short"] == 1


@pytest.mark.parametrize("total", [1000, 20000, 7, 0])
def test_quota_sums(spark, total):
    c = spark.createDataFrame([(f"c{i}", w) for i, w in enumerate([20, 20, 20, 10, 10, 5, 5, 5, 5])], "k string, w long")
    q = [r.quota for r in R.quotas(c, total).collect()]
    assert sum(q) == total and min(q) >= 0


def test_class_cap_matches_search(spark):
    for counts in ([620, 145, 129, 106], [10, 10, 10], [500], [100, 60, 50, 45, 1]):
        df = spark.createDataFrame([(n,) for n in counts], "n long")
        best = [k for k in range(40, max(counts) + 1) if max(min(n, k) for n in counts) <= 0.45 * sum(min(n, k) for n in counts) + 1e-9]
        assert R.class_cap(df).first().cap == (max(best) if best else None), counts


def test_stratified_split_small_strata(spark):
    d = spark.createDataFrame([(i, "a", f"k{i}") for i in range(200)] + [(900, "b", "x"), (901, "b", "y"), (902, None, None)], "i long, s string, k string")
    got = {(r.s, r.split): r["count"] for r in R.stratified_split(d, "s", "k").groupBy("s", "split").count().collect()}
    assert got[("a", "val")] == 2 and got[("a", "eval")] == 8 and got[("b", "train")] == 2 and got[(None, "train")] == 1


def test_compaction(spark):
    rows = [("1", "fact", "same", "active", 1, 1, 1), ("2", "fact", "same", "active", 2, 1, 2), ("3", "fact", "gone", "deleted", 1, 1, 3), ("4", "session", "same", "active", 1, 1, 4)]
    c = M.compact(spark.createDataFrame(rows, "id string, kind string, content string, state string, created_at long, revision long, seq long"))
    assert {r.id: r.state_after for r in c.collect()} == {"1": "deprecated", "2": "active", "4": "active"}


def test_heads_with_chain_and_cycle(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 100), (200, 201), (201, 202), (202, 200), (7000, 201)], "id long, next long")
    got = {r.id: r.head for r in M.revision_heads(d).collect()}
    assert all(got[i] == 30 for i in range(1, 31)) and got[100] == got[101] == 100 and got[202] == got[201] == got[7000] == 200


@pytest.mark.parametrize("values, trend, bad", [([2.0, 1.5, 1.2, 1.0, 0.8], "improving", False), ([0.8, 1.0, 1.4, 1.9, 2.5], "regressing", True), ([1.0, 1.04, 1.08, 1.12, 1.16, 1.2, 1.24, 1.28], "stable", True), ([1.0, 1.0], "needs_more_data", False)])
def test_drift(spark, values, trend, bad):
    s = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "name string, seq long, value double")
    r = M.drift(s, window=8, tolerance=0.1).first()
    assert (r.trend, r.drift) == (trend, bad)


def test_gates(spark):
    gates = spark.createDataFrame([("target", "gain", "", 0.1), ("old", "no_regress", "", 0.05)], "metric string, type string, op string, bound double")
    runs = [("good", "target", 5.2, 4.4), ("good", "old", 2.83, 2.84), ("weak", "target", 5.2, 5.15), ("weak", "old", 2.0, 2.0), ("part", "target", 5.2, 4.0)]
    m = spark.createDataFrame(runs, "name string, metric string, base double, candidate double")
    assert {r.name: r.decision for r in M.gate_decisions(m, gates).collect()} == {"good": "ACCEPT", "weak": "REJECT", "part": "MISSING"}
    assert {r.decision for r in M.gate_decisions(m.where("name = 'good'"), gates, manual=True).collect()} == {"PENDING_HUMAN"}


def test_feedback(spark):
    f = spark.createDataFrame([("a", "s", "user_signal", "fine text", 0.2, "verified"), ("b", None, None, None, None, None)], "id string, source string, tier string, text string, confidence double, verification_status string")
    got = {r.id: r.e for r in f.select("id", M.feedback_errors().alias("e")).collect()}
    assert got["a"] == ["low_confidence"] and len(got["b"]) == 5


def test_json_filter(spark):
    d = spark.createDataFrame([(1, '{"a": {"b": 2.5}}'), (2, '{"a": {"b": 3.5}}'), (3, '{"a": {"b": "2"}}'), (4, "x"), (5, None), (6, '{"a": {"b": true}}')], "i int, doc string")
    path, op, v = M.parse_filter("a.b__lt=3.0")
    assert [r.i for r in d.where(M.match_json(F.col("doc"), path, v, op)).collect()] == [1]


def test_fit_events(spark):
    from weftline.operators.generation import fit_events

    ev = lambda *xs: [(imp, ts, i, t) for i, (imp, ts, t) in enumerate(xs)]
    rows = [(1, ev((5, 3, "a" * 10), (9, 1, "b" * 10), (2, 0, "z"), (5, 2, "c" * 10), (4, 9, "dd"))), (2, ev((1, 1, "x" * 99))), (3, []), (4, None), (5, ev((1, 2, "low"), (1, 1, "er")))]
    d = spark.createDataFrame(rows, "i int, e array<struct<imp:int,ts:long,ord:long,text:string>>")
    got = {r.i: r.t for r in d.select("i", fit_events(F.col("e"), budget=30, most=8).alias("t")).collect()}
    assert got[1] == "b" * 10 + " | " + "a" * 10 + " | dd" and got[2] == "x" * 99 and got[3] == got[4] == "" and got[5] == "er | low"


def test_topped_up_split_reaches_its_sizes(spark):
    from weftline.operators.records import topped_up_split

    rows = [(f"c{i % 7}", f"k{i}") for i in range(200)] + [("thin", "t1"), ("thin", "t2"), (None, "x"), ("c0", None), ("c0", "k0")]
    d = spark.createDataFrame(rows, "category string, dedup_key string")
    got = topped_up_split(d, "category", "dedup_key", 0.03, 0.06, 5)
    n = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert sum(n.values()) == 202 and n["val"] >= 6 and n["eval"] >= 12 and got.distinct().count() == 202
    assert got.where("category = 'thin' and split = 'train'").count() >= 1
    assert topped_up_split(d.limit(0), "category", "dedup_key", 0.1, 0.1, 5).count() == 0


def test_positions_of_sparse_orders(spark):
    from weftline.operators.positions import positions

    rows = [(f"g{i % 3}" if i % 10 else None, (i * 7919) ** 2) for i in range(500)] + [("g0", None)]
    d = spark.createDataFrame(rows, "g string, o long")
    got = {}
    for r in positions(d, ["g"], "o").collect():
        got.setdefault(r.g, []).append((r.o if r.o is not None else -1, r.pos, r.group_rows))
    for v in got.values():
        assert [p for _, p, _ in sorted(v)] == list(range(len(v))) and {n for *_, n in v} == {len(v)}
    assert positions(d.limit(0), [], "o").count() == 0
