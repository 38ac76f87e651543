import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm.group_splits import divided_records, record_cell_keys, related_roots, spanning_forest, split_groups
from weftline.llm.mixing import balanced, mix, unreachable
from weftline.llm.sampling import bounded_quotas, controlled_rounding, draw_sample, quota_report

T = "plan_name string, sample_rows long, classification string, category string, target_share double, min_rows long, supply long"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.randoms(use_true_random=False))
def test_rounding_keeps_both_margins(r, c, rnd):
    t = np.array([[rnd.choice([0, rnd.random() * 9, rnd.randint(0, 5)]) for _ in range(c)] for _ in range(r)], float)
    x = controlled_rounding(t)
    assert np.all(np.abs(x - t) < 1)
    for got, want in ((x.sum(0), t.sum(0)), (x.sum(1), t.sum(1)), (x.sum(), t.sum())):
        assert np.all(np.abs(got - want) < 1 + 1e-9)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 4), st.integers(1, 5), st.randoms(use_true_random=False))
def test_quotas_keep_bounds_and_margins_where_these_allow_it(r, c, rnd):
    t = np.array([[rnd.random() * 9 for _ in range(c)] for _ in range(r)])
    high = np.array([[rnd.choice([0, 3, 50, 50]) for _ in range(c)] for _ in range(r)])
    low = np.minimum(high, [[rnd.choice([0, 0, 2, 5]) for _ in range(c)] for _ in range(r)])
    q, whole = bounded_quotas(t, low, high), controlled_rounding(t)
    assert np.all((low <= q) & (q <= high))
    assert q.sum() == max(min(whole.sum(), high.sum()), low.sum())
    free = bounded_quotas(t, 0 * low, 0 * high + 50)
    assert np.array_equal(free.sum(0), whole.sum(0)) and np.array_equal(free.sum(1), whole.sum(1))


def test_quotas_move_within_their_row_and_column():
    t = np.array([[10.0, 10.0], [10.0, 10.0]])
    q = bounded_quotas(t, np.array([[0, 0], [0, 15]]), np.full((2, 2), 40))
    assert q.tolist() == [[15, 5], [5, 15]]
    q = bounded_quotas(t, np.zeros((2, 2), int), np.array([[4, 40], [40, 40]]))
    assert q.tolist() == [[4, 16], [16, 4]]


def records(spark):
    rows = [(f"r{i % 90}", ["Normal", "normal ", "'malicious'", None][i % 4], ["A b", "a-B", None][i % 3], i, 1) for i in range(200)] + [(None, "normal", "A b", 999, 1)]
    return spark.createDataFrame(rows, "id string, classification string, category string, record_no long, row_key long")


def targets(spark):
    rows = [("p", 40, "normal", "A B", 0.7, 1, 0), ("p", 40, "malicious", "A B", 0.1, 30, 0), ("p", 40, "unknown", "A B", 0.2, None, 0), ("q", 10, "normal", "A B", 1.0, 0, 0), ("z", 0, "normal", "A B", None, None, 0)]
    return spark.createDataFrame(rows, T)


def test_quotas(spark):
    r = records(spark)
    n = {k: len({i % 90 for i in range(200) if i % 4 in v and i % 3 < 2}) for k, v in (("normal", (0, 1)), ("malicious", (2,)))}
    q = {(x.plan_name, x.row_name): x for x in quota_report(r, targets(spark)).collect()}
    assert q["p", "normal"].supply == n["normal"] and q["p", "malicious"].supply == n["malicious"]
    assert q["p", "malicious"].need == 30 and q["p", "malicious"].met == (n["malicious"] >= 30)
    assert (q["p", "unknown"].supply, q["p", "unknown"].need, q["p", "unknown"].met, q["p", "unknown"].quota) == (0, 8, False, 0)
    assert (q["z", "normal"].need, q["z", "normal"].met) == (0, True)
    s = draw_sample(r, targets(spark), "record_no")
    got = {(x.plan_name): x["count"] for x in s.groupBy("plan_name").count().collect()}
    assert got == {"p": q["p", "normal"].quota + q["p", "malicious"].quota, "q": 10}
    assert s.groupBy("plan_name", "id", "record_no").count().where("count > 1").count() == 0
    assert quota_report(r.limit(0), targets(spark)).where("supply > 0").count() == 0
    assert quota_report(r, targets(spark).limit(0)).count() == 0


def test_forest_has_one_edge_less_than_nodes(spark):
    e = spark.createDataFrame([(i, (i * 7 + 3) % 50) for i in range(50)] + [(100, 101), (100, 101), (5, 5)], "u long, v long")
    forest, roots = spanning_forest(e)
    n, c = roots.count(), roots.select("root").distinct().count()
    assert forest.distinct().count() == n - c
    assert roots.where("node in (100, 101)").select("root").distinct().count() == 1
    assert spanning_forest(e.limit(0))[1].count() == 0


def test_relations_through_any_key(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, "c", "y"), (5, None, None), (6, None, None), (7, None, "y")]
    d = spark.createDataFrame(rows, "id long, author string, src string")
    r = {x.id: x.root for x in related_roots(d, "id", [F.col("author"), F.col("src")]).collect()}
    assert r[1] == r[2] == r[3] and r[4] == r[7] and len({r[1], r[4], r[5], r[6]}) == 4


def test_splits_keep_groups_and_proportions(spark):
    rows = [(i, f"g{i % 3}" if i % 10 == 0 else f"s{i // 4}") for i in range(8000)]
    d = spark.createDataFrame(rows, "id long, g string")
    roots = related_roots(d, "id", [F.col("g")])
    s = split_groups(roots, {"train": 0.8, "val": 0.1, "test": 0.1})
    assert s.select("root").distinct().count() == s.count() == roots.select("root").distinct().count()
    size = {r.split: r.n for r in s.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert abs(size["train"] - 6400) < 160 and abs(size["val"] - 800) < 160
    assert split_groups(roots.limit(0), {"train": 1.0}).count() == 0


def test_divided(spark):
    c = "record_no long, id string, category string, grid_index int, split_name string, root long, split string"
    rows = [(1, "v3_000007.0", "A b", None, "train"), (2, "engine-v4-s000007-1", "a-B", -1, "val"), (3, "x", "A b", 7, None), (4, "y", "A b", 8, "train"), (5, "y", None, 7, "eval"), (6, "odd", "A b", None, "eval"), (7, None, "A b", 7, "train")]
    d = spark.createDataFrame([(*r, 0, "s") for r in rows], c)
    assert sorted(r.id for r in divided_records(d, "record_no", "split_name", record_cell_keys()).collect()) == [1, 2, 7]
    assert divided_records(d.limit(0), "record_no", "split_name", record_cell_keys()).count() == 0


def test_mix(spark):
    sizes = spark.createDataFrame([(i, ["a", "b", "c", None][i % 4], "en", 10) for i in range(400)] + [(900, "a", "de", 0)], "id long, source string, lang string, tokens long")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.4, 1), ("c", 0.05, None), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    r = balanced(sizes, t)
    assert unreachable(r) == ["b", "none"]
    assert np.allclose(np.exp(r.source[[0, 2]] + r.lang[0]), [2.0, 0.2], rtol=1e-6) and r.full.tolist() == [False, True, False, False]
    docs, report = mix(sizes, t)
    c = {(r.source): (r.lo, r.hi) for r in docs.groupBy("source").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()}
    assert c["a"] in ((1, 2), (2, 2), (2, 3)) and c["b"] == (1, 1) and c[None] == (0, 0)
    got = {r.source: r for r in report.collect()}
    assert abs(got["a"].mixed_tokens - 2000) <= 10 and got["b"].mixed_tokens == 1000 and got["none"].mixed_tokens == 0 and 0 < got["c"].mixed_tokens < 500
    assert abs(sum(x.share for x in got.values()) - 1) < 1e-9 and got["b"].missed == 600
    assert mix(sizes.limit(0), t)[0].count() == 0 and mix(sizes, t.limit(0))[0].where("copies > 0").count() == 0


def test_mix_keeps_sources_exact_and_languages_near(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % 3}", ["en", "de"][int(rng.random() < [0.3, 0.5, 0.7][i % 3])], int(rng.integers(1, 400))) for i in range(6000)]
    sizes = spark.createDataFrame(rows, "id long, source string, lang string, tokens long")
    t = spark.createDataFrame([("s0", 0.7, 3), ("s1", 0.2, 2), ("s2", 0.1, 4)], "source string, target_share double, max_repeats int")
    docs, report = mix(sizes, t)
    assert all(abs(r.share - r.target_share) < 0.01 for r in report.collect())
    de = lambda d: d.agg((F.sum(F.when(F.col("lang") == "de", F.col("t"))) / F.sum("t")).alias("x")).first().x
    whole = de(sizes.withColumn("t", F.col("tokens")))
    got = de(docs.join(sizes.drop("source"), "id").withColumn("t", F.col("tokens") * F.col("copies")))
    plain = 0.7 * 0.3 + 0.2 * 0.5 + 0.1 * 0.7  # what source rates alone would give
    assert abs(got - whole) < 0.3 * abs(plain - whole) and docs.agg(F.max("copies")).first()[0] <= 4
