from pyspark.sql import functions as F

from weftline.operators import text as T


def one(spark, c, *values, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(c).collect()]


def test_control_scrub(spark):
    assert one(spark, T.scrub_controls(F.col("t")), "a\x01b\x02c\nd\te\x7f", None, "") == ["abc\nd\te", None, ""]


def test_squeeze_and_key(spark):
    assert one(spark, T.squeeze(F.col("t")), "  a \t b\n", "") == ["a b", ""]
    a, b = one(spark, T.content_key(F.col("t")), "A  b", "a b ")
    assert a == b and a.startswith("distill:") and len(a) == 24


def test_ordered_dedup(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("abacb")] + [(9, None), (10, None)], "ord int, line string")
    rows = T.first_of_each(df, ["line"], ["ord"]).collect()
    assert sorted((r.ord, r.line) for r in rows) == [(0, "a"), (1, "b"), (3, "c"), (9, None)]


def test_repetition_gates(spark):
    loop = "x" * 20 + "the same sentence of about sixty characters, again and again. " * 12
    assert one(spark, T.loops_in_head(F.col("t")), loop, "short", None, " " * 400) == [True, False, False, False]
    assert one(spark, T.loops_anywhere(F.col("t")), loop, "short", None) == [True, False, False]


def test_ngrams_and_leak(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert sorted(r.gram for r in T.shingles(df, "doc_id", "text", 3).collect()) == ["a b c", "b c d"]
    held = spark.createDataFrame([(7, "x b c d")], "doc_id long, text string")
    r = T.leak_report(T.shingles(df, "doc_id", "text", 3), T.shingles(held, "doc_id", "text", 3)).first()
    assert (r.overlap, r.heldout_grams, r.leak_free) == (1, 2, False)
    assert [x.doc_id for x in T.decontaminate(df, held, 3).orderBy("doc_id").collect()] == [2, 3]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.leak_report(T.shingles(df, "doc_id", "text", 3), T.shingles(df, "doc_id", "text", 3)).first().leak_free
    assert T.repetition_fraction(df, "doc_id", "text").count() == 0
    assert T.paragraph_dedup(df).count() == 0


def test_positions(spark):
    from weftline.operators.positions import positions

    d = spark.createDataFrame([(g, i * 7) for g in ("a", None) for i in range(50)] + [("b", 3)], "g string, i long")
    got = positions(d.repartition(5), ["g"], "i", 40).collect()
    assert all(r.pos == r.i // 7 and r.group_rows == 50 for r in got if r.g != "b") and len(got) == 101
    assert sorted(r.pos for r in positions(d, [], "i", 40).collect()) == list(range(101))
    assert positions(d.limit(0), ["g"], "i").count() == 0
