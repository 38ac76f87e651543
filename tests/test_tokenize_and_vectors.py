import base64
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import tokenize as K
from weftline.operators import vectors as V

TEXTS = ["hello world\nit's 'fine'", "日本語 🙂 \xa0 x", "", None, "a" * 10000]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_word_round_trip(spark):
    d = docs(spark)
    v = K.vocabulary(K.piece_counts(d), 100, 1)
    got = {r.doc_id: r.text for r in K.decode(K.encode(d, v), v).collect()}
    assert got == {i: t for i, t in enumerate(TEXTS) if t and len(t)}


def test_equal_run_merges_once():
    assert K.merge_pair(np.array([1, 1, 1, 1]), 1, 1, 9).tolist() == [9, 1, 1]
    assert K.merge_pair(np.array([1, 2, 1, 2]), 1, 2, 9).tolist() == [9, 9]


def test_bpe_round_trip(spark):
    d = spark.createDataFrame([(1, "low lower lowest " * 20), (2, None), (3, "ü")], "doc_id long, text string")
    m = K.train_bpe(d, 6)
    assert len(m) == 6 and m[0][2] == 256
    got = {r.doc_id: r.ids for r in K.encode_bpe(d, m).collect()}
    assert K.decode_bpe(got[1], m) == "low lower lowest " * 20 and got[2] is None and K.decode_bpe(got[3], m) == "ü"


def trained_one_by_one(texts, merges, least=2):
    """Recounts all pairs of all whole texts before every single merge."""
    seqs = [np.frombuffer(t.encode(), np.uint8).astype(np.int64) for t in texts if t]
    done = []
    while len(done) < merges:
        n = Counter(p for s in seqs for p in zip(s[:-1].tolist(), s[1:].tolist()))
        best = min(n, key=lambda p: (-n[p], p), default=None)
        if best is None or n[best] < least:
            break
        done.append((*best, 256 + len(done)))
        seqs = [K.merge_pair(s, *done[-1]) for s in seqs]
    return done


def test_bpe_counts_whole_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé \n", k=rng.randint(1, 6))) for _ in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)] + ["a" * 500, "ab" * 300, "", None, "ab" * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = trained_one_by_one(texts, 70)
    assert len(want) == 70 and K.train_bpe(d, 70) == want
    e = K.encode_bpe(d, want)
    assert {r.doc_id: r.text for r in K.decoded_bpe(e, want).collect()} == dict(enumerate(texts))
    assert K.train_bpe(d.limit(0), 5) == []


def test_context_windows_drop_the_rest(spark):
    t = spark.createDataFrame([(1, i, i * 10) for i in range(10)], "doc_id long, pos int, token_id long")
    w = K.context_windows(t, 4).orderBy("window").collect()
    assert [(r.x, r.y) for r in w] == [([0, 10, 20, 30], [10, 20, 30, 40]), ([40, 50, 60, 70], [50, 60, 70, 80])]


def test_vector_blob(spark):
    d = spark.createDataFrame([(1, base64.b64encode(struct.pack("<3f", 1, -2, 3)).decode()), (2, "AAA="), (3, None)], "i long, b string")
    assert [r.vector for r in V.decode_base64_floats(d, "i", "b").orderBy("i").collect()] == [[1.0, -2.0, 3.0], None, None]


@pytest.mark.parametrize("k", [1, 3])
def test_topk_against_numpy(spark, k):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n = x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    want = {(q, i) for q in (0, 5, 7) for i in np.lexsort((np.arange(60), -np.round(n @ n[q], 12)))[:k]}
    got = {(r.query_id, r.id) for r in V.block_topk(d, d.where("vec_id in (0, 5, 7, 99)"), k).collect()}
    assert got == want


def test_topk_by_weights_ranks_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 6)).round(1)
    bonus = (rng.integers(0, 4, 5000) / 4).round(2)
    d = spark.createDataFrame([(i, v.tolist(), float(b)) for i, (v, b) in enumerate(zip(x, bonus))], "vec_id long, embedding array<double>, bonus double").repartition(3)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = V.block_topk(d, d.where("vec_id < 4"), 7, weights={"cos": (1.0, F.lit(0.0)), "both": (0.5, F.col("bonus"))}).collect()
    for name, w, b in (("cos", 1.0, 0 * bonus), ("both", 0.5, bonus)):
        for q in range(4):
            s = w * np.clip(n @ n[q], 0, 1) + b
            want = np.lexsort((np.arange(5000), -np.round(s, 9)))[:7].tolist()
            assert [r.id for r in sorted((r for r in got if r.name == name and r.query_id == q), key=lambda r: r.rank)] == want


@pytest.mark.parametrize("n", [0, 1, 2, 999, 1000])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n).round(2).tolist()
    d = spark.createDataFrame([(v,) for v in [*x, None]], "x double")
    got = V.exact_median(d, "x", bins=16).first().median
    assert got is None if n == 0 else abs(got - np.median(x)) < 1e-12


def test_topk_of_nothing(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert V.block_topk(d, d, 3).count() == 0


def test_cosine_edges(spark):
    d = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_budget_skip_keeps_later_small_items(spark):
    d = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate([5, 9, 2, 4])], "q long, rank int, tokens long")
    assert sorted(r.rank for r in V.budget_skip(d, "q", "rank", "tokens", 11).collect()) == [1, 3, 4]
    assert sorted(r.rank for r in V.budget_prefix(d, "q", "rank", "tokens", 11).collect()) == [1]
