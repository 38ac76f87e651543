"""Vector retrieval, ranking and evaluation queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import vectors as V
from weftline.plans.corpus import docs
from weftline.plans.registering import registering
from weftline.session import table

QUERIES, ORACLE = {}, {}
query = registering(QUERIES, ORACLE)
K = 5


def embs(spark, sf):
    return table(spark, sf, "embeddings")


_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_TOP = (
    f"e AS (SELECT vec_id, label, embedding, sqrt({_DOT('embedding', 'embedding')}) AS n FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0), "
    f"c AS (SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id AS id, e.label AS il, CASE WHEN q.n * e.n > 0 THEN {_DOT('q.embedding', 'e.embedding')} / (q.n * e.n) ELSE 0 END AS cosine FROM q, e), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rank FROM c)"
)


def _topk(spark, sf, k=K):
    e = embs(spark, sf)
    return V.block_topk(e, e.where("vec_id % 50 = 0"), k)


@query(f"WITH {_TOP} SELECT query_id, id, round_even(cosine, 6) AS cosine, rank FROM r WHERE rank <= {K}")
def cosine_topk(spark, sf):
    return _topk(spark, sf).withColumn("cosine", F.bround("cosine", 6)).withColumn("rank", F.col("rank").cast("long"))


_AGE = "TIMESTAMP '2031-01-01' - to_days(CAST(id % 90 AS INT))"
_SC = lambda w: f"{w['cosine']} * greatest(0, least(1, cosine)) + {w['recency']} * exp(-(id % 90) / 30.0) + {w['confidence']} * ((id % 10) / 10.0) + {w['kind']} * (CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.3 ELSE 0.5 END)"


def _weights(sets):
    """Weight sets for `block_topk`: what a row's score has besides the cosine is known before any query."""
    now = F.lit("2031-01-01 00:00:00").cast("timestamp")
    made = F.timestamp_micros(F.unix_micros(now) - (F.col("vec_id") % 90) * 86_400_000_000)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("fact", "episode", "session", "other")]), (F.col("vec_id") % 4 + 1).cast("int"))
    return {n: (w["cosine"], V.hybrid_score(F.lit(0.0), V.recency(made, now), (F.col("vec_id") % 10) / 10.0, kind, w)) for n, w in sets.items()}


def _hybrid(spark, sf, k, sets):
    e = embs(spark, sf)
    return V.block_topk(e, e.where("vec_id % 50 = 0"), k, weights=_weights(sets))


@query(
    f"WITH {_TOP}, h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, id, {_SC(V.WEIGHTS)} AS score FROM c)) "
    f"SELECT query_id, id, round_even(score, 6) AS score, rank FROM h WHERE rank <= {K}"
)
def hybrid_rank(spark, sf):
    """Top k by hybrid score over all vectors."""
    h = _hybrid(spark, sf, K, {"default": V.WEIGHTS})
    return h.select("query_id", "id", F.bround("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _budgeted(spark, sf):
    return _topk(spark, sf, 8).select("query_id", "id", F.col("rank").cast("long").alias("rank"), (F.col("id") % 37 + 1).alias("tokens"))


@query(f"WITH {_TOP}, t AS (SELECT query_id, id, rank, id % 37 + 1 AS tokens FROM r WHERE rank <= 8), w AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS u FROM t) SELECT query_id, id, rank, tokens FROM w WHERE u <= 60 OR rank = 1")
def budget_prefix(spark, sf):
    return V.budget_prefix(_budgeted(spark, sf), "query_id", "rank", "tokens", 60)


@query(
    f"WITH RECURSIVE {_TOP}, t AS (SELECT query_id, id, rank, id % 37 + 1 AS tokens FROM r WHERE rank <= 8), "
    "f AS (SELECT query_id, id, rank, tokens, tokens AS used, true AS kept FROM t WHERE rank = 1 UNION ALL "
    "SELECT t.query_id, t.id, t.rank, t.tokens, f.used + CASE WHEN f.used + t.tokens <= 60 THEN t.tokens ELSE 0 END, f.used + t.tokens <= 60 FROM f JOIN t ON t.query_id = f.query_id AND t.rank = f.rank + 1) "
    "SELECT query_id, id, rank, tokens FROM f WHERE kept"
)
def budget_skip(spark, sf):
    return V.budget_skip(_budgeted(spark, sf), "query_id", "rank", "tokens", 60).select("query_id", "id", "rank", "tokens")


@query(
    f"WITH {_TOP}, t AS (SELECT query_id, rank, id % 37 + 1 AS tokens, id FROM r WHERE rank <= 8), w AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS u FROM t) "
    "SELECT query_id, '<|memory|>' || chr(10) || string_agg('<|mem|> id=' || id || ' kind=fact', chr(10) ORDER BY rank) || chr(10) || '<|/memory|>' AS block FROM w WHERE u <= 60 OR rank = 1 GROUP BY query_id"
)
def memory_block(spark, sf):
    """Budgeted hits of each query as one text block in rank order."""
    b = V.budget_prefix(_budgeted(spark, sf), "query_id", "rank", "tokens", 60)
    line = F.format_string("<|mem|> id=%d kind=fact", "id")
    g = b.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("ls"))
    return g.select("query_id", F.concat(F.lit("<|memory|>\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n<|/memory|>")).alias("block"))


_GOLD = "m AS (SELECT r.*, ql = il AND query_id <> id AS is_gold FROM r), g AS (SELECT query_id, count(*) FILTER (is_gold) AS g FROM m GROUP BY query_id)"
_METRIC = (
    "p AS (SELECT query_id, min(rank) FILTER (is_gold) AS first, sum(CASE WHEN is_gold THEN 1 / log2(rank + 1) END) AS dcg FROM m WHERE rank <= 5 GROUP BY query_id), "
    "i AS (SELECT query_id, (SELECT coalesce(sum(1 / log2(x + 1)), 0) FROM range(1, least(g.g, 5) + 1) t(x)) AS ideal FROM g)"
)


def _gold(spark, sf, ranked):
    e = embs(spark, sf).select("vec_id", "label")
    n = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("gold"))
    q = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")).join(n, F.col("ql") == n.label).drop("label")
    d = e.select(F.col("vec_id").alias("id"), F.col("label").alias("il"))
    return ranked.join(q, "query_id").join(d, "id").withColumn("is_gold", (F.col("ql") == F.col("il")) & (F.col("query_id") != F.col("id")))


@query(
    f"WITH {_TOP}, {_GOLD}, {_METRIC} SELECT round_even(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 4) AS hit1, round_even(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 4) AS hitk, "
    "round_even(avg(coalesce(1.0 / first, 0)), 4) AS mrr, round_even(avg(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END), 4) AS ndcg FROM p JOIN i USING (query_id)"
)
def retrieval_metrics(spark, sf):
    return V.retrieval_metrics(_gold(spark, sf, _topk(spark, sf)), "gold", K)


# The weight sets compared.
WEIGHT_SETS = {
    "default": {"cosine": 1.0, "recency": 0.15, "confidence": 0.25, "kind": 0.10},
    "cosine_only": {"cosine": 1.0, "recency": 0.0, "confidence": 0.0, "kind": 0.0},
    "recency_boost": {"cosine": 1.0, "recency": 0.5, "confidence": 0.1, "kind": 0.1},
    "confidence_boost": {"cosine": 1.0, "recency": 0.05, "confidence": 0.5, "kind": 0.1},
    "kind_boost": {"cosine": 0.8, "recency": 0.1, "confidence": 0.2, "kind": 0.5},
}


def _grid() -> dict:
    return WEIGHT_SETS | {f"grid_r{r}_c{c}": {"cosine": 1.0 - r - c, "recency": r, "confidence": c, "kind": 0.1} for r in (0.0, 0.25, 0.5) for c in (0.0, 0.25, 0.5)}


_GRID = "w AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, query_id, id, ql = il AND query_id <> id AS is_gold, {_SC(w)} AS score FROM c" for n, w in _grid().items()) + ")"


@query(
    f"WITH {_TOP}, {_GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY name, query_id ORDER BY round(score, 9) DESC, id) AS rk FROM w), p AS (SELECT name, query_id, min(rk) FILTER (is_gold AND rk <= 20) AS first FROM k GROUP BY ALL) "
    "SELECT name, round_even(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 4) AS hit1, round_even(avg(coalesce(1.0 / first, 0)), 4) AS mrr FROM p GROUP BY name"
)
def weight_grid(spark, sf):
    """Hit rate at 1 and MRR of each weight set in its own top 20 over all vectors; all sets from one matrix product."""
    near = _gold(spark, sf, _hybrid(spark, sf, 20, _grid()))
    first = near.groupBy("name", "query_id").agg(F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first"))
    mean = lambda c: F.bround(F.avg(F.coalesce(c, F.lit(0.0))), 4)
    return first.groupBy("name").agg(mean((F.col("first") == 1).cast("double")).alias("hit1"), mean(1.0 / F.col("first")).alias("mrr"))


@query(
    "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS t FROM documents), s AS (SELECT doc_id, CAST('0x' || substring(sha256(t), 1, 8) AS BIGINT) % 64 AS idx, "
    "sum(CASE WHEN CAST('0x' || substring(sha256(t || '$'), 1, 8) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS s FROM t GROUP BY ALL) SELECT doc_id, idx, round_even(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 6) AS v FROM s WHERE s <> 0"
)
def hash_embedding(spark, sf):
    return V.hash_embedding(docs(spark, sf), "doc_id", "text").withColumn("v", F.bround("v", 6))


@query("SELECT count(*) AS vectors, any_value(len(embedding)) AS dim, count(DISTINCT label) AS labels FROM embeddings")
def vector_stats(spark, sf):
    return embs(spark, sf).agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dim"), F.count_distinct("label").alias("labels"))


_LONG = "l AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def _long(spark, sf):
    return embs(spark, sf).select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query(
    f"WITH {_LONG}, s AS (SELECT i, max(abs(v)) / 127 AS scale FROM l GROUP BY i), q AS (SELECT l.*, scale, round_even(v / scale, 0) AS q FROM l JOIN s USING (i)) "
    "SELECT i, round_even(max(abs(v - q * scale)), 6) AS max_err, round_even(avg(abs(v - q * scale)), 6) AS mean_err, CAST(sum(q) AS BIGINT) AS code_sum FROM q GROUP BY i"
)
def quantise_int8(spark, sf):
    q = V.quantise_int8(_long(spark, sf), ["i"], "v")
    return q.groupBy(F.col("i").cast("long").alias("i")).agg(F.bround(F.max("err"), 6).alias("max_err"), F.bround(F.avg("err"), 6).alias("mean_err"), F.sum("q").alias("code_sum"))


@query(f"WITH {_LONG}, a AS (SELECT i, avg(v) AS m FROM l GROUP BY i), d AS (SELECT vec_id, avg(abs(v - m)) AS d FROM l JOIN a USING (i) GROUP BY vec_id) SELECT round_even(median(d), 6) AS median_diff FROM d")
def median_mean_diff(spark, sf):
    """Median over vectors of the mean absolute difference to the average vector."""
    l = _long(spark, sf)  # noqa: E741
    m = l.groupBy("i").agg(F.avg("v").alias("m"))
    d = l.join(F.broadcast(m), "i").groupBy("vec_id").agg(F.avg(F.abs(F.col("v") - F.col("m"))).alias("d"))
    return V.exact_median(d, "d").select(F.bround("median", 6).alias("median_diff"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings")
def base64_vectors(spark, sf):
    """Round trip of float vectors through base64 blobs."""
    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda v: np.asarray(v, "<f4").tobytes())

    blobs = embs(spark, sf).select("vec_id", F.base64(pack("embedding")).alias("blob"))
    return V.decode_base64_floats(blobs, "vec_id", "blob").select("vec_id", F.transform("vector", lambda x: x.cast("double")).alias("v"))


@query()
def half_precision(spark, sf):
    return V.to_half(embs(spark, sf), "vec_id", "embedding", "bf16")


@query(
    "WITH g AS (SELECT id AS example_id, context FROM feedback WHERE context IS NOT NULL AND id IS NOT NULL), r AS (SELECT DISTINCT id, classification FROM records WHERE id IS NOT NULL) "
    "SELECT classification, count(*) AS n FROM g JOIN r ON g.context = r.id GROUP BY classification"
)
def gold_lookup(spark, sf):
    """Feedback joined to the records it names; a few records draw most of it, which the adaptive join splits."""
    f = table(spark, sf, "feedback").where("context is not null and id is not null").select("context")
    r = table(spark, sf, "records").where("id is not null").select("id", "classification").distinct()
    n = f.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    return n.join(r, n.context == r.id).groupBy("classification").agg(F.sum("n").alias("n"))


@query(r"SELECT round_even(avg(CASE WHEN list_has_any(regexp_extract_all(lower(analysis), '[a-z0-9.-]+', 0), regexp_extract_all(lower(recommended_action), '[a-z0-9.-]+', 0)) THEN 1.0 ELSE 0 END), 6) AS recall FROM records WHERE analysis IS NOT NULL AND recommended_action IS NOT NULL")
def fact_recall(spark, sf):
    """Share of records whose action mentions a word of the analysis."""
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9.-]+"), F.lit(0))
    r = table(spark, sf, "records").where("analysis is not null and recommended_action is not null")
    return r.agg(F.bround(F.avg(F.arrays_overlap(w("analysis"), w("recommended_action")).cast("double")), 6).alias("recall"))
