"""Exact vector retrieval, hybrid ranking, token budgets and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.storage import materialize

# Fixed values of the ranking.
WEIGHTS = {"cosine": 1.0, "recency": 0.15, "confidence": 0.25, "kind": 0.10}
KIND_WEIGHTS = {"fact": 1.0, "semantic": 1.0, "episode": 0.8, "session": 0.3}
TAU_DAYS = 30.0
#: Query vectors scored per block; the matrix of a block is what is broadcast.
BLOCK = 1024
#: Rows scored at once, and decimal places to which scores count as equal.
SLICE, PLACES = 2048, 9


def dot(a: Column, b: Column) -> Column:
    z = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(z, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for different sizes, a zero vector or null."""
    d = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (d > 0), dot(a, b) / d), F.lit(0.0))


def l2_normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def decode_base64_floats(df: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """(id, vector): little-endian float32 blobs; null where the length is no multiple of four."""

    @F.pandas_udf("array<float>")
    def dec(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, "<f4").tolist() if b is not None and len(b) % 4 == 0 else None)

    return df.select(id_col, dec(F.unbase64(blob_col)).alias("vector"))


class TopK:
    """The k best scores of each of n queries so far, ties to the smaller id; n x k numbers, whatever is added."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids, self.scores = np.zeros((n, 0), np.int64), np.zeros((n, 0))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """ids of a batch and their scores (query x row); scores equal to PLACES places are ties."""
        if scores.shape[1] > self.k:
            # Whatever ties with the k-th best must stay, so rows are cut by its value, not by number.
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            some = (scores >= (kth - 10.0**-PLACES)[:, None]).any(0)
            ids, scores = ids[some], scores[:, some]
        self.ids = np.concatenate([self.ids, np.broadcast_to(ids, scores.shape)], 1)
        self.scores = np.concatenate([self.scores, scores], 1)
        if self.ids.shape[1] > self.k:
            order = np.lexsort((self.ids, -np.round(self.scores, PLACES)), axis=1)[:, : self.k]
            self.ids, self.scores = np.take_along_axis(self.ids, order, 1), np.take_along_axis(self.scores, order, 1)


def block_topk(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", weights: dict[str, tuple[float, Column]] | None = None
) -> DataFrame:
    """(query_id, id, cosine, rank): exact top k of every query against all rows, in blocks.

    Queries are cut into blocks of BLOCK rows. For each block one matrix product per Arrow slice
    scores all rows; each task keeps only its k best of each query, and a final rank merges the
    tasks. Neither side is ever crossed row by row.

    weights: name -> (weight of the cosine cut to 0..1, the rest of a row's score as a column of
    `vectors`). Then the rank is by that score over all rows, for every name from the same
    product, and (name, score) come out too.
    """
    spark = vectors.sparkSession
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull())
    names = list(weights or {"": None})
    rest = F.array(*[w[1].cast("double") for w in (weights or {}).values()]) if weights else F.array().cast("array<double>")
    base = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), rest.alias("rest"))
    hybrid, share = bool(weights), np.array([w[0] for w in (weights or {}).values()])
    out = None

    def blocks():
        rows: list = []
        for r in q.toLocalIterator():  # a partition at a time; the driver holds one block
            rows.append(r)
            if len(rows) == BLOCK:
                yield rows
                rows = []
        if rows:
            yield rows

    for rows in blocks():
        ids = np.array([r["query_id"] for r in rows])
        m = np.stack([np.asarray(r["v"], float) for r in rows])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, m / np.where(n > 0, n, 1)))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qi, qm = shared.value
            best = [TopK(len(qi), k) for _ in names]
            for b in batches:
                b = b[[v is not None and len(v) == qm.shape[1] for v in b.v]]
                for lo in range(0, len(b), SLICE):
                    p = b.iloc[lo : lo + SLICE]
                    x = np.stack([np.asarray(v, float) for v in p.v])
                    nx = np.linalg.norm(x, axis=1, keepdims=True)
                    cos = qm @ (x / np.where(nx > 0, nx, 1)).T
                    if not hybrid:
                        best[0].add(p.id.to_numpy(), cos)
                        continue
                    extra = np.stack([np.asarray(r, float) for r in p.rest])
                    for j in range(len(names)):
                        best[j].add(p.id.to_numpy(), share[j] * np.clip(cos, 0, 1) + extra[:, j])
            for name, t in zip(names, best):
                if t.ids.size:
                    yield pd.DataFrame({"name": name, "query_id": np.repeat(qi, t.ids.shape[1]), "id": t.ids.ravel(), "score": t.scores.ravel()})

        part = base.mapInPandas(score, "name string, query_id long, id long, score double")
        part = materialize(part, "topk-block")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "name string, query_id long, id long, score double")
    rk = F.row_number().over(W.partitionBy("name", "query_id").orderBy(F.desc(F.round("score", PLACES)), "id"))
    top = out.withColumn("rank", rk).where(F.col("rank") <= k)
    return top if weights else top.select("query_id", "id", F.col("score").alias("cosine"), "rank")


def recency(created_at: Column, now: Column, tau: float = TAU_DAYS) -> Column:
    """exp(-age in days / tau); a missing or future time counts as new."""
    days = (F.unix_micros(now) - F.unix_micros(created_at)) / 86_400e6
    return F.exp(-F.greatest(F.lit(0.0), F.coalesce(days, F.lit(0.0))) / tau)


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def hybrid_score(cos: Column, rec: Column, confidence: Column, kind: Column, weights: dict[str, float] | None = None) -> Column:
    w = WEIGHTS | (weights or {})
    kw = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_WEIGHTS.items() for x in kv])[kind], F.lit(0.5))
    return w["cosine"] * clip01(cos) + w["recency"] * rec + w["confidence"] * clip01(confidence) + w["kind"] * kw


def budget_skip(df: DataFrame, key: str, rank: str, tokens: str, budget: int) -> DataFrame:
    """Rows of each ranked list that fit: walk the ranks, keep what still fits (or the very first), skip the rest.

    An ordered fold over each key's list; lists are top-k results, so they are short by nature."""
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank, tokens))).alias("l"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc, x):
        fits = (acc["used"] + x[tokens] <= budget) | (F.size(acc["kept"]) == 0)
        return F.when(fits, F.struct((acc["used"] + x[tokens]).cast("long").alias("used"), F.concat(acc["kept"], F.array(x[rank].cast("int"))).alias("kept"))).otherwise(acc)

    kept = lists.select(key, F.explode(F.aggregate("l", empty, step)["kept"]).alias(rank))
    return df.join(kept, [key, rank])


def budget_prefix(df: DataFrame, key: str, rank: str, tokens: str, budget: int) -> DataFrame:
    """Rows up to the first one that overflows the budget; the first row always stays."""
    used = F.sum(tokens).over(W.partitionBy(key).orderBy(rank).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_u", used).where((F.col("_u") <= budget) | (F.col(rank) == 1)).drop("_u")


def retrieval_metrics(ranked: DataFrame, gold_count: str, k: int, query: str = "query_id") -> DataFrame:
    """(hit1, hitk, mrr, ndcg) over queries; `ranked` has rank, is_gold and the number of gold rows of the query."""
    per = ranked.groupBy(query).agg(
        F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("is_gold") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.max(gold_count).alias("g"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("g"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    per = per.withColumn("ideal", F.when(F.col("g") > 0, ideal).otherwise(0.0))
    mean = lambda c: F.bround(F.avg(c), 4)
    return per.agg(
        mean(F.coalesce((F.col("first") <= 1).cast("double"), F.lit(0.0))).alias("hit1"),
        mean(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias("hitk"),
        mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        mean(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)).alias("ndcg"),
    )


def hash_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, idx, v): signed bag of words hashed into `dim` places and normalised, in long form without zeros.

    Words are counted per text first, so each distinct word is hashed once a text."""
    term = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("([a-z0-9]+)"), F.lit(1))).alias("t")
    t = df.select(id_col, term).groupBy(id_col, "t").agg(F.count(F.lit(1)).alias("n"))
    seed = lambda c: F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")
    sign = F.when(seed(F.concat("t", F.lit("$"))) % 2 == 1, 1).otherwise(-1)
    v = t.groupBy(id_col, (seed(F.col("t")) % dim).alias("idx")).agg(F.sum(F.col("n") * sign).alias("s")).where("s <> 0")
    length = F.sqrt(F.sum(F.col("s").cast("double") * F.col("s")).over(W.partitionBy(id_col)))
    return v.select(id_col, "idx", (F.col("s") / length).alias("v"))


def exact_median(df: DataFrame, col: str, bins: int = 65536) -> DataFrame:
    """(median): the exact median of a column without sorting it whole; nulls do not count, no rows give null.

    A histogram of `bins` equal steps between the extremes says in which bins the middle values
    lie; only the rows of these bins are ranked, and of them only the step they fall in.
    """
    d = materialize(df.select(F.col(col).cast("double").alias("x")).where("x is not null"), "median")
    lo, hi, n = d.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([(None,)], "median double")
    want = sorted({(n - 1) // 2, n // 2})
    skip = 0
    while hi > lo and d.count() > bins:
        step = (hi - lo) / bins
        at = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / step))
        upto, cut = skip, []
        for b, c in sorted(tuple(r) for r in d.groupBy(at).count().collect()):
            if any(upto <= w < upto + c for w in want):
                cut.append((b, upto))
            upto += c
        part = d.where(at.between(cut[0][0], cut[-1][0]))
        new_lo, new_hi, kept = part.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
        if kept == d.count():
            break
        d, lo, hi, skip = part, new_lo, new_hi, cut[0][1]
    if hi == lo:
        return spark.createDataFrame([(lo,)], "median double")
    rank = F.row_number().over(W.orderBy("x")) - 1 + skip
    return d.select("x", rank.alias("r")).where(F.col("r").isin(want)).agg(F.avg("x").alias("median"))


def quantise_int8(df: DataFrame, cols: list[str], value: str) -> DataFrame:
    """Adds q (int8 code) and err (absolute error) with one scale per group of `cols`: max|v| / 127."""
    top = df.groupBy(*cols).agg((F.max(F.abs(value)) / 127).alias("scale"))
    j = df.join(top, cols)
    q = F.when(F.col("scale") > 0, F.bround(F.col(value) / F.col("scale"))).otherwise(0).cast("int")
    return j.withColumn("q", q).withColumn("err", F.abs(F.col(value) - F.col("q") * F.col("scale")))


def to_half(df: DataFrame, id_col: str, vec_col: str, kind: str = "fp16") -> DataFrame:
    """(id, vector): values rounded to half precision, or cut to bfloat16."""

    @F.pandas_udf("array<float>")
    def half(s: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            x = np.asarray(v, np.float32)
            if kind == "fp16":
                return x.astype(np.float16).astype(np.float32).tolist()
            return (x.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32).tolist()

        return s.map(one)

    return df.select(id_col, half(F.col(vec_col)).alias("vector"))
