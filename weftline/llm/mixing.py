"""Mixing sources to target weights (problem 9) by entropy balancing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.language import language_code
from weftline.llm.tokens import VOCABULARIES, count_tokens
from weftline.storage import materialize

#: Weight of the ties that hold the mix's languages and lengths near the corpus; the sources' tokens are exact.
SOFTNESS = 0.02
#: Newton steps at most, and what a source's tokens may be off at the end, as a share of all wanted tokens.
ROUNDS, TOLERANCE = 40, 1e-9


def document_sizes(docs: DataFrame, id_col: str = "doc_id", name: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> DataFrame:
    """(id, source, lang, tokens) of every document, written once; null and empty texts have 0 tokens.

    lang is a two-letter code, `other` where the label names none."""
    key = F.struct(F.col(id_col).alias("id"), "source", F.coalesce(language_code(F.col("lang")), F.lit("other")).alias("lang"))
    sized = count_tokens(docs.select(key.alias("k"), "text"), "k", "text", name, folder)
    return materialize(sized.select("k.id", "k.source", "k.lang", "tokens"), "mix-sizes")


def source_balance(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of targets (source, target_share, max_repeats): tokens held and wanted.

    The total is the tokens of all documents, those without a source included. A target source
    without documents holds 0 tokens; null max_repeats means 1. Sources are compared exactly.
    """
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    t = targets.select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"))
    out = t.join(held, "source", "left").fillna(0, ["tokens", "docs"]).crossJoin(F.broadcast(total))
    return out.withColumn("wanted", F.coalesce(F.col("target_share") * F.col("total"), F.lit(0.0)))


class Rates:
    """Rates of documents: exp(source + language + length), never above the source's cap; all of a full source at its cap."""

    def __init__(self, balance: pd.DataFrame, langs: list[str], mean: float, spread: float):
        self.balance, self.langs, self.mean, self.spread = balance, langs, mean, spread
        held, wanted, cap = (balance[c].to_numpy(float) for c in ("tokens", "wanted", "max_repeats"))
        # The caps are in the problem: a source whose cap allows no more than is wanted has every document at it.
        self.full = (held > 0) & (cap * held <= wanted)
        self.live = (held > 0) & (wanted > 0) & (cap > 0) & ~self.full
        self.source = np.log(np.where(self.live, wanted, 1.0) / np.where(self.live, held, 1.0))
        self.lang, self.length = np.zeros(len(langs)), 0.0

    def column(self, spark) -> tuple[DataFrame, Column, Column]:
        """(tables to join by source, the rate of a document, whether it is below its cap); both have a row per source or language."""
        b = self.balance
        rows = [(s, float(x), float(c), bool(f), bool(v)) for s, x, c, f, v in zip(b.source, self.source, b.max_repeats, self.full, self.live)]
        per = spark.createDataFrame(rows, "source string, a double, cap double, full boolean, live boolean")
        lang = F.lit(0.0)
        for code, m in zip(self.langs, self.lang):
            lang = F.when(F.col("lang") == code, F.lit(float(m))).otherwise(lang)
        tilt = F.exp(F.least(F.lit(50.0), F.col("a") + lang + self.length * self.z()))
        rate = F.when(F.col("full"), F.col("cap")).when(F.col("live"), F.least("cap", tilt)).otherwise(F.lit(0.0))
        return per, rate, F.col("live") & (tilt < F.col("cap"))

    def z(self) -> Column:
        """Length of a document in standard units of log tokens."""
        return (F.log1p(F.col("tokens").cast("double")) - self.mean) / self.spread


def balanced(sizes: DataFrame, targets: DataFrame) -> Rates:
    """Entropy balancing: of all rates that give each source its wanted tokens under its cap, those nearest to 1.

    The constraints are the tokens of each source (exact), and the languages and the mean log
    length of the sources' documents, tied to the corpus with SOFTNESS. The dual is convex; each
    Newton step is one distributed aggregation of gradient and curvature over all documents,
    grouped by source and language, and a solve on the driver of a system of as many unknowns as
    there are sources and languages. A step that would change a rate more than e-fold is shortened.
    """
    spark = sizes.sparkSession
    bal = source_balance(sizes, targets).orderBy("source").toPandas()
    known = sizes.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").where("tokens > 0")
    x = F.log1p(F.col("tokens").cast("double"))
    by_lang = known.groupBy("lang").agg(F.sum("tokens").alias("t"), F.sum(x * F.col("tokens")).alias("x"), F.sum(x * x * F.col("tokens")).alias("xx")).orderBy("lang").toPandas()
    all_t = float(by_lang.t.sum())
    mean = by_lang.x.sum() / all_t if all_t else 0.0
    spread = float(np.sqrt(max(by_lang.xx.sum() / all_t - mean**2, 0.0))) if all_t else 0.0
    r = Rates(bal, by_lang.lang.tolist(), float(mean), spread or 1.0)
    aim = np.where(r.live, bal.wanted, np.where(r.full, bal.max_repeats * bal.tokens, 0.0)).astype(float)
    size = float(aim.sum())
    if not r.live.any():
        return r
    n, m = len(bal), len(r.langs)
    lang_aim = by_lang.t.to_numpy(float) / all_t * size
    at_s, at_l = {s: i for i, s in enumerate(bal.source)}, {v: i for i, v in enumerate(r.langs)}
    best = None
    for _ in range(ROUNDS):
        per, rate, free = r.column(spark)
        w = F.col("tokens") * rate
        z = r.z()
        f = F.when(free, w).otherwise(0.0)
        cells = known.join(F.broadcast(per), "source").groupBy("source", "lang").agg(
            F.sum(w).alias("w"), F.sum(w * z).alias("wz"), F.sum(f).alias("f"), F.sum(f * z).alias("fz"), F.sum(f * z * z).alias("fzz")
        )
        grad, hess = np.zeros(n + m + 1), np.zeros((n + m + 1, n + m + 1))
        for c in cells.collect():
            i, j = at_s[c.source], n + at_l[c.lang]
            grad[[i, j]] += c.w
            grad[-1] += c.wz
            for k in (i, j):
                hess[k, k] += c.f
                hess[k, -1] += c.fz
                hess[-1, k] += c.fz
            hess[i, j] += c.f
            hess[j, i] += c.f
            hess[-1, -1] += c.fzz
        grad -= np.concatenate([aim, lang_aim, [0.0]])
        grad[n:] += SOFTNESS * size * np.concatenate([r.lang, [r.length]])
        off = float(np.abs(grad[np.concatenate([r.live, np.ones(m + 1, bool)])]).max())
        if best is None or off < best[0]:
            best = (off, r.source.copy(), r.lang.copy(), r.length)
        if off <= TOLERANCE * size:
            break
        hess[range(n, n + m + 1), range(n, n + m + 1)] += SOFTNESS * size
        use = np.flatnonzero(np.concatenate([r.live, np.ones(m + 1, bool)]))
        h = hess[np.ix_(use, use)] + 1e-9 * size * np.eye(len(use))
        step = np.zeros(n + m + 1)
        step[use] = np.linalg.solve(h, grad[use])
        step /= max(1.0, float(np.abs(step).max()))
        r.source, r.lang, r.length = r.source - step[:n], r.lang - step[n:-1], r.length - float(step[-1])
    _, r.source, r.lang, r.length = best
    return r


def unreachable(rates: Rates) -> list[str]:
    """Sources that are short with every document at its cap, or that have none."""
    b = rates.balance
    return [s for s, t, c, w in zip(b.source, b.tokens, b.max_repeats, b.wanted) if c * t < w]


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """((id, source, copies), report): the copies of each document and the shares reached and missed.

    A document gets the whole part of its rate and one more with the probability of the rest,
    decided by a hash of its id, so the draw repeats and needs no order. Documents whose source
    is null or has no target get 0 copies. A rate table has one row per target source (a fixed
    small list), so it is broadcast. The report gives of each source tokens held, wanted, mixed
    and missed, its share of the mix (these add up to 1) and of all tokens.
    """
    r = balanced(sizes, targets)
    per, rate, _ = r.column(sizes.sparkSession)
    unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    d = sizes.join(F.broadcast(per), "source", "left").withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    copies = F.least(F.coalesce("cap", F.lit(0.0)), F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("long"))
    dealt = d.select("id", "source", "tokens", copies.cast("long").alias("copies"))
    got = dealt.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"))
    report = source_balance(sizes, targets).join(got, "source", "left").fillna(0, ["mixed_tokens"])
    mixed = report.agg(F.sum("mixed_tokens").alias("mixed"))
    report = report.crossJoin(F.broadcast(mixed)).select(
        "source", "target_share", "max_repeats", "tokens", "docs", "total", "wanted",
        (~F.col("source").isin(unreachable(r))).alias("reachable"), "mixed_tokens",
        F.greatest(F.lit(0.0), F.col("wanted") - F.col("mixed_tokens")).alias("missed"),
        F.try_divide("mixed_tokens", "mixed").alias("share"), F.try_divide("mixed_tokens", "total").alias("share_of_total"),
    )
    return dealt.drop("tokens"), report
