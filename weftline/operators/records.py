"""Validation, repair, quotas and splits of structured security records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.positions import hash_order, positions
from weftline.operators.text import content_key, loops_anywhere, loops_in_head, squeeze
from weftline.storage import materialize

# Fixed values of the record format.
CLASSES = ["normal", "suspicious", "malicious", "unknown"]
HARDNESS = {"INFO": 5, "LOW": 20, "MEDIUM": 45, "HIGH": 70, "CRITICAL": 90}
WARNED = ["suspicious", "malicious"]
CATEGORIES = ["Normal behavior", "Suspicious behavior", "Early-warning sequences", "False positives", "Multi-signal correlation", "Authentication", "Network", "Process behavior", "Vulnerability / code security"]
NO_OPS = ["no action required", "no action needed", "none", "no action", "no further action", "nothing", "n/a", "not applicable"]
MIN_INPUT, MIN_ANALYSIS, MIN_ACTION, TOP_CONFIDENCE = 120, 40, 40, 0.97


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for cond, name in rules[1:]:
        out = out.when(F.coalesce(cond, F.lit(False)), name)
    return out


def all_reasons(rules: list[tuple[Column, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, n in rules]), lambda x: x.isNotNull())


def is_no_op(action: Column) -> Column:
    """A no-op phrase, or one followed by little."""
    body = F.lower(F.rtrim(squeeze(action), F.lit(".!? ")))
    return reduce(lambda a, b: a | b, [(body == p) | (body.startswith(p) & (F.length(body) < len(p) + 90)) for p in NO_OPS])


def hardness_of(risk: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in HARDNESS.items() for x in kv])[risk]


def repaired(df: DataFrame, strict: bool = False, max_input: int = 1200, max_analysis: int = 420) -> DataFrame:
    """Adds `reason` (first failing rule, null if sound) and the repaired fields r_*.

    Text is put on one line, case of class and risk restored, the early-warning flag made a
    function of the class, confidence clamped, hardness taken from the risk, an unknown category
    replaced by a default. Null texts count as empty. A no-op action is accepted for normal
    records unless `strict`.
    """
    one = lambda c: F.coalesce(squeeze(F.col(c)), F.lit(""))
    evidence = F.filter(F.transform("evidence", lambda e: squeeze(e)), lambda e: e != "")
    d = df.withColumns(
        {
            "r_input": one("input"), "r_class": F.lower(one("classification")), "r_risk": F.upper(one("risk")),
            "r_evidence": evidence, "r_analysis": one("analysis"), "r_action": one("recommended_action"),
        }
    )
    n = lambda c: F.length(F.col(c))
    rules = [
        (n("r_input") < MIN_INPUT, "input_too_short"),
        (n("r_input") > max_input, "input_too_long"),
        (loops_in_head(F.col("r_input")), "input_repetitive"),
        (~F.col("r_class").isin(CLASSES), "bad_classification"),
        (~F.col("r_risk").isin(list(HARDNESS)), "bad_risk"),
        (F.col("evidence").isNull(), "evidence_not_list"),
        (F.size("r_evidence") == 0, "evidence_empty"),
        (n("r_analysis") < MIN_ANALYSIS, "analysis_too_short"),
        (n("r_analysis") > max_analysis, "analysis_too_long"),
        (loops_in_head(F.col("r_analysis")), "analysis_repetitive"),
        (F.col("r_action") == "", "no_recommended_action"),
        (is_no_op(F.col("r_action")) & (F.lit(strict) | (F.col("r_class") != "normal")), "action_is_no_op"),
        (n("r_action") < MIN_ACTION, "action_too_short"),
        (F.col("confidence").isNull(), "bad_confidence"),
    ]
    default = F.when(F.col("r_class") == "normal", "Normal behavior").otherwise("Suspicious behavior")
    cat = F.trim("category")
    return d.withColumns(
        {
            "reason": first_reason(rules),
            "r_early": F.col("r_class").isin(WARNED),
            "r_confidence": F.least(F.lit(TOP_CONFIDENCE), F.greatest(F.lit(0.0), F.col("confidence"))),
            "r_hardness": hardness_of(F.col("r_risk")),
            "r_category": F.when(cat.isin(CATEGORIES), cat).otherwise(default),
        }
    )


def strict_reason(df: DataFrame, max_input: int = 1200, max_analysis: int = 420) -> DataFrame:
    """Adds `reason2`: the rejecting validator, where an inconsistent flag is a fault and long actions too."""
    d = repaired(df, strict=True, max_input=max_input, max_analysis=max_analysis)
    n = lambda c: F.length(F.col(c))
    required = ["input", "classification", "risk", "early_warning", "evidence", "analysis", "recommended_action", "confidence"]
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull()), ",")
    rules = [
        (n("r_input") < MIN_INPUT, "input_too_short"),
        (n("r_input") > max_input, "input_too_long"),
        (loops_in_head(F.col("r_input")), "input_repetitive"),
        (~F.col("r_class").isin(CLASSES), "bad_classification"),
        (~F.col("r_risk").isin(list(HARDNESS)), "bad_risk"),
        (F.size("r_evidence") == 0, "evidence_empty"),
        (n("r_analysis") < MIN_ANALYSIS, "analysis_too_short"),
        ((n("r_analysis") > max_analysis) | (n("r_action") > max_analysis), "text_too_long"),
        (loops_in_head(F.col("r_analysis")), "analysis_repetitive"),
        (F.col("r_action") == "", "no_recommended_action"),
        (is_no_op(F.col("r_action")), "action_is_no_op"),
        (n("r_action") < MIN_ACTION, "action_too_short"),
        (F.col("early_warning") != F.col("r_early"), "early_warning_inconsistent"),
    ]
    return d.withColumn("reason2", F.when(missing != "", F.concat(F.lit("missing:"), missing)).otherwise(first_reason(rules)))


def generator_reason(max_input: int = 1200, max_analysis: int = 420) -> Column:
    """The generator's own gate on raw fields."""
    n = lambda c: F.coalesce(F.length(F.col(c)), F.lit(0))
    return first_reason(
        [
            (~n("input").between(MIN_INPUT, max_input), "input_len"),
            (~n("analysis").between(MIN_ANALYSIS, max_analysis), "analysis_len"),
            (~n("recommended_action").between(MIN_ACTION, max_analysis), "action_len"),
            (~F.coalesce(F.col("classification").isin(CLASSES), F.lit(False)), "bad_class"),
            (~F.coalesce(F.col("risk").isin(list(HARDNESS)), F.lit(False)), "bad_risk"),
            (~F.coalesce(F.col("early_warning") == F.col("classification").isin(WARNED), F.lit(False)), "early_inconsistent"),
            (F.coalesce(F.size("evidence"), F.lit(0)) == 0, "no_evidence"),
            (loops_anywhere(F.col("input")) | loops_anywhere(F.col("analysis")), "repetitive"),
        ]
    )


#: Fields that every record must have; in a typed table a field that is not there is null.
REQUIRED = ["input", "classification", "risk", "early_warning", "evidence", "analysis", "recommended_action", "confidence"]


def faults(max_input: int = 1200, max_analysis: int = 420) -> dict[str, Column]:
    """Independent invariant checks; one record may fail several."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    n = lambda c: F.length(s(c))
    cls = F.coalesce(F.col("classification"), F.lit(""))
    warned = cls.isin(WARNED)
    conf = F.coalesce(F.col("confidence"), F.lit(-1.0))
    noop = is_no_op(s("recommended_action"))
    return {
        "missing_fields": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED]),
        "bad_classification": ~cls.isin(CLASSES),
        "bad_risk": ~s("risk").isin(list(HARDNESS)),
        "bad_confidence": ~conf.between(0.0, 1.0),
        "early_warning_not_bool": F.col("early_warning").isNull(),
        "hardness_mismatch": ~F.col("hardness").eqNullSafe(hardness_of(s("risk"))),
        "evidence_empty": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
        "input_multiline": s("input").contains("\n"),
        "input_too_short": n("input") < MIN_INPUT,
        "input_too_long": n("input") > max_input,
        "input_repetitive": loops_in_head(s("input")),
        "analysis_too_short": n("analysis") < MIN_ANALYSIS,
        "analysis_too_long": n("analysis") > max_analysis,
        "analysis_repetitive": loops_in_head(s("analysis")),
        "action_is_no_op": noop & warned,
        "accepted_no_op_on_normal": noop & (cls == "normal"),
        "action_too_short": n("recommended_action") < MIN_ACTION,
        "early_warning_inconsistent": F.coalesce("early_warning", F.lit(False)) != warned,
        "confidence_at_ceiling": F.coalesce("confidence", F.lit(0.0)) > TOP_CONFIDENCE,
        "unknown_category": ~s("category").isin(CATEGORIES),
        "missing_provenance": ~F.coalesce("synthetic", F.lit(False)) | (s("source") == ""),
        "dedup_key_mismatch": ~F.col("dedup_key").eqNullSafe(content_key(s("input"))),
        "early_warning_on_normal": F.coalesce("early_warning", F.lit(False)) & (cls == "normal"),
    }


def audit(df: DataFrame, **limits) -> DataFrame:
    """(fault, n): how many records violate each invariant, in one pass, with repeated dedup keys counted too."""
    checks = faults(**limits)
    # Grouping by the key first counts repeated keys in the same scan; what is shuffled is one row of counts a key and task.
    per = df.groupBy("dedup_key").agg(*[F.count_if(c).alias(k) for k, c in checks.items()], (F.count(F.lit(1)) - 1).alias("duplicate_record"))
    names = [*checks, "duplicate_record"]
    one = per.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names])
    pairs = F.array(*[F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in names])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def quotas(counts: DataFrame, total: int, key: str = "k", weight: str = "w") -> DataFrame:
    """(key, quota): integers that sum to `total`, by largest remainder, ties to the smaller key.

    Works on one row per category, a small table by nature."""
    s = counts.withColumn("raw", F.lit(total) * F.col(weight) / F.sum(weight).over(W.partitionBy()))
    s = s.withColumn("base", F.floor("raw")).withColumn("frac", F.round(F.col("raw") - F.floor("raw"), 9))
    rank = F.row_number().over(W.orderBy(F.desc("frac"), key))
    short = F.lit(total) - F.sum("base").over(W.partitionBy())
    return s.select(key, (F.col("base") + F.when(rank <= short, 1).otherwise(0)).cast("long").alias("quota"))


def class_cap(counts: DataFrame, n: str = "n", floor: int = 40, share: float = 0.45) -> DataFrame:
    """(cap): the largest cap under which no class exceeds `share` of the rest; null if none does.

    `counts` has one row per class. The share of the largest class grows with the cap, so only
    caps at class sizes and between them matter; closed form per segment instead of a search:
    with m classes above the cap holding K each and S below it, K / (m K + S) <= share.
    """
    segs = counts.select(F.col(n).alias("hi")).distinct().withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("hi")), F.lit(0)))
    joined = segs.crossJoin(counts.select(F.col(n).alias("c")))
    agg = joined.groupBy("lo", "hi").agg(
        F.sum(F.when(F.col("c") <= F.col("lo"), F.col("c")).otherwise(0)).alias("below"), F.count_if(F.col("c") > F.col("lo")).alias("m")
    )
    limit = F.floor(F.lit(share) * F.col("below") / (1 - F.lit(share) * F.col("m")) + 1e-9)
    k = F.when(F.lit(share) * F.col("m") >= 1, F.col("hi")).otherwise(F.least(F.col("hi"), limit))
    best = agg.withColumn("k", k.cast("long")).where((F.col("k") >= floor) & (F.col("k") > F.col("lo")))
    return best.agg(F.max("k").alias("cap"))


def stratified_split(df: DataFrame, stratum: str, key: str, val: float = 0.01, evals: float = 0.04) -> DataFrame:
    """Adds `split`: per stratum in key order, the first rows to val, the next to eval, the rest to train.

    A stratum under three rows goes to train. Positions come from a range-bucketed count, so a
    stratum of any size is ranked in parallel: a window per (stratum, key prefix) plus the
    prefix totals.
    """
    d = df.withColumn("_b", F.substring(F.sha2(F.coalesce(F.col(key), F.lit("")), 256), 1, 2))
    tot = d.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(stratum)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tot = tot.withColumns({"_before": before, "_n": F.sum("_c").over(w)}).withColumnRenamed(stratum, "_s").withColumnRenamed("_b", "_bb")
    j = d.join(tot, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bb")))
    h = F.sha2(F.coalesce(F.col(key), F.lit("")), 256)
    pos = F.row_number().over(W.partitionBy(stratum, "_b").orderBy(h, key)) + F.col("_before")
    n = F.col("_n")
    n_val = F.when(n >= 3, F.least(n - 2, F.greatest(F.lit(1), F.bround(n * val).cast("long")))).otherwise(0)
    left = n - 2 - n_val
    n_eval = F.when(left >= 1, F.least(left, F.greatest(F.lit(1), F.bround(n * evals).cast("long")))).otherwise(0)
    split = F.when(pos <= n_val, "val").when(pos <= n_val + n_eval, "eval").otherwise("train")
    return j.withColumn("split", split).drop("_b", "_s", "_bb", "_c", "_before", "_n")


def topped_up_split(df: DataFrame, stratum: str, key: str, val: float, evals: float, seed: int) -> DataFrame:
    """(stratum, key, split): a seeded stratified split that reaches its global sizes.

    Keys are distinct. Per stratum in seeded hash order the first rows go to val and the next to
    eval, no more than a quarter of the stratum (or one row) each, and one row stays in train. What the
    rounding and this cap leave short of the global sizes (none under 20 rows) is moved out of
    train, last stratum and key first, to val and then to eval. Null strata or keys take no part.
    """
    d = df.select(stratum, key).where(F.col(stratum).isNotNull() & F.col(key).isNotNull()).distinct()
    d = positions(d.withColumn("_o", hash_order(F.concat(F.lit(f"{seed}:"), key))), [stratum], "_o", tie=key)
    n = F.col("group_rows")
    share = lambda f: F.least(F.bround(n * f).cast("long"), F.greatest(F.lit(1), F.floor(n / 4)))
    n_val = F.least(share(val), F.greatest(F.lit(0), n - 1))
    n_eval = F.least(share(evals), F.greatest(F.lit(0), n - n_val - 1))
    first = F.when(F.col("pos") < n_val, "val").when(F.col("pos") < n_val + n_eval, "eval").otherwise("train")
    d = materialize(d.select(stratum, key, first.alias("split")), "split-strata")
    got = {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    total = sum(got.values())
    want = {k: max(1, round(total * f)) if total >= 20 else 0 for k, f in (("val", val), ("eval", evals))}
    short = {k: max(0, want[k] - got.get(k, 0)) for k in want}
    if not sum(short.values()):
        return d
    # As many rows as strata are short by rounding, unless more than a quarter is asked for.
    moved = d.where("split = 'train'").orderBy(F.desc(stratum), F.desc(key)).limit(sum(short.values()))
    rank = F.row_number().over(W.orderBy(F.desc(stratum), F.desc(key)))
    moved = materialize(moved.select(stratum, key, F.when(rank <= short["val"], "val").otherwise("eval").alias("to")), "split-moved")
    return d.join(moved, [stratum, key], "left").select(stratum, key, F.coalesce("to", "split").alias("split"))


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only: the order of a seeded shuffle."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def chat_block(question: Column, answer: Column, who: str = "Bot") -> Column:
    return F.concat(F.lit("You: "), question, F.lit(f"\n{who}: "), answer)


def answer_text() -> Column:
    return F.format_string("%s Classification: %s, risk %s. Recommended action: %s", F.col("r_analysis"), F.upper("r_class"), F.col("r_risk"), F.col("r_action"))
