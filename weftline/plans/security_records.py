"""Record validation, repair, split and manifest queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import records as R
from weftline.operators import text as T
from weftline.operators.positions import positions
from weftline.plans.corpus import KEY, SQ
from weftline.plans.registering import registering
from weftline.session import spread, table

QUERIES, ORACLE = {}, {}
query = registering(QUERIES, ORACLE)


def recs(spark, sf):
    return table(spark, sf, "records")


def repaired(spark, sf):
    cols = ["record_no", "input", "classification", "risk", "early_warning", "evidence", "analysis", "recommended_action", "confidence", "hardness", "category"]
    return R.repaired(spread(recs(spark, sf).select(*cols), "record_no"))


_L = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_HARD = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.HARDNESS.items()) + " END"


def _loop_a(t: str) -> str:
    h = f"substring({t}, 1, 480)"
    p = lambda o: f"substring({h}, CAST({o} AS BIGINT) + 1, 60)"
    occ = lambda x: f"(CASE WHEN trim({x}) = '' THEN 0 ELSE (length({h}) - length(replace({h}, {x}, ''))) / length({x}) END >= 3)"
    return f"(CASE WHEN length({h}) < 240 THEN false ELSE " + " OR ".join(occ(p(o)) for o in ("0", f"length({h}) // 2", f"length({h}) - 120")) + " END)"


def _loop_b(t: str) -> str:
    occ = lambda o: f"(length(substring({t}, {o + 1}, 60)) = 60 AND (length({t}) - length(replace({t}, substring({t}, {o + 1}, 60), ''))) / 60 > 3)"
    return f"(CASE WHEN length({t}) < 120 THEN false ELSE " + " OR ".join(occ(o) for o in (20, 30, 40)) + " END)"


def _noop(t: str) -> str:
    b = f"lower(rtrim({SQ(t)}, '.!? '))"
    return "(" + " OR ".join(f"{b} = '{p}' OR (starts_with({b}, '{p}') AND length({b}) < {len(p) + 90})" for p in R.NO_OPS) + ")"


_ONE = lambda c: f"coalesce({SQ(c)}, '')"
_BASE = (
    f"b AS (SELECT *, {_ONE('input')} AS ri, lower({_ONE('classification')}) AS rc, upper({_ONE('risk')}) AS rr, "
    f"list_filter(list_transform(evidence, lambda e: {SQ('e')}), lambda e: e <> '') AS re, {_ONE('analysis')} AS ra, {_ONE('recommended_action')} AS rx FROM records)"
)


def _salvage(strict: bool) -> str:
    rules = [
        ("length(ri) < 120", "input_too_short"), ("length(ri) > 1200", "input_too_long"), (_loop_a("ri"), "input_repetitive"),
        (f"rc NOT IN {_L(R.CLASSES)}", "bad_classification"), (f"rr NOT IN {_L(R.HARDNESS)}", "bad_risk"),
        ("evidence IS NULL", "evidence_not_list"), ("len(re) = 0", "evidence_empty"), ("length(ra) < 40", "analysis_too_short"),
        ("length(ra) > 420", "analysis_too_long"), (_loop_a("ra"), "analysis_repetitive"), ("rx = ''", "no_recommended_action"),
        (f"{_noop('rx')} AND ({'true' if strict else 'false'} OR rc <> 'normal')", "action_is_no_op"),
        ("length(rx) < 40", "action_too_short"), ("confidence IS NULL", "bad_confidence"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in rules) + " END"


_REP = f"{_BASE}, s AS (SELECT *, {_salvage(False)} AS reason, rc IN {_L(R.WARNED)} AS r_early, least(0.97, greatest(0.0, confidence)) AS r_conf, {_HARD.format('rr')} AS r_hard, CASE WHEN trim(category) IN {_L(R.CATEGORIES)} THEN trim(category) WHEN rc = 'normal' THEN 'Normal behavior' ELSE 'Suspicious behavior' END AS r_cat FROM b)"


@query(
    f"WITH {_REP} SELECT record_no, reason, ri AS r_input, rc AS r_class, rr AS r_risk, r_early, r_conf AS r_confidence, r_hard AS r_hardness, r_cat AS r_category, "
    "ra || ' Classification: ' || upper(rc) || ', risk ' || rr || '. Recommended action: ' || rx AS answer FROM s"
)
def repair_records(spark, sf):
    cols = ["record_no", "reason", "r_input", "r_class", "r_risk", "r_early", "r_confidence", "r_hardness", "r_category"]
    return repaired(spark, sf).select(*cols, R.answer_text().alias("answer"))


@query(f"WITH {_REP} SELECT reason, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM records), 4) AS pct FROM s WHERE reason IS NOT NULL GROUP BY reason")
def reject_histogram(spark, sf):
    d = repaired(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return d.withColumn("pct", F.bround(F.col("n") * 100.0 / total, 4)).where("reason is not null")


@query(f"WITH {_REP} SELECT rc AS class, count(*) AS records, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason LIKE 'input%') AS bad_input, count(*) FILTER (reason LIKE 'a%') AS bad_answer FROM s GROUP BY rc")
def survival_by_class(spark, sf):
    r = F.col("reason")
    return repaired(spark, sf).groupBy(F.col("r_class").alias("class")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(r.isNull()).alias("kept"), F.count_if(r.startswith("input")).alias("bad_input"), F.count_if(r.startswith("a")).alias("bad_answer")
    )


@query(
    f"WITH {_REP} SELECT count(*) FILTER (ri <> input) AS flattened, count(*) FILTER (rc <> classification) AS class_case, count(*) FILTER (rr <> risk) AS risk_case, "
    "count(*) FILTER (r_early <> early_warning) AS flag, count(*) FILTER (r_hard <> hardness) AS hardness, count(*) FILTER (r_cat <> category) AS category, count(*) FILTER (r_conf <> confidence) AS confidence FROM s WHERE reason IS NULL"
)
def repair_counters(spark, sf):
    pairs = {"flattened": ("r_input", "input"), "class_case": ("r_class", "classification"), "risk_case": ("r_risk", "risk"), "flag": ("r_early", "early_warning"), "hardness": ("r_hardness", "hardness"), "category": ("r_category", "category"), "confidence": ("r_confidence", "confidence")}
    d = repaired(spark, sf).where("reason is null")
    return d.agg(*[F.count_if(F.col(a) != F.col(b)).alias(k) for k, (a, b) in pairs.items()])


def _v2() -> str:
    req = ["input", "classification", "risk", "early_warning", "evidence", "analysis", "recommended_action", "confidence"]
    miss = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in req) + "], lambda x: x IS NOT NULL), ',')"
    rules = [
        ("length(ri) < 120", "input_too_short"), ("length(ri) > 1200", "input_too_long"), (_loop_a("ri"), "input_repetitive"),
        (f"rc NOT IN {_L(R.CLASSES)}", "bad_classification"), (f"rr NOT IN {_L(R.HARDNESS)}", "bad_risk"), ("len(re) = 0", "evidence_empty"),
        ("length(ra) < 40", "analysis_too_short"), ("length(ra) > 420 OR length(rx) > 420", "text_too_long"), (_loop_a("ra"), "analysis_repetitive"),
        ("rx = ''", "no_recommended_action"), (_noop("rx"), "action_is_no_op"), ("length(rx) < 40", "action_too_short"),
        (f"early_warning <> (rc IN {_L(R.WARNED)})", "early_warning_inconsistent"),
    ]
    return f"CASE WHEN {miss} <> '' THEN 'missing:' || {miss} " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in rules) + " END"


@query(f"WITH {_BASE} SELECT record_no, {_v2()} AS reason FROM b")
def validate_records(spark, sf):
    return R.strict_reason(recs(spark, sf)).select("record_no", F.col("reason2").alias("reason"))


_GEN = [
    ("NOT coalesce(length(input), 0) BETWEEN 120 AND 1200", "input_len"), ("NOT coalesce(length(analysis), 0) BETWEEN 40 AND 420", "analysis_len"),
    ("NOT coalesce(length(recommended_action), 0) BETWEEN 40 AND 420", "action_len"), (f"NOT coalesce(classification IN {_L(R.CLASSES)}, false)", "bad_class"),
    (f"NOT coalesce(risk IN {_L(R.HARDNESS)}, false)", "bad_risk"), (f"NOT coalesce(early_warning = (classification IN {_L(R.WARNED)}), false)", "early_inconsistent"),
    ("coalesce(len(evidence), 0) = 0", "no_evidence"), (f"{_loop_b('input')} OR {_loop_b('analysis')}", "repetitive"),
]


@query("SELECT record_no, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in _GEN) + " END AS reason FROM records")
def generator_gate(spark, sf):
    return recs(spark, sf).select("record_no", R.generator_reason().alias("reason"))


_S = lambda c: f"coalesce({c}, '')"
_FAULTS = {
    "missing_fields": " OR ".join(f"{c} IS NULL" for c in R.REQUIRED),
    "bad_classification": f"{_S('classification')} NOT IN {_L(R.CLASSES)}", "bad_risk": f"{_S('risk')} NOT IN {_L(R.HARDNESS)}",
    "bad_confidence": "NOT coalesce(confidence, -1) BETWEEN 0 AND 1", "early_warning_not_bool": "early_warning IS NULL",
    "hardness_mismatch": f"hardness IS DISTINCT FROM {_HARD.format('risk')}", "evidence_empty": "coalesce(len(evidence), 0) = 0",
    "input_multiline": f"contains({_S('input')}, chr(10))", "input_too_short": f"length({_S('input')}) < 120", "input_too_long": f"length({_S('input')}) > 1200",
    "input_repetitive": _loop_a(_S("input")), "analysis_too_short": f"length({_S('analysis')}) < 40", "analysis_too_long": f"length({_S('analysis')}) > 420",
    "analysis_repetitive": _loop_a(_S("analysis")), "action_is_no_op": f"{_noop(_S('recommended_action'))} AND classification IN {_L(R.WARNED)}",
    "accepted_no_op_on_normal": f"{_noop(_S('recommended_action'))} AND classification = 'normal'", "action_too_short": f"length({_S('recommended_action')}) < 40",
    "early_warning_inconsistent": f"coalesce(early_warning, false) <> ({_S('classification')} IN {_L(R.WARNED)})", "confidence_at_ceiling": "coalesce(confidence, 0) > 0.97",
    "unknown_category": f"{_S('category')} NOT IN {_L(R.CATEGORIES)}", "missing_provenance": f"NOT coalesce(synthetic, false) OR {_S('source')} = ''",
    "dedup_key_mismatch": f"dedup_key IS DISTINCT FROM {KEY(_S('input'))}", "early_warning_on_normal": "coalesce(early_warning, false) AND classification = 'normal'",
}


@query(
    " UNION ALL ".join(f"SELECT '{k}' AS fault, count(*) FILTER ({c}) AS n FROM records" for k, c in _FAULTS.items())
    + " UNION ALL SELECT 'duplicate_record', count(*) - (SELECT count(*) FROM (SELECT DISTINCT dedup_key FROM records)) FROM records"
)
def audit_invariants(spark, sf):
    return R.audit(spread(recs(spark, sf), "record_no"))


@query(f"WITH {_REP}, v AS (SELECT record_no, {KEY('ri')} AS key FROM s WHERE reason IS NULL) SELECT key, min(record_no) AS record_no FROM v GROUP BY key")
def keyed_dedup(spark, sf):
    v = repaired(spark, sf).where("reason is null").select("record_no", T.content_key(F.col("r_input")).alias("key"))
    return T.first_of_each(v, ["key"], ["record_no"])


@query(
    f"WITH {_REP} SELECT record_no, format('salvaged-v1-{{:06d}}', row_number() OVER (ORDER BY record_no)) AS new_id, row_number() OVER (ORDER BY record_no) AS new_index FROM s WHERE reason IS NULL"
)
def provenance_stamp(spark, sf):
    """Sequential ids in input order."""
    d = positions(repaired(spark, sf).where("reason is null").select("record_no"), [], "record_no")
    n = F.col("pos") + 1
    return d.select("record_no", n.alias("new_index"), F.format_string("salvaged-v1-%06d", n).alias("new_id"))


@query(f"WITH {_REP} SELECT record_no, 'ALERT ' || ri || ' | EARLY_WARNING ' || rc || ' RISK=' || rr || ' HARDNESS=' || r_hard AS line, 'You: ' || ri || chr(10) || 'Bot: ' || ra AS block FROM s WHERE reason IS NULL")
def alert_and_chat_text(spark, sf):
    d = repaired(spark, sf).where("reason is null")
    line = F.format_string("ALERT %s | EARLY_WARNING %s RISK=%s HARDNESS=%d", "r_input", "r_class", "r_risk", "r_hardness")
    return d.select("record_no", line.alias("line"), R.chat_block(F.col("r_input"), F.col("r_analysis")).alias("block"))


@query(
    r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_kind = 'alert' AND text IS NOT NULL) "
    r"SELECT doc_id, regexp_extract(line, 'EARLY_WARNING[ \t]+([a-zA-Z0-9_]+)', 1) AS label, string_split(line, '| EARLY_WARNING')[1] AS prefix, regexp_extract(line, 'EARLY_WARNING[ \t]+([a-zA-Z0-9_]+)', 1) IN ('normal', 'suspicious', 'malicious', 'unknown') AS known FROM l WHERE contains(line, 'EARLY_WARNING')"
)
def label_extract(spark, sf):
    l = T.lines_of(table(spark, sf, "documents").where("doc_kind = 'alert'")).where(F.col("line").contains("EARLY_WARNING"))  # noqa: E741
    label = F.regexp_extract("line", r"EARLY_WARNING[ \t]+([a-zA-Z0-9_]+)", 1)
    return l.select("doc_id", label.alias("label"), F.substring_index("line", "| EARLY_WARNING", 1).alias("prefix"), label.isin(R.CLASSES).alias("known"))


_CAT = "coalesce(category, '?')"


@query(
    f"WITH c AS (SELECT {_CAT} AS k, count(*) AS w FROM records GROUP BY 1), r AS (SELECT k, 997 * CAST(w AS DOUBLE) / sum(w) OVER () AS raw FROM c), "
    "f AS (SELECT k, floor(raw) AS base, round(raw - floor(raw), 9) AS frac FROM r), g AS (SELECT *, row_number() OVER (ORDER BY frac DESC, k) AS rk, 997 - sum(base) OVER () AS short FROM f) "
    "SELECT k, CAST(base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g"
)
def quota_plan(spark, sf):
    c = recs(spark, sf).groupBy(F.coalesce("category", F.lit("?")).alias("k")).agg(F.count(F.lit(1)).alias("w"))
    return R.quotas(c, 997)


@query(
    "WITH n AS (SELECT lower(trim(classification)) AS c, count(*) AS n FROM records WHERE classification IS NOT NULL GROUP BY 1), k AS (SELECT unnest(range(40, (SELECT max(n) + 1 FROM n))) AS k), "
    "s AS (SELECT k, max(least(n, k)) AS top, sum(least(n, k)) AS total FROM k, n GROUP BY k) SELECT CAST(max(k) AS BIGINT) AS cap FROM s WHERE top <= 0.45 * total + 1e-9"
)
def class_cap(spark, sf):
    c = recs(spark, sf).where("classification is not null").groupBy(F.lower(F.trim("classification")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return R.class_cap(c)


_SPLIT = (
    "WITH d AS (SELECT doc_id, coalesce(lang, '?') AS stratum, sha256('k' || doc_id) AS key FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(key), key) AS pos, count(*) OVER (PARTITION BY stratum) AS n FROM d), "
    "v AS (SELECT *, CASE WHEN n >= 3 THEN least(n - 2, greatest(1, CAST(round_even(n * 0.01, 0) AS BIGINT))) ELSE 0 END AS nv FROM r), e AS (SELECT *, CASE WHEN n - 2 - nv >= 1 THEN least(n - 2 - nv, greatest(1, CAST(round_even(n * 0.04, 0) AS BIGINT))) ELSE 0 END AS ne FROM v), "
    "s AS (SELECT doc_id, stratum, CASE WHEN pos <= nv THEN 'val' WHEN pos <= nv + ne THEN 'eval' ELSE 'train' END AS split FROM e)"
)


def _split_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("stratum"), F.sha2(F.concat(F.lit("k"), "doc_id"), 256).alias("key"), F.octet_length("text").alias("bytes"))
    return R.stratified_split(d, "stratum", "key")


@query(_SPLIT + " SELECT * FROM s")
def stratified_split(spark, sf):
    return _split_docs(spark, sf).select("doc_id", "stratum", "split")


@query(_SPLIT + " SELECT split, stratum, count(*) AS rows, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes, CAST(bit_xor(CAST('0x' || substring(sha256('m' || doc_id), 1, 15) AS BIGINT)) AS BIGINT) AS digest FROM s JOIN documents USING (doc_id) GROUP BY ALL")
def split_manifest(spark, sf):
    """Rows, bytes and an order-free digest per split and stratum: no split is gathered into one string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("m"), "doc_id"), 256), 1, 15), 16, 10).cast("long")
    return _split_docs(spark, sf).groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.bit_xor(h).alias("digest"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substring(sha256('20051:' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0 < 0.01 THEN 'val' WHEN CAST('0x' || substring(sha256('20051:' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0 < 0.05 THEN 'eval' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf):
    """The seeded shuffle split as a map-only hash order; proportions hold in expectation."""
    u = R.hash_share(F.col("doc_id").cast("string"), 20051)
    return table(spark, sf, "documents").select("doc_id", F.when(u < 0.01, "val").when(u < 0.05, "eval").otherwise("train").alias("split"))


@query(
    "WITH d AS (SELECT DISTINCT category AS c, dedup_key AS k FROM records WHERE category IS NOT NULL AND dedup_key IS NOT NULL), "
    "p AS (SELECT c, k, row_number() OVER (PARTITION BY c ORDER BY CAST('0x' || substring(sha256('20051:' || k), 1, 15) AS BIGINT), k) - 1 AS pos, count(*) OVER (PARTITION BY c) AS n, count(*) OVER () AS total FROM d), "
    "v AS (SELECT *, least(CAST(round_even(n * 0.03, 0) AS BIGINT), greatest(1, n // 4), greatest(0, n - 1)) AS nv FROM p), e AS (SELECT *, least(CAST(round_even(n * 0.06, 0) AS BIGINT), greatest(1, n // 4), greatest(0, n - nv - 1)) AS ne FROM v), "
    "f AS (SELECT c, k, total, CASE WHEN pos < nv THEN 'val' WHEN pos < nv + ne THEN 'eval' ELSE 'train' END AS split FROM e), "
    "s AS (SELECT CASE WHEN any_value(total) >= 20 THEN greatest(0, greatest(1, round_even(any_value(total) * 0.03, 0)) - count(*) FILTER (split = 'val')) ELSE 0 END AS sv, CASE WHEN any_value(total) >= 20 THEN greatest(0, greatest(1, round_even(any_value(total) * 0.06, 0)) - count(*) FILTER (split = 'eval')) ELSE 0 END AS se FROM f), "
    "t AS (SELECT c, k, row_number() OVER (ORDER BY c DESC, k DESC) AS rk FROM f WHERE split = 'train') "
    "SELECT f.c AS category, f.k AS dedup_key, CASE WHEN rk <= sv THEN 'val' WHEN rk <= sv + se THEN 'eval' ELSE f.split END AS split FROM f LEFT JOIN t USING (c, k), s"
)
def topped_up_split(spark, sf):
    """Seeded stratified split with at most a quarter of a category held out, topped up to its global sizes."""
    return R.topped_up_split(recs(spark, sf), "category", "dedup_key", 0.03, 0.06, 20051)


@query(
    "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_type, sha256(event_id || ':' || event_type), event_id) AS pos, count(*) OVER () AS n FROM events) "
    "SELECT event_id, CASE WHEN pos > n - n * 2 // 100 THEN 'eval' WHEN pos > n - 2 * (n * 2 // 100) THEN 'val' ELSE 'train' END AS split FROM r"
)
def ordered_tail_split(spark, sf):
    """Label-sorted order cut at the tail. Position = total of smaller labels + rank in (label, hash byte)."""
    d = table(spark, sf, "events").select("event_id", "event_type", F.sha2(F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type"), 256).alias("h"))
    d = d.withColumn("b", F.substring("h", 1, 2))
    t = d.groupBy("event_type", "b").agg(F.count(F.lit(1)).alias("c"))
    t = t.withColumns({"before": F.coalesce(F.sum("c").over(W.orderBy("event_type", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("c").over(W.partitionBy())})
    pos = F.row_number().over(W.partitionBy("event_type", "b").orderBy("h", "event_id")) + F.col("before")
    k = F.floor(F.col("n") * 2 / 100)
    j = d.join(t, ["event_type", "b"]).withColumn("pos", pos)
    return j.select("event_id", F.when(F.col("pos") > F.col("n") - k, "eval").when(F.col("pos") > F.col("n") - 2 * k, "val").otherwise("train").alias("split"))


@query("WITH l AS (SELECT doc_id, dense_rank() OVER (ORDER BY source DESC NULLS LAST) AS rk FROM documents WHERE source IS NOT NULL) SELECT doc_id, CASE rk WHEN 1 THEN 'eval' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM l")
def leave_last_sources_out(spark, sf):
    """The last source to eval, the one before to val; the source list is small by nature."""
    d = table(spark, sf, "documents").where("source is not null")
    s = d.select("source").distinct().withColumn("rk", F.row_number().over(W.orderBy(F.desc("source"))))
    return d.join(s, "source").select("doc_id", F.when(F.col("rk") == 1, "eval").when(F.col("rk") == 2, "val").otherwise("train").alias("split"))


@query("SELECT record_no, category, dedup_key FROM records ORDER BY category, dedup_key, record_no")
def sorted_records(spark, sf):
    return recs(spark, sf).select("record_no", "category", "dedup_key").orderBy("category", "dedup_key", "record_no")


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 20")
def shuffled_head(spark, sf):
    """First rows of a seeded shuffle: a bounded heap per task, not a full sort."""
    h = F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)
    return table(spark, sf, "documents").select("doc_id").orderBy(h, "doc_id").limit(20)


@query("SELECT text FROM documents WHERE text IS NOT NULL UNION ALL SELECT input FROM records WHERE input IS NOT NULL")
def union_corpora(spark, sf):
    return table(spark, sf, "documents").select("text").unionByName(recs(spark, sf).select(F.col("input").alias("text"))).where("text is not null")


_FEATS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query("SELECT l_orderkey, l_linenumber, 'ALERT ' || " + " || ' ' || ".join(f"'{c[2:]}=' || {c}" for c in _FEATS) + " || ' | EARLY_WARNING ' || lower(l_returnflag) AS line FROM lineitem")
def telemetry_lines(spark, sf):
    """Fixed-order name=value lines from columns."""
    parts = F.concat_ws(" ", *[F.concat(F.lit(c[2:] + "="), F.col(c).cast("string")) for c in _FEATS])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("ALERT "), parts, F.lit(" | EARLY_WARNING "), F.lower("l_returnflag")).alias("line"))


@query("SELECT count(*) AS lines, count(*) FILTER (CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END) AS objects FROM raw_records")
def tolerant_json_scan(spark, sf):
    """Lines read and lines that are objects; the rest are counted as rejects, not fatal."""
    v = F.try_parse_json("payload")
    ok = F.schema_of_variant(v).startswith("OBJECT")
    return table(spark, sf, "raw_records").agg(F.count(F.lit(1)).alias("lines"), F.count_if(ok).alias("objects"))


@query("SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(payload)) AS k FROM raw_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT') WHERE k NOT IN ('id', 'input', 'classification', 'risk', 'early_warning', 'evidence', 'analysis', 'recommended_action', 'confidence') GROUP BY k")
def unexpected_fields(spark, sf):
    known = ["id", "input", "classification", "risk", "early_warning", "evidence", "analysis", "recommended_action", "confidence"]
    ok = F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT")
    k = table(spark, sf, "raw_records").where(ok).select(F.explode(F.json_object_keys("payload")).alias("k"))
    return k.where(~F.col("k").isin(known)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
