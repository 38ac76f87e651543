"""Memory store, feedback, experience, gates, drift and experiment queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import memory as M
from weftline.operators import text as T
from weftline.operators.positions import positions
from weftline.plans.registering import registering
from weftline.session import table

QUERIES, ORACLE = {}, {}
query = registering(QUERIES, ORACLE)


def ev(spark, sf):
    return table(spark, sf, "events")


_ACT = "CASE event_id % 11 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' WHEN 2 THEN 'restore' WHEN 3 THEN 'dispute' WHEN 4 THEN 'resolve' WHEN 5 THEN 'correct' ELSE 'add' END"
_MUT = f"m AS (SELECT user_id * 100 + event_id % 97 AS id, event_id AS seq, CASE WHEN event_id % 997 = 0 THEN 'purge' ELSE {_ACT} END AS action FROM events)"


def _mutations(spark, sf):
    return ev(spark, sf).selectExpr("user_id * 100 + event_id % 97 AS id", "event_id AS seq", f"CASE WHEN event_id % 997 = 0 THEN 'purge' ELSE {_ACT} END AS action")


@query(
    f"WITH {_MUT}, g AS (SELECT id, arg_max(action, seq) FILTER (action IN ('add', 'restore', 'delete', 'correct')) AS a, arg_max(action, seq) FILTER (action IN ('dispute', 'resolve')) AS s, bool_or(action = 'purge') AS gone, max(seq) AS seq FROM m GROUP BY id) "
    "SELECT id, CASE a WHEN 'delete' THEN 'deleted' WHEN 'correct' THEN 'deprecated' ELSE 'active' END AS state, CASE WHEN s = 'dispute' THEN 'disputed' ELSE 'clear' END AS status, seq FROM g WHERE NOT gone"
)
def memory_state(spark, sf):
    return M.current_state(_mutations(spark, sf))


@query(
    f"WITH {_MUT}, g AS (SELECT id, arg_max(action, seq) FILTER (action IN ('add', 'restore', 'delete', 'correct')) AS a, arg_max(action, seq) FILTER (action IN ('dispute', 'resolve')) AS s, bool_or(action = 'purge') AS gone FROM m GROUP BY id) "
    "SELECT id FROM g WHERE NOT gone AND coalesce(a, 'add') NOT IN ('delete', 'correct') AND coalesce(s, '') <> 'dispute'"
)
def memory_active(spark, sf):
    return M.current_state(_mutations(spark, sf)).where("state = 'active' and status <> 'disputed'").select("id")


@query(
    f"WITH {_MUT}, g AS (SELECT id, arg_max(action, seq) FILTER (action IN ('dispute', 'resolve')) AS s, max(seq) FILTER (action IN ('dispute', 'resolve')) AS seq, bool_or(action = 'purge') AS gone FROM m GROUP BY id) "
    "SELECT id, seq FROM g WHERE NOT gone AND s = 'dispute'"
)
def conflicts_queue(spark, sf):
    """Records that are disputed and not resolved."""
    return M.conflicts(_mutations(spark, sf))


@query(
    "WITH n AS (SELECT user_id AS id, event_id AS seq FROM events WHERE event_id % 3 <> 0), s AS (SELECT user_id AS id, event_id AS seq FROM events WHERE event_id % 3 = 0), f AS (SELECT id, min(seq) AS seq FROM n WHERE id NOT IN (SELECT id FROM s WHERE id IS NOT NULL) GROUP BY id) "
    "SELECT 'refused' AS what, count(*) AS n FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = n.id AND f.seq = n.seq) UNION ALL SELECT 'stored', (SELECT count(*) FROM s) + (SELECT count(*) FROM f)"
)
def guarded_insert(spark, sf):
    """Inserts under immutable ids: what is stored and what is refused."""
    e = ev(spark, sf).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"))
    store, refused = M.inserted(e.where("seq % 3 = 0"), e.where("seq % 3 <> 0"))
    n = lambda d, what: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(refused, "refused").unionByName(n(store, "stored"))


_MEM = (
    "d AS (SELECT doc_id AS seq, 'm' || doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'semantic' WHEN 2 THEN 'episode' WHEN 3 THEN 'session' ELSE 'guess' END AS kind, text AS content, "
    "CASE doc_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'tool' WHEN 2 THEN 'system' ELSE 'import' END AS source, (doc_id % 13) / 10.0 AS confidence, CASE doc_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' ELSE 'maybe' END AS verification_status, "
    "CAST(doc_id % 3 AS INT) AS revision, created_at, {exp} AS expires_at, CASE doc_id % 7 WHEN 0 THEN 'deleted' ELSE 'active' END AS state FROM documents)"
)
_DMEM = _MEM.format(exp="created_at + to_days(CAST(doc_id % 9 AS INT) - 1)")


def _memory(spark, sf):
    spark_sql = _MEM.format(exp="created_at + make_dt_interval(CAST(doc_id % 9 AS INT) - 1)").replace("FROM documents)", "FROM {docs})")
    return spark.sql(f"WITH {spark_sql} SELECT * FROM d", docs=table(spark, sf, "documents"))


@query(
    f"WITH {_DMEM} SELECT id, CASE WHEN trim(coalesce(content, '')) = '' THEN 'empty_content' WHEN kind NOT IN ('fact', 'semantic', 'episode', 'session') THEN 'bad_kind' WHEN NOT confidence BETWEEN 0 AND 1 THEN 'bad_confidence' "
    "WHEN verification_status NOT IN ('unverified', 'verified', 'disputed') THEN 'bad_status' WHEN revision < 1 THEN 'bad_revision' WHEN expires_at < created_at THEN 'expires_before_created' END AS fault FROM d"
)
def memory_validate(spark, sf):
    return _memory(spark, sf).select("id", M.record_fault().alias("fault"))


@query(f"WITH {_DMEM} SELECT id FROM d WHERE expires_at <= TIMESTAMP '2031-06-01'")
def memory_expire(spark, sf):
    m = _memory(spark, sf).withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return M.expired(m, F.lit("2031-06-01").cast("timestamp")).select("id")


@query(
    f"WITH {_DMEM}, l AS (SELECT * FROM d WHERE state <> 'deleted'), r AS (SELECT *, row_number() OVER (PARTITION BY kind, content ORDER BY created_at DESC NULLS LAST, revision DESC, seq DESC) AS rn FROM l) "
    "SELECT id, CASE WHEN rn = 1 OR content IS NULL THEN 'active' ELSE 'deprecated' END AS state_after FROM r"
)
def memory_compact(spark, sf):
    c = M.compact(_memory(spark, sf))
    return c.select("id", F.when(F.col("content").isNull(), "active").otherwise(F.col("state_after")).alias("state_after"))




@query(
    "WITH RECURSIVE l AS (SELECT doc_id AS id, doc_id + 1 AS next FROM documents WHERE doc_id % 6 <> 0), h AS (SELECT id, next AS head FROM l UNION ALL SELECT h.id, l.next FROM h JOIN l ON h.head = l.id) "
    "SELECT id, max(head) AS head FROM h GROUP BY id"
)
def revision_heads(spark, sf):
    links = table(spark, sf, "documents").where("doc_id % 6 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") + 1).alias("next"))
    return M.revision_heads(links).where("id <> head")


@query(f"WITH {_DMEM} SELECT id || ':r' || (revision + 1) AS id, kind, content || '!' AS content, revision + 1 AS revision, id AS deprecates FROM d WHERE verification_status = 'maybe'")
def memory_correct(spark, sf):
    return M.corrected(_memory(spark, sf).where("verification_status = 'maybe'"), F.concat("content", F.lit("!")), F.current_timestamp()).drop("created_at")


@query(f"WITH {_DMEM} SELECT id, ['a', 'promoted:from_session:' || id] AS attribution, ['promoted'] AS tags, CASE WHEN confidence >= 0.7 THEN 'verified' ELSE 'unverified' END AS verification_status FROM d WHERE kind = 'session'")
def session_promote(spark, sf):
    m = _memory(spark, sf).where("kind = 'session'").withColumns({"attribution": F.array(F.lit("a")), "tags": F.array(F.lit("promoted"))})
    return M.promoted(m)


@query(f"WITH {_DMEM} SELECT kind, state, count(*) AS n FROM d GROUP BY ALL")
def store_stats(spark, sf):
    return _memory(spark, sf).groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DMEM} SELECT id FROM d WHERE kind = 'session' AND expires_at > TIMESTAMP '2031-06-01' AND contains(content, 'e')")
def session_recall(spark, sf):
    """Live session rows within their scope."""
    return _memory(spark, sf).where("kind = 'session' and expires_at > timestamp '2031-06-01' and contains(content, 'e')").select("id")


_TIERS = "CASE coalesce(tier, '') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.TIER_MIN.items()) + " ELSE 1.0 END"
_FB = (
    "list_filter([CASE WHEN coalesce(tier, '') NOT IN (" + ", ".join(f"'{k}'" for k in M.TIER_MIN) + ") THEN 'unknown_tier' END, CASE WHEN coalesce(source, '') = '' THEN 'missing_source' END, "
    "CASE WHEN coalesce(verification_status, '') NOT IN ('verified', 'human_verified', 'automated') THEN 'unverifiable_status:' || CASE WHEN coalesce(verification_status, '') = '' THEN 'none' ELSE verification_status END END, "
    f"CASE WHEN length(trim(coalesce(text, ''))) < 4 THEN 'too_short' END, CASE WHEN coalesce(confidence, 0) < {_TIERS} THEN 'low_confidence' END], lambda x: x IS NOT NULL)"
)


@query(f"SELECT id, given_at, {_FB} AS errors, CASE WHEN len({_FB}) = 0 THEN 'accepted' ELSE 'quarantined' END AS result FROM feedback")
def feedback_cascade(spark, sf):
    e = M.feedback_errors()
    return table(spark, sf, "feedback").select("id", "given_at", e.alias("errors"), F.when(F.size(e) == 0, "accepted").otherwise("quarantined").alias("result"))


@query(f"SELECT tier, count(*) AS n, count(*) FILTER (len({_FB}) = 0) AS accepted FROM feedback GROUP BY tier")
def intake_report(spark, sf):
    return table(spark, sf, "feedback").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(M.feedback_errors()) == 0).alias("accepted"))


@query("WITH e AS (SELECT *, map_keys(payload) AS ks FROM experience) SELECT min(id) AS id, dedup_key FROM e WHERE dedup_key IS NOT NULL GROUP BY dedup_key")
def experience_dedup(spark, sf):
    """First example of each dedup key, whatever its status."""
    return T.first_of_each(table(spark, sf, "experience").where("dedup_key is not null").select("id", "dedup_key"), ["dedup_key"], ["id"])


@query("SELECT status, kind, count(*) AS n FROM experience GROUP BY ALL")
def experience_stats(spark, sf):
    return table(spark, sf, "experience").groupBy("status", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, kind FROM experience WHERE status = 'active' AND kind IN ('sft', 'preference')")
def active_examples(spark, sf):
    return table(spark, sf, "experience").where("status = 'active' and kind in ('sft', 'preference')").select("id", "kind")


_CANON = "'{' || array_to_string(list_transform(list_sort(map_keys(payload)), lambda k: '\"' || k || '\": \"' || payload[k] || '\"'), ', ') || '}'"


@query(f"SELECT id, kind || ':' || substring(sha256({_CANON}), 1, 16) AS key FROM experience WHERE payload IS NOT NULL")
def kinded_keys(spark, sf):
    """Key of kind and canonical payload (sorted fields)."""
    pairs = F.transform(F.array_sort(F.map_keys("payload")), lambda k: F.concat(F.lit('"'), k, F.lit('": "'), F.element_at("payload", k), F.lit('"')))
    canon = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    e = table(spark, sf, "experience").where("payload is not null")
    return e.select("id", F.concat("kind", F.lit(":"), F.substring(F.sha2(canon, 256), 1, 16)).alias("key"))


@query("SELECT id, context AS input, text AS output FROM feedback WHERE tier = 'user_signal'")
def sft_payloads(spark, sf):
    return table(spark, sf, "feedback").where("tier = 'user_signal'").select("id", F.col("context").alias("input"), F.col("text").alias("output"))


@query("SELECT id, CASE event_id % 5 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'quarantined' ELSE 'active' END AS status FROM (SELECT user_id AS id, max(event_id) AS event_id FROM events GROUP BY user_id)")
def example_status(spark, sf):
    """Last status event of each example."""
    last = ev(spark, sf).groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("e"))
    return last.select("id", F.when(F.col("e") % 5 == 0, "withdrawn").when(F.col("e") % 5 == 1, "quarantined").otherwise("active").alias("status"))


_MET = "m AS (SELECT 'u' || user_id AS name, event_type AS metric, avg(value) FILTER (event_id % 2 = 0) AS base, avg(value) FILTER (event_id % 2 = 1) AS candidate FROM events GROUP BY ALL)"
_GATES = [("purchase", "gain", "", -5.0), ("view", "no_regress", "", 10.0), ("click", "absolute", "<", 500.0)]


def _metrics(spark, sf):
    odd = F.col("event_id") % 2 == 1
    return ev(spark, sf).groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("metric")).agg(
        F.avg(F.when(~odd, F.col("value"))).alias("base"), F.avg(F.when(odd, F.col("value"))).alias("candidate")
    )


@query(
    f"WITH {_MET}, g AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in _GATES) + ") t(metric, type, op, bound)), n AS (SELECT DISTINCT name FROM m), "
    "j AS (SELECT n.name, g.*, m.base, m.candidate FROM n CROSS JOIN g LEFT JOIN m ON m.name = n.name AND m.metric = g.metric), "
    "r AS (SELECT name, bool_and(CASE type WHEN 'gain' THEN base - candidate >= bound WHEN 'no_regress' THEN candidate - base <= bound ELSE candidate < bound END) AS ok, bool_or(base IS NULL) AS missing FROM j GROUP BY name) "
    "SELECT name, CASE WHEN missing THEN 'MISSING' WHEN ok THEN 'ACCEPT' ELSE 'REJECT' END AS decision FROM r"
)
def gate_decision(spark, sf):
    g = spark.createDataFrame(_GATES, "metric string, type string, op string, bound double")
    return M.gate_decisions(_metrics(spark, sf), F.broadcast(g))


@query(f"WITH {_MET} SELECT name, metric, round_even(candidate - base, 6) AS delta FROM m WHERE base IS NOT NULL AND candidate IS NOT NULL")
def base_vs_candidate(spark, sf):
    return _metrics(spark, sf).where("base is not null and candidate is not null").select("name", "metric", F.bround(F.col("candidate") - F.col("base"), 6).alias("delta"))


_SER = "s AS (SELECT event_type || '-' || user_id % 10 AS name, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS seq, avg(value) / 100 AS value FROM events GROUP BY ALL)"


@query(
    f"WITH {_SER}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM s), l AS (SELECT * FROM r WHERE rn <= 5), t AS (SELECT *, -(value - lag(value) OVER (PARTITION BY name ORDER BY seq)) AS step, min(value) OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM l), "
    "g AS (SELECT name, count(*) AS n, avg(step) AS ms, arg_max(value, seq) AS last, arg_max(best, seq) AS best FROM t GROUP BY name), h AS (SELECT *, CASE WHEN n < 3 THEN 'needs_more_data' WHEN ms > 0.1 THEN 'improving' WHEN ms < -0.1 THEN 'regressing' ELSE 'stable' END AS trend FROM g) "
    "SELECT name, trend, CASE trend WHEN 'regressing' THEN true WHEN 'stable' THEN last - best > 0.2 ELSE false END AS drift FROM h"
)
def drift_report(spark, sf):
    day = F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp")))
    s = ev(spark, sf).groupBy(F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("name"), day.alias("seq")).agg((F.avg("value") / 100).alias("value"))
    return M.drift(s)


@query("SELECT user_id AS name, event_id AS sha, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS superseded_by FROM events WHERE event_type = 'purchase'")
def lineage(spark, sf):
    e = ev(spark, sf).where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("name"), F.col("event_id").alias("sha"), F.lead("event_id").over(W.partitionBy("user_id").orderBy("event_id")).alias("superseded_by"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT user_id AS name, max(event_id) FILTER (rn = 1) AS active, max(event_id) FILTER (rn = 2) AS rollback_to FROM r WHERE rn <= 2 GROUP BY user_id")
def rollback_target(spark, sf):
    """Latest and previous entry of each name by aggregates, without sorting histories."""
    e = ev(spark, sf)
    top = e.groupBy("user_id").agg(F.max("event_id").alias("active"))
    prev = e.join(top, "user_id").where("event_id < active").groupBy("user_id").agg(F.max("event_id").alias("rollback_to"))
    return top.join(prev, "user_id", "left").select(F.col("user_id").alias("name"), "active", "rollback_to")


@query("SELECT DISTINCT event_type AS metric FROM events")
def metric_names(spark, sf):
    m = ev(spark, sf).select(F.create_map("event_type", "value").alias("m"))
    return m.select(F.explode(F.map_keys("m")).alias("metric")).distinct()


@query("SELECT event_type, round_even(exp(least(sum(value / 100 * user_id) / sum(user_id), 30)), 6) AS ppl FROM events GROUP BY event_type")
def weighted_ppl(spark, sf):
    mean = F.sum(F.col("value") / 100 * F.col("user_id")) / F.sum("user_id")
    return ev(spark, sf).groupBy("event_type").agg(F.bround(F.exp(F.least(mean, F.lit(30.0))), 6).alias("ppl"))


@query(
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), s AS (SELECT event_type, value, i // greatest(1, n // 7) AS shard FROM r) "
    "SELECT event_type, shard, round_even(avg(value), 6) AS loss FROM s WHERE shard < 7 GROUP BY ALL"
)
def loss_shards(spark, sf):
    """Means of contiguous shards of each trajectory; the remainder is dropped."""
    e = positions(ev(spark, sf).select("event_type", "event_id", "value"), ["event_type"], "event_id")
    shard = F.floor(F.col("pos") / F.greatest(F.lit(1), F.floor(F.col("group_rows") / 7)))
    return e.withColumn("shard", shard).where("shard < 7").groupBy("event_type", "shard").agg(F.bround(F.avg("value"), 6).alias("loss"))


_DET = "d AS (SELECT classification AS truth, CASE WHEN early_warning THEN 'suspicious' WHEN early_warning IS NULL THEN '' ELSE 'normal' END AS pred FROM records WHERE classification IN ('normal', 'suspicious', 'malicious', 'unknown'))"


@query(
    f"WITH {_DET} SELECT round_even(CAST(count(*) FILTER (pred <> '' AND pred = truth) AS DOUBLE) / greatest(1, count(*) FILTER (pred <> '')), 6) AS accuracy, "
    "round_even(CAST(count(*) FILTER (truth <> 'normal' AND pred <> '' AND pred <> 'normal') AS DOUBLE) / greatest(1, count(*) FILTER (truth <> 'normal')), 6) AS detection_of_all_attacks, "
    "round_even(CAST(count(*) FILTER (truth = 'normal' AND pred <> '' AND pred <> 'normal') AS DOUBLE) / greatest(1, count(*) FILTER (truth = 'normal')), 6) AS false_positives FROM d"
)
def detection_metrics(spark, sf):
    r = table(spark, sf, "records").where("classification in ('normal', 'suspicious', 'malicious', 'unknown')")
    p = F.when(F.col("early_warning"), "suspicious").when(F.col("early_warning").isNull(), "").otherwise("normal")
    d = r.select(F.col("classification").alias("t"), p.alias("p"))
    share = lambda a, b: F.bround(F.count_if(a) / F.greatest(F.lit(1), F.count_if(b)), 6)
    t, p = F.col("t"), F.col("p")
    return d.agg(
        share((p != "") & (p == t), p != "").alias("accuracy"),
        share((t != "normal") & (p != "") & (p != "normal"), t != "normal").alias("detection_of_all_attacks"),
        share((t == "normal") & (p != "") & (p != "normal"), t == "normal").alias("false_positives"),
    )


@query(f"WITH {_DET} SELECT truth, count(*) FILTER (pred <> '' AND pred = truth) AS hit, count(*) FILTER (pred <> '') AS scored FROM d GROUP BY truth")
def detection_by_class(spark, sf):
    r = table(spark, sf, "records").where("classification in ('normal', 'suspicious', 'malicious', 'unknown')")
    p = F.when(F.col("early_warning"), "suspicious").when(F.col("early_warning").isNull(), "").otherwise("normal")
    return r.groupBy(F.col("classification").alias("truth")).agg(F.count_if((p != "") & (p == F.col("classification"))).alias("hit"), F.count_if(p != "").alias("scored"))


@query("SELECT event_type, max(event_id) AS last_event, arg_max(value, event_id) AS last_value FROM events GROUP BY event_type")
def audit_last(spark, sf):
    return ev(spark, sf).groupBy("event_type").agg(F.max("event_id").alias("last_event"), F.max_by("value", "event_id").alias("last_value"))


@query("SELECT raw_id FROM raw_records WHERE CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN json_type(payload, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND TRY_CAST(payload ->> '$.confidence' AS DOUBLE) < 0.8 ELSE false END")
def experiment_query(spark, sf):
    """Ad-hoc filter on JSON documents: dot path, operator suffix, type-strict."""
    path, op, value = M.parse_filter("confidence__lt=0.8")
    return table(spark, sf, "raw_records").where(M.match_json(F.col("payload"), path, value, op)).select("raw_id")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value < 50) AS below FROM events GROUP BY event_type HAVING count(*) FILTER (value < 50) > 0")
def threshold_check(spark, sf):
    g = ev(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 50).alias("below"))
    return g.where("below > 0")
