"""Streaming and connector queries: each runs to the end of its input and returns what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.plans.learning import _FB
from weftline.plans.registering import registering
from weftline.session import table
from weftline.sources import readers, writers
from weftline.sources.registry import Registry
from weftline.storage import checkpoint_dir
from weftline.streaming import pipelines as P

QUERIES, ORACLE = {}, {}
query = registering(QUERIES, ORACLE)
FIELDS = ["id", "source", "tier", "text", "confidence", "verification_status", "context"]


def work(spark) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


_IN = f"SELECT id, tier, text FROM feedback WHERE length(trim(text)) > 0 AND len({_FB}) {{0}} 0"


def _intake(spark, sf):
    w = work(spark)
    table(spark, sf, "feedback").select(*FIELDS).repartition(4).write.json(f"{w}/inbox")
    P.run_intake(spark, f"{w}/inbox", f"{w}/accepted", f"{w}/quarantined", f"{w}/checkpoint", status=f"{w}/status").awaitTermination()
    return w


@query(_IN.format("="))
def stream_intake(spark, sf):
    return spark.read.parquet(f"{_intake(spark, sf)}/accepted").select("id", "tier", "text")


@query(_IN.format(">"))
def stream_quarantine(spark, sf):
    return spark.read.parquet(f"{_intake(spark, sf)}/quarantined").select("id", "tier", "text")


@query(f"SELECT count(*) FILTER (len({_FB}) = 0) AS accepted, count(*) FILTER (len({_FB}) > 0) AS quarantined, true AS pending FROM feedback WHERE length(trim(text)) > 0")
def stream_status(spark, sf):
    """What the intake says of its batches."""
    st = spark.read.parquet(f"{_intake(spark, sf)}/status")
    return st.agg(F.sum("accepted").alias("accepted"), F.sum("quarantined").alias("quarantined"), F.max("pending").alias("pending"))


@query("SELECT id FROM experience WHERE status = 'active' AND id NOT IN (SELECT id FROM experience WHERE kind = 'sft' AND id IS NOT NULL)")
def pending_examples(spark, sf):
    e = table(spark, sf, "experience")
    return P.pending_examples(e.where("status = 'active'"), e.where("kind = 'sft'")).select("id")


def _events_stream(spark, sf, flush=False):
    """flush: a last row without key, 400 days on, moves the watermark past all others, so that nothing stays open but its own state."""
    e = table(spark, sf, "events")
    w = work(spark)
    e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{w}/events")
    if flush:
        last = spark.read.parquet(f"{w}/events").agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).where("ts is not null")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        last.select(none("long", "event_id"), "ts", none("long", "user_id"), none("string", "event_type"), none("double", "value")).write.mode("append").parquet(f"{w}/events")
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(f"{w}/events"), w


def _finish(stream, w):
    stream.writeStream.option("checkpointLocation", f"{w}/checkpoint").trigger(availableNow=True).format("parquet").outputMode("append").start(f"{w}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{w}/out")


@query("SELECT count(DISTINCT user_id || ':' || event_type) AS keys FROM events")
def stream_dedup(spark, sf):
    s, w = _events_stream(spark, sf)
    s = s.withColumn("k", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type"))
    return _finish(P.dedup_stream(s, "k", "ts", "400 days").select("k"), w).agg(F.count(F.lit(1)).alias("keys"))


@query()
def stream_sessions(spark, sf):
    s, w = _events_stream(spark, sf, flush=True)
    return _finish(P.session_stream(s, "user_id", "ts"), w)


@query()
def stream_windows(spark, sf):
    s, w = _events_stream(spark, sf, flush=True)
    return _finish(P.windowed_counts(s, "ts", "event_type").select("window.start", "event_type", "n"), w)


_DRIFT = (
    "WITH s AS (SELECT event_type AS name, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS seq, avg(value) / 100 + CASE WHEN event_type < 'm' THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 % 100000 * 0.2 ELSE 0 END AS value FROM events GROUP BY event_type, date_trunc('day', ts)), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM s), l AS (SELECT * FROM r WHERE rn <= 5), "
    "t AS (SELECT *, -(value - lag(value) OVER (PARTITION BY name ORDER BY seq)) AS step, min(value) OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM l), "
    "g AS (SELECT name, avg(step) AS ms, arg_max(value, seq) AS last, arg_max(best, seq) AS best FROM t GROUP BY name)"
)


def _drift(spark, sf, registry=None):
    w = work(spark)
    day = F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp")))
    points = table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), day.alias("seq")).agg((F.avg("value") / 100).alias("value"))
    points = points.withColumn("value", F.col("value") + F.when(F.col("name") < "m", F.floor(F.col("seq") / 86400) % 100000 * 0.2).otherwise(0))
    points.write.parquet(f"{w}/points")
    points = spark.readStream.schema("name string, seq long, value double").parquet(f"{w}/points")
    P.drift_watch(points, f"{w}/history", f"{w}/alerts", f"{w}/checkpoint", registry).awaitTermination()
    return spark.read.schema("name string, trend string, drift boolean, batch int, at int").parquet(f"{w}/alerts").select("name", "trend")


@query(f"{_DRIFT} SELECT name, CASE WHEN ms < -0.1 THEN 'regressing' ELSE 'stable' END AS trend FROM g WHERE ms < -0.1 OR (ms <= 0.1 AND last - best > 0.2)")
def stream_drift(spark, sf):
    """Names that drift; the values of some rise by a fifth a day, so that there are such names."""
    return _drift(spark, sf)


@query(f"{_DRIFT} SELECT name, CASE WHEN ms < -0.1 OR (ms <= 0.1 AND last - best > 0.2) THEN '1.0.0' ELSE '2.0.0' END AS semver FROM g")
def stream_drift_rollback(spark, sf):
    """Two versions of each name, the second promoted; names that drift go back to the first."""
    path = f"{work(spark)}/registry"
    reg = Registry(spark, path)
    for r in table(spark, sf, "events").select("event_type").distinct().collect():
        for v in (1, 2):
            e = reg.register(r[0], f"{v}.0.0", f"{r[0]}-{v}", "c", f"2031-01-0{v}")
        reg.promote(r[0], e["sha256"])
    reg.save()
    _drift(spark, sf, path)
    return writers.current(spark, path).where("active").select("name", "semver")


@query("SELECT category, count(*) AS n FROM records WHERE input IS NOT NULL GROUP BY category")
def text_round_trip(spark, sf):
    """Ordered text sink and line scan."""
    w = work(spark)
    r = table(spark, sf, "records").where("input is not null").select(F.to_json(F.struct("category", "dedup_key", "input")).alias("line"), "category", "dedup_key", "record_no")
    writers.ordered_text(r, f"{w}/text", "line", ["category", "dedup_key", "record_no"])
    back, _ = readers.json_lines(spark, f"{w}/text", "category string, dedup_key string, input string")
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_no, count(*) AS n FROM raw_records GROUP BY file_no")
def audit_append(spark, sf):
    """Audit rows appended in two commits and read back."""
    w = work(spark)
    raw = table(spark, sf, "raw_records").select("raw_id", "file_no", F.col("landed_at").cast("timestamp").alias("ts"))
    for part in (0, 1):
        writers.append_audit(raw.where(f"raw_id % 2 = {part}"), f"{w}/audit")
    return spark.read.parquet(f"{w}/audit").groupBy("file_no").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_no, count(*) AS n, CASE WHEN file_no % 2 = 0 THEN 1 ELSE 2 END AS version FROM raw_records GROUP BY file_no")
def audited_snapshots(spark, sf):
    """Two commits of audit rows with a snapshot each; an attempt that fails leaves nothing visible."""
    w = work(spark)
    raw = table(spark, sf, "raw_records").select("raw_id", "file_no", F.col("landed_at").cast("timestamp").alias("ts"))
    for part in (0, 1):
        writers.snapshot(raw.where(f"file_no % 2 = {part}").select("raw_id"), f"{w}/store", raw.where(f"file_no % 2 = {part}"))
    writers.append_audit(raw.withColumn("version", F.lit(3)), f"{w}/store/audit")  # what a writer leaves that dies before its snapshot shows
    return writers.committed_audit(spark, f"{w}/store").groupBy("file_no", "version").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name AS name, '2.0.0' AS semver, 3 AS entries FROM region")
def registry_rollback(spark, sf):
    """Three versions of each artifact registered, the last promoted, then rolled back by one, over snapshots."""
    path = f"{work(spark)}/registry"
    names = [r[0] for r in table(spark, sf, "region").select("r_name").collect()]
    reg = Registry(spark, path)
    for n in names:
        for v in (1, 2, 3):
            e = reg.register(n, f"{v}.0.0", f"{n}-{v}", "c", f"2031-01-0{v}")
        reg.promote(n, e["sha256"])
    reg.save()
    reg = Registry(spark, path)
    for n in names:
        reg.rollback(n)
    reg.save()
    now = writers.current(spark, path)
    return now.groupBy("name").agg(F.max(F.when(F.col("active"), F.col("semver"))).alias("semver"), F.count(F.lit(1)).cast("int").alias("entries"))


@query(
    "SELECT doc_kind, count(*) AS rows, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters, CAST(bit_xor(CAST('0x' || substring(sha256(doc_id || ':' || coalesce(text, '')), 1, 15) AS BIGINT)) AS BIGINT) AS digest, "
    "'squeeze, scrub' AS cleaning_rules, 'length, repetition' AS filters FROM documents GROUP BY doc_kind"
)
def corpus_manifest(spark, sf):
    """Content digest, rules and filters of each part of the corpus."""
    return writers.manifest(table(spark, sf, "documents"), "doc_kind", "doc_id", "text", ["squeeze", "scrub"], ["length", "repetition"])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 0")
def snapshot_store(spark, sf):
    """A store with a configuration check: only active, embedded rows come back."""
    w = work(spark)
    conf = {"name": "given", "dim": 64}
    e = table(spark, sf, "embeddings").withColumn("state", F.when(F.col("vec_id") % 2 == 0, "active").otherwise("deleted"))
    e.write.parquet(f"{w}/store/records")
    spark.createDataFrame([(1, str(sorted(conf.items())))], "schema int, embedder string").write.json(f"{w}/store/meta")
    return readers.open_store(spark, f"{w}/store", conf).select("vec_id", "label")




_LABEL = "CASE l_suppkey % 4 WHEN 0 THEN 'Bad Label' WHEN 1 THEN 'normal' WHEN 2 THEN 'smurf' ELSE 'unseen_attack' END"


def _telemetry(spark, sf, **how):
    nums = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: ((F.col("l_orderkey") + i) % 7).cast("string"))
    line = F.array_join(F.concat(nums, F.array(F.expr(_LABEL), F.lit("5"))), ",")
    return readers.telemetry_csv(table(spark, sf, "lineitem").select(line.alias("line")), **how)


@query(f"SELECT {_LABEL} AS label, count(*) AS rows, count(*) FILTER (l_suppkey % 4 <> 0) AS alerts, count(*) FILTER (l_suppkey % 4 IN (1, 2)) AS known FROM lineitem GROUP BY 1")
def csv_telemetry(spark, sf):
    """Positional CSV of held-out rows: unseen labels are alerts too, malformed rows are counted, not fatal."""
    a = _telemetry(spark, sf)
    return a.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count("alert").alias("alerts"), F.count_if("known").alias("known"))


@query(f"SELECT {_LABEL} AS label, count(*) AS rows, count(*) FILTER (l_suppkey % 4 IN (1, 2)) AS alerts FROM lineitem GROUP BY 1")
def csv_telemetry_domain(spark, sf):
    """The same rows where only normal and the known attacks are well formed."""
    return _telemetry(spark, sf, domain=True).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count("alert").alias("alerts"))
