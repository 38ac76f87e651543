"""Rendering, budget and grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import generation as G
from weftline.operators.records import quotas
from weftline.plans.registering import registering
from weftline.session import table

QUERIES, ORACLE = {}, {}
query = registering(QUERIES, ORACLE)


@query(
    "WITH e AS (SELECT event_id, ts, 'host-' || user_id AS h, event_type AS a, CAST(event_id % 9999 AS VARCHAR) AS p, props AS m, event_id % 6 AS d FROM events) SELECT event_id, CASE d "
    "WHEN 0 THEN '<30>' || strftime(ts, '%b %d %H:%M:%S') || ' ' || h || ' ' || a || '[' || p || ']: ' || m WHEN 1 THEN strftime(ts, '%b %d %H:%M:%S') || ' ' || h || ' ' || a || '[' || p || ']: ' || m "
    "WHEN 2 THEN 'CEF:0|' || a || '|sensor|1.0|' || m || '|2|Event|dst=' || h WHEN 4 THEN h || ' system ' || a || ' ' || m WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || a || ' ' || h || ': ' || m "
    "ELSE CAST(json_object('ts', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'host', h, 'log', a, 'pid', p, 'event', m) AS VARCHAR) END AS line FROM e"
)
def render_logs(spark, sf):
    """Events in six dialects, here in turn by id so that SQL can follow."""
    d = F.element_at(F.array(*[F.lit(x) for x in G.DIALECTS]), (F.col("event_id") % 6 + 1).cast("int"))
    host = F.concat(F.lit("host-"), F.col("user_id").cast("string"))
    line = G.render_event(d, F.col("ts"), host, F.col("event_type"), F.col("event_id") % 9999, F.col("props"))
    return table(spark, sf, "events").select("event_id", line.alias("line"))


@query()
def fit_events(spark, sf):
    """Events of each user and day that fit a record, by importance, in time order."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    item = F.struct((F.col("event_id") % 7).alias("imp"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("ord"), F.concat_ws(" ", "event_type", "props").alias("text"))
    return e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("e")))).alias("l")).select("user_id", "day", G.fit_events(F.transform("l", lambda x: x["e"])).alias("text"))


@query(
    "SELECT record_no, CASE WHEN length(analysis || ' Seen ' || grid.timing || ' at ' || grid.env || '.') <= 420 THEN analysis || ' Seen ' || grid.timing || ' at ' || grid.env || '.' "
    "WHEN length(analysis || ' Seen ' || grid.timing || '.') <= 420 THEN analysis || ' Seen ' || grid.timing || '.' ELSE analysis END AS analysis FROM records"
)
def append_clause(spark, sf):
    full = F.concat(F.lit("Seen "), "grid.timing", F.lit(" at "), "grid.env", F.lit("."))
    return table(spark, sf, "records").select("record_no", G.append_clause(F.col("analysis"), [full, F.concat(F.lit("Seen "), "grid.timing", F.lit("."))]).alias("analysis"))


@query(
    "WITH g AS (SELECT lower(trim(category)) AS k, record_no AS pos FROM records WHERE category IS NOT NULL), w AS (SELECT k, count(*) AS w FROM g GROUP BY k), r AS (SELECT k, 500 * CAST(w AS DOUBLE) / sum(w) OVER () AS raw FROM w), "
    "f AS (SELECT k, floor(raw) AS base, round(raw - floor(raw), 9) AS frac FROM r), q AS (SELECT k, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, k) <= 500 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM f), "
    "n AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos) AS rk FROM g) SELECT k, pos FROM n JOIN q USING (k) WHERE rk <= quota - 3"
)
def fill_grid(spark, sf):
    g = table(spark, sf, "records").where("category is not null").select(F.lower(F.trim("category")).alias("k"), F.col("record_no").alias("pos"))
    w = g.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    return G.fill_grid(g, w.select("k", F.lit(3).alias("n")), quotas(w, 500))


@query(
    "SELECT i AS pos, s AS sweep, (i % 72 // 18 + s) % 4 AS c0, (i % 18 // 6 + s) % 3 AS c1, (i % 6 // 2 + s) % 3 AS c2, (i % 2 + s) % 2 AS c3 FROM (SELECT i, i // 72 AS s FROM range(216) t(i))"
)
def grid_walk(spark, sf):
    """Three sweeps over a grid of 4 x 3 x 3 x 2 framings, each rotated against the one before."""
    return G.grid_walk(spark, [4, 3, 3, 2], 3)


@query(
    "WITH g AS (SELECT lower(trim(category)) AS k, record_no AS pos FROM records WHERE category IS NOT NULL), n AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos) AS rk FROM g), "
    "m AS (SELECT k, pos, pos % 4 <> 0 AS ok FROM n WHERE rk <= 20), l AS (SELECT k, 20 - count(*) FILTER (ok) AS l FROM m GROUP BY k) SELECT n.k, n.pos FROM n JOIN l USING (k) WHERE rk > 20 AND rk <= 20 + l"
)
def grid_backfill(spark, sf):
    """Twenty cells a category were tried, one in four failed: the next cells take their places."""
    g = table(spark, sf, "records").where("category is not null").select(F.lower(F.trim("category")).alias("k"), F.col("record_no").alias("pos"))
    q = g.select("k").distinct().withColumn("quota", F.lit(20))
    none = q.select("k", F.lit(0).alias("n"))
    made = G.fill_grid(g, none, q).withColumn("ok", F.col("pos") % 4 != 0)
    return G.backfilled(g, made, q)


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE len(embedding) END AS dims FROM embeddings")
def fill_embeddings(spark, sf):
    """Rows without a vector get one from a given embedder, the others keep theirs."""
    e = table(spark, sf, "embeddings").withColumns({"content": F.col("vec_id").cast("string"), "embedding": F.when(F.col("vec_id") % 3 != 0, F.col("embedding"))})
    return G.fill_embeddings(e, lambda c: F.array(c.cast("float"))).select("vec_id", F.size("embedding").alias("dims"))
