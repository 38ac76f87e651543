"""Structured Streaming: inbox intake with quarantine, stateful deduplication, session state with a lifetime, drift watch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.memory import drift, feedback_errors
from weftline.sources.readers import inbox_rows
from weftline.sources.registry import Registry


def inbox_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback rows of files that land in a folder; the checkpoint, not a cursor file, remembers what was read."""
    raw = spark.readStream.option("wholetext", True).format("text").load(folder).withColumn("path", F.col("_metadata.file_path"))
    return inbox_rows(raw)


def run_intake(spark: SparkSession, folder: str, accepted: str, quarantined: str, checkpoint: str, once: bool = True, every: str = "120 seconds", status: str | None = None):
    """Validates each batch and writes accepted and quarantined rows side by side.

    A batch is identified by its id in the output path, so a batch that is run again after a
    failure overwrites its own files: each row lands once. status: a folder that gets one row for each
    batch: rows accepted and quarantined, and whether there are new examples to learn from.
    """

    def both(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("errors", feedback_errors()).persist()
        judged.where(F.size("errors") == 0).drop("errors").write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        judged.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{quarantined}/batch={batch_id}")
        if status:
            n = judged.agg(F.count_if(F.size("errors") == 0).alias("accepted"), F.count_if(F.size("errors") > 0).alias("quarantined"))
            n.withColumn("pending", F.col("accepted") > 0).write.mode("overwrite").parquet(f"{status}/batch={batch_id}")
        judged.unpersist()

    w = inbox_stream(spark, folder).writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def pending_examples(examples: DataFrame, learnt: DataFrame, id_col: str = "id") -> DataFrame:
    """Examples that the last cycle did not know: what a daemon waits for before it runs another cycle."""
    return examples.where(F.col(id_col).isNotNull()).join(learnt.select(id_col).distinct(), id_col, "left_anti")


def dedup_stream(rows: DataFrame, key: str, time: str, watermark: str = "7 days") -> DataFrame:
    """First row of each key; state is dropped once the watermark passes, so it stays bounded."""
    return rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def session_stream(rows: DataFrame, session: str, time: str, ttl_ms: int = 24 * 3_600_000, watermark: str = "1 hour") -> DataFrame:
    """(session, rows, first_at, last_at) of sessions that ended: `ttl_ms` of event time without a new row.

    A gap of `ttl_ms` or more parts sessions, whether its rows come in one batch or in several."""
    r = rows.select(F.col(session).alias("session"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", watermark)
    ended = r.groupBy("session", F.session_window("at", f"{ttl_ms} milliseconds")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    return ended.select("session", "rows", "first_at", "last_at")


def windowed_counts(rows: DataFrame, time: str, key: str, length: str = "1 day", watermark: str = "2 days") -> DataFrame:
    """Counts per event-time window and key; late rows within the watermark are counted."""
    return rows.withWatermark(time, watermark).groupBy(F.window(time, length), key).agg(F.count(F.lit(1)).alias("n"))


def drift_watch(points: DataFrame, history: str, alerts: str, checkpoint: str, registry: str | None = None):
    """Appends metric points (name, seq, value) to the history and writes the names that drift after each batch.

    registry: the folder of a `Registry`; the active entry of a name that drifts goes back to the
    one before. The alerts of a batch are written last, so a batch that is run again after a failure
    rolls back only names whose entry is still the one that drifted (`superseded_by` says so).
    """

    def watch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
        spark = batch.sparkSession
        bad = drift(spark.read.parquet(history)).where("drift").withColumn("batch", F.lit(batch_id)).persist()
        if registry:
            reg = Registry(spark, registry)
            for name in [r["name"] for r in bad.select("name").collect()]:
                entry = reg.active(name)
                if entry and entry["active"] and entry["superseded_by"] != f"drift {batch_id}":
                    back = reg.rollback(name)
                    entry["superseded_by"] = back["superseded_by"] = f"drift {batch_id}"
            reg.save()
        bad.write.mode("overwrite").parquet(f"{alerts}/at={batch_id}")
        bad.unpersist()

    return points.writeStream.foreachBatch(watch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
