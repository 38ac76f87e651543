"""Duplicates hidden by formatting (problem 7): canonical records, range-sorted, scanned run by run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.canon import field_pairs
from weftline.session import spread
from weftline.storage import materialize, shuffle_width

_RUNS = "id long, first_id long, part int, run long, key string"


def canonical_key(c):
    """The text's field-value pairs in sorted order; equal texts up to layout have equal keys. Null for no content."""
    key = F.array_join(F.array_sort(field_pairs(c)), "\u0001")
    return F.when(key != "", key)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent runs of equal full keys in one sorted partition.

    Emits (id, first id of its run, partition, run number) for each row as it passes, so a run of
    any length needs no memory, and at the end one marker row (id null, with the key) for the
    partition's first and last run, which may go on in a neighbouring partition.
    """
    part = TaskContext.get().partitionId()
    run, open_key, open_first, ends = -1, None, 0, {}

    def out(ids, firsts, runs, keys):
        n = len(runs)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(firsts, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(runs, pa.int64()), pa.array(keys, pa.string())],
            names=["id", "first_id", "part", "run", "key"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column(1), np.asarray(b.column(0))
        new = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            new[1:] = ~np.asarray(pc.equal(keys.slice(1), keys.slice(0, b.num_rows - 1)))
        new[0] = keys[0].as_py() != open_key
        starts = np.flatnonzero(new)
        runs = run + np.cumsum(new)
        firsts = np.where(runs == run, open_first, 0)
        if len(starts):
            at = np.maximum(np.cumsum(new) - 1, 0)
            firsts = np.where(runs == run, open_first, ids[starts][at])
        yield out(b.column(0), firsts, runs, [None] * b.num_rows)
        run, open_key, open_first = int(runs[-1]), keys[b.num_rows - 1].as_py(), int(firsts[-1])
        if not ends:
            ends["first"] = (int(runs[0]), int(firsts[0]), keys[0].as_py())
    if ends:
        last = (run, open_first, open_key)
        marks = [ends["first"]] if ends["first"][0] == run else [ends["first"], last]
        yield out(pa.array([None] * len(marks), pa.int64()), [m[1] for m in marks], [m[0] for m in marks], [m[2] for m in marks])


def format_duplicates(df: DataFrame, id_col: str, text_col: str, partitions: int | None = None) -> DataFrame:
    """(id, first_id): every row with content and the smallest id of its set of equal texts.

    Equal means the same field-value pairs whatever blanks, case, marks, layout and order of
    fields. Null texts and texts without any letter or digit belong to no set and are left out.

    The canonical records are range-partitioned and sorted by (hash of the key, key, id). A key
    that a third of all rows share spreads over as many ranges as it needs, since ids are part
    of the sort; one scan of each sorted partition compares neighbouring full keys. Runs that
    touch a partition's edge are joined across partitions through a table of at most two rows
    per partition.
    """
    spark = df.sparkSession
    keyed = materialize(
        spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id")
        .select("id", canonical_key(F.col("text")).alias("key"))
        .where("key is not null")
        .select("id", F.xxhash64("key").alias("h"), "key"),
        "fd-keys",
    )
    n = partitions or shuffle_width(spark)
    ordered = keyed.repartitionByRange(n, "h", "id").sortWithinPartitions("h", "key", "id").select("id", "key")
    runs = materialize(ordered.mapInArrow(_scan, _RUNS), "fd-runs")
    marks = runs.where("id is null")
    whole = marks.groupBy("key").agg(F.min("first_id").alias("whole_first"))
    fix = F.broadcast(marks.join(whole, "key").select("part", "run", "whole_first"))
    return (
        runs.where("id is not null")
        .join(fix, ["part", "run"], "left")
        .select("id", F.coalesce("whole_first", "first_id").alias("first_id"))
    )


def format_representatives(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(first_id, copies): one representative for each distinct text and how many rows hold it."""
    return format_duplicates(df, id_col, text_col).groupBy("first_id").agg(F.count(F.lit(1)).alias("copies"))
