"""Sinks: ordered text, JSON lines, append-only audit, snapshots behind a pointer, caches and a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.positions import hash_order


def ordered_text(df: DataFrame, path: str, text: str, order: list[str], parts: int | None = None) -> None:
    """Text files whose concatenation in name order is the corpus in `order`: range-partitioned, sorted within."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, text unescaped."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Audit rows appended, partitioned by day of `ts`; nothing is rewritten."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, function from a name under `path` to its Path)."""
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str, folder: str) -> list[int]:
    fs, at = _files(spark, path)
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at(folder))) if fs.exists(at(folder)) else []


def snapshot(df: DataFrame, path: str, audit: DataFrame | None = None) -> int:
    """A full snapshot under the next number, which it returns.

    A number is taken by creating its claim, which succeeds for one writer only; the data are
    written under it and become visible by the creation of one file after they are complete.
    Of two writers the later claim is the newer snapshot, whichever ends first. audit (ts, ...):
    rows that are appended to the audit before the snapshot becomes visible, with its number;
    a number without a visible snapshot is an attempt that failed.
    """
    spark = df.sparkSession
    fs, at = _files(spark, path)
    n = max(_numbers(spark, path, "claims"), default=0) + 1
    while not fs.createNewFile(at(f"claims/{n:012d}")):
        n += 1
    df.write.parquet(f"{path}/v-{n:012d}")
    if audit is not None:
        append_audit(audit.withColumn("version", F.lit(n)), f"{path}/audit")
    fs.createNewFile(at(f"done/{n:012d}"))
    return n


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete snapshot, or the given one."""
    done = _numbers(spark, path, "done")
    if not done or (version and version not in done):
        raise ValueError(f"no such snapshot under {path}")
    return spark.read.parquet(f"{path}/v-{version or done[-1]:012d}")


def committed_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows of snapshots that became visible."""
    done = spark.createDataFrame([(n,) for n in _numbers(spark, path, "done")], "version int")
    return spark.read.parquet(f"{path}/audit").join(F.broadcast(done), "version", "left_semi")


def manifest(df: DataFrame, by: str, id_col: str, text_col: str, rules: list[str], filters: list[str]) -> DataFrame:
    """(by, rows, characters, digest, cleaning_rules, filters): what a corpus holds, by its content.

    The digest combines a hash of every id and text in any order, so no corpus is gathered into one string; null texts count as rows."""
    h = hash_order(F.concat(F.col(id_col).cast("string"), F.lit(":"), F.coalesce(text_col, F.lit(""))))
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("characters"), F.bit_xor(h).alias("digest"))
    lines = lambda x: F.lit(", ".join(x))
    return g.withColumns({"cleaning_rules": lines(rules), "filters": lines(filters)})


def cached(df: DataFrame, root: str, corpus_sha: str, tokenizer_sha: str, split: str) -> DataFrame:
    """A derived table kept under the digests of what it was derived from; computed only where it is missing."""
    spark = df.sparkSession
    path = f"{root}/{split}-{corpus_sha[:16]}-{tokenizer_sha[:16]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
