"""Materialisation of intermediate tables in the folder all executors share.

`checkpoint_dir` reads `spark.checkpoint.dir` from the session and sets a folder of its own
only where that is unset (tests on one machine). `materialize` writes a Parquet table there,
so that a lost executor costs no recomputation and lineage is cut; nothing is kept in
executor-local storage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a private one in local tests; a cluster without one is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back; the plan starts anew from the files.

    The files live until `drop`, `release` or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of `materialize` that nothing reads any more, such as the last round's; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete the tables `materialize` wrote in this session; returns how many."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
