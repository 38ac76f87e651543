"""Session construction and table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, wherever it was started from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="weftline-ship-")  # on the driver; Spark's file server hands the archive on
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    copy = shutil.copytree(here, f"{tmp}/src/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tmp}/{here.name}", "zip", Path(copy).parent, here.name))


def build_session(app: str = "weftline", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution, Arrow).

    On a cluster the master, memory and `spark.checkpoint.dir` come from the submit
    command; only what is engine policy is set here.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under `sf_dir`; columns and filters are pushed into the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, by: str) -> DataFrame:
    """`df` over all cores where its scan has fewer partitions than the session has cores.

    Small inputs in few row groups would otherwise leave cores idle; large ones are left as they
    are, without a shuffle. `by` is a column that differs from row to row.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, by)
