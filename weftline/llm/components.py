"""Connected components and spanning forests over edge tables, in rounds over the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import drop, materialize


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of `edges`; root is the smallest node of the component.

    Alternates the large-star and small-star steps, each a group-by on one end, until a round
    changes nothing. Every round is written to the shared folder: no lineage grows, no edge
    reaches the driver. Self-loops and repeated edges are harmless; no edges give no rows.
    """
    cur = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    cur = materialize(cur.distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        last, cur = cur, materialize(small, "cc")
        drop(last)
        after = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = cur.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
