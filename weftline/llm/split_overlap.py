"""Records shared between splits, exactly or nearly (problem 3), by an exact set-similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.canon import word_set, words
from weftline.llm.near_duplicates import linked_classes
from weftline.session import spread
from weftline.storage import materialize


def _overlap_classes(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str, num: int, den: int, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members (id, side, cid), hits (a, b)): records with their class of equal word sets, and pairs of
    classes, training side first, that overlap. Copies are not expanded."""
    side = F.when(F.col(split_col) == train, F.lit(0)).otherwise(F.lit(1))
    base = df.where(F.col(split_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), side.alias("side"), F.col(text_col).alias("text")
    )
    rows = spread(base, "id").select("id", "side", word_set(F.col("text")).alias("toks"))
    # The filter comes after the write: before it, the words would be taken once for it and once more for the rows.
    rows = materialize(rows.withColumn("sh", F.xxhash64("toks")), "so-rows").where(F.size("toks") > 0)
    classes = materialize(
        rows.groupBy("sh").agg(
            F.min("id").alias("cid"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.first("toks").alias("toks")
        ),
        "so-classes",
    )
    spelt = base.select("id", words(F.col("text")).alias("words"))
    links = materialize(linked_classes(classes, spelt, num, den, hot), "so-links")
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = links.join(classes.where("lo = 0").select(F.col("cid").alias("a")), "a").join(classes.where("hi = 1").select(F.col("cid").alias("b")), "b").select("a", "b")
    same = classes.where("lo = 0 and hi = 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    hits = materialize(near.unionByName(same).distinct(), "so-hits")
    return rows.select("id", "side", "sh").join(classes.select("sh", "cid"), "sh").select("id", "side", "cid"), hits


def split_overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train", num: int = 8, den: int = 10, hot: int | None = None) -> DataFrame:
    """(train_id, held_id): pairs of a training record and one of another split with word similarity >= num/den.

    Rows with a null split or text, or without a word, have no pair; an id delivered twice gives
    a pair once. Texts equal as word sets collapse to one class before any join and are expanded
    only in the result. Extra columns are ignored; an empty table gives no pairs.

    Pairs of classes come from `linked_classes`, which misses none, whatever the size of a family.
    """
    member, hits = _overlap_classes(df, id_col, text_col, split_col, train, num, den, hot)
    return (
        hits.join(member.where("side = 0").select(F.col("cid").alias("a"), F.col("id").alias("train_id")), "a")
        .join(member.where("side = 1").select(F.col("cid").alias("b"), F.col("id").alias("held_id")), "b")
        .where("train_id <> held_id")
        .select("train_id", "held_id")
        .distinct()
    )


def overlap_counts(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train", num: int = 8, den: int = 10, hot: int | None = None) -> DataFrame:
    """(id, links): each record outside the training split that overlaps with it, and with how many training rows.

    Counted on classes: copies are never expanded into pairs."""
    member, hits = _overlap_classes(df, id_col, text_col, split_col, train, num, den, hot)
    n = member.where("side = 0").groupBy(F.col("cid").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    per = hits.join(n, "a").groupBy("b").agg(F.sum("n").alias("links"))
    return member.where("side = 1").join(per, F.col("cid") == F.col("b")).select("id", "links")
