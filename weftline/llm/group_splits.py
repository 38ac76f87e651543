"""Splits that keep related records together (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.canon import letters_only
from weftline.storage import drop, materialize

#: A root with more than this share of all records is placed by remaining room, largest first; at most 1/GIANT exist.
GIANT = 0.01
#: Roots that one task orders within a hash range; the number of ranges follows from it.
RANGE_ROOTS = 50_000


def spanning_forest(edges: DataFrame, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(forest (u, v), roots (node, root)) of an edge table (u, v) by minimum-edge contraction; both are written tables.

    In each round every component picks its smallest outgoing edge (edges have distinct ranks,
    so the picks hold no cycle longer than two); picked edges enter the persisted forest, and
    components are contracted along them by pointer jumping. Each round at least halves the
    components that still have an edge. All state is written to the shared folder.
    """
    ranked = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live = materialize(ranked.select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv"), F.xxhash64("u", "v").alias("w")), "sf-edges")
    nodes = live.select(F.col("u").alias("node")).unionByName(live.select(F.col("v").alias("node"))).distinct()
    label = materialize(nodes.select("node", F.col("node").alias("root")), "sf-label")
    forest, picks = None, []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        ends = live.select(F.col("cu").alias("c"), F.col("cv").alias("d"), "w", "u", "v").unionByName(
            live.select(F.col("cv").alias("c"), F.col("cu").alias("d"), "w", "u", "v")
        )
        pick = ends.groupBy("c").agg(F.min(F.struct("w", "u", "v", "d")).alias("e")).select("c", "e.d", "e.u", "e.v")
        pick = materialize(pick, "sf-pick")
        new = pick.select("u", "v").distinct()
        picks.append(pick)
        forest = new if forest is None else forest.unionByName(new)
        # Of two components that picked each other the smaller stays root.
        back = pick.select(F.col("c").alias("d"), F.col("d").alias("dd"))
        hop = pick.join(back, "d", "left").select(
            F.col("c").alias("n"), F.when((F.col("dd") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("p")
        )
        hop = materialize(hop, "sf-hop")
        while True:
            up = hop.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            nxt = materialize(hop.join(up, "p").select("n", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "sf-hop")
            moved = not nxt.where("moved").isEmpty()
            drop(hop)
            hop = nxt
            if not moved:
                break
        last, label = label, materialize(
            label.join(hop.select(F.col("n").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "sf-label"
        )
        drop(last)
        a = hop.select(F.col("n").alias("cu"), F.col("p").alias("pu"))
        b = hop.select(F.col("n").alias("cv"), F.col("p").alias("pv"))
        last, live = live, materialize(
            live.join(a, "cu").join(b, "cv").where("pu <> pv").select("u", "v", F.col("pu").alias("cu"), F.col("pv").alias("cv"), "w"), "sf-edges"
        )
        drop(last, hop)
    if forest is None:
        forest = label.select(F.col("node").alias("u"), F.col("root").alias("v")).limit(0)
    forest = materialize(forest.distinct(), "sf-forest")
    drop(*picks)
    return forest, label


def _node(kind, key) -> Column:
    """A 128-bit node of the graph: at 10^10 nodes no two are expected to fall together."""
    return F.unhex(F.md5(F.concat(F.lit(f"{kind}#"), key.cast("string"))))


def related_forest(df: DataFrame, id_col: str, keys: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (id, first_node), forest (u, v), roots (node, root)) of the records and what they share; all are written tables.

    Keys are Columns (author, source, entity, ...). In the graph of records and key values every
    record hangs on its keys; the edge to its first key is its minimum edge, so these leaf edges
    are contracted at once (`rows`). What is left is a graph of key values, where a key that a
    third of all rows hold is one node; Boruvka rounds contract it to `forest`.
    """
    nodes = F.array_compact(F.array(*[F.when(k.isNotNull(), _node(i, k)) for i, k in enumerate(keys)]))
    rows = df.select(F.col(id_col).alias("id"), nodes.alias("nodes")).withColumn(
        "first_node", F.coalesce(F.get("nodes", F.lit(0)), _node("record", F.to_json(F.struct("id"))))
    )
    rows = materialize(rows, "rr-leaf-edges")
    edges = rows.where(F.size("nodes") > 1).select(F.col("first_node").alias("u"), F.explode(F.slice("nodes", 2, max(1, len(keys) - 1))).alias("v"))
    return rows.select("id", "first_node"), *spanning_forest(edges)


def related_roots(df: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(id, root): records that share any of the keys, directly or through others, have one root.

    A null key relates nothing, and a record whose keys are all null is its own root. Repeated
    ids and extra columns do no harm; an empty table has no roots. The roots are read from the
    written forest of `related_forest`.
    """
    rows, _, roots = related_forest(df, id_col, keys)
    return rows.join(roots, rows.first_node == roots.node, "left").select("id", F.coalesce("root", "first_node").alias("root"))


def split_groups(roots: DataFrame, proportions: dict[str, float], seed: int = 11) -> DataFrame:
    """(root, size, split): roots dealt to splits so that the records of each split meet its proportion.

    Roots are stratified by size band (powers of two) and dealt systematically: along the hash
    order within a band the running record count decides the split, so each band is divided in
    proportion. Roots above GIANT of all records (at most 1/GIANT of them, so they fit the
    driver) are placed first, each where most room is left, and the proportions of the rest are
    corrected for them. Running counts are two-level: totals of hash ranges first, then within
    a range, so no band is one task; a range holds about RANGE_ROOTS roots, however many there are.
    """
    sizes = materialize(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sg-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    names = list(proportions)
    room = {k: proportions[k] / sum(proportions.values()) * total for k in names}
    giants = sizes.where(F.col("size") > GIANT * total).orderBy(F.desc("size"), "root").collect() if total else []
    placed = []
    for g in giants:
        to = max(names, key=lambda k: (room[k], -names.index(k)))
        room[to] -= g["size"]
        placed.append((g["root"], g["size"], to))
    free = {k: max(0.0, v) for k, v in room.items()}
    rest_total = sum(free.values()) or 1.0
    small = sizes.where(F.col("size") <= GIANT * total).withColumns(
        {"band": F.floor(F.log2("size")).cast("int"), "h": F.xxhash64("root", F.lit(seed))}
    )
    small = small.withColumn("range", F.shiftright("h", 64 - max(1, (sizes.count() // RANGE_ROOTS).bit_length())))
    ranges = small.groupBy("band", "range").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("band").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.withColumns({"start": before, "all": F.sum("n").over(W.partitionBy("band"))}).select("band", "range", "start", "all")
    within = F.sum("size").over(W.partitionBy("band", "range").orderBy("h", "root").rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2
    at = small.withColumn("mid", within).join(starts, ["band", "range"]).withColumn("q", (F.col("start") + F.col("mid")) / F.col("all"))
    split, edge = F.lit(names[-1]), 1.0
    for k in reversed(names):
        split = F.when(F.col("q") < edge, F.lit(k)).otherwise(split)
        edge -= free[k] / rest_total
    dealt = at.select("root", "size", split.alias("split"))
    if placed:
        dealt = dealt.unionByName(df_of(sizes, placed))
    return dealt


def df_of(like: DataFrame, rows: list) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, f"root {dict(like.dtypes)['root']}, size long, split string")


def record_cell_keys() -> list[Column]:
    """What relates records: category (letters only) and grid cell, null without a category or cell; and the id they were delivered under."""
    from_id = F.try_to_number(F.nullif(F.regexp_extract("id", r"^(?:engine-v4-s|v3_|salvaged-v1-)(\d+)", 1), F.lit("")), F.lit("999999999999999999"))
    cell = F.coalesce(F.when(F.col("grid_index") >= 0, F.col("grid_index").cast("long")), from_id.cast("long"))
    cat = F.nullif(letters_only(F.col("category")), F.lit(""))
    return [F.when(cat.isNotNull() & cell.isNotNull(), F.concat_ws("#", cat, cell.cast("string"))), F.col("id")]


def divided_records(df: DataFrame, id_col: str, split_col: str, keys: list[Column]) -> DataFrame:
    """(id): records with a split whose first key is shared with a record of another split today.

    Records that share a key have one root, so the exact look at the first key is taken within
    roots. Records without a split or a first key take no part.
    """
    part = df.where(F.col(split_col).isNotNull() & keys[0].isNotNull())
    rows = part.select(F.struct(id_col, split_col, keys[0].alias("key")).alias("rec"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    rooted = related_roots(rows, "rec", [F.col(f"k{i}") for i in range(len(keys))])
    rooted = rooted.select(F.col(f"id.{id_col}").alias("id"), F.col(f"id.{split_col}").alias("split"), F.col("id.key").alias("key"), "root")
    divided = rooted.groupBy("root", "key").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("root", "key")
    return rooted.join(divided, ["root", "key"], "left_semi").select("id")
