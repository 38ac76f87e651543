"""Rendering and fitting of event records: dialects, budgets, appended clauses, grid quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.positions import positions

DIALECTS = ["syslog", "auth", "cef", "json", "winsec", "k8s"]


def render_event(dialect: Column, ts: Column, host: Column, app: Column, pid: Column, msg: Column) -> Column:
    """One log line of an event in a dialect; an unknown dialect gives null. Nulls inside count as '-'."""
    h, a, m = (F.coalesce(c, F.lit("-")) for c in (host, app, msg))
    p = F.coalesce(pid, F.lit(0)).cast("string")
    short = F.date_format(ts, "MMM dd HH:mm:ss")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tail = F.concat(short, F.lit(" "), h, F.lit(" "), a, F.lit("["), p, F.lit("]: "), m)
    body = F.to_json(F.struct(iso.alias("ts"), h.alias("host"), a.alias("log"), p.alias("pid"), m.alias("event")))
    return (
        F.when(dialect == "syslog", F.concat(F.lit("<30>"), tail))
        .when(dialect == "auth", tail)
        .when(dialect == "cef", F.concat(F.lit("CEF:0|"), a, F.lit("|sensor|1.0|"), m, F.lit("|2|Event|dst="), h))
        .when(dialect == "json", body)
        .when(dialect == "winsec", F.concat(h, F.lit(" system "), a, F.lit(" "), m))
        .when(dialect == "k8s", F.concat(iso, F.lit(" "), a, F.lit(" "), h, F.lit(": "), m))
    )


def pick_dialect(key: Column) -> Column:
    """A dialect by hash of the key, so that a corpus does not speak one vendor's language."""
    return F.element_at(F.array(*[F.lit(d) for d in DIALECTS]), (F.pmod(F.xxhash64(key), F.lit(len(DIALECTS))) + 1).cast("int"))


def fit_events(events: Column, budget: int = 480, floor: int = 3, most: int = 8, sep: str = " | ") -> Column:
    """The text of a record's events (struct imp, ts, ord, text) that fits the budget, in time order.

    Events of importance >= floor (all, if none is) are tried from the most important down, ties
    in the given order; one that does not fit is skipped, later shorter ones may still fit; at most
    `most`. If none fits, the first event alone is taken. An empty or null list gives an empty text.
    """
    kept = F.filter(events, lambda e: F.coalesce(e["imp"], F.lit(5)) >= floor)
    pool = F.when(F.size(kept) > 0, kept).otherwise(events)
    ranked = F.array_sort(F.transform(pool, lambda e, i: F.struct((-F.coalesce(e["imp"], F.lit(5))).alias("r"), i.alias("i"), e["ts"].alias("ts"), e["ord"].alias("ord"), e["text"].alias("text"))))
    start = F.struct(F.lit(-len(sep)).alias("used"), F.array().cast("array<struct<ts:bigint,ord:bigint,text:string>>").alias("got"))

    def step(acc, e):
        size = acc["used"] + F.length(e["text"]) + len(sep)
        item = F.struct(e["ts"].cast("long").alias("ts"), e["ord"].cast("long").alias("ord"), e["text"].alias("text"))
        return F.when((size <= budget) & (F.size(acc["got"]) < most), F.struct(size.alias("used"), F.concat(acc["got"], F.array(item)).alias("got"))).otherwise(acc)

    chosen = F.array_sort(F.aggregate(ranked, start, step)["got"])
    first = F.get(events, F.lit(0))["text"]
    return F.when(F.size(chosen) > 0, F.array_join(F.transform(chosen, lambda e: e["text"]), sep)).otherwise(F.coalesce(first, F.lit("")))


def append_clause(text: Column, clauses: list[Column], limit: int = 420) -> Column:
    """The text with the first clause that keeps it within the limit; unchanged if none does."""
    return F.coalesce(*[F.when(F.length(F.concat(text, F.lit(" "), c)) <= limit, F.concat(text, F.lit(" "), c)) for c in clauses], text)


def grid_walk(spark, sizes: list[int], sweeps: int) -> DataFrame:
    """(pos, sweep, c0, c1, ...): every cell of a grid in walking order, sweep after sweep.

    The first axis starts one further in each sweep, the others are shifted by the sweep, so no
    sweep repeats the order of framings of the one before. Made of a range: nothing is looped over.
    """
    cells = 1
    for n in sizes:
        cells *= n
    d = spark.range(cells * sweeps).select(F.col("id").alias("pos"), F.floor(F.col("id") / cells).alias("sweep"))
    step = cells
    for i, n in enumerate(sizes):
        step //= n
        d = d.withColumn(f"c{i}", (F.floor(F.col("pos") / step) % n + F.col("sweep")) % n)
    return d


def fill_grid(grid: DataFrame, have: DataFrame, quotas: DataFrame, key: str = "k", order: str = "pos") -> DataFrame:
    """Grid cells (k, pos) still to be made: per category, the first quota - have cells in grid order.

    A resumed run passes what exists as `have` (k, n) and gets the rest; nothing is replayed. Cells
    are numbered in two levels, so a category of any size is no single task."""
    left = quotas.join(have, key, "left").withColumn("left", F.col("quota") - F.coalesce("n", F.lit(0))).select(F.col(key).alias("_k"), "left")
    at = positions(grid.select(key, F.col(order).alias("_at")), [key], "_at")
    return at.join(left, F.col(key) == F.col("_k")).where(F.col("pos") < F.col("left")).select(key, F.col("_at").alias(order))


def backfilled(grid: DataFrame, made: DataFrame, quotas: DataFrame, key: str = "k", order: str = "pos") -> DataFrame:
    """Cells to be made where some came out as duplicates or rejects: made (k, pos, ok) says which, and for each one that
    failed the category's next cell in walking order takes its place."""
    good = made.groupBy(key).agg(F.count_if("ok").alias("n"))
    fresh = grid.join(made.select(key, order), [key, order], "left_anti")
    return fill_grid(fresh, good, quotas, key, order)


def fill_embeddings(df: DataFrame, embed, text_col: str = "content", vec_col: str = "embedding") -> DataFrame:
    """Embeds only the rows that lack a vector; `embed` is a Column function of the text."""
    return df.withColumn(vec_col, F.coalesce(vec_col, embed(F.col(text_col))))
