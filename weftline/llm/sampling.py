"""Samples that match target category proportions (problem 2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.canon import letters_only

BINS = 4096


def controlled_rounding(table: np.ndarray) -> np.ndarray:
    """Integer table whose cells are floor or ceiling of `table` and whose margins and total are too.

    A unit that is left over in a row must go to a column with room: a max-flow over
    source -> rows -> columns -> sink with a lower bound on each margin (its floor) and
    capacity one more where the margin is fractional. Solved by augmenting paths; the lower
    bounds are met first.
    """
    t = np.where(np.abs(table - np.rint(table)) < 1e-9, np.rint(table), table)
    base = np.floor(t)
    cell = (t - base > 1e-12).astype(int)
    r_need = np.floor(t.sum(1) + 1e-9) - base.sum(1)
    c_need = np.floor(t.sum(0) + 1e-9) - base.sum(0)
    r_cap = r_need + ((t.sum(1) - np.floor(t.sum(1) + 1e-9)) > 1e-9)
    c_cap = c_need + ((t.sum(0) - np.floor(t.sum(0) + 1e-9)) > 1e-9)
    flow = np.zeros(t.shape, int)

    def augment(starts, r_lim, c_lim) -> bool:
        """One more unit from a row in `starts` to a column under its limit, by breadth-first search."""
        seen, queue = {("r", i): None for i in starts}, [("r", i) for i in starts]
        while queue:
            kind, i = node = queue.pop(0)
            if kind == "c" and flow[:, i].sum() < c_lim[i]:
                while seen[node] is not None:
                    prev = seen[node]
                    if node[0] == "c":
                        flow[prev[1], node[1]] = 1
                    else:
                        flow[node[1], prev[1]] = 0
                    node = prev
                return True
            nexts = (
                [("c", j) for j in np.flatnonzero((cell[i] == 1) & (flow[i] == 0))]
                if kind == "r"
                else [("r", k) for k in np.flatnonzero(flow[:, i] == 1)]
            )
            for x in nexts:
                if x not in seen:
                    seen[x] = node
                    queue.append(x)
        return False

    for r_lim, c_lim in ((r_need, c_need), (r_need, c_cap), (r_cap, c_need)):
        while starts := [i for i in range(len(t)) if flow[i].sum() < r_lim[i]]:
            if not augment(starts, r_lim, c_lim):
                break
    total = int(np.floor(t.sum() + 0.5))
    while (base + flow).sum() < total and (starts := [i for i in range(len(t)) if flow[i].sum() < r_cap[i]]):
        if not augment(starts, r_cap, c_cap):
            break
    return (base + flow).astype(np.int64)


def bounded_quotas(table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Integer quotas near `table` with low <= quota <= high in each cell and, where these allow it, its rounded margins.

    The controlled rounding is cut to the bounds; what rows and columns then lack or have too
    much of is a second max-flow: a unit goes from a row through a cell with room to a column,
    and back through a cell above its lower bound to another row. What no flow can settle is
    left: margins that the bounds do not allow. If the total is still off and any cell has room,
    the room is used, cells of rows and columns that are off first, so that the size holds.
    """
    whole = controlled_rounding(table)
    q = np.clip(whole, low, high)
    r, c = q.shape
    source, sink = r + c, r + c + 1
    cap = np.zeros((r + c + 2, r + c + 2), np.int64)
    lack_r, lack_c = whole.sum(1) - q.sum(1), whole.sum(0) - q.sum(0)
    cap[source, :r], cap[:r, sink] = np.maximum(lack_r, 0), np.maximum(-lack_r, 0)
    cap[r : r + c, sink], cap[source, r : r + c] = np.maximum(lack_c, 0), np.maximum(-lack_c, 0)
    cap[:r, r : r + c], cap[r : r + c, :r] = high - q, (q - low).T
    room = cap[:r, r : r + c].copy()
    while True:
        back = {source: source}
        queue = [source]
        while queue and sink not in back:
            u = queue.pop(0)
            for v in np.flatnonzero(cap[u]).tolist():
                if v not in back:
                    back[v] = u
                    queue.append(v)
        if sink not in back:
            break
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        unit = min(cap[e] for e in path)
        for u, v in path:
            cap[u, v] -= unit
            cap[v, u] += unit
    q = q + room - cap[:r, r : r + c]
    short = int(whole.sum() - q.sum())
    way = 1 if short > 0 else -1
    off = lambda v, axis: np.sign(whole.sum(axis)[v] - q.sum(axis)[v]) * way
    for i, j in sorted(np.ndindex(r, c), key=lambda e: (-off(e[0], 1) - off(e[1], 0), -table[e], e)):
        unit = min(abs(short), int(high[i, j] - q[i, j] if way > 0 else q[i, j] - low[i, j]))
        q[i, j] += way * unit
        short -= way * unit
    return q


def _plan_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Integer quotas of one plan between min_rows and supply, with both margins kept where these allow it."""
    out = pdf.assign(x=pdf.target_share.fillna(0.0) * pdf.sample_rows.fillna(0))
    out["upper"], out["floor_rows"] = out.supply, np.minimum(out.min_rows.fillna(0).clip(lower=0), out.supply)
    grid = lambda v, how: out.pivot_table(index="row_key", columns="col_key", values=v, aggfunc=how, fill_value=0)
    want = grid("x", "sum")
    low, high = grid("floor_rows", "max").to_numpy(np.int64), grid("upper", "max").to_numpy(np.int64)
    cells = {"rounded": controlled_rounding(want.to_numpy(float)), "quota": bounded_quotas(want.to_numpy(float), low, high)}
    cells["row_missed"] = cells["rounded"].sum(1, keepdims=True) - cells["quota"].sum(1, keepdims=True) + 0 * cells["quota"]
    cells["col_missed"] = cells["rounded"].sum(0, keepdims=True) - cells["quota"].sum(0, keepdims=True) + 0 * cells["quota"]
    for name, values in cells.items():
        flat = pd.DataFrame(values, want.index, want.columns).stack().rename(name).reset_index()
        out = out.merge(flat, on=["row_key", "col_key"], how="left")
    # A cell that is asked for more than its upper bound allows cannot be met, whatever the margins.
    out["met"] = out.need <= out.upper
    return out.drop(columns=["x", "upper", "floor_rows"]).fillna({k: 0 for k in cells}).astype({k: "int64" for k in cells})


def quota_report(df: DataFrame, targets: DataFrame, id_col: str = "id", row: str = "classification", col: str = "category") -> DataFrame:
    """Per target cell: supply (distinct ids), need, integer quota, whether the need can be met, and what its margins miss.

    quota lies between min_rows and supply; the margins of the rounded shares (`rounded`) are
    kept where these bounds allow it, row_missed and col_missed say by how much they are not.
    Targets that name a pair twice share one quota.

    Names are compared letters only. Rows whose id, row or column name is null supply nothing;
    an id repeated in a cell counts once. need is the larger of min_rows and
    target_share * sample_rows rounded to the nearest whole number. A cell without records has
    supply 0; no targets give no rows. The plan tables have a fixed small size (categories, not
    records), so each plan is rounded in one task.
    """
    supply = (
        df.select(F.col(id_col).alias("_id"), letters_only(F.col(row)).alias("row_key"), letters_only(F.col(col)).alias("col_key"))
        .where("_id is not null and row_key is not null and col_key is not null")
        .groupBy("row_key", "col_key", "_id").agg(F.lit(1).alias("one"))
        .groupBy("row_key", "col_key").agg(F.count("one").alias("supply"))
    )
    t = targets.select("plan_name", "sample_rows", F.col(row).alias("row_name"), F.col(col).alias("col_name"), "target_share", "min_rows")
    t = t.withColumns({"row_key": letters_only(F.col("row_name")), "col_key": letters_only(F.col("col_name"))})
    cells = t.join(supply, ["row_key", "col_key"], "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    need = F.greatest(F.coalesce("min_rows", F.lit(0)), F.round(F.col("target_share") * F.col("sample_rows")).cast("long"))
    cells = cells.withColumn("need", F.coalesce(need, F.lit(0)))
    schema = cells.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", rounded long, quota long, row_missed long, col_missed long, met boolean"
    return cells.groupBy("plan_name").applyInPandas(_plan_quotas, schema)


def draw_sample(df: DataFrame, targets: DataFrame, order_col: str, id_col: str = "id", row: str = "classification", col: str = "category", seed: int = 7) -> DataFrame:
    """(plan_name, id, order_col): exactly `quota` ids of each cell of each plan, by smallest random key.

    The random key is a hash of the id, so the draw repeats. No cell is sorted as a whole: a
    histogram of keys per cell gives the bin where the quota is reached; ids of lower bins are
    taken outright and only the ids of that one bin are ranked. Repeated deliveries of an id
    count once, by the smallest order_col.
    """
    quotas = quota_report(df, targets, id_col, row, col).select("plan_name", "row_key", "col_key", "quota").distinct()
    ids = (
        df.select(F.col(id_col).alias("id"), letters_only(F.col(row)).alias("row_key"), letters_only(F.col(col)).alias("col_key"), F.col(order_col).alias(order_col))
        .where("id is not null and row_key is not null and col_key is not null")
        .groupBy("row_key", "col_key", "id").agg(F.min(order_col).alias(order_col))
        .withColumn("u", F.xxhash64("id", F.lit(seed)))
        .withColumn("bin", F.pmod("u", F.lit(BINS)))
    )
    hist = ids.groupBy("row_key", "col_key", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("plan_name", "row_key", "col_key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    cuts = quotas.join(hist, ["row_key", "col_key"]).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    cuts = cuts.where("before < quota").withColumn("left_over", F.col("quota") - F.col("before"))
    cand = ids.join(cuts, ["row_key", "col_key", "bin"])
    taken = cand.where("n <= left_over").select("plan_name", "id", order_col)
    rank = F.row_number().over(W.partitionBy("plan_name", "row_key", "col_key", "bin").orderBy("u", "id"))
    last = cand.where("n > left_over").withColumn("rk", rank).where("rk <= left_over").select("plan_name", "id", order_col)
    return taken.unionByName(last)
