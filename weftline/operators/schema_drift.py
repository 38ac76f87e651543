"""Schemas that drift between files (problem 5): path-value maps, change reports, one consistent table."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import spread
from weftline.storage import materialize

#: A whole number of at least so many digits does not fit a long and is held as a decimal without places.
LONG_DIGITS = 19
#: Share of a file's readable objects that must hold a non-null value for the file to have the field.
PRESENCE = 0.5
#: Share of the ids in both files whose values must agree for a renaming.
AGREEMENT = 0.8
#: Columns that the consistent table may have besides the given ones.
MOST_COLUMNS = 200


def _kind(text: Column, value: Column) -> Column:
    """string, integer, decimal (a number with a point or an exponent), boolean, array or object; null for a JSON null.

    The JSON text tells all but numbers apart; only these are asked for their type."""
    first = F.substring(text, 1, 1)
    of = F.schema_of_variant(value)
    whole = (of == "BIGINT") | (F.regexp_extract(of, r"^DECIMAL\((\d+),0\)", 1).try_cast("int") >= LONG_DIGITS)
    return (
        F.when(first == '"', "string")
        .when(first == "[", "array")
        .when(first == "{", "object")
        .when(first.isin("t", "f"), "boolean")
        .when(first != "n", F.when(whole, "integer").otherwise("decimal"))
    )


def _object(payload: Column) -> Column:
    """The fields of a JSON text that is one object and nothing else; null for any other text."""
    alone = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]"))).try_cast("array<variant>")
    return F.when(F.size(alone) == 1, F.get(alone, F.lit(0)).try_cast("map<string,variant>"))


def path_values(raw: DataFrame, depth: int = 1) -> DataFrame:
    """Lines of record files as (line, field, raw type, JSON value) rows, by variant functions in one pass.

    Unreadable lines, null payloads and JSON that is no object give one row with readable =
    false and no field. Repeated keys in an object: the last one counts. Null values give no row.
    With a depth above 1 the fields of objects within objects come too, as dotted paths.
    """
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    where = ["raw_id", "feed", "file_no", "file_name", "line_no"]
    need = raw.select("raw_id", "feed", F.col("file_no").cast("int"), "file_name", F.col("line_no").cast("int"), "payload")
    lines = spread(need.where("feed is not null and file_no is not null"), "raw_id").select(*where, _object(F.col("payload")).alias("o"))
    lines = lines.withColumns({"readable": F.col("o").isNotNull(), "key": F.try_element_at("o", F.lit("id"))}).withColumn("key_text", F.to_json("key"))
    lines = lines.withColumn("id", F.when(F.col("key_text").rlike('^["0-9-]'), F.col("key").try_cast("string")))
    pair = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value")))
    each = F.explode(F.concat(pair, F.coalesce(F.map_entries("o"), F.slice(pair, 1, 0))))
    rows = lines.select(*where, "readable", "id", each.alias("e")).select(*where, "readable", "id", F.col("e.key").alias("field"), "e.value")
    typed = lambda d: d.withColumn("text", F.to_json("value")).withColumn("kind", _kind(F.col("text"), F.col("value")))
    rows = typed(rows)
    out = rows.where("field is null or kind is not null")
    for _ in range(depth - 1):
        inner = F.explode(F.map_entries(F.col("value").try_cast("map<string,variant>")))
        rows = rows.where("kind = 'object'").select(*where, "readable", "id", "field", inner.alias("e"))
        rows = typed(rows.select(*where, "readable", "id", F.concat_ws(".", "field", "e.key").alias("field"), "e.value"))
        out = out.unionByName(rows.where("kind is not null"))
    return out.select(*where, "readable", "id", "field", "kind", F.col("text").alias("value"))


def file_fields(values: DataFrame) -> DataFrame:
    """Per file and field: type of most values (ties by name), and whether the file has the field."""
    lines = values.where("field is null and readable").groupBy("feed", "file_no").agg(F.count(F.lit(1)).alias("objects"))
    kinds = values.where("field is not null").groupBy("feed", "file_no", "field", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = kinds.groupBy("feed", "file_no", "field").agg(
        F.sum("n").alias("held"), F.min(F.struct(-F.col("n"), F.col("kind"))).getField("kind").alias("kind")
    )
    return best.join(lines, ["feed", "file_no"]).withColumn("present", F.col("held") >= PRESENCE * F.col("objects"))


def file_order(values: DataFrame) -> DataFrame:
    """(feed, file_no, file_name, prev_no): each file of a feed with the next lower file number."""
    files = values.where("field is null").groupBy("feed", "file_no").agg(F.min("file_name").alias("file_name"))
    return files.withColumn("prev_no", F.lag("file_no").over(W.partitionBy("feed").orderBy("file_no")))


def schema_changes(values: DataFrame) -> DataFrame:
    """(file_name, change_kind, old_field, new_field): added, removed, renamed and retyped top-level fields.

    A gone and a new field are a renaming if at least AGREEMENT of the ids that both files hold
    with both fields have equal values; a field takes part in one renaming at most, the best
    agreement first, ties by name. A feed's first file has no changes; empty input gives none.
    """
    files = file_order(values)
    has = file_fields(values).where("present").select("feed", "file_no", "field", "kind")
    step = files.where("prev_no is not null")
    old = step.join(has.select("feed", F.col("file_no").alias("prev_no"), "field", F.col("kind").alias("old_kind")), ["feed", "prev_no"])
    new = step.join(has.select("feed", "file_no", "field", F.col("kind").alias("new_kind")), ["feed", "file_no"])
    both = old.select("feed", "file_no", "file_name", "prev_no", "field", "old_kind").join(
        new.select("feed", "file_no", "field", "new_kind", F.col("file_name").alias("fn"), F.col("prev_no").alias("pn")), ["feed", "file_no", "field"], "full"
    )
    both = materialize(
        both.select("feed", "file_no", F.coalesce("file_name", "fn").alias("file_name"), F.coalesce("prev_no", "pn").alias("prev_no"), "field", "old_kind", "new_kind"),
        "sd-steps",
    )
    gone, come = both.where("new_kind is null"), both.where("old_kind is null")
    cand = gone.select("feed", "file_no", "prev_no", F.col("field").alias("old_field")).join(
        come.select("feed", "file_no", F.col("field").alias("new_field")), ["feed", "file_no"]
    )
    # Values by id, one per file (the first line), only of fields that may have been renamed.
    v = values.where("field is not null and id is not null")
    first = lambda d, f: d.groupBy("feed", "file_no", f, "id").agg(F.min_by("value", "line_no").alias("value"))
    was = first(v.join(cand.select("feed", F.col("prev_no").alias("file_no"), F.col("old_field").alias("field")).distinct(), ["feed", "file_no", "field"]), "field")
    now = first(v.join(cand.select("feed", "file_no", F.col("new_field").alias("field")).distinct(), ["feed", "file_no", "field"]), "field")
    pairs = (
        cand.join(was.select("feed", F.col("file_no").alias("prev_no"), F.col("field").alias("old_field"), "id", F.col("value").alias("a")), ["feed", "prev_no", "old_field"])
        .join(now.select("feed", "file_no", F.col("field").alias("new_field"), "id", F.col("value").alias("b")), ["feed", "file_no", "new_field", "id"])
        .groupBy("feed", "file_no", "old_field", "new_field")
        .agg(F.count(F.lit(1)).alias("ids"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree"))
        .where(F.col("agree") >= AGREEMENT)
    )
    order = [F.desc("agree"), F.desc("ids")]
    pairs = pairs.withColumn("ro", F.row_number().over(W.partitionBy("feed", "file_no", "old_field").orderBy(*order, "new_field")))
    pairs = pairs.where("ro = 1").withColumn("rn", F.row_number().over(W.partitionBy("feed", "file_no", "new_field").orderBy(*order, "old_field")))
    renamed = materialize(pairs.where("rn = 1").select("feed", "file_no", "old_field", "new_field"), "sd-renamed")
    gone = gone.join(renamed.select("feed", "file_no", F.col("old_field").alias("field")), ["feed", "file_no", "field"], "left_anti")
    come = come.join(renamed.select("feed", "file_no", F.col("new_field").alias("field")), ["feed", "file_no", "field"], "left_anti")
    row = lambda d, k, o, n: d.select("file_name", F.lit(k).alias("change_kind"), o.alias("old_field"), n.alias("new_field"))
    return (
        row(come, "added", F.lit(""), F.col("field"))
        .unionByName(row(gone, "removed", F.col("field"), F.lit("")))
        .unionByName(row(both.where("old_kind <> new_kind"), "retyped", F.col("field"), F.col("field")))
        .unionByName(row(renamed.join(files.select("feed", "file_no", "file_name"), ["feed", "file_no"]), "renamed", F.col("old_field"), F.col("new_field")))
    )


#: Casts of a JSON value to the type of a column of the consistent table.
def _typed(kind: str, value: Column) -> Column:
    text = F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")).otherwise(value)
    low = F.lower(F.trim(text))
    if kind == "integer":
        num = F.when(low == "true", F.lit(1.0)).when(low == "false", F.lit(0.0)).otherwise(low.try_cast("double"))
        return F.when(num == F.floor(num), num.cast("decimal(38,0)").try_cast("long"))
    if kind == "decimal":
        return low.try_cast("double")
    if kind == "boolean":
        return F.when(low.isin("true", "1", "yes", "1.0"), True).when(low.isin("false", "0", "no", "0.0"), False)
    return text


def _plain(name: str) -> str:
    """A field name without case and marks."""
    return "".join(ch for ch in name.lower() if ch.isalnum())


def derived_columns(values: DataFrame, columns: dict[str, str], aliases: dict[str, str] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """(columns, aliases) for `consistent_table` from all files: those given, and one column for every other field that a file has.

    Names that the renamings of `schema_changes` link, directly or through others, in any feed
    are one column: of the given name if one is among them, else of the name that most files
    have. Names that are fields of the same file, and two given columns, are never joined; the
    most frequent renamings come first. A new column has the type of most of its values over all
    files, integer with decimal gives decimal; arrays and objects are JSON strings. Beyond
    MOST_COLUMNS new columns the rarest have none and stay in `rest`. What comes to the driver
    grows with the number of names, not of files.
    """
    has = materialize(file_fields(values).where("present").select("feed", "file_no", "field", "kind", "held"), "sd-has")
    linked = schema_changes(values).where("change_kind = 'renamed'").groupBy("old_field", "new_field").count().collect()
    n = has.select(F.col("field").alias("a"), "feed", "file_no")
    apart = defaultdict(set)
    for r in n.join(n.withColumnRenamed("a", "b"), ["feed", "file_no"]).where("a < b").select("a", "b").distinct().collect():
        if _plain(r.a) != _plain(r.b):
            apart[_plain(r.a)].add(_plain(r.b))
            apart[_plain(r.b)].add(_plain(r.a))
    files, names, kinds = Counter(), defaultdict(Counter), defaultdict(Counter)
    for r in has.groupBy("field", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("held").alias("held")).collect():
        k = _plain(r.field)
        files[k] += r.files
        names[k][r.field] += r.files
        kinds[k][r.kind] += r.held
    given = {_plain(k): k for k in columns} | {_plain(a): k for a, k in (aliases or {}).items()}
    group = {k: {k} for k in files.keys() | given.keys() if k}

    def join(a: str, b: str, sure: bool = False) -> None:
        x, y = group.get(a), group.get(b)
        if x is None or y is None or x is y:
            return
        owners = {given[k] for k in x | y if k in given}
        if not sure and (len(owners) > 1 or any(apart[k] & y for k in x)):
            return
        x |= y
        for k in y:
            group[k] = x

    for a, k in given.items():
        join(_plain(k), a, True)
    for r in sorted(linked, key=lambda r: (-r["count"], r.old_field, r.new_field)):
        join(_plain(r.old_field), _plain(r.new_field))
    cols, also, new = dict(columns), dict(aliases or {}), []
    for g in {id(g): g for g in group.values()}.values():
        owner = next((given[k] for k in sorted(g) if k in given), None)
        if owner is None:
            most = min(g, key=lambda k: (-files[k], k))
            name = min(names[most].items(), key=lambda x: (-x[1], x[0]))[0]
            new.append((-sum(files[k] for k in g), name, g))
        else:
            also |= {k: owner for k in g if k != _plain(owner)}
    taken = {c.lower() for c in cols} | {"raw_id", "feed", "file_no", "file_name", "line_no", "record_id", "rest"}
    for _, name, g in sorted(new, key=lambda x: x[:2])[:MOST_COLUMNS]:
        kind = sum((kinds[k] for k in g), Counter())
        best = min(kind, key=lambda k: (-kind[k], k))
        col = name
        while col.lower() in taken:
            col += "_"
        taken.add(col.lower())
        cols[col] = "decimal" if best == "integer" and kind["decimal"] else best if best in ("integer", "decimal", "boolean") else "string"
        also |= {k: col for k in g}
    return cols, also


def consistent_table(
    raw: DataFrame, columns: dict[str, str], aliases: dict[str, str] | None = None, values: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(table, failures): every readable line with typed columns, and values that do not cast.

    columns: name -> integer, decimal, boolean or string; aliases: other name -> column name,
    for instance from `derived_columns`; names that differ only in case or marks need no alias.
    Failures are reported as (file_name, line_no, column, kind, value), never dropped silently:
    the column is null in the table. Lines without a field have null there. `rest` maps every
    other field of the line to its JSON value: fields without a column, and further names of a
    column that the line already has. values: `path_values(raw)` where it is written already.
    """
    values = materialize(path_values(raw), "sd-values") if values is None else values
    known = {_plain(k): k for k in columns} | {_plain(a): k for a, k in (aliases or {}).items()}
    name = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.lower(F.regexp_replace("field", r"[^\p{L}\p{N}]+", ""))]
    v = values.where("readable").withColumn("col", name)
    exact = F.when(F.col("field") == F.col("col"), 0).otherwise(1)
    held = {c: f"_{i}" for i, c in enumerate(columns)}  # names of fields may be those of other columns, or hold dots
    q = lambda c: F.col(held[c])
    pick = lambda c: F.min_by(F.when(F.col("col") == c, F.struct("field", "kind", "value")), F.when(F.col("col") == c, F.struct(exact, "field")))
    wide = v.groupBy("raw_id", "feed", "file_no", "file_name", "line_no").agg(
        F.max("id").alias("record_id"),
        F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value"))).alias("_all"),
        *[pick(c).alias(held[c]) for c in columns],
    )
    wide = materialize(wide, "sd-wide")
    used = F.array(*[q(c)["field"] for c in columns])
    rest = F.map_from_entries(F.filter("_all", lambda x: ~F.coalesce(F.array_contains(F.array_compact(used), x["field"]), F.lit(False))))
    table = wide.select(
        "raw_id", "feed", "file_no", "file_name", "line_no", "record_id", *[_typed(k, q(c)["value"]).alias(c) for c, k in columns.items()], rest.alias("rest")
    )
    fails = F.filter(
        F.array(*[F.when(q(c).isNotNull() & _typed(k, q(c)["value"]).isNull(), F.struct(F.lit(c).alias("column"), q(c)["kind"].alias("kind"), q(c)["value"].alias("value"))) for c, k in columns.items()]),
        lambda x: x.isNotNull(),
    )
    failures = wide.select("file_name", "line_no", F.explode(fails).alias("f")).select("file_name", "line_no", "f.*")
    return table, failures
