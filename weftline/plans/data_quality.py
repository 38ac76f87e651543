"""Queries of the core for problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.schema_drift import AGREEMENT, PRESENCE, consistent_table, derived_columns, file_fields, path_values, schema_changes
from weftline.session import table
from weftline.storage import materialize

COLUMNS = {
    "id": "string", "input": "string", "classification": "string", "risk": "string", "early_warning": "boolean",
    "analysis": "string", "recommended_action": "string", "confidence": "decimal", "hardness": "integer",
    "category": "string", "grid_index": "integer", "source": "string", "synthetic": "boolean",
    "teacher_model": "string", "created_at": "string",
}
ALIASES = {"analysis_text": "analysis", "action": "recommended_action"}


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(path_values(table(spark, sf, "raw_records")), "sd-values")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(_values(spark, sf))


def p5_fields(spark: SparkSession, sf: str) -> DataFrame:
    return file_fields(_values(spark, sf))


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Per feed, path (objects within objects included) and raw type: in how many lines it holds a value."""
    v = path_values(table(spark, sf, "raw_records"), depth=4).where("field is not null")
    return v.groupBy("feed", F.col("field").alias("path"), "kind").agg(F.count(F.lit(1)).alias("lines"))


def _consistent(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    values = _values(spark, sf)
    return consistent_table(table(spark, sf, "raw_records"), *derived_columns(values, COLUMNS, ALIASES), values)


def p5_table(spark: SparkSession, sf: str) -> DataFrame:
    return _consistent(spark, sf)[0]


def p5_cast_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _consistent(spark, sf)[1]


def p5_rest(spark: SparkSession, sf: str) -> DataFrame:
    """What has no column: fields left in `rest`, with the number of lines."""
    return p5_table(spark, sf).select(F.explode("rest").alias("field", "value")).groupBy("field").agg(F.count(F.lit(1)).alias("lines"))


def p5_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    bad = _values(spark, sf).where("field is null and not readable")
    return bad.groupBy("feed").agg(F.count(F.lit(1)).alias("unreadable"))


QUERIES = {f.__name__: f for f in (p5_found, p5_fields, p5_paths, p5_table, p5_cast_failures, p5_rest, p5_unreadable)}
_LINES = "l AS (SELECT raw_id, feed, file_no, file_name, line_no, payload, coalesce(json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT', false) AS ok FROM raw_records WHERE feed IS NOT NULL AND file_no IS NOT NULL)"
_VALUES = (
    _LINES + ", o AS (SELECT * FROM l WHERE ok), e AS (SELECT feed, file_no, line_no, CASE WHEN json_type(payload, '$.id') NOT IN ('BOOLEAN', 'NULL', 'ARRAY', 'OBJECT') THEN payload ->> '$.id' END AS id, "
    "j.key AS field, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS kind, CAST(j.value AS VARCHAR) AS value "
    "FROM o, LATERAL json_each(o.payload) j WHERE j.type <> 'NULL')"
)
_FIELDS = (
    _VALUES + ", n AS (SELECT feed, file_no, count(*) AS objects FROM o GROUP BY ALL), k AS (SELECT feed, file_no, field, kind, count(*) AS c FROM e GROUP BY ALL), "
    "b AS (SELECT feed, file_no, field, CAST(sum(c) AS BIGINT) AS held, arg_min(kind, (-c, kind)) AS kind FROM k GROUP BY feed, file_no, field), "
    f"f AS (SELECT feed, file_no, field, held, kind, objects, held >= {PRESENCE} * objects AS present FROM b JOIN n USING (feed, file_no))"
)
_CHANGES = (
    _FIELDS + ", s AS (SELECT feed, file_no, min(file_name) AS file_name, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS prev_no FROM l GROUP BY feed, file_no), "
    "p AS (SELECT s.*, f.field, f.kind FROM s JOIN f ON f.feed = s.feed AND f.file_no = s.prev_no WHERE f.present), q AS (SELECT s.*, f.field, f.kind FROM s JOIN f USING (feed, file_no) WHERE f.present AND s.prev_no IS NOT NULL), "
    "gone AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.feed = p.feed AND q.file_no = p.file_no AND q.field = p.field)), "
    "come AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.feed = q.feed AND p.file_no = q.file_no AND p.field = q.field)), "
    "v AS (SELECT feed, file_no, field, id, arg_min(value, line_no) AS value FROM e WHERE id IS NOT NULL GROUP BY ALL), "
    "a AS (SELECT g.feed, g.file_no, g.file_name, g.field AS old_field, c.field AS new_field, count(*) AS ids, avg(CASE WHEN x.value = y.value THEN 1.0 ELSE 0 END) AS agree FROM gone g JOIN come c USING (feed, file_no) "
    "JOIN v x ON x.feed = g.feed AND x.file_no = g.prev_no AND x.field = g.field JOIN v y ON y.feed = g.feed AND y.file_no = g.file_no AND y.field = c.field AND y.id = x.id GROUP BY ALL), "
    f"r1 AS (SELECT *, row_number() OVER (PARTITION BY feed, file_no, old_field ORDER BY agree DESC, ids DESC, new_field) AS ro FROM a WHERE agree >= {AGREEMENT}), "
    "r2 AS (SELECT *, row_number() OVER (PARTITION BY feed, file_no, new_field ORDER BY agree DESC, ids DESC, old_field) AS rn FROM r1 WHERE ro = 1), r AS (SELECT * FROM r2 WHERE rn = 1)"
)
ORACLE = {
    "p5_fields": f"WITH {_FIELDS} SELECT * FROM f",
    "p5_unreadable": f"WITH {_LINES} SELECT feed, count(*) AS unreadable FROM l WHERE NOT ok GROUP BY feed",
    "p5_found": f"WITH {_CHANGES} SELECT file_name, 'renamed' AS change_kind, old_field, new_field FROM r "
    "UNION ALL SELECT file_name, 'removed', field, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.feed = gone.feed AND r.file_no = gone.file_no AND r.old_field = gone.field) "
    "UNION ALL SELECT file_name, 'added', '', field FROM come WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.feed = come.feed AND r.file_no = come.file_no AND r.new_field = come.field) "
    "UNION ALL SELECT p.file_name, 'retyped', p.field, p.field FROM p JOIN q USING (feed, file_no, field) WHERE p.kind <> q.kind",
}
