"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.answer_defects import answer_defects
from weftline.llm.format_duplicates import format_duplicates, format_representatives
from weftline.llm.group_splits import divided_records, record_cell_keys, related_forest, related_roots, split_groups
from weftline.llm.mixing import balanced, document_sizes, mix, unreachable
from weftline.llm.near_duplicates import near_duplicate_groups
from weftline.llm.sampling import draw_sample, quota_report
from weftline.llm.split_overlap import overlap_counts, split_overlaps
from weftline.llm.subjects import document_subjects
from weftline.llm.tokens import count_tokens, encode
from weftline.session import table
from weftline.storage import materialize

#: Similarity of problems 3 and 6, as TESTDATA.md states it: 7 of 10 distinct words.
NUM, DEN = 7, 10
PROPORTIONS = {"train": 0.9, "val": 0.04, "eval": 0.06}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return answer_defects(table(spark, sf, "records"), corpus=table(spark, sf, "documents"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return p1_found(spark, sf).groupBy("answer_field", "defect").agg(F.count(F.lit(1)).alias("answers"))


def _quotas(spark: SparkSession, sf: str) -> DataFrame:
    return quota_report(table(spark, sf, "records"), table(spark, sf, "sample_targets"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    short = _quotas(spark, sf).where("not met")
    return short.select("plan_name", F.col("row_name").alias("classification"), F.col("col_name").alias("category"))


def p2_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return _quotas(spark, sf).select(
        "plan_name", F.col("row_name").alias("classification"), F.col("col_name").alias("category"), "supply", "need", "met", "rounded", "quota", "row_missed", "col_missed"
    )


def p2_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per plan: rows asked for, rows in the sample, and whether every quota lies in its bounds and is drawn exactly."""
    q = _quotas(spark, sf)
    per = q.groupBy("plan_name").agg(
        F.max("sample_rows").alias("sample_rows"), F.sum("quota").alias("quota"),
        F.min((F.col("quota") >= F.least(F.coalesce("min_rows", F.lit(0)), "supply")) & (F.col("quota") <= F.col("supply"))).alias("in_bounds"),
    )
    drawn = p2_sample(spark, sf).groupBy("plan_name").agg(F.count(F.lit(1)).alias("drawn"))
    exact = F.coalesce("drawn", F.lit(0)) == F.col("quota")
    return per.join(drawn, "plan_name", "left").select("plan_name", "sample_rows", "quota", "in_bounds", exact.alias("exact"))


def p2_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Per plan and classification or category: the rows its margin asks for and how many of them the bounds do not allow."""
    q = _quotas(spark, sf)
    side = lambda kind, name, missed: q.groupBy("plan_name", F.lit(kind).alias("margin"), F.col(name).alias("name")).agg(
        F.sum("rounded").alias("rounded"), F.sum("quota").alias("quota"), F.max(missed).alias("missed")
    )
    return side("classification", "row_name", "row_missed").unionByName(side("category", "col_name", "col_missed"))


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    return draw_sample(table(spark, sf, "records"), table(spark, sf, "sample_targets"), "record_no")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    o = split_overlaps(table(spark, sf, "records"), "record_no", "input", "split_name", num=NUM, den=DEN)
    return o.select(F.least("train_id", "held_id").alias("record_a"), F.greatest("train_id", "held_id").alias("record_b"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "records")
    held = r.select(F.col("record_no").alias("id"), "split_name", "source")
    hit = overlap_counts(r, "record_no", "input", "split_name", num=NUM, den=DEN)
    return hit.join(held, "id").groupBy("split_name", "source").agg(F.count(F.lit(1)).alias("records"), F.sum("links").alias("pairs"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return divided_records(table(spark, sf, "records"), "record_no", "split_name", record_cell_keys()).select(F.col("id").alias("record_no"))


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    roots = materialize(related_roots(table(spark, sf, "records"), "record_no", record_cell_keys()), "p4-roots")
    return roots.join(split_groups(roots, PROPORTIONS), "root").select(F.col("id").alias("record_no"), F.hex("root").alias("root"), "split")


def p4_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The written forest: nodes that are related through more than one key, trees and edges; edges and trees add up to the nodes."""
    _, forest, roots = related_forest(table(spark, sf, "records"), "record_no", record_cell_keys())
    trees = roots.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("root").alias("trees"))
    return trees.crossJoin(forest.agg(F.count(F.lit(1)).alias("edges")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    g = near_duplicate_groups(table(spark, sf, "records"), "record_no", ["input", "analysis"], NUM, DEN)
    return g.where("grouped").select(F.col("id").alias("record_no"), F.col("group_id").alias("group_no"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    d = format_duplicates(table(spark, sf, "records"), "record_no", "input")
    return d.where("id <> first_id").select(F.col("first_id").alias("first_no"), F.col("id").alias("copy_no"))


def p7_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return format_representatives(table(spark, sf, "records"), "record_no", "input")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"), "doc_id", "text")


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"), "doc_id", "text")


def p8_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"), "doc_id", "text", offsets=True)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    short = unreachable(balanced(document_sizes(table(spark, sf, "documents")), table(spark, sf, "mix_targets")))
    return spark.createDataFrame([(s,) for s in short], "source string")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(document_sizes(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mix(document_sizes(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return document_subjects(*[table(spark, sf, t) for t in ("documents", "subject_labels", "subjects")])


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    return p10_found(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p2_found, p2_quotas, p2_totals, p2_margins, p2_sample, p3_found, p3_report, p4_found, p4_splits, p4_forest, p6_found,
        p7_found, p7_representatives, p8_ids, p8_counts, p8_offsets, p9_found, p9_mix, p9_report, p10_found, p10_composition,
    )
}

_LETTERS = "lower(regexp_replace({0}, '[^\\p{{L}}]+', '', 'g'))".format

ORACLE = {
    "p2_found": f"""
        WITH r AS (SELECT DISTINCT id, {_LETTERS('classification')} AS c, {_LETTERS('category')} AS g FROM records
                   WHERE id IS NOT NULL AND classification IS NOT NULL AND category IS NOT NULL),
             s AS (SELECT c, g, count(*) AS supply FROM r GROUP BY c, g)
        SELECT t.plan_name, t.classification, t.category FROM sample_targets t
        LEFT JOIN s ON s.c = {_LETTERS('t.classification')} AND s.g = {_LETTERS('t.category')}
        WHERE coalesce(s.supply, 0) < greatest(coalesce(t.min_rows, 0), round(t.target_share * t.sample_rows))""",
    "p2_totals": f"""
        WITH r AS (SELECT DISTINCT id, {_LETTERS('classification')} AS c, {_LETTERS('category')} AS g FROM records
                   WHERE id IS NOT NULL AND classification IS NOT NULL AND category IS NOT NULL),
             s AS (SELECT c, g, count(*) AS supply FROM r GROUP BY c, g),
             t AS (SELECT t.*, coalesce(s.supply, 0) AS supply FROM sample_targets t
                   LEFT JOIN s ON s.c = {_LETTERS('t.classification')} AND s.g = {_LETTERS('t.category')})
        SELECT plan_name, max(sample_rows) AS sample_rows,
               CAST(greatest(least(round(sum(target_share * sample_rows)), sum(supply)), sum(least(coalesce(min_rows, 0), supply))) AS BIGINT) AS quota,
               true AS in_bounds, true AS exact
        FROM t GROUP BY plan_name""",
    "p4_forest": f"""
        WITH r AS (SELECT id, {_LETTERS('category')} AS g,
                          coalesce(CASE WHEN grid_index >= 0 THEN CAST(grid_index AS BIGINT) END,
                                   TRY_CAST(nullif(regexp_extract(id, '^(?:engine-v4-s|v3_|salvaged-v1-)(\\d+)', 1), '') AS BIGINT)) AS cell FROM records),
             e AS (SELECT DISTINCT id, g || '#' || cell AS k FROM r WHERE id IS NOT NULL AND g <> '' AND cell IS NOT NULL),
             one AS (SELECT id, k, min(k) OVER (PARTITION BY id) AS other FROM e),
             n AS (SELECT count(DISTINCT id) + count(DISTINCT k) AS nodes, count(DISTINCT k) - count(DISTINCT CASE WHEN k <> other THEN k END) AS trees FROM one)
        SELECT nodes, trees, nodes - trees AS edges FROM n""",
    "p4_found": f"""
        WITH r AS (SELECT record_no, split_name, {_LETTERS('category')} AS g,
                          coalesce(CASE WHEN grid_index >= 0 THEN CAST(grid_index AS BIGINT) END,
                                   TRY_CAST(nullif(regexp_extract(id, '^(?:engine-v4-s|v3_|salvaged-v1-)(\\d+)', 1), '') AS BIGINT)) AS cell
                   FROM records WHERE category IS NOT NULL AND split_name IS NOT NULL),
             k AS (SELECT * FROM r WHERE g <> '' AND cell IS NOT NULL),
             d AS (SELECT g, cell FROM k GROUP BY g, cell HAVING count(DISTINCT split_name) > 1)
        SELECT record_no FROM k JOIN d USING (g, cell)""",
}
