"""Corpus hygiene, deduplication and leakage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import text as T
from weftline.plans.registering import registering
from weftline.session import spread, table

QUERIES, ORACLE = {}, {}
query = registering(QUERIES, ORACLE)
WS = r"[ \t\n\x0B\f\r]"
#: Squeezed white space in SQL.
SQ = (r"regexp_replace(regexp_replace({0}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')").format
KEY = lambda x: f"('distill:' || substring(sha256({SQ(f'lower({x})')}), 1, 16))"
LINES = "(SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
STRIP = r"list_filter(list_transform(string_split_regex({0}, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda x: x <> '')".format
TRAIN, HELD = "doc_kind IN ('prose', 'note', 'chat') AND source <> 'notes_18'", "source = 'notes_18'"


def docs(spark, sf):
    return spread(table(spark, sf, "documents"), "doc_id")


@query("SELECT doc_id, regexp_replace(text || chr(1) || chr(13) || chr(127), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g') AS clean FROM documents")
def sanitize_documents(spark, sf):
    dirty = F.concat("text", F.chr(F.lit(1)), F.chr(F.lit(13)), F.chr(F.lit(127)))
    return docs(spark, sf).select("doc_id", T.scrub_controls(dirty).alias("clean"))


@query(f"SELECT doc_id, {SQ('text')} AS one, array_to_string({STRIP('text')}, ' | ') AS piped FROM documents")
def one_line_documents(spark, sf):
    c = F.col("text")
    return docs(spark, sf).select("doc_id", T.squeeze(c).alias("one"), T.pipe_lines(c).alias("piped"))


@query(
    "WITH t AS (SELECT doc_id, '*** START OF THIS PROJECT GUTENBERG EBOOK x ***' || chr(10) || '-----' || chr(10) || '[Illustration: y]' || chr(10) || text AS text FROM documents)"
    ", k AS (SELECT doc_id, list_filter(" + STRIP(r"regexp_replace(text, '(?s)\*\*\* (START|END) OF (THIS|THE) PROJECT GUTENBERG EBOOK .*?\*\*\*[ \t\n\x0B\f\r]*', '', 'g')")
    + r", lambda x: NOT regexp_matches(x, '^(-{5,}|_{5,}|={5,}|#{5,}|\.{5,})$') AND NOT starts_with(x, '[Illustration') AND x NOT IN ('Project Gutenberg', 'www.gutenberg.org')) AS l FROM t)"
    r" SELECT doc_id, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]{2,}', ' ', 'g') || chr(10) AS clean FROM k"
)
def boilerplate_documents(spark, sf):
    banner = F.lit("*** START OF THIS PROJECT GUTENBERG EBOOK x ***\n-----\n[Illustration: y]\n")
    return docs(spark, sf).select("doc_id", T.clean_boilerplate(F.concat(banner, "text")).alias("clean"))


@query(
    "WITH f AS (SELECT record_no, '```json' || chr(10) || analysis || chr(10) || '```' AS a FROM records), "
    r"t AS (SELECT record_no, regexp_replace(a, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS a FROM f) "
    r"SELECT record_no, CASE WHEN starts_with(a, '```') THEN regexp_replace(a, '^```[a-zA-Z]*[ \t\n\x0B\f\r]*|[ \t\n\x0B\f\r]*```$', '', 'g') ELSE a END AS reply FROM t"
)
def strip_fences(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "analysis", F.lit("\n```"))
    return table(spark, sf, "records").select("record_no", T.strip_fence(fenced).alias("reply"))


@query(f"SELECT doc_id, {KEY('text')} AS key, sha256(text) AS fp, substring(sha256(text), 1, 12) AS short, CAST('0x' || substring(sha256(text), 1, 8) AS BIGINT) AS seed FROM documents")
def hash_documents(spark, sf):
    c = F.col("text")
    return docs(spark, sf).select("doc_id", T.content_key(c).alias("key"), T.fingerprint(c).alias("fp"), T.short_hash(c).alias("short"), T.stable_seed(c).alias("seed"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def exact_dedup_documents(spark, sf):
    return T.first_of_each(docs(spark, sf).select("doc_id", "text"), ["text"], ["doc_id"])


@query(f"SELECT doc_id, min(line_no) AS line_no, line FROM {LINES} GROUP BY doc_id, line")
def dedup_lines(spark, sf):
    return T.first_of_each(T.lines_of(docs(spark, sf)).withColumn("line_no", F.col("line_no").cast("long")), ["doc_id", "line"], ["line_no"])


@query(f"SELECT doc_id, count(*) FILTER (length(line) >= 8) AS kept, count(*) FILTER (length(line) < 8) AS removed FROM {LINES} GROUP BY doc_id")
def min_length_lines(spark, sf):
    n = F.length("line")
    return T.lines_of(docs(spark, sf)).groupBy("doc_id").agg(F.count_if(n >= 8).alias("kept"), F.count_if(n < 8).alias("removed"))


@query(
    "WITH p AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)), "
    f"q AS (SELECT doc_id, pos, {SQ('p')} AS p FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(p) ORDER BY pos) AS rn FROM q WHERE p <> '') "
    "SELECT doc_id, string_agg(p, chr(10) ORDER BY pos) || chr(10) AS text FROM r WHERE rn = 1 GROUP BY doc_id"
)
def paragraph_dedup(spark, sf):
    return T.paragraph_dedup(docs(spark, sf), sep="\n")


_HEAD = "substring(text, 1, 480)"
_OCC = lambda t, p: f"(CASE WHEN trim({p}) = '' THEN 0 ELSE (length({t}) - length(replace({t}, {p}, ''))) / length({p}) END)"
_OFF = lambda o: f"substring({_HEAD}, CAST({o} AS BIGINT) + 1, 60)"


@query(
    f"SELECT doc_id, CASE WHEN text IS NULL OR length({_HEAD}) < 240 THEN false ELSE "
    + " OR ".join(f"{_OCC(_HEAD, _OFF(o))} >= 3" for o in ("0", f"length({_HEAD}) // 2", f"length({_HEAD}) - 120"))
    + " END AS repetitive FROM documents"
)
def repetition_gate_a(spark, sf):
    return docs(spark, sf).select("doc_id", T.loops_in_head(F.col("text")).alias("repetitive"))


@query(
    "SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 120 THEN false ELSE "
    + " OR ".join(f"(length(substring(text, {o + 1}, 60)) = 60 AND (length(text) - length(replace(text, substring(text, {o + 1}, 60), ''))) / 60 > 3)" for o in (20, 30, 40))
    + " END AS repetitive FROM documents"
)
def repetition_gate_b(spark, sf):
    return docs(spark, sf).select("doc_id", T.loops_anywhere(F.col("text")).alias("repetitive"))


_W = f"list_filter(string_split({SQ('text')}, ' '), lambda x: x <> '')"
_GRAMS = lambda n, w="w": f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


@query(
    f"WITH d AS (SELECT doc_id, {_W} AS w FROM documents), g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN {_GRAMS(4)} END AS g FROM d) "
    "SELECT doc_id, CASE WHEN g IS NULL THEN 0.0 ELSE round_even(1 - CAST(len(list_distinct(g)) AS DOUBLE) / len(g), 6) END AS fraction FROM g"
)
def repetition_fraction(spark, sf):
    r = T.repetition_fraction(docs(spark, sf), "doc_id", "text")
    return r.withColumn("fraction", F.bround("fraction", 6))


def _gram_sql(where: str, n: int) -> str:
    return f"SELECT DISTINCT doc_id, unnest({_GRAMS(n)}) AS gram FROM (SELECT doc_id, {_W.replace('text', 'lower(text)')} AS w FROM documents WHERE {where}) WHERE len(w) >= {n}"


def _sides(spark, sf):
    d = docs(spark, sf)
    return d.where(TRAIN), d.where(HELD)


@query(
    f"WITH t AS (SELECT DISTINCT gram FROM ({_gram_sql(TRAIN, 8)})), h AS (SELECT DISTINCT gram FROM ({_gram_sql(HELD, 8)})), "
    "c AS (SELECT (SELECT count(*) FROM h) AS heldout_grams, (SELECT count(*) FROM t) AS train_grams, (SELECT count(*) FROM h WHERE gram IN (SELECT gram FROM t)) AS overlap) "
    "SELECT *, coalesce(round_even(CAST(overlap AS DOUBLE) / nullif(heldout_grams, 0), 6), 0) AS fraction, overlap = 0 AS leak_free FROM c"
)
def ngram_leak_report(spark, sf):
    a, b = _sides(spark, sf)
    return T.leak_report(T.shingles(a, "doc_id", "text", 8), T.shingles(b, "doc_id", "text", 8))


@query(
    f"WITH h AS (SELECT DISTINCT gram FROM ({_gram_sql(HELD, 13)})), t AS ({_gram_sql(TRAIN, 13)}) "
    f"SELECT doc_id, lang FROM documents WHERE {TRAIN} AND doc_id NOT IN (SELECT doc_id FROM t WHERE gram IN (SELECT gram FROM h))"
)
def decontaminate_documents(spark, sf):
    a, b = _sides(spark, sf)
    return T.decontaminate(a, b).select("doc_id", "lang")


@query(f"SELECT doc_id, count(DISTINCT gram) AS grams FROM ({_gram_sql('true', 5)}) GROUP BY doc_id")
def distinct_ngrams(spark, sf):
    return T.shingles(docs(spark, sf), "doc_id", "text", 5).groupBy("doc_id").agg(F.count(F.lit(1)).alias("grams"))


@query(
    f"WITH l AS (SELECT x.*, d.source FROM {LINES} x JOIN documents d USING (doc_id)) "
    "SELECT DISTINCT line FROM l WHERE source = 'notes_18' AND line <> '' AND line IN (SELECT line FROM l WHERE source <> 'notes_18')"
)
def exact_line_leak(spark, sf):
    a, b = (T.lines_of(docs(spark, sf).where(w)).select("line").where("line <> ''") for w in ("source <> 'notes_18'", HELD))
    return b.distinct().join(a.distinct(), "line", "left_semi")


@query(
    "WITH r AS (SELECT DISTINCT split_name, input FROM records WHERE split_name IS NOT NULL AND input IS NOT NULL), i AS (SELECT DISTINCT split_name, id FROM records WHERE split_name IS NOT NULL AND id IS NOT NULL) "
    "SELECT a.split_name AS split_a, b.split_name AS split_b, 'body' AS what, count(*) AS shared FROM r a JOIN r b ON a.input = b.input AND a.split_name < b.split_name GROUP BY ALL "
    "UNION ALL SELECT a.split_name, b.split_name, 'id', count(*) FROM i a JOIN i b ON a.id = b.id AND a.split_name < b.split_name GROUP BY ALL"
)
def split_disjointness(spark, sf):
    r = table(spark, sf, "records").where("split_name is not null")

    def shared(col, what):
        x = r.where(F.col(col).isNotNull()).select("split_name", F.col(col).alias("v")).distinct()
        pair = x.select("v", F.col("split_name").alias("split_a")).join(x.select("v", F.col("split_name").alias("split_b")), "v")
        return pair.where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared")).select("split_a", "split_b", F.lit(what).alias("what"), "shared")

    return shared("input", "body").unionByName(shared("id", "id"))


@query("SELECT split_name, count(*) AS overlap FROM records WHERE source <> 'v3_notebook' AND split_name IS NOT NULL AND input IN (SELECT input FROM records WHERE source = 'v3_notebook') GROUP BY split_name")
def external_overlap(spark, sf):
    r = table(spark, sf, "records")
    ext = r.where("source = 'v3_notebook'").select("input").distinct()
    own = r.where("source <> 'v3_notebook' and split_name is not null")
    return own.join(ext, "input", "left_semi").groupBy("split_name").agg(F.count(F.lit(1)).alias("overlap"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def class_distribution(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT round_even(1 - CAST(count(DISTINCT {KEY('text')}) AS DOUBLE) / count(*), 6) AS redundancy FROM documents WHERE text IS NOT NULL")
def redundancy_ratio(spark, sf):
    k = docs(spark, sf).where("text is not null").select(T.content_key(F.col("text")).alias("k"))
    return k.agg(F.bround(1 - F.count_distinct("k") / F.count(F.lit(1)), 6).alias("redundancy"))


@query(f"SELECT doc_id, line_no, line FROM {LINES} WHERE regexp_matches(line, '(?i)tribunal|serv[ei]r') ORDER BY doc_id, line_no LIMIT 50")
def search_text(spark, sf):
    """Regex search with a hit limit: the limit is the feature."""
    hit = T.lines_of(docs(spark, sf)).where(T.matches(spark, F.col("line"), "tribunal|serv[ei]r", True))
    return hit.withColumn("line_no", F.col("line_no").cast("long")).orderBy("doc_id", "line_no").limit(50)


@query(f"SELECT doc_id, line_no, line FROM {LINES} JOIN documents USING (doc_id) WHERE contains(line, '?') AND source GLOB '*notes*' ORDER BY doc_id, line_no LIMIT 50")
def search_literal(spark, sf):
    """A pattern that is no regular expression is searched as it stands, in sources that match a glob."""
    d = docs(spark, sf).where(F.col("source").like("%notes%"))
    hit = T.lines_of(d).where(T.matches(spark, F.col("line"), "?", True))
    return hit.withColumn("line_no", F.col("line_no").cast("long")).orderBy("doc_id", "line_no").limit(50).select("doc_id", "line_no", "line")


@query(f"WITH n AS (SELECT doc_id, count(*) AS total FROM {LINES} GROUP BY doc_id) SELECT doc_id, line_no, line, CASE WHEN total > 5 THEN 5 END AS next_start FROM {LINES} JOIN n USING (doc_id) WHERE line_no >= 2 AND line_no < 5")
def sliced_read(spark, sf):
    """Lines start .. start + limit - 1 of each document, with where to go on."""
    d = docs(spark, sf).where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    s = d.select("doc_id", F.when(F.size("l") > 5, F.lit(5).cast("long")).alias("next_start"), F.posexplode("l").alias("p", "line")).where("p between 2 and 4")
    return s.select("doc_id", F.col("p").cast("long").alias("line_no"), "line", "next_start")
