"""Tokenisation, vocabulary, chunking and dialogue queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import text as T
from weftline.operators import tokenize as K
from weftline.operators.positions import hash_order, positions
from weftline.plans.corpus import LINES, SQ, docs
from weftline.plans.registering import registering
from weftline.storage import materialize

QUERIES, ORACLE = {}, {}
query = registering(QUERIES, ORACLE)


_P = r"regexp_extract_all(text, '([A-Za-z0-9'']+| |\n|[^\n])', 0)"
_CNT = f"c AS (SELECT piece, count(*) AS n FROM (SELECT unnest({_P}) AS piece FROM documents WHERE {{0}}) GROUP BY piece)"
_WORDY = r"length(piece) > 1 AND regexp_matches(piece, '^[\p{L}\p{N}'']+$') AND regexp_matches(piece, '[\p{L}\p{N}]')"
_VOC = (
    _CNT.format("lang IS DISTINCT FROM 'en'")
    + ", s AS (SELECT unnest(range(4)) AS token_id, unnest(['<pad>', '<bos>', '<eos>', '<unk>']) AS piece, 0 AS n), "
    "ch AS (SELECT row_number() OVER (ORDER BY encode(piece)) + 3 AS token_id, piece, n FROM c WHERE length(piece) = 1), "
    f"w AS (SELECT row_number() OVER (ORDER BY n DESC, encode(piece)) + (SELECT count(*) FROM ch) + 3 AS token_id, piece, n FROM c WHERE {_WORDY} AND n >= 2), "
    "v AS (SELECT * FROM s UNION ALL SELECT * FROM ch UNION ALL SELECT * FROM w WHERE token_id < 1200)"
)


def _vocab(spark, sf):
    foreign = docs(spark, sf).where(~F.col("lang").eqNullSafe(F.lit("en")))
    return materialize(K.vocabulary(K.piece_counts(foreign), 1200), "vocab")


@query(f"WITH {_CNT.format('true')} SELECT * FROM c")
def word_token_counts(spark, sf):
    return K.piece_counts(docs(spark, sf))


@query(f"WITH {_VOC} SELECT CAST(token_id AS BIGINT) AS token_id, piece, CAST(n AS BIGINT) AS n FROM v")
def word_vocab(spark, sf):
    return _vocab(spark, sf)


@query(f"WITH {_VOC} SELECT round_even(CAST(sum(n) FILTER (piece IN (SELECT piece FROM v)) AS DOUBLE) / sum(n), 6) AS coverage FROM c")
def vocab_coverage(spark, sf):
    v = _vocab(spark, sf)
    c = K.piece_counts(docs(spark, sf).where(~F.col("lang").eqNullSafe(F.lit("en"))))
    return c.join(v.select("piece", F.lit(1).alias("k")), "piece", "left").agg(F.bround(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))) / F.sum("n"), 6).alias("coverage"))


_ENC = f"p AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS piece FROM (SELECT doc_id, {_P} AS l FROM documents WHERE text IS NOT NULL)), e AS (SELECT doc_id, pos, coalesce(token_id, 3) AS token_id FROM p LEFT JOIN v USING (piece))"


@query(f"WITH {_VOC}, {_ENC} SELECT doc_id, pos, CAST(token_id AS BIGINT) AS token_id FROM e")
def word_encode(spark, sf):
    return K.encode(docs(spark, sf), _vocab(spark, sf))


@query(f"WITH {_VOC}, {_ENC} SELECT doc_id, string_agg(CASE WHEN token_id = 3 THEN '?' ELSE v.piece END, '' ORDER BY pos) AS text FROM e JOIN v USING (token_id) GROUP BY doc_id")
def word_decode(spark, sf):
    v = _vocab(spark, sf)
    return K.decode(K.encode(docs(spark, sf), v), v)


@query(
    f"WITH {_VOC}, {_ENC}, d AS (SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, round_even(CAST(count(*) FILTER (token_id = 3) AS DOUBLE) / count(*), 6) AS oov, round_even(CAST(count(*) AS DOUBLE) / any_value(chars), 6) AS tokens_per_char, round_even(CAST(any_value(bytes) AS DOUBLE) / count(*), 6) AS bytes_per_token FROM e JOIN d USING (doc_id) GROUP BY doc_id"
)
def oov_rate(spark, sf):
    d = docs(spark, sf).select("doc_id", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    n = F.count(F.lit(1))
    e = K.encode(docs(spark, sf), _vocab(spark, sf)).groupBy("doc_id").agg(n.alias("n"), F.count_if(F.col("token_id") == 3).alias("u"))
    j = e.join(d, "doc_id")
    return j.select("doc_id", F.bround(F.col("u") / F.col("n"), 6).alias("oov"), F.bround(F.col("n") / F.col("chars"), 6).alias("tokens_per_char"), F.bround(F.col("bytes") / F.col("n"), 6).alias("bytes_per_token"))


@query(f"WITH {_VOC}, {_CNT.format(chr(39) + 'a' + chr(39) + ' = ' + chr(39) + 'a' + chr(39)).replace('c AS', 'a AS', 1)} SELECT piece, n FROM a WHERE piece NOT IN (SELECT piece FROM v)")
def unknown_words(spark, sf):
    return K.piece_counts(docs(spark, sf)).join(_vocab(spark, sf), "piece", "left_anti")


@query(
    "WITH h AS (SELECT hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) > 1), p AS (SELECT unnest(list_transform(range(len(h) // 2 - 1), lambda i: substring(h, i * 2 + 1, 4))) AS p FROM h) "
    "SELECT CAST('0x' || substring(p, 1, 2) AS INT) AS a, CAST('0x' || substring(p, 3, 2) AS INT) AS b, count(*) AS n FROM p GROUP BY p"
)
def byte_pair_counts(spark, sf):
    return K.byte_pairs(docs(spark, sf))


@query(f"WITH t AS (SELECT len({_P}) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM t) SELECT p, n AS tokens FROM r JOIN (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS p) ON i = CAST(floor(c * p) AS BIGINT)")
def block_percentiles(spark, sf):
    """Nearest-rank percentiles from a histogram of token counts: no global sort of documents."""
    h = docs(spark, sf).where("text is not null").groupBy(F.size(K.pieces(F.col("text"))).cast("long").alias("tokens")).agg(F.count(F.lit(1)).alias("c"))
    w = W.orderBy("tokens")
    h = h.withColumns({"upto": F.sum("c").over(w), "total": F.sum("c").over(W.partitionBy())})
    ps = F.explode(F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)])).alias("p")
    x = h.select("tokens", "c", "upto", "total", ps).withColumn("at", F.floor(F.col("total") * F.col("p")))
    return x.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c"))).select(F.col("p").cast("decimal(3,2)").cast("double").alias("p"), "tokens")


@query(
    f"WITH {_VOC}, {_ENC}, y AS (SELECT *, lead(token_id) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM e) "
    'SELECT doc_id, pos // 128 AS "window", sum(token_id * (pos % 128 + 1)) AS xs, sum(y * (pos % 128 + 1)) AS ys FROM y WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) = 128'
)
def context_windows(spark, sf):
    """Windows checked through position-weighted sums of inputs and targets."""
    w = K.context_windows(K.encode(docs(spark, sf), _vocab(spark, sf)), 128)
    s = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return w.select("doc_id", "window", s("x").alias("xs"), s("y").alias("ys"))


MERGES = 64


def _merges(spark, sf):
    return K.train_bpe(docs(spark, sf), MERGES)


@query()
def bpe_merges(spark, sf):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(_merges(spark, sf))], "rank int, a long, b long, new_id long")


@query()
def bpe_encode(spark, sf):
    return K.encode_bpe(docs(spark, sf), _merges(spark, sf)).select("doc_id", F.size("ids").alias("tokens"))


@query("SELECT doc_id, text FROM documents")
def bpe_round_trip(spark, sf):
    """Every text encoded with the learnt merges and decoded again."""
    m = _merges(spark, sf)
    return K.decoded_bpe(K.encode_bpe(docs(spark, sf), m), m)


@query("SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_total, true AS fewer_tokens, true AS roundtrip_exact, 0 AS unknown_tokens FROM documents")
def bpe_report(spark, sf):
    """Quality of the learnt merges over all texts: bytes, whether tokens are fewer, and whether all texts come back."""
    m = _merges(spark, sf)
    d = docs(spark, sf).where("text is not null")
    e = materialize(K.encode_bpe(d, m), "bpe-encoded")
    back = K.decoded_bpe(e, m).select("doc_id", F.col("text").alias("back"))
    j = d.join(e, "doc_id").join(back, "doc_id")
    return j.agg(
        F.sum(F.octet_length("text").cast("long")).alias("bytes_total"), (F.sum(F.size("ids")) < F.sum(F.octet_length("text"))).alias("fewer_tokens"),
        F.min(F.col("text") == F.col("back")).alias("roundtrip_exact"), F.count_if(F.exists("ids", lambda x: x >= 256 + len(m))).cast("int").alias("unknown_tokens"),
    )


@query(
    f"WITH {_VOC}, {_ENC}, n AS (SELECT doc_id, (count(*) - 1) // 128 AS w FROM e GROUP BY doc_id), x AS (SELECT doc_id, unnest(range(w)) AS win FROM n), ep AS (SELECT unnest([0, 1]) AS epoch) "
    "SELECT epoch, doc_id, win AS \"window\", row_number() OVER (PARTITION BY epoch ORDER BY CAST('0x' || substring(sha256(epoch || ':' || doc_id || ':' || win), 1, 15) AS BIGINT)) - 1 AS pos FROM x, ep"
)
def epoch_windows(spark, sf):
    """Order of all full windows in each epoch: a seeded shuffle by hash, numbered without a global sort."""
    n = K.encode(docs(spark, sf), _vocab(spark, sf)).groupBy("doc_id").agg(F.floor((F.count(F.lit(1)) - 1) / 128).alias("w")).where("w > 0")
    x = n.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("window")).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    x = x.withColumn("o", hash_order(F.concat_ws(":", "epoch", "doc_id", "window")))
    return positions(x, ["epoch"], "o").select("epoch", "doc_id", "window", "pos")


_CHAT = f"l AS (SELECT doc_id, line_no, line FROM {LINES} JOIN documents d USING (doc_id) WHERE d.doc_kind = 'chat' AND (starts_with(line, 'You:') OR starts_with(line, 'Bot:')))"


def _turns(spark, sf):
    t = T.lines_of(docs(spark, sf).where("doc_kind = 'chat'"))
    return t.where(F.col("line").startswith("You:") | F.col("line").startswith("Bot:")).withColumn("line_no", F.col("line_no").cast("long"))


@query(f"WITH {_CHAT}, n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM l) SELECT doc_id, line_no, 'You: ' || substring(line, 6) || chr(10) || 'Bot: ' || substring(nxt, 6) AS block FROM n WHERE nxt IS NOT NULL")
def chat_pairs(spark, sf):
    """Neighbouring turns as question and answer; a dialogue of n turns gives n - 1 pairs."""
    t = _turns(spark, sf).withColumn("nxt", F.lead("line").over(W.partitionBy("doc_id").orderBy("line_no"))).where("nxt is not null")
    cut = lambda c: F.substring(c, 6, 1 << 30)
    return t.select("doc_id", "line_no", F.concat(F.lit("You: "), cut("line"), F.lit("\nBot: "), cut("nxt")).alias("block"))


@query("SELECT round_even(CAST(sum(length(text)) FILTER (doc_kind = 'chat') AS DOUBLE) / sum(length(text)), 6) AS share FROM documents")
def dialogue_share(spark, sf):
    n = F.length("text")
    return docs(spark, sf).agg(F.bround(F.sum(F.when(F.col("doc_kind") == "chat", n)) / F.sum(n), 6).alias("share"))


@query("WITH c AS (SELECT doc_id, text, unnest(range((length(text) - 1) // 200 + 1)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, i, substring(text, i * 200 + 1, 200) AS chunk FROM c")
def fixed_chunks(spark, sf):
    d = docs(spark, sf).where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 200))).alias("i"))
    return d.select("doc_id", "i", F.substring("text", (F.col("i") * 200 + 1).cast("int"), F.lit(200)).alias("chunk"))


@query(f"WITH w AS (SELECT doc_id, list_filter(string_split({SQ('text')}, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(range(least(20, (len(w) + 95) // 96))) AS i FROM w) SELECT doc_id, i, array_to_string(w[i * 96 + 1:i * 96 + 96], ' ') AS window_text FROM s")
def word_windows(spark, sf):
    """Windows of 96 words; at most 20 per document, which is the operator's own bound."""
    d = docs(spark, sf).select("doc_id", F.filter(F.split(T.squeeze(F.col("text")), " "), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(20), F.floor((F.size("w") + 95) / 96))
    d = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return d.select("doc_id", "i", F.array_join(F.slice("w", (F.col("i") * 96 + 1).cast("int"), F.lit(96)), " ").alias("window_text"))


@query(r"SELECT doc_id, unnest(range(len(s))) AS seg_no, unnest(s) AS seg FROM (SELECT doc_id, regexp_extract_all(text, '(?s).*?HARDNESS=[0-9]+(?:\n|$)', 0) AS s FROM documents WHERE doc_kind = 'alert' AND text IS NOT NULL)")
def marker_segments(spark, sf):
    """Documents cut after each marker line."""
    s = F.regexp_extract_all("text", F.lit(r"(?s).*?HARDNESS=[0-9]+(?:\n|$)"), F.lit(0))
    return docs(spark, sf).where("doc_kind = 'alert'").select("doc_id", F.posexplode(s).alias("seg_no", "seg")).withColumn("seg_no", F.col("seg_no").cast("long"))


# Words that tell nothing apart.
STOP = ["a", "an", "the", "of", "is", "are", "isn't", "was", "to", "in", "on", "at", "what", "what's", "which", "its", "it's", "than", "as", "and", "or", "for", "with", "into", "that", "this", "by", "over", "after", "only"]


@query("SELECT record_no, list_sort(list_filter(list_distinct(string_split(" + SQ("lower(analysis)") + ", ' ')), lambda w: w <> '' AND NOT list_contains([" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP) + "], w))) AS words FROM records")
def distinctive_words(spark, sf):
    w = F.array_distinct(F.split(T.squeeze(F.lower("analysis")), " "))
    keep = F.filter(w, lambda x: (x != "") & ~x.isin(STOP))
    return spark.read.parquet(f"{sf}/records.parquet").select("record_no", F.array_sort(keep).alias("words"))


@query(
    f"WITH {_CHAT}, b AS (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i FROM l), p AS (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i FROM {LINES} JOIN documents d USING (doc_id) WHERE d.doc_kind = 'prose' AND line <> ''), n AS (SELECT count(*) AS n FROM b) "
    "SELECT i * 2 AS ord, line FROM p UNION ALL SELECT p.i * 2 + 1, b.line FROM p, n JOIN b ON b.i = p.i % n.n"
)
def interleave(spark, sf):
    """Prose lines and chat lines in turn, chat lines reused in a cycle.

    Global positions come from per-document totals (one row per document) and a rank within the document.
    """

    def numbered(d):
        tot = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
        tot = tot.withColumn("r", F.floor(F.col("doc_id") / 1024))
        by = tot.groupBy("r").agg(F.sum("c").alias("rc")).withColumn("rb", F.coalesce(F.sum("rc").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        tot = tot.join(by, "r").withColumn("before", F.col("rb") + F.coalesce(F.sum("c").over(W.partitionBy("r").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        at = F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")) - 1
        return d.withColumn("k", at).join(tot.select("doc_id", "before"), "doc_id").select((F.col("k") + F.col("before")).alias("i"), "line")

    b = numbered(_turns(spark, sf))
    p = numbered(T.lines_of(docs(spark, sf).where("doc_kind = 'prose'")).where("line <> ''"))
    n = b.agg(F.count(F.lit(1)).alias("n"))
    reuse = p.crossJoin(F.broadcast(n)).where("n > 0").select(F.col("i").alias("pi"), (F.col("i") % F.col("n")).alias("i"))
    return p.select((F.col("i") * 2).alias("ord"), "line").unionByName(reuse.join(b, "i").select((F.col("pi") * 2 + 1).alias("ord"), "line"))
