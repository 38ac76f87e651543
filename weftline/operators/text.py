"""Text hygiene: Column functions on one text each, no shuffle. Null in, null out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, written out so that every engine reads it alike.
WS = r"[ \t\n\x0B\f\r]"
_WS_CHARS = " \t\n\x0b\f\r"


def scrub_controls(c: Column) -> Column:
    """Without C0 controls other than tab and newline, and without DEL."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f]", "")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(_WS_CHARS))


def squeeze(c: Column, sep: str = " ") -> Column:
    """Trimmed, every white-space run as one separator."""
    return F.regexp_replace(strip(c), f"{WS}+", sep)


def strip_lines(c: Column) -> Column:
    """The text's lines, trimmed, blank ones dropped."""
    trimmed = F.transform(F.split(c, "\r\n|\n|\r"), lambda x: strip(x))
    return F.filter(trimmed, lambda x: x != "")


def pipe_lines(c: Column) -> Column:
    """Stripped lines joined by ' | '; blanks inside lines stay."""
    return F.array_join(strip_lines(c), " | ")


# What frames the text of a public book file.
BANNER = r"(?s)\*\*\* (START|END) OF (THIS|THE) PROJECT GUTENBERG EBOOK .*?\*\*\*\s*"
RULE = r"^(-{5,}|_{5,}|={5,}|#{5,}|\.{5,})$"
MARK, FRAMES = "[Illustration", ["Project Gutenberg", "www.gutenberg.org"]


def clean_boilerplate(c: Column) -> Column:
    """Without start and end banners, rules, illustration marks and repeated blanks; ends in one newline."""
    keep = F.filter(strip_lines(F.regexp_replace(c, BANNER, "")), lambda x: ~x.rlike(RULE) & ~x.startswith(MARK) & ~x.isin(FRAMES))
    t = F.regexp_replace(F.array_join(keep, "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.concat(F.regexp_replace(t, r"[ \t]{2,}", " "), F.lit("\n"))


def strip_fence(c: Column) -> Column:
    """A reply without the Markdown fence around it."""
    t = strip(c)
    return F.when(t.startswith("```"), F.regexp_replace(t, f"^```[a-zA-Z]*{WS}*|{WS}*```$", "")).otherwise(t)


def content_key(c: Column, prefix: str = "distill:") -> Column:
    """Key of the text without case and white-space differences."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(squeeze(F.lower(c)), 256), 1, 16))


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def stable_seed(c: Column) -> Column:
    """First 32 bits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")


def occurrences(text: Column, piece: Column) -> Column:
    """Non-overlapping occurrences of a non-empty piece."""
    return (F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)


def loops_in_head(c: Column, anchor: int = 60, repeats: int = 3, window: int = 480) -> Column:
    """Whether an anchor at the start, middle or end of the first `window` characters occurs `repeats` times there."""
    head = F.substring(c, 1, window)
    n = F.length(head)
    hit = [
        F.when(F.length(F.trim(p)) > 0, occurrences(head, p) >= repeats).otherwise(False)
        for off in (F.lit(0), F.floor(n / 2), n - 2 * anchor)
        for p in [F.substring(head, (off + 1).cast("int"), F.lit(anchor))]
    ]
    return F.when(c.isNull(), F.lit(False)).when(n < 4 * anchor, F.lit(False)).otherwise(reduce(lambda a, b: a | b, hit))


def loops_anywhere(c: Column, anchor: int = 60, repeats: int = 3) -> Column:
    """The looser gate: anchors near the start, more than `repeats` occurrences in the whole text."""
    hit = []
    for off in (anchor // 3, anchor // 2, 2 * anchor // 3):
        p = F.substring(c, off + 1, anchor)
        hit.append(F.when(F.length(p) == anchor, occurrences(c, p) > repeats).otherwise(False))
    return F.when(c.isNull(), F.lit(False)).when(F.length(c) < 2 * anchor, F.lit(False)).otherwise(reduce(lambda a, b: a | b, hit))


def lines_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 0, line); a null text has no lines."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Order-preserving deduplication: the first row of each key. Null is a key like any other.

    A group-by on the key with the smallest row as aggregate: partial results combine before
    the shuffle, so a key with many copies is not one task's sort.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_first"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def paragraph_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sep: str = "\n\n") -> DataFrame:
    """(id, text): per document, paragraphs squeezed, repeats (case aside) and blanks dropped, order kept."""
    p = df.select(id_col, F.posexplode(F.split(text_col, sep)).alias("pos", "p")).withColumn("p", squeeze(F.col("p"))).where("p <> ''")
    kept = first_of_each(p.withColumn("canon", F.lower("p")), [id_col, "canon"], ["pos"])
    joined = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("ps"))
    return joined.select(id_col, F.concat(F.array_join(F.transform("ps", lambda x: x["p"]), sep), F.lit("\n")).alias(text_col))


def shingles(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, gram): distinct word n-grams of each text; short and null texts give none."""
    w = df.select(id_col, F.filter(F.split(F.lower(squeeze(F.col(text_col))), " "), lambda x: x != "").alias("w")).where(F.size("w") >= n)
    gram = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))
    return w.select(id_col, F.explode(F.array_distinct(gram)).alias("gram"))


def repetition_fraction(df: DataFrame, id_col: str, text_col: str, n: int = 4) -> DataFrame:
    """(id, fraction): share of a text's word n-grams that repeat an earlier one; 0 without n-grams."""
    w = df.select(id_col, F.filter(F.split(squeeze(F.col(text_col)), " "), lambda x: x != "").alias("w"))
    gram = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " ")))
    g = w.select(id_col, gram.alias("g"))
    return g.select(id_col, F.when(F.col("g").isNotNull(), 1 - F.size(F.array_distinct("g")) / F.size("g")).otherwise(0.0).alias("fraction"))


def leak_report(train: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct n-grams of both sides, how many held-out ones the training side has, and their share."""
    a, b = train.select("gram").distinct(), held.select("gram").distinct()
    both = b.join(a, "gram", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))
    counts = b.agg(F.count(F.lit(1)).alias("heldout_grams")).crossJoin(a.agg(F.count(F.lit(1)).alias("train_grams"))).crossJoin(both)
    share = F.coalesce(F.try_divide("overlap", "heldout_grams"), F.lit(0.0))
    return counts.withColumns({"fraction": F.bround(share, 6), "leak_free": F.col("overlap") == 0})


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without any n-gram of the benchmark; null and short texts are kept.

    The benchmark's grams are pre-aggregated; the join is left to the optimizer, which
    broadcasts them only while they are small.
    """
    grams = shingles(benchmark, id_col, text_col, n).select("gram").distinct()
    dirty = shingles(docs, id_col, text_col, n).join(grams, "gram", "left_semi").select(id_col).distinct()
    return docs.join(dirty, id_col, "left_anti")


def matches(spark, c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a text holds the regular expression; a pattern that is none is looked for as it stands."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001
        return F.lower(c).contains(pattern.lower()) if ignore_case else c.contains(pattern)
    return c.rlike(f"(?i){pattern}" if ignore_case else pattern)
