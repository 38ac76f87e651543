"""Column functions for canonical forms of names, words and field-value texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_RE = r"[\p{L}\p{N}]+"
#: A field name in any of the layouts `k=v`, `k: v`, `"k": "v"`, `k = 'v'`.
FIELD_RE = r"(?<![\p{L}\p{N}])(\p{L}+)[\"'”’]?[\s\p{Z}]*[=:]"


def letters_only(c: Column) -> Column:
    """A name without case, blanks and marks; null stays null."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}]+", ""))


def words(*cols: Column) -> Column:
    """All words (longest runs of letters and digits, lower case) of the columns in order; nulls count as empty."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *cols)), F.lit(WORD_RE), F.lit(0))


def word_set(*cols: Column) -> Column:
    """Distinct words as sorted 32-bit hashes: compact, and all that set similarity needs."""
    return F.sort_array(F.array_distinct(F.transform(words(*cols), lambda w: F.hash(w))))


def field_pairs(c: Column) -> Column:
    """`field\\u0002value` strings of a log-event text in order of appearance.

    Blanks, case and every mark around or inside values are dropped, so all layouts of the
    same event give the same pairs. Text before the first field is kept as a pair of its own;
    null gives null.
    """
    marked = F.regexp_replace(F.lower(c), FIELD_RE, "\u0001$1\u0002")
    bare = F.regexp_replace(marked, r"[^\p{L}\p{N}\x01\x02]+", "")
    return F.filter(F.split(bare, "\u0001"), lambda p: p != "")
