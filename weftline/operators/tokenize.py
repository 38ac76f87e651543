"""Word-level and byte-pair tokenisation, vocabularies, context windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word of ASCII letters, digits and apostrophes, a blank, a newline, or any other single character.
PIECE_RE = r"([A-Za-z0-9']+| |\n|[^\n])"
SPECIALS = ["<pad>", "<bos>", "<eos>", "<unk>"]
UNK = 3


def pieces(c: Column) -> Column:
    """All pieces of a text in order; concatenated they are the text."""
    return F.regexp_extract_all(c, F.lit(PIECE_RE), F.lit(0))


def is_word(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}']+$") & c.rlike(r"[\p{L}\p{N}]")


def piece_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(piece, n) over all texts, combined before the shuffle."""
    return df.select(F.explode(pieces(F.col(text_col))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, size: int, least: int = 2) -> DataFrame:
    """(token_id, piece, n): specials, then every single character by bytes, then the most frequent words.

    Words by falling count, ties by bytes, with at least `least` occurrences, as many as fit into
    `size`. Candidate words are cut to `size` by a top-k before they are numbered, so the one
    ordered task holds no more than the vocabulary.
    """
    spark = counts.sparkSession
    special = spark.createDataFrame([(i, s) for i, s in enumerate(SPECIALS)], "token_id long, piece string")
    byte = lambda: F.encode("piece", "UTF-8")
    chars = counts.where(F.length("piece") == 1)
    chars = chars.withColumn("token_id", F.row_number().over(W.orderBy(byte())).cast("long") + len(SPECIALS) - 1)
    n_chars = chars.agg(F.count(F.lit(1)).alias("c"))
    words = counts.where((F.length("piece") > 1) & is_word(F.col("piece")) & (F.col("n") >= least))
    top = words.orderBy(F.desc("n"), byte()).limit(size)
    top = top.withColumn("rk", F.row_number().over(W.orderBy(F.desc("n"), byte())))
    base = top.crossJoin(n_chars).withColumn("token_id", F.col("rk").cast("long") + F.col("c") + len(SPECIALS) - 1).where(F.col("token_id") < size)
    return special.withColumn("n", F.lit(0).cast("long")).unionByName(chars.select("token_id", "piece", "n")).unionByName(base.select("token_id", "piece", "n"))


#: Vocabularies of up to this many pieces are broadcast, so that texts are not shuffled to look up a blank.
BROADCAST_PIECES = 1_000_000


def _lookup(vocab: DataFrame) -> DataFrame:
    return F.broadcast(vocab) if vocab.count() <= BROADCAST_PIECES else vocab


def encode(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token_id): pieces looked up in the vocabulary, unknown ones as UNK."""
    p = df.select(id_col, F.posexplode(pieces(F.col(text_col))).alias("pos", "piece"))
    return p.join(_lookup(vocab.select("piece", "token_id")), "piece", "left").select(id_col, "pos", F.coalesce("token_id", F.lit(UNK).cast("long")).alias("token_id"))


def decode(tokens: DataFrame, vocab: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): pieces in order, ids without a piece and UNK as '?'."""
    known = vocab.where(F.col("token_id") != UNK).select("token_id", "piece")
    p = tokens.join(_lookup(known), "token_id", "left").withColumn("piece", F.coalesce("piece", F.lit("?")))
    return p.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text"))


def context_windows(tokens: DataFrame, length: int, id_col: str = "doc_id") -> DataFrame:
    """(id, window, x, y): full non-overlapping windows per text and their targets shifted by one; the rest is dropped."""
    t = tokens.withColumn("y", F.lead("token_id").over(W.partitionBy(id_col).orderBy("pos")))
    t = t.withColumn("window", F.floor(F.col("pos") / length)).where("y is not null")
    g = t.groupBy(id_col, "window").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id", "y"))).alias("s")).where(F.size("s") == length)
    return g.select(id_col, "window", F.transform("s", lambda v: v["token_id"]).alias("x"), F.transform("s", lambda v: v["y"]).alias("y"))


def byte_pairs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, n): adjacent byte pairs over all texts."""
    b = df.where(F.octet_length(text_col) > 1).select(F.hex(F.encode(text_col, "UTF-8")).alias("h"))
    pair = F.transform(F.sequence(F.lit(0), (F.length("h") / 2).cast("int") - 2), lambda i: F.substring("h", i * 2 + 1, F.lit(4)))
    c = b.select(F.explode(pair).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    num = lambda s: F.conv(F.substring("p", s, 2), 16, 10).cast("int")
    return c.select(num(1).alias("a"), num(3).alias("b"), "n")


def merge_pair(ids: np.ndarray, a: int, b: int, new: int) -> np.ndarray:
    """Merge (a, b) where its previous occurrence does not start one place before (runs of one token merge once)."""
    at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
    if at.size > 1:
        at = at[np.append(True, np.diff(at) != 1)]
    if not at.size:
        return ids
    out = ids.copy()
    out[at] = new
    return np.delete(out, at + 1)


def _streams(b: pd.DataFrame, col: str) -> np.ndarray:
    """All byte or token sequences of a batch in one array, with -1 before each."""
    parts = [np.full(1, -1, np.int64)]
    for v in b[col]:
        parts += [np.asarray(v, np.int64), np.full(1, -1, np.int64)]
    return np.concatenate(parts)


def _merged(ids: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    for m in merges:
        ids = merge_pair(ids, *m)
    return ids


#: Candidate pairs that come to the driver in a round, and merges after which the sequences are written anew.
BPE_TOP, BPE_REWRITE = 64, 32


def train_bpe(df: DataFrame, merges: int, least: int = 2, text_col: str = "text") -> list[tuple[int, int, int]]:
    """Merges (a, b, new id) by falling pair count, ties to the smaller pair.

    Every text is one byte sequence, whole, newlines and all; equal texts are one weighted
    sequence. A round counts adjacent pairs of all sequences in one distributed pass. It takes
    the best pair, and those after it that no merge before can change: pairs of other tokens with
    strictly falling counts, since a merge of two tokens makes no pair more frequent than those it
    takes from.
    Merged sequences are kept as a table, rewritten every BPE_REWRITE merges, so a pass applies
    only the latest merges. Only BPE_TOP candidates come to the driver.
    """
    from weftline.storage import drop, materialize

    texts = df.where(F.octet_length(text_col) > 1).groupBy(F.col(text_col).alias("t")).agg(F.count(F.lit(1)).alias("w"))

    def to_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"ids": [np.frombuffer(t.encode("utf-8", "replace"), np.uint8).astype(np.int32) for t in b.t], "w": b.w})

    table = materialize(texts.mapInPandas(to_bytes, "ids array<int>, w long"), "bpe")
    done: list[tuple[int, int, int]] = []
    fresh: list[tuple[int, int, int]] = []

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w, part in b.groupby("w"):
                ids = _merged(_streams(part, "ids"), fresh)
                pair = ids[:-1] * (1 << 31) + ids[1:]
                code, n = np.unique(pair[(ids[:-1] >= 0) & (ids[1:] >= 0)], return_counts=True)
                yield pd.DataFrame({"a": code >> 31, "b": code & ((1 << 31) - 1), "n": n * int(w)})

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"ids": [_merged(np.asarray(v, np.int64), fresh).astype(np.int32) for v in b.ids], "w": b.w})

    while len(done) < merges:
        counts = table.mapInPandas(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        top = counts.orderBy(F.desc("n"), "a", "b").limit(BPE_TOP).collect()
        used: set[int] = set()
        for i, r in enumerate(top):
            tied = i and top[i - 1]["n"] == r["n"]
            if len(done) == merges or (i and (tied or i + 1 == len(top) or top[i + 1]["n"] == r["n"] or {r["a"], r["b"]} & used)):
                break
            used |= {r["a"], r["b"]}
            done.append((r["a"], r["b"], 256 + len(done)))
            fresh.append(done[-1])
            if r["a"] == r["b"]:  # what is left of a run may still be the most frequent pair
                break
        if not top:
            break
        if len(fresh) >= BPE_REWRITE:
            old, table = table, materialize(table.mapInPandas(rewrite, "ids array<int>, w long"), "bpe")
            drop(old)
            fresh.clear()
    return done


def encode_bpe(df: DataFrame, merges: list[tuple[int, int, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): bytes with the merges applied in training order, a whole batch at a time; null gives null."""

    @F.pandas_udf("array<long>")
    def enc(s: pd.Series) -> pd.Series:
        some = s.notna().to_numpy()
        raw = pd.DataFrame({"v": [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in s[some]]})
        ids = _merged(_streams(raw, "v"), merges)
        at = np.flatnonzero(ids == -1)
        out = np.full(len(s), None, object)
        out[np.flatnonzero(some)] = [ids[i + 1 : j] for i, j in zip(at[:-1], at[1:])] + ([] if some.any() else [])
        return pd.Series(out)

    return df.select(id_col, enc(F.col(text_col)).alias("ids"))


def decoded_bpe(encoded: DataFrame, merges: list[tuple[int, int, int]], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): token lists back to text; null gives null."""

    @F.pandas_udf("string")
    def dec(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else decode_bpe(v, merges))

    return encoded.select(id_col, dec(F.col(ids_col)).alias("text"))


def decode_bpe(ids: list[int], merges: list[tuple[int, int, int]]) -> str:
    piece = {i: bytes([i]) for i in range(256)}
    for a, b, new in merges:
        piece[new] = piece[a] + piece[b]
    return b"".join(piece[i] for i in ids).decode("utf-8", "replace")
