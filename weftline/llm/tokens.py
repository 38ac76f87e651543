"""Encoding with a public byte-level BPE vocabulary (problem 8), without regular expressions.

Texts of a batch are one code-point array. Each code point has a class (letter, number, blank,
other); runs of one class are found by comparing neighbours, and the few rules that look across
a run's edge (a single space joins the run after it, a lone apostrophe may open a contraction)
are fixed transitions applied to all run boundaries at once. Slices between boundaries are then
merged by rank, each distinct slice once per worker.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; every function takes another path as parameter.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
#: Distinct slices kept per worker; when full, the cache starts anew.
CACHE = 200_000

# The white space of Unicode.
_BLANKS = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
# Contractions after an apostrophe.
_SHORT = {"s", "t", "m", "d"}
_LONG = {"re", "ve", "ll"}


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8)
    table[_BLANKS] = BLANK
    return table


def boundaries(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Start offsets of all pretokens of the concatenated code points; no pretoken spans two texts."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[text_starts[text_starts < n]] = True
    run = np.ones(n, bool)
    run[1:] = cls[1:] != cls[:-1]
    run |= first[:n]
    starts = run.copy()
    at = np.flatnonzero(run)
    ends = np.append(at[1:], n)
    # A run of blanks before other characters of the same text gives up its last blank: a plain
    # space joins the run after it, any other blank is a pretoken of its own.
    inner = (cls[at] == BLANK) & (ends < n) & ~first[np.minimum(ends, n)]
    last = ends[inner] - 1
    starts[last] = True
    glue = cp[last] == 32
    starts[ends[inner][glue]] = False
    # A lone apostrophe that starts a pretoken, followed by letters.
    lone = at[(cls[at] == OTHER) & (cp[at] == 39) & (ends - at == 1)]
    lone = lone[starts[lone] & (lone + 1 < n)]
    lone = lone[~first[lone + 1] & (cls[np.minimum(lone + 1, n - 1)] == LETTER)]
    for i in lone.tolist():
        one = chr(cp[i + 1])
        two = one + chr(cp[i + 2]) if i + 2 < n and not first[i + 2] else ""
        size = 2 if one in _SHORT else 3 if two in _LONG else 0
        if size:
            starts[i + 1] = False
            if i + size < n and cls[i + size] == LETTER and not first[i + size]:
                starts[i + size] = True
    return np.flatnonzero(starts)


def read_vocabulary(name: str, folder: str) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


class Vocabulary:
    """Ranks of byte strings, and rank-ordered merging with a cache of slices."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES, data: bytes | None = None):
        lines = (read_vocabulary(name, folder) if data is None else data).splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left; a heap keeps it near linear."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        parts: list = [piece[i : i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for a in (prv[i], i):
                b = nxt[a] if a >= 0 else n
                if b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [ranks[p] for p in parts if p is not None]

    def encode_batch(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order, the id offsets of each text, where each slice starts in the joined texts, and its ids."""
        texts = [t or "" for t in texts]
        whole = "".join(texts)
        char_off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = boundaries(cp, char_off[:-1])
        cut = at.tolist() + [len(whole)]
        ids: list[int] = []
        counts = np.zeros(len(at), np.int64)
        cache, merge = self.cache, self.merge
        for k in range(len(at)):
            s = whole[cut[k] : cut[k + 1]]
            got = cache.get(s)
            if got is None:
                got = merge(s.encode("utf-8", "replace"))
                if len(cache) >= CACHE:
                    cache.clear()
                if len(s) <= 64:
                    cache[s] = got
            ids += got
            counts[k] = len(got)
        id_at = np.concatenate([[0], np.cumsum(counts)])
        return ids, id_at[np.searchsorted(at, char_off)], at, counts


_HELD: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(name: str, folder: str, data: bytes | None = None) -> Vocabulary:
    """One vocabulary per process; data: its file's content, where the folder is not at hand."""
    if (name, folder) not in _HELD:
        _HELD[name, folder] = Vocabulary(name, folder, data)
    return _HELD[name, folder]


def encode(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES, offsets: bool = False) -> DataFrame:
    """(id_col, ids): token ids of every text without special tokens; null and empty texts have an empty list.

    Strings that look like special tokens are ordinary text. Texts of any length are encoded
    whole. Repeated rows are encoded each; extra columns are ignored; an empty table gives no
    rows. With `offsets` a list `starts` goes along: for each id the character where its slice
    of the text begins, so that a run of ids can be traced back. Map-only: no shuffle. The vocabulary's file is
    read on the driver and broadcast (a megabyte or so), so executors need no such folder.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name, folder, shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = part.column(1).to_pylist()
                ids, off, at, counts = vocab.encode_batch(texts)
                off = pa.array(off, pa.int32())
                cols = [part.column(0), pa.ListArray.from_arrays(off, pa.array(ids, pa.int32()))]
                if offsets:
                    begin = np.cumsum([0, *[len(t or "") for t in texts]])
                    local = at - begin[np.searchsorted(begin, at, "right") - 1]
                    cols.append(pa.ListArray.from_arrays(off, pa.array(np.repeat(local, counts), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "starts"][: len(cols)])

    kind = dict(df.select(id_col).dtypes)[id_col]
    schema = f"`{id_col}` {kind}, ids array<int>" + ", starts array<int>" * offsets
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(ids: list[int], name: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> str:
    """The text of a list of ids."""
    vocab = vocabulary(name, folder)
    if not hasattr(vocab, "pieces"):
        vocab.pieces = {v: k for k, v in vocab.ranks.items()}
    return b"".join(vocab.pieces[i] for i in ids).decode("utf-8", "replace")


def count_tokens(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> DataFrame:
    """(id_col, tokens) by the same encoder."""
    return encode(df, id_col, text_col, name, folder).select(id_col, F.size("ids").cast("long").alias("tokens"))
