"""Subject areas of documents (problem 10)."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.near_duplicates import mix64
from weftline.session import spread

#: Buckets of hashed word n-grams; labelled documents used for fitting at most; sentences that make a subject.
BITS, FIT_DOCUMENTS, LEAST_SENTENCES = 16, 3_000, 3
BUCKETS = 1 << BITS
#: Words whose hash a worker remembers.
CACHE = 500_000

_WORD = re.compile(r"[^\W\d_]+")
_ID = re.compile(r"\b[\w.:/\\-]*\d[\w.:/\\-]*\b")
_PROSE = re.compile(r"(?<=[.!?。])[\s　]+|[\n\r  ]+")
_LINE = re.compile(r"[\n\r  ]+")
_MARK = re.compile(r"^\s*(?:(?:You|Bot)\s*:|[-–—*•]|ROW#\d+)\s*")
_PAIR = re.compile(r"\b(app|event)=([\w-]+)")


def sentences(text: str, kind: str | None) -> list[str]:
    """Sentences of a prose text or note; lines of chat, memory and alert texts (known by kind or by their marks)."""
    lines = kind in ("chat", "memory", "alert") or (kind is None and bool(re.match(r"\s*(You:|Bot:|- |ROW#)", text)))
    parts = (_LINE if lines else _PROSE).split(text)
    return [p for p in (_MARK.sub("", x).strip() for x in parts) if p]


def tokens(sentence: str) -> tuple[list[str], bool]:
    """Words between a start and an end mark, identifiers left out; of a log line its sources and events, which make no n-grams."""
    if "app=" in sentence:
        return [f"{k}={v}" for k, v in _PAIR.findall(sentence)], False
    return ["^", *_WORD.findall(_ID.sub(" ", sentence.lower())), "$"], True


_CODES: dict[str, int] = {}


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): distinct hashed word unigrams, bigrams and trigrams of each sentence of a batch, all at once."""
    if len(_CODES) > CACHE:
        _CODES.clear()
    codes, sizes, prose = [], [], []
    for x in batch:
        toks, grams = tokens(x)
        for t in toks:
            c = _CODES.get(t)
            if c is None:
                c = _CODES[t] = zlib.crc32(t.encode("utf-8", "replace"))
            codes.append(c)
        sizes.append(len(toks))
        prose.append(grams)
    n = np.asarray(sizes, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    h = mix64(np.asarray(codes, np.uint64))
    inner = np.ones(len(h), bool)
    gram = np.repeat(np.asarray(prose, bool), n)
    ends = np.cumsum(n)
    marks = np.asarray(prose, bool) & (n > 0)
    inner[ends[marks] - 1] = inner[(ends - n)[marks]] = False
    keys = [(row[inner], h[inner])]
    with np.errstate(over="ignore"):
        for k in (1, 2):
            same = (row[k:] == row[:-k]) & gram[k:] if len(h) > k else np.zeros(0, bool)
            g = h[:-k] * np.uint64(3) + h[k:] * np.uint64(5) + (h[1:-1] * np.uint64(7) if k == 2 else np.uint64(1)) if len(h) > k else h[:0]
            keys.append((row[: len(same)][same], mix64(g[same])))
    at = np.concatenate([(r.astype(np.int64) << BITS) | (g % np.uint64(BUCKETS)).astype(np.int64) for r, g in keys])
    at.sort()
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return at & (BUCKETS - 1), np.searchsorted(at >> BITS, np.arange(len(n) + 1))


class SubjectModel:
    """One-versus-rest linear classifiers over sentence features with a threshold per subject."""

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        self.weights = np.zeros((BUCKETS, len(subjects)), np.float32)
        self.bias = np.full(len(subjects), -1.0, np.float32)
        self.cut = np.zeros(len(subjects), np.float32)

    def scores(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean feature weight plus bias per sentence and subject, scaled by the root of the length."""
        out = np.tile(self.bias, (len(off) - 1, 1))
        full = np.flatnonzero(np.diff(off))
        if len(full):
            norm = np.sqrt(np.diff(off)[full])[:, None]
            out[full] += np.add.reduceat(self.weights[flat], off[:-1][full], 0) / norm
        return out

    def subjects_of(self, texts: list[str | None], kinds: list[str | None], least: int = LEAST_SENTENCES) -> list[list[str]]:
        """Subjects with at least `least` sentences about them; a sentence is about its best subject if above the cut."""
        parts, owner = [], []
        for i, (t, k) in enumerate(zip(texts, kinds)):
            got = sentences(t, k) if t else []
            parts += got
            owner += [i] * len(got)
        out: list[list[str]] = [[] for _ in texts]
        if not parts:
            return out
        z = self.scores(*features(parts)) - self.cut
        best = z.argmax(1)
        hit = z[np.arange(len(z)), best] > 0
        counts = np.zeros((len(texts), len(self.subjects)), int)
        np.add.at(counts, (np.asarray(owner)[hit], best[hit]), 1)
        for i, j in zip(*np.nonzero(counts >= least)):
            out[i].append(self.subjects[j])
        return out


def fit_subjects(docs: list[tuple[str, str | None, set[str]]], subjects: list[str], rounds: int = 3, epochs: int = 6) -> SubjectModel:
    """Fit from documents with their complete subject sets (weak labels: which sentence is meant is unknown).

    Start: a sentence's subject is the one of its document under which its n-grams are most
    over-represented among labelled documents, or none. Then classifiers are trained on these
    sentence labels and labels are re-estimated from them, under the documents' constraints:
    only the document's own subjects, each with at least three sentences.
    """
    index = {s: k for k, s in enumerate(subjects)}
    parts, owner = [], []
    for i, (t, k, _) in enumerate(docs):
        got = sentences(t, k)
        parts += got
        owner += [i] * len(got)
    model = SubjectModel(subjects)
    if not parts:
        return model
    flat, off = features(parts)
    owner_a = np.asarray(owner)
    own = np.zeros((len(docs), len(subjects)), bool)
    for i, (_, _, y) in enumerate(docs):
        own[i, [index[s] for s in y if s in index]] = True
    row = np.repeat(np.arange(len(parts)), np.diff(off))
    # Over-representation of each n-gram under each subject, per document.
    n_docs, base = np.zeros(BUCKETS), np.zeros((BUCKETS, len(subjects)))
    seen = np.unique(np.stack([flat, owner_a[row]], 1), axis=0)
    np.add.at(n_docs, seen[:, 0], 1)
    np.add.at(base, seen[:, 0], own[seen[:, 1]].astype(float))
    prior = own.mean(0) + 1e-3
    lift = np.log((base + 2 * prior) / ((n_docs + 2)[:, None] * prior))
    lift *= np.minimum(1.0, n_docs / 4)[:, None]
    z = np.zeros((len(parts), len(subjects)))
    np.add.at(z, row, lift[flat])
    z /= np.maximum(1, np.diff(off))[:, None]
    z -= 0.35
    for r in range(rounds):
        allowed = np.where(own[owner_a], z, -np.inf)
        best = allowed.argmax(1)
        top = allowed[np.arange(len(z)), best]
        label = np.where(top > 0, best, -1)
        # each subject of a document needs its three best sentences
        for i, j in zip(*np.nonzero(own)):
            lo, hi = np.searchsorted(owner_a, [i, i + 1])
            if (label[lo:hi] == j).sum() < LEAST_SENTENCES:
                best_of = lo + np.argsort(-z[lo:hi, j], kind="stable")[:LEAST_SENTENCES]
                label[best_of] = j
        model = SubjectModel(subjects)
        norm = 1 / np.sqrt(np.maximum(1, np.diff(off)))
        y = np.zeros((len(parts), len(subjects)), np.float32)
        y[np.flatnonzero(label >= 0), label[label >= 0]] = 1
        g2 = np.full((BUCKETS, len(subjects)), 1e-6, np.float32)
        b2 = np.full(len(subjects), 1e-6, np.float32)
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            order = rng.permutation(len(parts))
            for lo in range(0, len(order), 256):
                ids = order[lo : lo + 256]
                fl = np.concatenate([flat[off[i] : off[i + 1]] for i in ids]) if len(ids) else flat[:0]
                rw = np.repeat(np.arange(len(ids)), np.diff(off)[ids])
                sizes = np.diff(off)[ids]
                s = np.tile(model.bias, (len(ids), 1))
                full = np.flatnonzero(sizes)
                if len(full):
                    at = np.concatenate([[0], np.cumsum(sizes)])[:-1][full]
                    s[full] += np.add.reduceat(model.weights[fl], at, 0) * norm[ids][full][:, None]
                e = (1 / (1 + np.exp(-s)) - y[ids]).astype(np.float32)
                u, inv = np.unique(fl, return_inverse=True)
                pull = e * norm[ids][:, None]
                g = np.stack([np.bincount(inv, pull[rw, k], len(u)) for k in range(len(subjects))], 1).astype(np.float32)
                g += 1e-4 * model.weights[u]
                g2[u] += g * g
                model.weights[u] -= 0.5 * g / np.sqrt(g2[u])
                gb = e.sum(0)
                b2 += gb * gb
                model.bias -= 0.5 * gb / np.sqrt(b2)
        z = model.scores(flat, off)
    # Calibrate each subject's cut on the labelled documents: best F1 of "three sentences above it".
    counts_at = []
    cuts = np.linspace(-2.5, 2.5, 21)
    best = z.argmax(1)
    top = z[np.arange(len(z)), best]
    for c in cuts:
        n = np.zeros(own.shape, int)
        hit = top > c
        np.add.at(n, (owner_a[hit], best[hit]), 1)
        counts_at.append(n >= LEAST_SENTENCES)
    for j in range(len(subjects)):
        f1 = [2 * (p[:, j] & own[:, j]).sum() / max(1, p[:, j].sum() + own[:, j].sum()) for p in counts_at]
        good = np.flatnonzero(np.asarray(f1) >= max(f1) - 1e-9)
        model.cut[j] = cuts[good[np.argmin(np.abs(cuts[good]))]]
    return model


def fit_from_tables(docs: DataFrame, labels: DataFrame, subjects: DataFrame, limit: int = FIT_DOCUMENTS) -> SubjectModel:
    """Fit on at most `limit` labelled documents, chosen by a hash of their id; repeated or null labels do no harm."""
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    sets = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("ys"))
    picked = sets.orderBy(F.xxhash64("doc_id")).limit(limit)
    rows = docs.select("doc_id", "text", "doc_kind").join(picked, "doc_id").where("text is not null").orderBy(F.xxhash64("doc_id"))
    return fit_subjects([(r["text"], r["doc_kind"], set(r["ys"])) for r in rows.toLocalIterator()], names)


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject): a row for each subject that at least three sentences of a document are about.

    Null, empty and blank texts have no subject. Texts of any length are read whole. Scoring is
    map-only; the classifiers (fixed size BUCKETS x subjects) are broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit_from_tables(docs, labels, subjects))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                p = b.iloc[lo : lo + 500]
                kinds = [k if isinstance(k, str) else None for k in p.doc_kind]
                found = shared.value.subjects_of([t if isinstance(t, str) else None for t in p.text], kinds)
                pairs = [(d, s) for d, ss in zip(p.doc_id, found) for s in ss]
                yield pd.DataFrame(pairs, columns=["doc_id", "subject"])

    return spread(docs.select("doc_id", "text", "doc_kind"), "doc_id").mapInPandas(run, "doc_id long, subject string")
