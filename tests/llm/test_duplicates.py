import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import near_duplicates as nd
from weftline.llm.components import connected_components
from weftline.llm.format_duplicates import format_duplicates, format_representatives
from weftline.llm.near_duplicates import HI, LO, OWN, RARE, _met, near_duplicate_groups
from weftline.llm.split_overlap import overlap_counts, split_overlaps


def family(rng, n, size=60, edits=6):
    """Texts of `n` families with edited members, and unrelated ones that share common words."""
    common = [f"c{i}" for i in range(30)]
    out = []
    for f in range(n):
        base = [f"w{f}x{i}" for i in range(size - 20)] + rng.sample(common, 20)
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            rng.shuffle(t)
            out.append(" ".join(t))
    return out


def links(texts, num, den):
    sets = [set(t.lower().split()) if t else set() for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("num, den", [(7, 10), (8, 10)])
def test_near_duplicates_against_all_pairs(spark, num, den):
    rng = random.Random(5)
    texts = family(rng, 60) + ["", None, "  ", "one", "one", "ONE!"]
    df = spark.createDataFrame([(i, t, None, i) for i, t in enumerate(texts)], "record_no long, a string, b string, id long")
    want = groups(len(texts), links([(t or "").replace("!", "") for t in texts], num, den))
    got = {r.id: (r.group_id, r.grouped) for r in near_duplicate_groups(df, "record_no", ["a", "b"], num, den).collect()}
    assert len(got) == len(texts)
    assert [got[i][0] for i in range(len(texts))] == want
    size = defaultdict(int)
    for g in want:
        size[g] += 1
    assert all(got[i][1] == (size[want[i]] > 1) for i in range(len(texts)))


def test_near_duplicates_of_nothing_and_of_one_hot_text(spark):
    none = spark.createDataFrame([], "i long, t string")
    assert near_duplicate_groups(none, "i", ["t"]).count() == 0
    hot = spark.createDataFrame([(i, "the same words in every row of a third" if i % 3 else f"other text number {i} alone") for i in range(600)], "i long, t string")
    g = near_duplicate_groups(hot, "i", ["t"], 9, 10)
    assert g.where("group_id = 1").count() == 400 and g.where("not grouped").count() == 200
    long = spark.createDataFrame([(1, "z " + " ".join(map(str, range(30000)))), (2, " ".join(map(str, range(30000))))], "i long, t string")
    assert {r.group_id for r in near_duplicate_groups(long, "i", ["t"]).collect()} == {1}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (50, 51)], "a long, b long")
    got = {r.node: r.root for r in connected_components(e, "a", "b").collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[51] == got[50] == 50 and 60 not in got
    assert connected_components(e.limit(0), "a", "b").count() == 0


FORMS = [
    "time=10:00 host=db-1 app=fw | time=10:05 host=db-2 app=idp",
    '{"host": "DB-1", "time": "10:00", "app": "fw"} | {"time": "10:05", "app": "idp", "host": "db-2"}',
    "[time = '10:00' , host = 'db-1' , app = 'fw'] / [time = '10:05' , host = 'db-2' , app = 'idp']",
    "Time: 10:00; Host:  db/1; App: fw\r\n- Time: 10:05; Host: db/2; App: idp",
]


def test_formats_collapse(spark):
    other = ["time=10:00 host=fw app=db-1 | time=10:05 host=db-2 app=idp", "time=10:00 host=db-1 app=fw", "", None, "--"]
    rows = [(i, t, "x", "y") for i, t in enumerate(FORMS + other)]
    got = {r.id: r.first_id for r in format_duplicates(spark.createDataFrame(rows, "record_no long, input string, key string, part string"), "record_no", "input").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}


def test_hot_copies_span_partitions(spark):
    rows = [(i, FORMS[i % 4] if i % 3 else f"host=h{i} app=a") for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(5)
    r = {x.first_id: x.copies for x in format_representatives(df, "i", "t").collect()}
    assert r[1] == 2000 and len(r) == 1001
    assert format_duplicates(df.limit(0), "i", "t").count() == 0


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(7)
    texts = family(rng, 40) + ["", None, "single", "single"]
    splits = [rng.choice(["train", "train", "val", "eval", None]) for _ in texts[:-2]] + ["train", "eval"]
    df = spark.createDataFrame([(i, t, s, "q", 0) for i, (t, s) in enumerate(zip(texts, splits))], "record_no long, input string, split_name string, text string, side int")
    want = {(a, b) if splits[a] == "train" else (b, a) for a, b in links(texts, 7, 10) if splits[a] and splits[b] and (splits[a] == "train") != (splits[b] == "train")}
    got = {(r.train_id, r.held_id) for r in split_overlaps(df, "record_no", "input", "split_name", num=7, den=10).collect()}
    assert got == want
    per = defaultdict(int)
    for _, b in want:
        per[b] += 1
    assert {r.id: r.links for r in overlap_counts(df, "record_no", "input", "split_name", num=7, den=10).collect()} == per
    assert split_overlaps(df.limit(0), "record_no", "input", "split_name").count() == 0


def hot_pairs(rng, n):
    """Edited values of `n` originals whose words are each in more than 40 other texts: links at 0.70 to 0.85 and just below."""
    vocab = [f"v{i}" for i in range(300)]
    out = []
    for _ in range(n):
        base = rng.sample(vocab, 60)
        out.append(" ".join(base))
        for edits in (5, 8, 10, 11):
            t = list(base)
            for i in rng.sample(range(60), edits):
                t[i] = rng.choice([v for v in vocab if v not in t])
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("hot", [20, None])
def test_near_duplicates_of_hot_words_against_all_pairs(spark, hot):
    texts = hot_pairs(random.Random(11), 70)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.id: r.group_id for r in near_duplicate_groups(df, "i", ["t"], 7, 10, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == groups(len(texts), links(texts, 7, 10))


def test_pairs_of_a_small_vocabulary_are_found(spark):
    """300 pairs at a similarity of 0.714 over 400 words that all are hot; and four fields of twelve words with one edit each."""
    rng = random.Random(17)
    texts = []
    for _ in range(300):
        base = rng.sample(range(400), 48)
        edited = base[:40] + [v for v in rng.sample(range(400), 60) if v not in base][:8]
        texts += [" ".join(f"v{v}" for v in base), " ".join(f"v{v}" for v in edited)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.id: r.group_id for r in near_duplicate_groups(df, "i", ["t"], 7, 10, hot=25).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(300)) == 300
    fields = []
    for i in range(100):
        f = [[f"a{i}f{k}w{j}" for j in range(12)] for k in range(4)]
        g = [[*x[:5], f"e{i}x{k}", *x[6:]] for k, x in enumerate(f)]
        fields += ["; ".join(f"F{k}: " + " ".join(x) for k, x in enumerate(t)) for t in (f, g)]
    rows = [(i, t, "val" if i % 2 else "train") for i, t in enumerate(fields)]
    got = {(r.train_id, r.held_id) for r in split_overlaps(spark.createDataFrame(rows, "i long, t string, s string"), "i", "t", "s", num=7, den=10).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(100)}


@pytest.mark.parametrize("hot", [15, None])
def test_overlaps_of_crowded_spans_against_all_pairs(spark, hot):
    rng = random.Random(13)
    base = [f"k{i}=v{i}" for i in range(30)]
    texts = hot_pairs(rng, 40)
    for i in range(80):
        t = list(base)
        for j in rng.sample(range(30), rng.randint(2, 6)):
            t[j] = f"k{j}=e{i}x{j}"
        texts.append(" ".join(t))
    splits = ["train" if i % 2 else "eval" for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, splits))], "i long, t string, s string")
    want = {(a, b) if splits[a] == "train" else (b, a) for a, b in links([t.replace("=", " ") for t in texts], 7, 10) if splits[a] != splits[b]}
    got = {(r.train_id, r.held_id) for r in split_overlaps(df, "i", "t", "s", num=7, den=10, hot=hot).collect()}
    assert len(want) > 300 and got == want


@pytest.mark.parametrize("sides", [(LO | HI,), (LO, LO, LO, HI), (LO, HI, LO | HI)])
def test_posts_of_common_keys_meet_in_blocks(sides):
    """Runs of 1 to 4,200 posts cut into batches anywhere: the pairs of a comparison of all with all."""
    rng = np.random.default_rng(3)
    k = np.repeat(np.arange(9) - 4, [1, 4200, 2, 16, 17, 40, 1, 700, 3])
    m = len(k)
    rare = np.isin(k, [-3, -1, 1, 4])
    cid, n, slack = rng.permutation(m) // 2, rng.integers(20, 60, m), rng.integers(-40, 120, m)
    flags = np.array(sides)[rng.integers(0, len(sides), m)] | np.where(rare, RARE, np.where(rng.random(m) < 0.5, OWN, 0))
    meta = (n << 34) | ((slack + (1 << 29)) << 4) | flags
    base = rng.integers(0, 2**62, (6, 2))
    b0, b1 = (base[rng.integers(0, 6, m), i] ^ (1 << rng.integers(0, 62, m)) ^ (1 << rng.integers(0, 62, m)) for i in (0, 1))
    b1 = np.where(rare, b1, 0)
    want = set()
    for key in np.unique(k):
        i = np.flatnonzero(k == key)
        x, y = (v.ravel() for v in np.meshgrid(i, i, indexing="ij"))
        apart = (np.bitwise_count(b0[x] ^ b0[y]) + np.bitwise_count(b1[x] ^ b1[y])).astype(int) * 17
        near = np.where(rare[x], apart <= 3 * (n[x] + n[y]) + 34, ((flags[x] | flags[y]) & OWN != 0) & (apart <= slack[x] + slack[y]))
        near &= (cid[x] < cid[y]) & ((np.minimum(n[x], n[y]) + 1) * 10 >= np.maximum(n[x], n[y]) * 7)
        near &= ((flags[x] & LO != 0) & (flags[y] & HI != 0)) | ((flags[y] & LO != 0) & (flags[x] & HI != 0))
        want |= set(zip(cid[x[near]].tolist(), cid[y[near]].tolist()))
    posts = pa.RecordBatch.from_arrays([pa.array(c) for c in (k, cid, meta, b0, b1)], names=["k", "cid", "meta", "b0", "b1"])
    got = [b for b in _met(7, 10)(posts.slice(i, 1237) for i in range(0, m, 1237))]
    assert {p for b in got for p in zip(*(c.to_pylist() for c in b.columns))} == want and len(want) > 1000


@pytest.mark.parametrize("shares, posts", [((1 / 4, 1 / 8), 200), ((1 / 4, 1 / 8), 40), ((1 / 4,), 0)])
def test_pairs_that_share_no_rare_word_meet_by_warm_ones(spark, monkeypatch, shares, posts):
    """Rare words all replaced in each edited text, words in a few and in most texts kept but some: as all pairs say, whether words are warm or not."""
    rng = random.Random(23)
    names, verbs = [f"n{i}" for i in range(60)], [f"c{i}" for i in range(40)]
    texts = []
    for i in range(90):
        base = [f"r{i}x{j}" for j in range(5)] + rng.sample(names, 7) + rng.sample(verbs, 30)
        for edits in (0, 1, 2, 3):
            t = [f"r{i}x{edits}y{j}" if w[0] == "r" else w for j, w in enumerate(base)]
            for j in rng.sample(range(5, 42), edits):
                t[j] = rng.choice([v for v in (names if j < 12 else verbs) if v not in t])
            texts.append(" ".join(t))
    monkeypatch.setattr(nd, "WARM_SHARES", shares)
    monkeypatch.setattr(nd, "WARM_POSTS", posts)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.id: r.group_id for r in near_duplicate_groups(df, "i", ["t"], 7, 10, hot=12).collect()}
    want = groups(len(texts), links(texts, 7, 10))
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts) / 2


def test_posts_below_their_level_do_not_meet_each_other(monkeypatch):
    """12,000 posts of one key, 10 of them at their own level: compared are these with all, not all with all."""
    m = 12_000
    meta = np.full(m, (50 << 34) | ((1 << 29) << 4) | LO | HI)
    meta[::1200] |= OWN
    b0 = np.random.default_rng(4).integers(0, 2**62, m)
    b0[7], b0[3] = b0[1200], b0[2]  # the second two are not at their level
    count, seen = np.bitwise_count, []
    monkeypatch.setattr(nd.np, "bitwise_count", lambda x: seen.append(x.size) or count(x))
    posts = pa.RecordBatch.from_arrays([pa.array(c) for c in (np.zeros(m, np.int64), np.arange(m), meta, b0, np.zeros(m, np.int64))], names=["k", "cid", "meta", "b0", "b1"])
    got = [tuple(p.values()) for b in _met(7, 10)([posts]) for p in b.to_pylist()]
    assert got == [(7, 1200)] and sum(seen) < 20 * m
