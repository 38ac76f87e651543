"""Near-duplicate groups by a grouped prefix join (problem 6), and the pieces other joins share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.canon import word_set, words
from weftline.llm.components import connected_components
from weftline.session import spread
from weftline.storage import materialize

#: A word in more than HOT_ROOT * sqrt(classes) classes (or in words / MOST_HOT, where that is more) is hot: no join key
#: of its own. At most MOST_HOT words are hot, which bounds what is broadcast: 36 bytes a word. A part of hot words that
#: more classes than that would hold by chance is a key only together with another such part.
HOT_ROOT, MOST_HOT = 3.0, 4_000_000
#: Hot words in up to one of WARM_SHARES of the classes are warm: join keys by twos. The largest share is taken whose keys
#: number at most WARM_POSTS a class on average and MOST_POSTS in any class; where none does, no word is warm.
WARM_SHARES, WARM_POSTS, MOST_POSTS = (1 / 128, 1 / 256, 1 / 512, 1 / 1024), 20, 20_000
#: Each level allows LEVEL_STEP times the differing words of the next higher one; none is below LEAST_LEVEL.
LEVEL_STEP, LEAST_LEVEL = 0.6, 6
#: Candidate records up to this number are broadcast when their word sets are fetched: 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Classes handled at once by NumPy.
SLICE = 4096
#: Posts, and pairs, handled at once; runs of one key up to SHORT_RUN posts are paired together, longer ones by blocks of rows and columns.
POSTS, SHORT_RUN, BLOCK = 1 << 16, 16, (32, 4096)

_POST = "k long, cid long, meta long, b0 long, b1 long, b2 long"
#: Flags in the lowest bits of meta: lo = 0, hi = 1, the level is the class's own, the key is a rare word or two warm ones.
LO, HI, OWN, RARE = 1, 2, 4, 8


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: turns word hashes into independent-looking keys."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seg(ufunc: np.ufunc, v: np.ndarray, off: np.ndarray) -> np.ndarray:
    """`ufunc` over each segment of v; 0 for empty segments."""
    out = np.zeros(len(off) - 1, v.dtype)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = ufunc.reduceat(v, off[:-1][full])
    return out


def _twos(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of every two entries of one owner, the first before the second; owner is ascending."""
    left = np.searchsorted(owner, owner, "right") - np.arange(len(owner)) - 1
    first = np.repeat(np.arange(len(owner)), left)
    return first, first + np.arange(len(first)) - np.repeat(np.cumsum(left) - left, left) + 1


class HotWords:
    """The hot words with their counts, and what the parts of each level are expected to hold; those in up to `warm` classes are warm."""

    def __init__(self, rows: np.ndarray, classes: int, limit: int, num: int, den: int, warm: int = 0):
        rows = rows[np.argsort(rows[:, 0])]
        self.words = rows[:, 0].astype(np.int32)
        self.count, self.warm = rows[:, 1], warm
        parted = self.count > warm
        self.rank = np.zeros(len(rows), np.int64)
        self.rank[np.lexsort((rows[:, 0], -rows[:, 1]))] = np.arange(len(rows))  # warm ones come last
        p = np.clip(rows[:, 1] / max(1, classes), 1e-12, 1 - 1e-6)
        self.out, self.logit = np.where(parted, np.log1p(-p), 0), np.log(p) - np.log1p(-p)
        self.heavy, self.num, self.den = np.log(max(1, limit) / max(1, classes)), num, den

    def found(self, b: pa.RecordBatch):
        """Of a batch of (cid, toks, ...): offsets, sizes, keys, class of each word, and in how many classes it is (0 for rare), with its index here."""
        lists = b.column(1)
        off = np.asarray(lists.offsets)
        tok = np.asarray(lists.values)[off[0] : off[-1]]
        off = (off - off[0]).astype(np.int64)
        n = np.diff(off)
        row = np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(self.words, tok), max(len(self.words) - 1, 0))
        count = np.where(self.words[at] == tok, self.count[at], 0) if len(self.words) else np.zeros(len(tok), np.int64)
        key = mix64(tok.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return off, n, key, row, count, at

    def spare(self, n: np.ndarray, row: np.ndarray, count: np.ndarray, warm: int):
        """Rare words of each class, how many of its warm ones make keys by twos, words spent in a pair without a common key of these, and slacks.

        Such a pair has no rare word in common and one warm word at most; the others differ. The
        slack of a class is its share, in 1 / (num + den), of twice the words that may differ
        besides. One word is added because two words may have one 32-bit hash.
        """
        rare = np.bincount(row[count == 0], minlength=len(n))
        mid = np.bincount(row[(count > 0) & (count <= warm)], minlength=len(n))
        lack = n - -(-(self.num * n) // self.den) + 1 - rare
        spent = rare + np.maximum(mid - 1, 0)
        return rare, np.where(lack >= 0, np.minimum(mid, lack + 2), 0), spent, (self.den - self.num) * n - (self.num + self.den) * (spent - 1)


def _size_bin(n: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log2(np.maximum(1, n))).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, SLICE):
            yield b.slice(lo, SLICE)


def _largest_slacks(hot: HotWords, warm: list[int]):
    """A mapInArrow function: for each limit of warm words the largest slack of each bin of sizes, and the keys by twos, of all and of one class at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[int]] = {}
        for b in _slices(batches):
            _, n, _, row, count, _ = hot.found(b)
            bins = _size_bin(n)
            for i, limit in enumerate(warm):
                _, mid, _, slack = hot.spare(n, row, count, limit)
                twos = mid * (mid - 1) // 2
                for k in np.unique(bins).tolist():
                    of = bins == k
                    old = best.get((i, k), [-1, 0, 0])
                    best[i, k] = [max(old[0], int(slack[of].max())), old[1] + int(twos[of].sum()), max(old[2], int(twos[of].max()))]
        rows = [(*k, *v) for k, v in best.items()]
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["warm", "size_bin", "slack", "posts", "most"])

    return run


def _levels(top: int) -> np.ndarray:
    """Numbers of differing words that the levels allow, ascending; the highest is `top`."""
    out = [top] if top >= 0 else []
    while out and out[-1] * LEVEL_STEP >= LEAST_LEVEL:
        out.append(int(out[-1] * LEVEL_STEP))
    return np.array(out[::-1], np.int64)


def _posts(hot: HotWords, bins: np.ndarray, best: np.ndarray):
    """A mapInArrow function: the join keys of each class, with what the pair filters need.

    bins, best: bins of sizes, ascending, and the largest slack of classes of that size or less.
    """
    num, den = hot.num, hot.den
    unit = num + den
    levels = _levels(int(2 * best[-1] // unit) if len(best) else -1)
    never = -(1 << 40)

    def rare_posts(n, off, key, row, is_rare):
        # Rare words in hash order come first in the global word order; keep those inside the prefix.
        order = np.lexsort((key, ~is_rare, row))
        pos = np.arange(len(key)) - off[:-1][row]
        longest = n - -(-(num * n) // den) + 2
        keep = order[is_rare[order] & (pos < longest[row])]
        return row[keep], key[keep]

    def warm_posts(key, row, mid):
        # All rare words differ, so the first two warm words in common, in hash order, are among the first `mid` of either class.
        order = np.lexsort((key, row))
        owner = row[order]
        pos = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order = order[pos < mid[owner]]
        x, y = _twos(row[order])
        with np.errstate(over="ignore"):
            return row[order][x], mix64(key[order][x] * np.uint64(5) + key[order][y])

    def part_keys(g, n_parts, at_g, take, row, key, at, slot):
        """(class, key) at one level: `take` parts of each class in at_g."""
        parts = n_parts
        mine = slot[row] >= 0
        cell = slot[row[mine]] * parts + hot.rank[at[mine]] % parts
        sums = np.zeros(len(at_g) * parts, np.uint64)
        np.add.at(sums, cell, key[mine])
        base = np.bincount(hot.rank % parts, hot.out, parts)
        chance = np.bincount(cell, hot.logit[at[mine]], len(at_g) * parts) + np.tile(base, len(at_g))
        with np.errstate(over="ignore"):
            tag = mix64(np.arange(parts, dtype=np.uint64) + np.uint64((g + 1) << 32))
            k = mix64(sums + np.tile(tag, len(at_g)))
        posted = np.tile(np.arange(parts), len(at_g)) < np.repeat(take, parts)
        weak = posted & (chance > hot.heavy)
        light = np.flatnonzero(posted & ~weak)
        yield at_g[light // parts], k[light]
        # Two parts more than words may differ are dealt: without an equal light part two weak ones are equal.
        w = np.flatnonzero(weak)
        x, y = _twos(w // parts)
        with np.errstate(over="ignore"):
            yield at_g[w[x] // parts], mix64(k[w[x]] * np.uint64(3) + k[w[y]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            off, n, key, row, count, at = hot.found(b)
            _, mid, spent, slack = hot.spare(n, row, count, hot.warm)
            is_rare, is_hot = count == 0, count > hot.warm
            is_warm = ~is_rare & ~is_hot
            sides = np.asarray(b.column(2)).astype(np.int64) * 0 + (np.asarray(b.column(2)) == 0) * LO + (np.asarray(b.column(3)) == 1) * HI
            meta = (n << 34) | ((slack + (1 << 29)) << 4) | sides
            bit = np.uint64(1) << (key & np.uint64(63))
            low = (key >> np.uint64(6)) & np.uint64(1)
            part = lambda keep: _seg(np.bitwise_xor, np.where(keep, bit, np.uint64(0)), off)
            b0, b1, hb = part(low == 0), part(low == 1), part(is_hot)
            # b2 holds half the words of b0: the two apart say more than b0, which is compared first.
            b2 = part((low == 0) & ((key >> np.uint64(7)) & np.uint64(1) == 0))
            cid = np.asarray(b.column(0))

            def out(cls, k, m, *x):
                ints = lambda v: pa.array(v.view(np.int64))
                return pa.RecordBatch.from_arrays([ints(k), pa.array(cid[cls]), pa.array(m), *[ints(v[cls]) for v in x]], names=["k", "cid", "meta", "b0", "b1", "b2"])

            for cls, k in (rare_posts(n, off, key, row, is_rare), warm_posts(key[is_warm], row[is_warm], mid)):
                yield out(cls, k, meta[cls] | RARE, b0, b1, b2)
            if not len(levels):
                continue
            need = 2 * slack // unit
            own = np.where(slack < 0, -1, np.searchsorted(levels, need))
            # The largest partner that can have all these words of this class differ, and the largest slack up to that size.
            most = ((den * n - unit * (spent - 1)) // num) + 1
            upto = np.searchsorted(bins, _size_bin(most), "right") - 1
            partner = np.where((most >= 0) & (upto >= 0), best[np.maximum(upto, 0)], never)
            hrow, hkey, hat = row[is_hot], key[is_hot], at[is_hot]
            none = np.zeros(len(n), np.uint64)
            for g, d in enumerate(levels.tolist()):
                below = levels[g - 1] if g else -1
                meets = (own < g) & (2 * partner // unit > below) & (slack + partner >= 0) & (2 * slack + (d + 1) * unit >= 0)
                at_g = np.flatnonzero((own == g) | meets)
                if not len(at_g):
                    continue
                # A class with less slack than the level differs in fewer words: so many parts suffice, and two more.
                most_other = np.minimum((d + 1) * unit, 2 * partner[at_g])
                take = np.clip((2 * slack[at_g] + most_other) // (2 * unit), 0, d) + 2
                slot = np.full(len(n), -1)
                slot[at_g] = np.arange(len(at_g))
                for cls, k in part_keys(g, d + 2, at_g, take, hrow, hkey, hat, slot):
                    yield out(cls, k, meta[cls] | np.where(own[cls] == g, OWN, 0), hb, none, none)

    return run


def _candidates(k: np.ndarray, cid: np.ndarray, meta: np.ndarray, b0: np.ndarray, b1: np.ndarray, b2: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes that share a key and pass the filters, of whole runs of equal keys in the order of k."""
    unit = num + den
    n = meta >> 34
    # Words that may be apart, in 1 / unit: overlap >= num / unit * (n_x + n_y), less one word that shares its hash.
    room = np.where(meta & RARE != 0, (den - num) * n + unit, ((meta >> 4) & ((1 << 30) - 1)) - (1 << 29))
    own, lo, hi = meta & (OWN | RARE) != 0, meta & LO != 0, meta & HI != 0

    def fits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        ok = (cid[x] != cid[y]) & ((small + 1) * den >= large * num) & (own[x] | own[y]) & ((lo[x] & hi[y]) | (lo[y] & hi[x]))
        x, y = x[ok], y[ok]
        half = b2[x] ^ b2[y]
        apart = np.bitwise_count(half).astype(np.int64) + np.bitwise_count(half ^ b0[x] ^ b0[y]) + np.bitwise_count(b1[x] ^ b1[y])
        ok = apart * unit <= room[x] + room[y]
        return x[ok], y[ok]

    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(k)))
    # Short runs: each row meets all after it.
    rows = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT_RUN), size))
    left = np.repeat(start + size, size)[rows] - rows - 1
    x = np.repeat(rows, left)
    yield fits(x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(left) - left, left))
    def blocks(left_rows: np.ndarray, right_rows: np.ndarray, every: bool, flat: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows ascending in size against rows of a size that may match; `every`: both are the same rows, each two meet once."""
        if len(left_rows) > len(right_rows):
            left_rows, right_rows = right_rows, left_rows
        sizes, x0, x1 = n[right_rows], b0[right_rows], b1[right_rows]
        for i in range(0, len(left_rows), BLOCK[0]):
            at = left_rows[i : i + BLOCK[0]]
            first = i if every else int(np.searchsorted(sizes, n[at[0]] * num // den - 1))
            last = int(np.searchsorted(sizes, (n[at[-1]] + 1) * den // num, "right"))
            y0, y1, most = b0[at, None], b1[at, None], room[at].max()
            for j in range(first, last, BLOCK[1]):
                to = min(j + BLOCK[1], last)
                apart = np.bitwise_count(y0 ^ x0[j:to])
                if not flat:
                    apart += np.bitwise_count(y1 ^ x1[j:to])
                limit = (most + room[right_rows[j:to]].max()) // unit
                if limit < 0:
                    continue
                hit = np.flatnonzero(apart <= min(limit, 255))
                p, q = i + hit // (to - j), j + hit % (to - j)
                if every:
                    p, q = p[q > p], q[q > p]
                yield fits(left_rows[p], right_rows[q])

    # Long runs: rows at their own level against each other and all others, side 1 against side 0.
    for s, e in zip(start[size > SHORT_RUN].tolist(), (start + size)[size > SHORT_RUN].tolist()):
        flat = not b1[s:e].any()
        by_size = s + np.argsort(n[s:e])
        mine, rest = by_size[own[by_size]], by_size[~own[by_size]]
        if (lo[s:e] & hi[s:e]).all():
            yield from blocks(mine, mine, True, flat)
            yield from blocks(mine, rest, False, flat)
        else:
            yield from blocks(mine[hi[mine]], by_size[lo[by_size]], False, flat)
            yield from blocks(rest[hi[rest]], mine[lo[mine]], False, flat)


def _met(num: int, den: int):
    """A mapInArrow function over posts in the order of k, all of a key in one partition: candidate pairs (a, b), a < b.

    A run of equal keys is held whole (48 bytes a post); pairs are compared in blocks of bounded size and never held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, got, count = [], 0, [], 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate([g[i] for g in got]) for i in (0, 1))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        def chunks() -> Iterator[list[np.ndarray]]:
            nonlocal held, rows
            want = POSTS
            for b in batches:
                held.append([np.asarray(c) for c in b.columns])
                rows += b.num_rows
                if rows < want:
                    continue
                cols = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                if cut:
                    yield [c[:cut] for c in cols]
                held, rows = [[c[cut:] for c in cols]], rows - cut
                want = max(POSTS, 2 * rows)
            if rows:
                yield [np.concatenate(c) for c in zip(*held)]

        for k, cid, meta, *bits in chunks():
            b0, b1, b2 = [b.view(np.uint64) for b in bits] + [np.zeros(len(k), np.uint64)] * (3 - len(bits))
            for x, y in _candidates(k, cid, meta, b0, b1, b2, num, den):
                if len(x):
                    got.append((cid[x], cid[y]))
                    count += len(x)
                if count > POSTS:
                    yield out()
                    got, count = [], 0
        if got:
            yield out()

    return run


def fetched(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of sets (id, ...) of the given ids; the ids are broadcast where they are few."""
    known = ids.distinct()
    return sets.join(F.broadcast(known) if known.count() <= BROADCAST_IDS else known, "id", "left_semi")


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with na, nb and both: the sizes of their sets in sets (id, toks) and of what they share."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    s = fetched(ids, sets.select("id", "toks"))
    joined = pairs.join(s.select(F.col("id").alias("a"), F.col("toks").alias("ta")), "a").join(
        s.select(F.col("id").alias("b"), F.col("toks").alias("tb")), "b"
    )
    return joined.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("both"))


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those whose texts' distinct words reach num/den of their union.

    sets (id, toks) are 32-bit hashes of words: two words may have one hash. Pairs that one such
    case more or less would not decide otherwise are settled by them; the words themselves, of
    texts (id, words), settle the others.
    """
    reach = lambda both, words: both * den >= num * words
    near = _overlap(pairs, sets).withColumn("all", F.col("na") + F.col("nb") - F.col("both"))
    near = materialize(near.where(reach(F.col("both") + 1, F.col("all"))).withColumn("sure", reach(F.col("both") - 1, F.col("all") + 1)), "nd-near")
    close = near.where("not sure").select("a", "b")
    words = texts.select("id", F.array_distinct("words").alias("toks"))
    exact = _overlap(close, words).where(reach(F.col("both"), F.col("na") + F.col("nb") - F.col("both")))
    return near.where("sure").select("a", "b").unionByName(exact.select("a", "b"))


def linked_classes(classes: DataFrame, texts: DataFrame, num: int, den: int, hot: int | None = None) -> DataFrame:
    """(a, b), a < b: every two of classes (cid, toks, lo, hi) whose word sets reach num/den of their union.

    lo and hi are the least and the greatest side of a class's members; only classes with
    members on different sides are paired (side 0 with 1), or all where lo = 0 and hi = 1.
    texts (id, words) gives the words of a class's representative.

    Exact, with no limit on the size of a group. Words are counted over classes and are rare or hot
    (in more than `hot` classes, by default HOT_ROOT times the root of their number); the less common hot ones are warm.
    Two classes that reach num/den and share a rare word share one
    inside both prefixes (rare words first), and two that share warm words only share two of them inside both.
    Others differ in all their rare and all but one of their warm words,
    which leaves a bounded number d of other words that may differ; these are dealt into
    d + 2 parts by their rank, so at least two parts are equal, empty ones included. A part that few
    classes hold by chance is a key; the others are keys by twos, so no key is common only because
    its words are. d is half from either class: each pair meets at the level of the class that
    allows more. Sizes and parity bitmaps filter, then whole sets are compared.
    """
    spark = classes.sparkSession
    given = classes.select("cid", "toks", "lo", "hi")
    rows, words = classes.agg(F.count(F.lit(1)), F.sum(F.size("toks").cast("long"))).first()
    limit = hot or max(int(HOT_ROOT * rows**0.5), (words or 0) // MOST_HOT)
    hot_rows = classes.select(F.explode("toks").alias("t")).groupBy("t").count().where(F.col("count") > limit)
    found = np.array([tuple(r) for r in hot_rows.toLocalIterator()], np.int64).reshape(-1, 2)
    words_of = spark.sparkContext.broadcast(HotWords(found, rows, limit, num, den))
    warm = sorted({w for share in WARM_SHARES if (w := int(share * rows)) > limit}, reverse=True) + [0]
    slacks = given.mapInArrow(lambda it: _largest_slacks(words_of.value, warm)(it), "warm int, size_bin int, slack long, posts long, most long")
    per = [tuple(r) for r in slacks.groupBy("warm", "size_bin").agg(F.max("slack"), F.sum("posts"), F.max("most")).collect()]
    words_of.unpersist()
    few = lambda i: sum(r[3] for r in per if r[0] == i) <= WARM_POSTS * rows and all(r[4] <= MOST_POSTS for r in per if r[0] == i)
    level = next(i for i in range(len(warm)) if few(i))
    shared = spark.sparkContext.broadcast(HotWords(found, rows, limit, num, den, warm[level]))
    by_size = sorted((r[1], r[2]) for r in per if r[0] == level)
    bins = np.array([r[0] for r in by_size], np.int64)
    best = np.maximum.accumulate(np.array([r[1] for r in by_size], np.int64)) if by_size else bins
    posts = given.mapInArrow(lambda it: _posts(shared.value, bins, best)(it), _POST)
    met = posts.repartition("k").sortWithinPartitions("k").mapInArrow(_met(num, den), "a long, b long")
    pairs = materialize(met.distinct(), "nd-pairs")
    return verified(pairs, classes.select(F.col("cid").alias("id"), "toks"), texts, num, den)


def near_duplicate_groups(df: DataFrame, id_col: str, text_cols: list[str], num: int = 8, den: int = 10, hot: int | None = None) -> DataFrame:
    """(id, class_id, group_id, links_class): every record, its class of equal word sets and its near-duplicate group.

    Two records are linked if at least num/den of the distinct words of both together occur in
    both; a group is all that is linked, named by its smallest id. Records without any word
    (null or empty texts) link to nothing. Ties and repeated rows fall into one class.

    Plan: one pass hashes the words and writes the sets; equal sets collapse to a class;
    `linked_classes` finds every two classes that are linked, exactly.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(text_cols)])
    hashes = word_set(*[F.col(f"t{i}") for i in range(len(text_cols))])
    sets = spread(texts, "id").select("id", hashes.alias("toks"))
    sig = materialize(sets.select("id", F.size("toks").alias("n"), F.xxhash64("toks").alias("sh"), "toks"), "nd-sets")
    classes = materialize(
        sig.where("n > 0").groupBy("sh").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies"), F.first("toks").alias("toks")),
        "nd-classes",
    )
    every = classes.select("cid", "toks", F.lit(0).alias("lo"), F.lit(1).alias("hi"))
    spelt = texts.select("id", words(*[F.col(f"t{i}") for i in range(len(text_cols))]).alias("words"))
    edges = materialize(linked_classes(every, spelt, num, den, hot), "nd-edges")
    comp = connected_components(edges, "a", "b")
    owner = classes.select("sh", F.col("cid").alias("class_id"), "copies").join(
        comp.select(F.col("node").alias("class_id"), "root"), "class_id", "left"
    )
    return (
        sig.select("id", F.when(F.col("n") > 0, F.col("sh")).alias("sh"))
        .join(owner, "sh", "left")
        .select(
            "id",
            F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("root", "class_id", "id").alias("group_id"),
            (F.col("root").isNotNull() | (F.coalesce("copies", F.lit(1)) > 1)).alias("grouped"),
        )
    )
