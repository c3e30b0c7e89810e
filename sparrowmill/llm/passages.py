"""Substring dedup by collinear chaining: fuzzy passages that two different texts share.

1. Seeds: of each run of `window` k-mers of words the least by hash, so any `k + window - 1` equal words share one. Equal
   texts are one text; its copies are listed as such and not compared.
2. All texts that have a seed are joined, in pairs, where MOST or fewer occurrences share it. What more share meets block by
   block: a seed carries WIDE bits of each word around it, and those pairs are kept of which these allow a passage of 40
   words in place. A passage of frequent seeds alone that isn't in place has two of them at different distances in its texts, so
   texts that have two frequent seeds at different distances are pairs too. Each pair then gets all frequent seeds that
   its texts share. A chain of one seed goes on only if the bits around it allow it.
3. Seeds of a pair of texts are chained in order of both: a Fenwick tree over the places in one text gives the best
   chain that ends before a seed, with a cost for the gap in each text.
4. Chains are aligned word by word: ends are extended while words agree (x-drop), gaps between seeds by the longest
   common subsequence. A passage is kept with `least_words` words or more of which the share `similarity` matches. The
   words travel as 16 bits of their hashes, so one pair of different words in 65,536 counts as equal.

Defined cases: a null text is empty; texts without k words have no seed; a text's own repeats are not passages; repeated
rows and equal texts under several ids are copies of the least id; null ids are kept as such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored, release, scratch
from .textnum import Rolling, U, Words, mix, sliding_min, slices, text_bytes, trim
from .texts import dealing, paired, runs, unique

#: Nine equal words are sure to share a seed, and of forty words of which 32 match 98 % do (simulated, edits at random places).
K, WINDOW, LEAST_WORDS, SIMILARITY = 5, 5, 40, 0.8
#: Score of a seed and cost of a word of gap in either text: a gap of about 50 words in both ends a chain.
SEED, GAP = 8.0, 0.08
#: A chain's least score: one seed. What it is worth is for the alignment to say.
LEAST_SCORE = SEED
#: Words after and before a seed of which its signature has a bit each.
AFTER, BEFORE = LEAST_WORDS - K, 64 - (LEAST_WORDS - K)
#: Occurrences of a seed up to which its cell pairs them, and those of a block beyond.
MOST, BLOCK = 64, 1024
#: Signatures, each of another bit of the words, that frequent seeds' pairs are held against.
WIDE = 4
#: Bits that stand for what follows a text's end, so that it looks like no words.
END = 0x5A6D3C9B1
#: Two seeds of one diagonal less than so many words apart always go into one chain.
NEAR = int(SEED / (2 * GAP))
#: Rows that are joined to their texts' seeds or words at once: what they carry is on disk for that long.
ROUND = 1 << 21
#: Words beyond a chain's ends that the alignment may look at.
MARGIN = 64


def word_hashes(column: pa.Array) -> tuple[Words, np.ndarray]:
    w = Words(column, lower=True)
    return w, Rolling(w.buf).of(w.start, w.end)


def seeds(column: pa.Array, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the first word in the row, hash) of each text's seeds; a text with fewer k-mers than a window gives its least one."""
    w, h = word_hashes(column)
    place, acc = _picked(w, h, k, window)
    return w.doc[place], place - w.first[w.doc[place]], acc


def signatures(column: pa.Array, k: int = K, window: int = WINDOW, apart: bool = False, which: int = 0, more: int = 0) -> tuple[np.ndarray, ...]:
    """seeds(), and for each a bit of each of the AFTER words that follow it (from the lowest up) and of the BEFORE words ahead of it.
    Where texts are to be held `apart`, what lies beyond a text's ends has bits of the text's own, as no word there matches another's.
    `which` bit of a word it is, from the highest down; `more` arrays of the bits after that follow."""
    w, h = word_hashes(column)
    place, acc = _picked(w, h, k, window)
    row = w.doc[place]
    follow, ahead = w.first[row] + w.count[row] - place - k, place - w.first[row]
    texts_own = _own_bits(w, h)[row] if apart else None

    def register(bits: np.ndarray, wide: int) -> np.ndarray:
        """At each word, the bits of the `wide` words from it on."""
        out, have = np.zeros(len(bits) + wide, U), 0
        run, size = np.append(bits, np.zeros(wide, U)), 1
        while have < wide:
            if wide >> (size.bit_length() - 1) & 1:
                out |= np.append(run[have:], np.zeros(have, U)) << U(have)
                have += size
            run = run | np.append(run[size:], np.zeros(size, U)) << U(size)
            size *= 2
        return out

    def inside(bits: np.ndarray | U, known: np.ndarray, wide: int) -> np.ndarray:
        return bits & ((U(1) << np.clip(known, 0, wide).astype(U)) - U(1))

    def signature(which: int) -> np.ndarray:
        bit = h >> U(63 - which) & U(1)
        after = inside(register(bit, AFTER)[np.minimum(place + k, len(h))], follow, AFTER)
        own = mix(texts_own + U(which)) if apart else None
        after |= (U(END) if own is None else own) & ~inside(~U(0), follow, AFTER) & U((1 << AFTER) - 1)
        before = inside(register(bit[::-1], BEFORE)[len(h) - place], ahead, BEFORE)
        if apart:
            before |= (own >> U(AFTER)) & ~inside(~U(0), ahead, BEFORE) & U((1 << BEFORE) - 1)
        return after | before << U(AFTER)

    return row, acc, ahead, *(signature(i) for i in range(which, which + more + 1))


def _own_bits(w: Words, h: np.ndarray) -> np.ndarray:
    """64 bits of each text's own: the sum of its words' hashes by their places, mixed."""
    with np.errstate(over="ignore"):
        total = np.append(U(0), np.cumsum(mix(h + (np.arange(len(h)) - w.first[w.doc]).astype(U)), dtype=U))
        return mix(total[w.first + w.count] - total[w.first])


def promising(x: np.ndarray, y: np.ndarray, k: int = K, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether seeds of these signatures may lie within `least_words` words in place of which the share `similarity` matches.
    Equal bits count as equal words and so do words beyond the signatures, so none that does is missed."""
    return _allows(~(x ^ y), k, least_words, similarity)


def _allows(same: np.ndarray, k: int, least_words: int, similarity: float) -> np.ndarray:
    """promising() where the bits of `same` tell which words around the seeds may be equal."""
    wide = least_words - k
    need = int(np.ceil(similarity * least_words - 1e-9)) - k
    windows = []  # (bits, how many of them have to be equal) of each place of the seed
    for f in range(wide + 1):
        a, b = min(f, AFTER), min(wide - f, BEFORE)
        windows.append(((1 << a) - 1 | ((1 << b) - 1) << AFTER, need - (wide - a - b)))
    out = np.zeros(len(same), bool)
    for i in range(0, len(windows), 9):
        part = windows[i : i + 9]
        union = 0
        for bits, _ in part:
            union |= bits
        may = np.flatnonzero(np.bitwise_count(same & U(union)) >= min(n for _, n in part))
        for bits, n in part:
            out[may] |= np.bitwise_count(same[may] & U(bits)) >= n
    return out


def _all_pairs(key: np.ndarray, n: np.ndarray, most: int, portion: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) in portions: all pairs of rows of different texts of the keys with `most` rows or fewer. Rows are ordered by key and text."""
    begin, many, _ = runs(key, n)
    for m in np.unique(many[many <= most]).tolist():
        i, j = np.triu_indices(m, 1)
        of, step = begin[many == m][:, None], max(1, portion // max(1, len(i)))
        for c in range(0, len(of), step):
            x, y = (of[c : c + step] + i).ravel(), (of[c : c + step] + j).ravel()
            keep = n[x] != n[y]
            yield x[keep], y[keep]


def _run_ends(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the seeds, in order, are not amid a run of one seed in a text, as of one word over and over. Of two such runs the
    first and last seeds give all that they share at its longest, and every way in which what is around them can go on."""
    alike = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
    return ~(np.append(False, alike) & np.append(alike, False)) if len(key) else np.zeros(0, bool)


def frequent_seeds(stored: DataFrame, keys: np.ndarray, shift: U, k: int, window: int) -> DataFrame:
    """(key, n, at, s0, ..., ahead, gap, p0, ...): where in `stored` the seeds `keys` (ascending, shifted; by their places there) are,
    each with WIDE signatures; of a seed less than NEAR words ahead of it in the text the key, how far that is and the signatures (else gap is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, key, place, *seen = signatures(part.column("text"), k, window, True, 0, WIDE - 1)
                key >>= shift
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hot = np.flatnonzero((keys[at] == key) & _run_ends(row, key))
                if len(hot):
                    row, at, place, seen = row[hot], at[hot], place[hot], [x[hot] for x in seen]
                    last = np.maximum(np.arange(len(hot)) - 1, 0)
                    gap = place - place[last]
                    gap[(row != row[last]) | (gap >= NEAR)] = 0
                    cols = {"key": at.astype(np.int32), "n": part.column("n").to_numpy()[row], "at": place.astype(np.int32), "ahead": at[last].astype(np.int32), "gap": gap.astype(np.int32)}
                    cols |= {f"s{i}": x.view(np.int64) for i, x in enumerate(seen)} | {f"p{i}": x[last].view(np.int64) for i, x in enumerate(seen)}
                    yield pa.record_batch({c: pa.array(x) for c, x in cols.items()})
        trim()

    return stored.select("n", "text").mapInArrow(run, "key int, n long, at int, ahead int, gap int, " + ", ".join(f"{c}{i} long" for c in "sp" for i in range(WIDE)))


def frequent_pairs(hot: DataFrame, k: int, least_words: int, similarity: float) -> DataFrame:
    """(first, other, a, b, alone) for the pairs of occurrences in `hot` (see frequent_seeds) of a key in different texts
    whose signatures together allow a passage. A key's occurrences are dealt to blocks, and each two blocks meet in a group of their own.

    Where both texts have the same seed as far ahead, near enough to go into one chain, and that is such a pair too, it
    stands for this one: of a row of them the first is given, so a pair of texts has one row for each of its passages or so.
    """
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("n", "at"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = [[f"{c}{i}" for i in range(WIDE)] for c in "sp"]
    dealt = dealt.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "n", "at", "ahead", "gap", *names[0], *names[1])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        i, j, own, n, at, ahead, gap = (group.column(c).to_numpy() for c in ("i", "j", "own", "n", "at", "ahead", "gap"))
        seen, past = ([group.column(c).to_numpy().astype(np.int64).view(U) for c in x] for x in names)

        def allowed(by: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
            apart = by[0][x] ^ by[0][y]
            for s in by[1:]:
                apart |= s[x] ^ s[y]
            return _allows(~apart, k, least_words, similarity)

        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own == j)
        for c in range(0, len(left), 128):
            x, y = np.repeat(left[c : c + 128], len(right)), np.tile(right, len(left[c : c + 128]))
            keep = n[x] < n[y] if i[0] == j[0] else n[x] != n[y]
            x, y = x[keep], y[keep]
            keep = allowed(seen, x, y)
            x, y = x[keep], y[keep]
            both = np.flatnonzero((gap[x] > 0) & (gap[x] == gap[y]) & (ahead[x] == ahead[y]))
            keep = np.ones(len(x), bool)
            keep[both] = ~allowed(past, x[both], y[both])
            x, y = x[keep], y[keep]
            if len(x):
                x, y = np.where(n[x] < n[y], x, y), np.where(n[x] < n[y], y, x)
                yield pa.record_batch({"first": pa.array(n[x]), "other": pa.array(n[y]), "a": pa.array(at[x]), "b": pa.array(at[y]), "alone": pa.array(np.ones(len(x), bool))})

    return dealt.groupBy("key", "i", "j").applyInArrow(cross, "first long, other long, a int, b int, alone boolean")


def by_rounds(df: DataFrame, key: str, rows: int, make: Callable[[DataFrame], DataFrame], keep: Callable[[Stored], Stored]) -> DataFrame:
    """What `make` gives of `df`, dealt by `key` to rounds of about ROUND of `rows` rows, each stored before the next one begins."""
    rounds, parts = max(1, -(-rows // ROUND)), []
    for i in range(rounds):
        parts.append(keep(Stored(make(df if rounds == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == i)))).df)
        release(df.sparkSession)
    return reduce(DataFrame.union, parts)


def gathered(met: DataFrame) -> DataFrame:
    """(first, other, a, b, alone): a row for each link, with arrays of its seeds' rows in `met`; those with an `a` below 0 only say that there is a link.
    Rows are sorted and cut in streams, so no link's arrays are held in the JVM's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def link(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            first, other, a, b, alone = (pa.concat_arrays([p.column(c) for p in parts]).to_numpy(zero_copy_only=False) for c in range(5))
            begin = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (other[1:] != other[:-1])))
            keep = a >= 0
            off = pa.array(np.append(0, np.cumsum(np.add.reduceat(keep, begin, dtype=np.int64))).astype(np.int32))
            lists = {c: pa.ListArray.from_arrays(off, pa.array(x[keep])) for c, x in (("a", a), ("b", b), ("alone", alone))}
            return pa.record_batch({"first": pa.array(first[begin]), "other": pa.array(other[begin])} | lists)

        held, last = [], None  # of the link that has not ended yet
        for batch in batches:
            if not batch.num_rows:
                continue
            first, other = (batch.column(c).to_numpy() for c in range(2))
            new = np.flatnonzero((first[1:] != first[:-1]) | (other[1:] != other[:-1])) + 1
            cut = new[-1] if len(new) else 0
            if held and (cut or last != (first[0], other[0])):
                yield link([*held, batch.slice(0, cut)] if last == (first[0], other[0]) or cut else held)
                held = []
            elif cut:
                yield link([batch.slice(0, cut)])
            held.append(batch.slice(cut))
            last = first[-1], other[-1]
        if held:
            yield link(held)

    dealt = met.select("first", "other", "a", "b", "alone").repartition("first").sortWithinPartitions("first", "other")
    return dealt.mapInArrow(run, "first long, other long, a array<int>, b array<int>, alone array<boolean>")


def seed_links(stored: DataFrame, k: int, window: int, least_words: int, similarity: float, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """(links, have). links: (first, other, a, b, alone), a row for each link, first below other, with the seeds that the texts share and whether one alone
    may be a chain; of frequent ones only some. have: (n, at, key), the frequent seeds of each text that has any. Repeated ones do no harm."""

    def extract(column):
        row, key, *more = signatures(column, k, window, True)
        keep = _run_ends(row, key)
        return row[keep], key[keep], *(x[keep] for x in more)

    def pair(key, n, place, signature):
        at = place.astype(np.int32)
        for x, y in _all_pairs(key, n, most):
            alone = promising(signature[x], signature[y], k, least_words, similarity)
            cols = {"first": n[x], "other": n[y], "a": at[x], "b": at[y], "alone": alone}
            yield pa.table({c: pa.array(v) for c, v in cols.items()} | {"hot": pa.nulls(len(x), pa.int64())})
        _, many, _ = runs(key, n)
        hot = np.unique(key[np.repeat(many > most, many)]).view(np.int64)
        kinds = {"first": pa.int64(), "other": pa.int64(), "a": pa.int32(), "b": pa.int32(), "alone": pa.bool_()}
        yield pa.table({c: pa.nulls(len(hot), kind) for c, kind in kinds.items()} | {"hot": pa.array(hot)})

    spark, schema = stored.sparkSession, "first long, other long, a int, b int, alone boolean"
    with scratch() as keep:
        met = paired(stored, extract, (np.uint32, np.uint64), None, pair, f"{schema}, hot long")
        rare = met.where("hot IS NULL").drop("hot")
        # A key of more than `most` occurrences is a few bytes here, whatever the number of its texts.
        keys = np.sort(np.array([r.hot for r in met.where("hot IS NOT NULL").select("hot").collect()], np.int64).view(U))
        if not len(keys):
            return keep(Stored(gathered(rare))).df, None
        hot = Stored(frequent_seeds(stored, keys, dealing(stored)[1], k, window))
        frequent = Stored(frequent_pairs(hot.df, k, least_words, similarity)).df
        release(spark)
        have = keep(Stored(hot.df.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("at", "key"))).alias("have")).select("n", "have.at", "have.key"))).df
        hot.drop()
        # Two frequent seeds that a chain may have one after the other, and texts that have them at different distances.
        one = have.select("n", F.arrays_zip("at", "key").alias("have")).select("n", "have", F.explode("have").alias("x"))
        two = one.select("n", "x", F.explode(F.filter("have", lambda y: (y["at"] > F.col("x.at")) & (y["at"] - F.col("x.at") < int(SEED / GAP)))).alias("y"))
        held = Stored(two.select("n", F.col("x.key").alias("x"), F.col("y.key").alias("y"), (F.col("y.at") - F.col("x.at")).alias("d")).distinct())
        two = held.df
        several = two.groupBy("x", "y").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("many")).where("lo < hi")
        several = Stored(several.select("x", "y", "many")).df
        bends = several.agg(F.sum(F.col("many").cast("double") * F.col("many") / 2)).first()[0] or 0

        def apart(p: DataFrame) -> DataFrame:
            p, q = (t.join(several.select("x", "y"), ["x", "y"]).alias(as_) for t, as_ in ((p, "p"), (two, "q")))
            p = p.join(q, (F.col("p.x") == F.col("q.x")) & (F.col("p.y") == F.col("q.y")) & (F.col("p.n") < F.col("q.n")) & (F.col("p.d") != F.col("q.d")))
            return p.select(F.col("p.n").alias("first"), F.col("q.n").alias("other")).distinct()

        # One row of sixteen, or fewer, is left of those that meet.
        bent = by_rounds(two, "n", int(bends // 16), apart, lambda t: t)
        held.drop()
        release(spark)
        links = keep(Stored(gathered(rare.union(frequent).union(bent.select("first", "other", F.lit(-1), F.lit(-1), F.lit(False)))))).df
    release(spark)
    return links, have


def beside(links: DataFrame, have: DataFrame | None) -> DataFrame:
    """`links` with (ax, kx, ay, ky): the places and keys of each text's frequent seeds (null: none), see seed_links()."""
    if have is None:
        return links.select("*", *(F.lit(None).cast("array<int>").alias(c) for c in ("ax", "kx", "ay", "ky")))
    return links.join(have.toDF("first", "ax", "kx"), "first", "left").join(have.toDF("other", "ay", "ky"), "other", "left")


def shared(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link, a, b, alone): the seeds of a batch of beside(), all the frequent ones that its texts share among them."""

    def flat(c: str) -> tuple[np.ndarray, np.ndarray]:
        size = batch.column(c).value_lengths().fill_null(0).to_numpy()
        return np.repeat(np.arange(len(size)), size), batch.column(c).flatten().to_numpy(zero_copy_only=False)

    (link, a), (_, b), (_, alone) = (flat(c) for c in ("a", "b", "alone"))
    (of_x, x), (_, key_x), (of_y, y), (_, key_y) = (flat(c) for c in ("ax", "kx", "ay", "ky"))
    key_x, key_y = (of.astype(np.int64) << 32 | key.astype(np.int64) for of, key in ((of_x, key_x), (of_y, key_y)))
    order = np.argsort(key_y, kind="stable")
    begin, end = (np.searchsorted(key_y[order], key_x, side) for side in ("left", "right"))
    many = end - begin
    at = order[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())]
    link, a, b = (np.concatenate(c).astype(np.int64) for c in ((link, np.repeat(of_x, many)), (a, np.repeat(x, many)), (b, y[at])))
    return link, a, b, np.append(alone.astype(bool), np.zeros(len(at), bool))


def _picked(w: Words, h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of all seeds."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h) - k + 1, U)
        for j in range(k):
            acc = mix(acc * U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    row = w.doc[: len(acc)]
    inside = w.doc[k - 1 :] == row
    key = np.where(inside, (acc & ~U(0xFFFFFFFF)) | np.arange(len(acc), dtype=U), ~U(0))
    pad = np.full(window - 1, ~U(0))
    # A window that begins at a k-mer and may reach over the row's end: what lies there is greater than all.
    end = (w.first + w.count - k + 1)[row]
    at = np.arange(len(acc))
    full = inside & ((at + window <= end) | (at == w.first[row]))
    short = np.flatnonzero(full & (at + window > end))
    least = sliding_min(np.concatenate([key, pad]), window)
    picked = least[full & (at + window <= end)] & U(0xFFFFFFFF)
    few = [int(s + np.argmin(key[s : end[s]])) for s in short]
    place = np.unique(np.concatenate([picked.astype(np.int64), np.array(few, np.int64)]))
    return place, acc[place]


def chains(a: list[int], b: list[int], k: int = K, least: float = LEAST_SCORE) -> list[tuple[int, int, int, int, list[tuple[int, int]]]]:
    """Collinear chains of the seeds (a[i], b[i]), best first, no seed in two: (from a, to a, from b, to b, seeds)."""
    points = sorted(set(zip(a, b)))
    rank = {y: i + 1 for i, y in enumerate(sorted({y for _, y in points}))}
    tree = [(-1e18, -1)] * (len(rank) + 1)
    score, back = [0.0] * len(points), [-1] * len(points)
    i = 0
    while i < len(points):
        j = i
        while j < len(points) and points[j][0] == points[i][0]:  # seeds at one place of a are no chain
            x, y = points[j]
            best, r = (-1e18, -1), rank[y] - 1
            while r:
                best = max(best, tree[r])
                r &= r - 1
            gain = best[0] - GAP * (x + y)
            score[j] = SEED + max(0.0, gain)
            back[j] = best[1] if gain > 0 else -1
            j += 1
        for q in range(i, j):
            x, y = points[q]
            value, r = (score[q] + GAP * (x + y), q), rank[y]
            while r < len(tree):
                if tree[r] < value:
                    tree[r] = value
                r += r & -r
        i = j
    used, out = set(), []
    for q in sorted(range(len(points)), key=lambda q: (-score[q], q)):
        path, p = [], q
        while p >= 0 and p not in used:
            path.append(points[p])
            used.add(p)
            p = back[p]
        if path and score[q] - (score[p] if p >= 0 else 0.0) + 1e-9 >= least:
            path.reverse()
            out.append((path[0][0], path[-1][0] + k, path[0][1], path[-1][1] + k, path))
    return out


def plain_chains(link: np.ndarray, a: np.ndarray, b: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, ...]:
    """(link, a, b, alone, plain): the different seeds of many links in order, and whether a link's are, as they stand, its one chain.

    On one diagonal costs add up, so the best chain that ends at a seed comes from the seed before it; where no step costs
    what a seed is worth, that is all of them, which is what chains() finds.
    """
    order = np.lexsort((~alone, b, a, link))
    link, a, b, alone = link[order], a[order], b[order], alone[order]
    same = np.append(False, link[1:] == link[:-1])
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) | ~same
    link, a, b, alone, same = link[new], a[new], b[new], alone[new], same[new]
    begin = np.flatnonzero(np.append(True, link[1:] != link[:-1]))
    step_a, step_b = np.diff(a, prepend=0), np.diff(b, prepend=0)
    bad = same & ((step_a != step_b) | (GAP * (step_a + step_b) >= SEED))
    size = np.diff(np.append(begin, len(link)))
    return link, a, b, alone, np.repeat(~np.logical_or.reduceat(bad, begin), size) if len(link) else bad


def run_ends(path: list[tuple[int, int]], k: int = K) -> list[tuple[int, int]]:
    """A chain's seeds without those inside a run of equal words: of seeds that touch on one diagonal the first and the last."""

    def touch(p: tuple[int, int], q: tuple[int, int]) -> bool:
        return q[0] - p[0] == q[1] - p[1] <= k

    return [s for i, s in enumerate(path) if not (0 < i < len(path) - 1 and touch(path[i - 1], s) and touch(s, path[i + 1]))]


def _extend(x: list[int], y: list[int], drop: int = 12) -> tuple[int, int]:
    """How far the words go on agreeing, in place, and how many match: +1, -2, until the score falls `drop` below its best."""
    score = best = length = matched = hits = 0
    for i, (p, q) in enumerate(zip(x, y)):
        if p == q:
            score, hits = score + 1, hits + 1
            if score > best:
                best, length, matched = score, i + 1, hits
        else:
            score -= 2
            if best - score > drop:
                break
    return length, matched


def align(a: list[int], b: list[int], path: list[tuple[int, int]], k: int = K) -> tuple[int, int, int, int, int]:
    """(from a, to a, from b, to b, matching words) of the passage around a chain's seeds in the words `a` and `b`."""
    x, y = path[0]
    n, matched = _extend(a[:x][::-1], b[:y][::-1])
    from_a, from_b = x - n, y - n
    at_a, at_b = x, y
    for x, y in path:
        if x < at_a or y < at_b:  # overlaps what is aligned: on the same diagonal its rest goes on, else it waits
            if x - at_a == y - at_b and x + k > at_a:
                matched, at_a, at_b = matched + x + k - at_a, x + k, y + k
            continue
        p, q = a[at_a:x], b[at_b:y]
        if len(p) == len(q) and (same := sum(s == t for s, t in zip(p, q))) >= len(p) - 2:
            matched += same
        elif p and q:
            matched += sum(m.size for m in SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks())
        matched, at_a, at_b = matched + k, x + k, y + k
    n, more = _extend(a[at_a:], b[at_b:])
    return from_a, at_a + n, from_b, at_b + n, matched + more


def _extend_all(words_a: np.ndarray, words_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, room: np.ndarray, step: int, drop: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_extend() for many places at once, forwards or backwards, and how many of the next LEAST_WORDS words after that match."""
    wide = int(room.max(initial=0)) + 1
    i = np.arange(wide)
    inside = i < room[:, None]
    equal = inside & (words_a[np.where(inside, at_a[:, None] + step * i, 0)] == words_b[np.where(inside, at_b[:, None] + step * i, 0)])
    score = np.cumsum(np.where(equal, 1, -2), axis=1)
    best = np.maximum.accumulate(np.maximum(score, 0), axis=1)
    stop = ~inside | (best - score > drop)
    score = np.where(np.logical_or.accumulate(stop, axis=1), 0, score)
    hits = np.append(np.zeros((len(room), 1), np.int64), np.cumsum(equal, axis=1), axis=1)
    length = np.where(score.max(axis=1) > 0, score.argmax(axis=1) + 1, 0)
    row = np.arange(len(room))
    matched = hits[row, length]
    return length, matched, hits[row, np.minimum(length + LEAST_WORDS, wide)] - matched


def align_all(words_a: np.ndarray, words_b: np.ndarray, off_a: np.ndarray, off_b: np.ndarray, first: np.ndarray, last: np.ndarray, diagonal: np.ndarray, k: int = K, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> tuple[np.ndarray, ...]:
    """(from, to, matched, sure) in each row's words of `a` for chains on one diagonal: what align() and widen() give, where `sure`.

    Row i's words are words_a[off_a[i]:off_a[i + 1]], its chain's seeds go from `first` to `last`, b's places are a's less
    `diagonal`. Not sure are chains with more than two edits between their seeds and those that widen() may yet draw out.
    """
    len_a, len_b = np.diff(off_a), np.diff(off_b)
    a, b = off_a[:-1] + first, off_b[:-1] + first - diagonal
    n, hits, more = _extend_all(words_a, words_b, a - 1, b - 1, np.minimum(first, first - diagonal), -1)
    end = last + k
    m, right, other = _extend_all(words_a, words_b, off_a[:-1] + end, off_b[:-1] + end - diagonal, np.minimum(len_a - end, len_b - end + diagonal), 1)
    size = end - first
    begin = np.cumsum(size) - size
    i = np.arange(size.sum()) - np.repeat(begin, size)
    inner = np.add.reduceat(words_a[np.repeat(a, size) + i] == words_b[np.repeat(b, size) + i], begin, dtype=np.int64) if len(size) else size
    start, stop, matched = first - n, end + m, inner + hits + right
    hopeless = (stop - start < least_words) & (matched + more + other < similarity * least_words)
    return start, stop, matched, (size - inner <= 2) & ((stop - start >= least_words) | hopeless)


def widen(a: list[int], b: list[int], found: tuple[int, int, int, int, int], least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> tuple[int, int, int, int, int]:
    """`found` by align(), drawn out in place to `least_words` words or more if the share still holds: x-drop leaves ends with many edits out."""
    fa, ta, fb, tb, matched = found
    short, long, n = min(ta - fa, tb - fb), max(ta - fa, tb - fb), least_words
    if short >= n:
        return found
    left = [p == q for p, q in zip(a[max(0, fa - n) : fa][::-1], b[max(0, fb - n) : fb][::-1])]
    right = [p == q for p, q in zip(a[ta : ta + n], b[tb : tb + n])]
    if matched + sum(left) + sum(right) < similarity * n:
        return found
    left, right = [0, *accumulate(left)], [0, *accumulate(right)]
    best = (-1e-9,)
    for l, m in enumerate(left):
        for r in range(max(0, n - short - l), len(right)):
            best = max(best, (matched + m + right[r] - similarity * (long + l + r), l, r))
    if len(best) == 1:
        return found
    _, l, r = best
    return fa - l, ta + r, fb - l, tb + r, matched + left[l] + right[r]


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs). texts: (id, t, n, least_id, copies) for each row, t the text's hash and n its number. pairs: (first,
    other, first_from, first_to, other_from, other_to, matched, similarity) for each passage of two texts by n, in words."""
    spark = df.sparkSession
    rows, stored = unique(df, id_col, text_col)
    texts = rows.join(stored.select("t", "n", "least_id", "copies"), "t").select("id", "t", "n", "least_id", "copies")

    path = "array<struct<a:int,b:int>>"

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("a", pa.int32()), ("b", pa.int32())])

        def give(link, ends, a, b, size):
            """A row for each chain: `ends` are (from a, to a, from b, to b), a, b the chains' seeds, `size` how many each has."""
            fa, ta, fb, tb = (np.asarray(x, np.int64) // MARGIN * MARGIN for x in ends)
            seeds_ = pa.StructArray.from_arrays([pa.array(np.asarray(x, np.int32)) for x in (a, b)], fields=list(point))
            paths = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), seeds_)
            cols = {"fa": fa, "ta": ta + MARGIN, "fb": fb, "tb": tb + MARGIN}
            return pa.record_batch({n: batch.column(n).take(pa.array(link)) for n in ("first", "other")} | {n: pa.array(x.astype(np.int32)) for n, x in cols.items()} | {"path": paths})

        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            link, a, b, alone = shared(batch)
            if not len(link):
                continue
            link, a, b, alone, plain = plain_chains(link, a, b, alone)
            going = plain & (alone | (np.bincount(link, minlength=batch.num_rows) > 1)[link])
            of, x, y = link[going], a[going], b[going]
            if len(of):
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                end = np.append(begin[1:], len(of)) - 1
                keep = np.zeros(len(of), bool)
                keep[begin] = keep[end] = True
                near = np.append((np.diff(x) <= k) & (of[1:] == of[:-1]), False)
                keep |= ~(near & np.append(False, near[:-1]))  # run_ends()
                yield give(of[begin], (x[begin], x[end] + k, y[begin], y[end] + k), x[keep], y[keep], np.bincount(of[keep])[of[begin]])
            rows, path = [], []
            rest = np.flatnonzero(~plain)
            cuts = np.flatnonzero(np.append(True, link[rest][1:] != link[rest][:-1])) if len(rest) else []
            for i, j in zip(cuts, [*cuts[1:], len(rest)]):
                at = rest[i:j]
                good = dict(zip(zip(a[at].tolist(), b[at].tolist()), alone[at].tolist()))
                for fa, ta, fb, tb, seeds_ in chains(a[at].tolist(), b[at].tolist(), k):
                    if len(seeds_) > 1 or good[seeds_[0]]:
                        path.append(run_ends(seeds_, k))
                        rows.append((link[at[0]], fa, ta, fb, tb))
            if rows:
                of, *ends = zip(*rows)
                yield give(np.array(of), ends, [p for x in path for p, _ in x], [q for x in path for _, q in x], [len(x) for x in path])
        trim()

    with scratch() as keep:
        links, have = seed_links(stored, k, window, least_words, similarity)
        chain = f"first long, other long, fa int, ta int, fb int, tb int, path {path}"
        found = by_rounds(links, "first", links.count(), lambda some: beside(some, have).mapInArrow(chained, chain), keep)
    release(spark)
    # The words around each chain's ends, cut at multiples of MARGIN so that chains of one passage share their stretch.
    spans = found.select(F.col("first").alias("n"), F.col("fa").alias("lo"), F.col("ta").alias("hi")).union(found.select("other", "fb", "tb")).distinct()
    wanted = spans.groupBy("n").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                w, h = word_hashes(part.column("text"))
                h = (h >> U(48)).astype(np.uint16)
                n, lo, hi, words = [], [], [], []
                for i, (key, want) in enumerate(zip(part.column("n").to_pylist(), part.column("spans").to_pylist())):
                    for s in want:
                        a = max(0, s["lo"] - MARGIN)
                        n.append(key), lo.append(s["lo"]), hi.append(s["hi"])
                        words.append(h[w.first[i] + a : w.first[i] + min(w.count[i], s["hi"] + MARGIN)].tobytes())
                yield pa.record_batch({"n": pa.array(n, pa.int64()), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32()), "words": pa.array(words, pa.binary())})
        trim()

    cut = Stored(stored.select("n", "text").join(wanted, "n").select("n", "text", "spans").mapInArrow(stretches, "n long, lo int, hi int, words binary")).df
    release(spark)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("first_from", "first_to", "other_from", "other_to", "matched")
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            words, off = zip(*(text_bytes(batch.column(c)) for c in ("wa", "wb")))
            words, off = [np.ascontiguousarray(w).view(np.uint16) for w in words], [o // 2 for o in off]
            path = batch.column("path")
            at = np.append(0, np.cumsum(path.value_lengths().to_numpy())).astype(np.int64)
            a, b = (path.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
            base_a, base_b = (np.maximum(0, batch.column(c).to_numpy().astype(np.int64) - MARGIN) for c in ("fa", "fb"))
            diagonal = a - b
            straight = np.maximum.reduceat(diagonal, at[:-1]) == np.minimum.reduceat(diagonal, at[:-1])
            start, stop, matched, sure = align_all(*words, *off, a[at[:-1]] - base_a, np.where(straight, a[at[1:] - 1], a[at[:-1]]) - base_a, diagonal[at[:-1]] - base_a + base_b, k, least_words, similarity)
            sure &= straight
            out = np.stack([start + base_a, stop + base_a, start + base_a - diagonal[at[:-1]], stop + base_a - diagonal[at[:-1]], matched], axis=1)
            for i in np.flatnonzero(~sure):
                x, y = (w[o[i] : o[i + 1]].tolist() for w, o in zip(words, off))
                seeds_ = list(zip((a[at[i] : at[i + 1]] - base_a[i]).tolist(), (b[at[i] : at[i + 1]] - base_b[i]).tolist()))
                fa, ta, fb, tb, n = widen(x, y, align(x, y, seeds_, k), least_words, similarity)
                out[i] = fa + base_a[i], ta + base_a[i], fb + base_b[i], tb + base_b[i], n
            share = out[:, 4] / np.maximum(1, np.maximum(out[:, 1] - out[:, 0], out[:, 3] - out[:, 2]))
            keep = np.flatnonzero((np.minimum(out[:, 1] - out[:, 0], out[:, 3] - out[:, 2]) >= least_words) & (share >= similarity - 1e-9))
            ids = {n: batch.column(n).take(pa.array(keep)) for n in ("first", "other")}
            yield pa.record_batch(ids | {n: pa.array(out[keep, i].astype(np.int32)) for i, n in enumerate(names)} | {"similarity": pa.array(share[keep])})
        trim()

    def worded(some: DataFrame) -> DataFrame:
        both = some.join(cut.toDF("other", "fb", "tb", "wb"), ["other", "fb", "tb"]).join(cut.toDF("first", "fa", "ta", "wa"), ["first", "fa", "ta"])
        return both.select("first", "other", "fa", "fb", "wa", "wb", "path").mapInArrow(
            aligned, "first long, other long, first_from int, first_to int, other_from int, other_to int, matched int, similarity double"
        )

    many = found.count()
    return texts, worded(found) if many <= ROUND else by_rounds(found, "other", many, worded, lambda t: t)


def without_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """`df` with the passages that an earlier text (by number) also has cut out of its texts; `length_col` follows. Rows keep their other columns.

    Copies of one text are all cut alike: choosing among them is near-dedup's task. What is left keeps its own spacing.
    """
    with scratch() as keep:
        texts, pairs = passages(df, id_col, text_col, **options)
        cuts = pairs.groupBy(F.col("other").alias("n")).agg(F.collect_list(F.struct("other_from", "other_to")).alias("cuts"))
        cuts = keep(Stored(texts.select(F.col("t").alias("_t"), "n").distinct().join(cuts, "n").select("_t", "cuts"))).df
    release(df.sparkSession)
    schema = df.schema
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = df.select(row, F.xxhash64(text).alias("_own")).join(cuts, F.col("_own") == F.col("_t"), "left").select("_row", "cuts")
    kept = joined.where("cuts IS NULL").select("_row.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column(0))
            texts = []
            w = Words(rows.column(text_col))
            for i, spans in enumerate(batch.column(1).to_pylist()):
                gone = np.zeros(w.count[i] + 1, bool)
                for s in spans:
                    gone[s["other_from"] : s["other_to"]] = True
                a, z = w.off[i], w.off[i + 1]
                keep = np.ones(z - a, bool)
                start = np.append(w.start[w.first[i] : w.first[i] + w.count[i]] - a, z - a)  # with the white space up to the next word
                for j in np.flatnonzero(gone[:-1]):
                    keep[start[j] : start[j + 1]] = False
                texts.append(w.buf[a:z][keep].tobytes())
            new = pa.array(texts, pa.binary()).cast(pa.string())
            import pyarrow.compute as pc

            cols = {n: new if n == text_col else pc.utf8_length(new).cast(rows.schema.field(n).type) if n == length_col else rows.column(n) for n in rows.schema.names}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return kept.union(joined.where("cuts IS NOT NULL").mapInArrow(cut, schema)).select(*(F.col(f"`{c}`") for c in df.columns))


def op3_passages(spark, sf_dir: str) -> DataFrame:
    """A row for each passage of two texts (by their least ids) and for each copy of a text of LEAST_WORDS words or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, pairs = passages(docs)
    texts = Stored(texts).df
    name = texts.select("n", "least_id").distinct()
    found = pairs.join(name.toDF("first", "other_id"), "first").join(name.toDF("other", "doc_id"), "other")
    found = found.select(F.lit("passage").alias("kind"), "doc_id", "other_id", F.col("other_from").alias("word_from"), F.col("other_to").alias("word_to"), F.col("first_from").alias("other_word_from"), F.col("first_to").alias("other_word_to"), "matched", F.round("similarity", 6).alias("similarity"))
    n = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    sizes = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("t"), n.alias("words")).where(F.col("words") >= LEAST_WORDS).groupBy("t").agg(F.first("words").alias("words"))
    copies = texts.where("copies > 1 AND id <> least_id").join(sizes, "t")
    zero = F.lit(0)
    return found.union(copies.select(F.lit("copy"), F.col("id"), "least_id", zero, "words", zero, "words", "words", F.lit(1.0)))
