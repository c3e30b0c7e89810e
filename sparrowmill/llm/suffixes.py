"""Substring dedup by a sparse suffix array: every byte covered by a string of `width` bytes that starts anywhere else.

1. Each window of `width` bytes is assigned to its least `gram` by hash (the leftmost of equals), a choice that depends
   on the window alone. Runs of windows with one such anchor are segments: about width / 2 times fewer than suffixes.
   Equal windows have equal anchors at equal places, so only segments of one anchor need to meet.
2. Duplicate detection, as distributed string sorting does before it exchanges strings: segments whose anchor occurs
   once drop out, and segments that are equal to all others of their anchor are settled by their count.
3. The suffixes from the anchors of what is left, one for each different segment, are sorted by a distributed merge
   sort: each task sorts its own into runs, front-coded (the length of the common prefix with the one before and the
   rest), exchanges them, and a loser tree merges the runs by common prefix lengths, never comparing a known prefix again.
4. The sorted order and its common prefix lengths give, bottom up over the intervals of common prefixes, the furthest
   common extension to the left within each interval; a window with offset o before the anchor is repeated if some
   other segment agrees on o bytes to the left and width - o to the right.

An anchor with more than HOT different segments is not sorted in one place: its windows are counted by two 64-bit
hashes, combined before the shuffle, with the same result. Copies never meet in pairs, and equal segments are one.

Defined cases: a null text is empty; texts shorter than `width` lose nothing; repeated rows (also of one id) are
repeats of each other; a text that repeats itself counts; texts are whole, up to 4 GB each.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored, release
from .textnum import BYTE, P1, P2, Rolling, U, mix, sliding_min, slices, text_bytes

WIDTH, GRAM = 200, 64
#: Segments of an anchor beyond which its windows are counted instead; segments to a merging task.
HOT, MERGED = 1 << 15, 40_000


def segments(buf: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """row, first (window, in the row), m (windows), o (bytes from the first window's start to its anchor), h, c of each segment."""
    none = np.zeros(0, np.int64)
    if len(buf) < width:
        return {"row": none, "first": none, "m": none, "o": none, "h": none, "c": none}
    roll = Rolling(buf)
    h = roll.windows(gram)
    key = (h & ~U(0xFFFFFFFF)) | np.arange(len(h), dtype=U)
    anchor = (sliding_min(key, width - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    ok = np.arange(len(anchor)) + width <= off[1:][row]
    p = np.flatnonzero(ok)
    if not len(p):
        return {"row": none, "first": none, "m": none, "o": none, "h": none, "c": none}
    a = anchor[p]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)))
    start, m = p[new], np.diff(np.append(new, len(p)))
    a = a[new]
    with np.errstate(over="ignore"):
        c = roll.of(start, start + m - 1 + width) ^ mix((a - start).astype(U) * P2 + P1)
    return {"row": row[start], "first": start - off[row[start]], "m": m, "o": a - start, "h": h[a].view(np.int64), "c": c.view(np.int64)}


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while known < n:
        mid = (known + n + 1) // 2
        if a[known:mid] == b[known:mid]:
            known = mid
        else:
            n = mid - 1
    return known


def front_code(items: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (right, left reversed, h, c): counts, common prefix lengths, the rest of each right, lefts."""
    before, shared, tails = b"", [], []
    for right, *_ in items:
        n = common(before, right)
        shared.append(n), tails.append(right[n:])
        before = right
    head = np.array([[s, len(t), len(x[1])] for s, t, x in zip(shared, tails, items)], "<u2")
    keys = np.array([x[2:] for x in items], "<i8")
    return len(items).to_bytes(4, "little") + head.tobytes() + keys.tobytes() + b"".join(tails) + b"".join(x[1] for x in items)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(common prefix with the one before, right, left, h, c) in order."""
    n = int.from_bytes(run[:4], "little")
    head = np.frombuffer(run, "<u2", 3 * n, 4).reshape(n, 3).tolist()
    keys = np.frombuffer(run, "<i8", 2 * n, 4 + 6 * n).reshape(n, 2).tolist()
    at = 4 + 22 * n
    left_at = at + sum(x[1] for x in head)
    right = b""
    for (shared, tail, left), (h, c) in zip(head, keys):
        right = right[:shared] + run[at : at + tail]
        yield shared, right, run[left_at : left_at + left], h, c
        at, left_at = at + tail, left_at + left


def merge(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """All runs' items in order of (right, left), each with its common prefix length with the one before: a loser tree.

    Of two candidates the one with the longer common prefix with the last item out comes first; only equal lengths are
    compared, from that length on, and the loser keeps its common prefix length with the winner.
    """
    streams = [read_run(r) for r in runs]
    size = 1 << max(0, len(streams) - 1).bit_length()
    head: list = [next(s, None) for s in streams] + [None] * (size - len(streams))
    shared = [0] * size  # of each run's head with the last item out, or with the one that beat it
    tree = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser)."""
        a, b = head[x], head[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        ra, rb = a[1], b[1]
        n = common(ra, rb, shared[x])
        if n == len(ra) == len(rb):
            first = a[2] <= b[2]
        else:
            first = n == len(ra) or (n < len(rb) and ra[n] < rb[n])
        w, lo = (x, y) if first else (y, x)
        shared[lo] = n
        return w, lo

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, lo = play(build(2 * node), build(2 * node + 1))
        tree[node] = lo
        return w

    winner = build(1)
    while head[winner] is not None:
        _, right, left, h, c = head[winner]
        yield shared[winner], right, left, h, c
        head[winner] = next(streams[winner], None)
        shared[winner] = head[winner][0] if head[winner] else 0
        node = (winner + size) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def offsets(group: list[tuple[int, bytes, bytes]], width: int = WIDTH) -> list[int]:
    """For each (common prefix with the one before, right, left) of one anchor in order: a bit for each offset o at which
    some other agrees on o bytes to the left and width - o to the right. Intervals of common prefixes are merged bottom
    up, the smaller into the larger, in the order of the lefts, so each meets the nearest others on both sides."""
    g = len(group)
    lefts = [x[2] for x in group]
    order = sorted(range(g), key=lambda i: lefts[i])
    rank = [0] * g
    for r, i in enumerate(order):
        rank[i] = r
    out = [0] * g

    def meet(r: int, q: int, depth: int) -> None:
        i, j = order[r], order[q]
        n, least = common(lefts[i], lefts[j]), width - depth
        if n >= least:
            bits = ((1 << (n - least + 1)) - 1) << least
            out[i] |= bits
            out[j] |= bits

    def union(x: list[int], y: list[int], depth: int) -> list[int]:
        if len(x) < len(y):
            x, y = y, x
        for r in y:
            k = bisect_left(x, r)
            if k:
                meet(r, x[k - 1], depth)
            if k < len(x):
                meet(r, x[k], depth)
            x.insert(k, r)
        return x

    stack: list[tuple[int, list[int]]] = []  # (common prefix with the set below, ranks)
    for i, (shared, _, _) in enumerate(group):
        ranks, depth = [rank[i]], 0 if i == 0 else min(shared, width)
        while stack and len(stack) > 1 and stack[-1][0] > depth:
            d, top = stack.pop()
            below_d, below = stack.pop()
            stack.append((below_d, union(below, top, d)))
        stack.append((depth, ranks))
    while len(stack) > 1:
        d, top = stack.pop()
        below_d, below = stack.pop()
        stack.append((below_d, union(below, top, d)))
    return out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return t.select("id", "t", F.xxhash64("id", "t").alias("k1"), F.xxhash64("t", "id", F.lit(7)).alias("k2"))


def repeated_segments(keyed: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, first, m, o, mask) for the segments of `keyed` (id, t, k1, k2) with a repeated window; a null mask: all of them, else the offsets of those that are."""
    spark = keyed.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 19):
                s = segments(*text_bytes(part.column("t")), width, gram)
                row = pa.array(s["row"])
                yield pa.record_batch({"k1": part.column("k1").take(row), "k2": part.column("k2").take(row), "at": pa.array((s["first"] << 20) | (s["m"] << 10) | s["o"]), "h": pa.array(s["h"]), "c": pa.array(s["c"])})

    all_ = Stored(keyed.select("k1", "k2", "t").mapInArrow(cut, "k1 long, k2 long, at long, h long, c long"))
    s = all_.df
    # Stored, so that both sides of the joins are exchanged and a hot anchor's segments can be split over tasks.
    found = Stored(s.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1").select("h", (F.col("lo") != F.col("hi")).alias("several"))).df
    release(spark)
    met = Stored(s.join(found, "h")).df
    release(spark)
    all_.drop()
    several = met.where("several")
    one = Stored(several.groupBy("h", "c").agg(F.min(F.struct("k1", "k2", "at")).alias("x")).select("h", "c", "x.*")).df
    hot = one.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h", F.lit(True).alias("hot"))
    wanted = one.join(hot, "h", "left").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("want"))
    source = keyed.select("k1", "k2", "t").join(wanted, ["k1", "k2"])
    targets = one.count() // MERGED + 1

    def run_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs for the merging tasks, and the windows' hashes of hot anchors."""
        cols = ("target", "run", "w1", "w2", "h", "c", "o")

        def give(target, run, w=None):
            n = len(target) if w is None else len(w[0])
            none = [None] * n
            v = [target, run, none, none, none, none, none] if w is None else [none, none, *w]
            return pa.record_batch(dict(zip(cols, (pa.array(x, t) for x, t in zip(v, (pa.int32(), pa.binary(), *[pa.int64()] * 4, pa.int32()))))))

        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                for t, want in zip(part.column("t").cast(pa.binary()).to_pylist(), part.column("want").to_pylist()):
                    roll = None
                    for x in want:
                        first, m, o = x["at"] >> 20, x["at"] >> 10 & 1023, x["at"] & 1023
                        a = first + o
                        if x["hot"]:
                            bytes_ = np.frombuffer(t, np.uint8)
                            roll = roll or (Rolling(bytes_), Rolling(mix(BYTE[bytes_] ^ P1)))
                            w = np.arange(first, first + m)
                            w1, w2 = (r.of(w, w + width).view(np.int64) for r in roll)
                            yield give(None, None, (w1, w2, np.full(m, x["h"]), np.full(m, x["c"]), (a - w).astype(np.int32)))
                        else:
                            held.setdefault(x["h"] % targets, []).append((t[a : first + m - 1 + width], t[first:a][::-1], x["h"], x["c"]))
                            size += m + width
                if size > 16 << 20:
                    yield give(list(held), [front_code(sorted(v)) for v in held.values()])
                    held, size = {}, 0
        if held:
            yield give(list(held), [front_code(sorted(v)) for v in held.values()])

    runs = Stored(source.mapInArrow(run_out, "target int, run binary, w1 long, w2 long, h long, c long, o int"))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, list[int]]] = []
        group: list = []

        def settle():
            if len(group) > 1:
                for x, bits in zip(group, offsets([y[:3] for y in group], width)):
                    if bits:
                        out.append((x[3], x[4], [o for o in range(width + 1) if bits >> o & 1]))

        for item in merge(list(pdf["run"])):
            if item[0] < gram:
                settle()
                group = []
            group.append(item)
        settle()
        return pd.DataFrame(out, columns=["h", "c", "mask"])  # the offsets at which a window is repeated

    masks = runs.df.where("target is not null").select("target", "run").groupBy("target").applyInPandas(merged, "h long, c long, mask array<int>")
    windows = runs.df.where("target is null").select("w1", "w2", "h", "c", "o")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    masks = masks.union(windows.join(twice, ["w1", "w2"]).groupBy("h", "c").agg(F.collect_set("o").alias("mask")))
    masks = Stored(masks).df
    release(spark)
    # Equal segments of an anchor with several: all of their windows are repeated, whatever the others are.
    counted = Stored(several.groupBy("h", "c").agg(F.count("*").alias("n")).join(masks, ["h", "c"], "left").where("n > 1 OR mask is not null").select("h", "c", F.when(F.col("n") == 1, F.col("mask")).alias("mask"))).df
    out = met.where("NOT several").select("k1", "k2", "at", F.lit(None).cast("array<int>").alias("mask")).union(several.join(counted, ["h", "c"]).select("k1", "k2", "at", "mask"))
    return out.select("k1", "k2", F.shiftright("at", 20).alias("first"), F.shiftright("at", 10).bitwiseAND(F.lit(1023)).cast("int").alias("m"), F.col("at").bitwiseAND(F.lit(1023)).cast("int").alias("o"), "mask")


def covered(n: int, first: np.ndarray, m: np.ndarray, o: np.ndarray, masks: list, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs (start, end) of the bytes that the repeated windows cover."""
    edge = np.zeros(n + 1, np.int64)
    whole = np.array([x is None for x in masks], bool)
    np.add.at(edge, first[whole], 1), np.add.at(edge, first[whole] + m[whole] - 1 + width, -1)
    for i in np.flatnonzero(~whole):
        w = first[i] + np.flatnonzero(np.isin(o[i] - np.arange(m[i]), masks[i]))
        np.add.at(edge, w, 1), np.add.at(edge, w + width, -1)
    on = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    return np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(on[:-1] & ~on[1:])


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, keep_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept_sha256[, kept]) for each row; spans: the removed runs of bytes, kept: what remains."""
    keyed = _keyed(df, id_col, text_col)
    found = Stored(repeated_segments(keyed, width, gram)).df
    lists = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "m", "o", "mask")).alias("s"))
    kind = df.schema[id_col].dataType.simpleString()
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                s = part.column("s")
                off = np.append(0, np.cumsum([0 if x is None else x for x in s.value_lengths().to_pylist()])).astype(np.int64)
                flat = s.flatten()
                first, m, o = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                masks = flat.field(3).to_pylist()
                n, gone, spans, sha, kept = [], [], [], [], []
                for i, t in enumerate(part.column("t").cast(pa.binary()).to_pylist()):
                    a, z = off[i], off[i + 1]
                    start, end = covered(len(t), first[a:z], m[a:z], o[a:z], masks[a:z], width) if z > a else (np.zeros(0, np.int64),) * 2
                    at, rest = 0, []
                    for x, y in zip(start.tolist(), end.tolist()):
                        rest.append(t[at:x])
                        at = y
                    rest = b"".join([*rest, t[at:]])
                    n.append(len(t)), gone.append(len(t) - len(rest)), spans.append([{"start": x, "end": y} for x, y in zip(start.tolist(), end.tolist())])
                    sha.append(hashlib.sha256(rest).hexdigest())
                    if keep_bytes:
                        kept.append(rest)
                out = {"id": part.column("id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array([len(x) for x in spans], pa.int64()), "spans": pa.array(spans, pairs), "kept_sha256": pa.array(sha, pa.string())}
                yield pa.record_batch(out | ({"kept": pa.array(kept, pa.binary())} if keep_bytes else {}))

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * keep_bytes
    return keyed.join(lists, ["k1", "k2"], "left").select("id", "t", "s").mapInArrow(cut, schema)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs, keep_bytes=False).withColumnRenamed("id", "doc_id")
