"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into `max_distance // 2 + 1` segments, so that of two fingerprints within
`max_distance` bits one segment differs by at most one bit. For each segment every variant with one bit wildcarded
is indexed; two values within one bit of each other share a variant. An equality join on (segment, wildcard, rest),
by its hash, finds the candidates and the join's condition verifies them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored, release, scratch
from .components import components
from .textnum import U, Words, mix, slices, xxh64
from .texts import dealing, paired, runs, unique

#: Occurrences of a shingle that each of them meets in one task.
SPLIT_KEY = 4096
#: Texts, about, and shingles that say which shingles are frequent. That is an order only: any gives the same pairs, this one few candidates.
SAMPLE, OFTEN = 8192, 1 << 17
#: 64-bit words of a wide fingerprint, and bits in which those of two candidates may differ. Sets at a Jaccard coefficient of 0.8
#: differ in 39 of 256 on average with a deviation of 6, so 96 are nine beyond; unrelated ones differ in 128 with a deviation of 8.
WORDS, FAR = 4, 96
#: 64-bit words of a set's parities.
PARITY = 4
#: Shared variants up to which they are broadcast, and fingerprints whose variants one task makes.
BROADCAST, SPLIT = 200_000, 20_000
_SPREAD = np.array([sum(((v >> (7 - j)) & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)


def bit_counts(h: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """(rows, 64): how many of a row's hashes have each bit, most significant first. Eight counters of 8 bits share a word; 255 fit."""
    out = np.zeros((rows, 64), np.int64)
    if not len(h):
        return out
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(first, len(doc)))
    parts = (size + 254) // 255
    group = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    by_doc = np.cumsum(parts) - parts
    bytes_ = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_SPREAD[bytes_[:, j]], group)
        out[doc[first], 8 * j : 8 * j + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), by_doc, axis=0, dtype=np.int64)
    return out


def simhash(column: pa.Array, width: int = 3, seed: int = 42, distinct: bool = False) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if over half of the shingles' hashes have it, repeats included unless `distinct`. No word: zero."""
    if distinct:
        doc, h = _shingle_sets(column, width, seed)
    else:
        w = Words(column, lower=True)
        doc, start, length = w.shingles(width)
        h = xxh64(w.joined, start, length, seed)
    counts = bit_counts(h, doc, len(column))
    total = np.bincount(doc, minlength=len(column))[:, None]
    return np.packbits(2 * counts > total, axis=1).view(">u8")[:, 0].astype(np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, distinct: bool = False) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit integer. One pass over the text, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.record_batch({"id": part.column("id"), "fp": pa.array(simhash(part.column("t"), width, seed, distinct).view(np.int64))})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _segments(fp: Column, max_distance: int) -> list[tuple[Column, int]]:
    n = max_distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)), hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b): pairs of different fingerprints in `fps` (fp, distinct) at `max_distance` bits or fewer, enough to join all that any such pairs join.

    Of the fingerprints that share a variant the least is the leader, and those within the distance are linked to it. Only
    where that leaves several groups, what is outside of a variant's largest one is compared with all that share it, and one
    link for each pair of groups is kept. So a group of n near copies gives about n links.
    """
    if not 1 <= max_distance <= 15:
        raise ValueError("max_distance must be 1 to 15")
    variants = F.array(
        *(F.xxhash64(F.lit(s * 64 + i), seg.bitwiseAND(F.lit(_signed(~(1 << i))))) for s, (seg, n) in enumerate(_segments(F.col("fp"), max_distance)) for i in range(n))
    )

    def near(x: str, y: str) -> Column:
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= max_distance

    # A few bytes a row make few splits, and each row sixty-four: dealt so that a task has no more than SPLIT to explode.
    index = fps.repartition(fps.count() // SPLIT + 1).select("fp", F.explode(variants).alias("v"))
    shared = Stored(index.groupBy("v").agg(F.min("fp").alias("leader"), F.max("fp").alias("hi")).where("leader <> hi").select("v", "leader")).df
    release(fps.sparkSession)
    # The planner takes the index, which it sees before it is exploded, for small; so what is broadcast is said here.
    members = Stored(index.join(F.broadcast(shared), "v") if shared.count() <= BROADCAST else index.hint("merge").join(shared, "v")).df
    release(fps.sparkSession)
    stars = Stored(members.where((F.col("leader") != F.col("fp")) & near("leader", "fp")).select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct()).df
    roots = components(stars)
    of = members.select("v", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("v", "fp", F.coalesce("root", "fp").alias("group"))
    of = Stored(of).df
    groups = of.groupBy("v", "group").agg(F.count("*").alias("n")).groupBy("v").agg(F.max(F.struct("n", "group")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    mixed = Stored(of.join(groups.select("v", F.col("most.group").alias("main")), "v")).df
    others = mixed.where("group <> main").select("v", F.col("fp").alias("a"), F.col("group").alias("g"))
    found = others.join(mixed.select("v", F.col("fp").alias("b"), F.col("group").alias("h")), "v").where((F.col("g") != F.col("h")) & near("a", "b"))
    found = found.groupBy(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).agg(F.min(F.struct("a", "b")).alias("x"))
    return stars.union(found.select("x.a", "x.b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, max_distance: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row of `df`.

    component_id: the least id in the connected component of the links, the row's own included. Equal fingerprints
    (empty and null texts have zero) are always linked. Repeated rows stay; null ids are ignored by the least, and a
    component of null ids alone has a null. Only the distinct fingerprints are joined, copies never meet in pairs.
    """
    fps = Stored(fingerprints(df, id_col, text_col, width, seed)).df
    with scratch() as keep:
        nodes = Stored(fps.groupBy("fp").agg(F.min("id").alias("least"))).df
        roots = components(links(nodes.select("fp"), max_distance))
        grouped = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
        named = keep(Stored(grouped.join(least, "root").select("fp", "component_id")))
    release(df.sparkSession)
    return fps.join(named.df, "fp").select("id", "fp", "component_id")


def _shingle_sets(column: pa.Array, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, ascending by both."""
    w = Words(column, lower=True)
    doc, start, length = w.shingles(width)
    h = xxh64(w.joined, start, length, seed)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The (a, b) of `pairs` whose texts' shingle sets have a Jaccard coefficient of `similarity` or more. `texts` (n, text) has each n once.

    A set travels as the sorted 32-bit halves of its hashes, so in one pair of a hundred thousand a shingle counts as shared that isn't.
    """
    wanted = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, h = _shingle_sets(part.column("text"), width)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                h = (h >> np.uint64(32)).astype(np.uint32)
                yield pa.record_batch({"n": part.column("n"), "s": pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())})

    known = Stored(texts.join(wanted, "n").select("n", "text").mapInArrow(sets, "n long, s binary")).df.hint("merge")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                both = int((both[1:] == both[:-1]).sum())
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(compare, "a long, b long")


def _verified_roots(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, root) of the components of the verified `pairs`. Each text's pair with its least partner is looked at first; of the
    others only those are that would join what isn't joined yet."""
    spark = pairs.sparkSession
    pairs = Stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()).df
    release(spark)
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    ok = Stored(verified(first, texts, width, similarity)).df
    release(spark)
    roots = Stored(components(ok)).df
    rest = pairs.join(first, ["a", "b"], "left_anti").join(roots.toDF("a", "x"), "a", "left").join(roots.toDF("b", "y"), "b", "left")
    rest = Stored(rest.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")).df
    more = Stored(verified(rest, texts, width, similarity)).df
    release(spark)
    return components(ok.union(more))


def often(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, U]:
    """(key, count, shift): the shingles that the most of about SAMPLE of `texts` (see texts.unique) have, ascending by `key`, a hash less its `shift` lowest bits."""
    sample = texts.where(F.pmod("t", F.lit(max(1, texts.count() // SAMPLE))) == 0).select("n", "text", "size")

    def count(key, n):
        begin, many, _ = runs(key, n)
        yield pa.table({"key": pa.array(key[begin].view(np.int64)), "many": pa.array(many.astype(np.int64))})

    found = paired(sample, lambda column: _shingle_sets(column, width), (), None, count, "key long, many long")
    rows = found.where("many > 2").orderBy(F.desc("many"), "key").limit(OFTEN).toArrow()
    key, many = rows.column("key").to_numpy().view(np.uint64), rows.column("many").to_numpy()
    order = np.argsort(key)
    return key[order], many[order].astype(np.int32), dealing(sample)[1]


def prefixes(column: pa.Array, width: int, similarity: float, known: tuple | None = None) -> tuple[np.ndarray, ...]:
    """(row, hash, size of the set, place in the set) of each text's prefix: of a set of n shingles, the rare first (see often();
    then in order of their hashes), the first n - ceil(similarity * n) + 1. Two sets of the similarity share a shingle of both prefixes."""
    row, h = _shingle_sets(column, width)
    if known is not None and len(known[0]):
        key, many, shift = known
        at = np.minimum(np.searchsorted(key, h >> shift), len(key) - 1)
        order = np.lexsort((h, np.where(key[at] == h >> shift, many[at], 0), row))
        row, h = row[order], h[order]
    size = np.bincount(row, minlength=len(column))
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    keep = place < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[row]
    return row[keep], h[keep], size[row[keep]].astype(np.uint32), place[keep].astype(np.uint32)


def shared_prefixes(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(key, n, size, place, least): a row for each of `texts` (see texts.unique) and each shingle that its prefix shares with another's;
    `size` is its set's, `place` the shingle's in it, `least` the first text with the shingle. As many rows as occurrences, whatever the number of a shingle's texts."""

    def pair(key, n, size, place):
        begin, many, _ = runs(key, n)
        least = np.repeat(n[begin], many)
        yield pa.table({"key": pa.array(key.view(np.int64)), "n": pa.array(n), "size": pa.array(size.astype(np.int64)), "place": pa.array(place.astype(np.int64)), "least": pa.array(least)})

    known = often(texts, width)
    return paired(texts, lambda column: prefixes(column, width, similarity, known), (np.uint32, np.uint32), None, pair, "key long, n long, size long, place long, least long")


def parities(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """(rows, PARITY): for each of 64 * PARITY classes of hashes whether a row has an odd number of them. An element that one of two
    sets lacks changes one bit, so where d bits differ, d elements or more do."""
    bit = (mix(h) >> U(32)) % U(64 * PARITY)
    count = np.bincount(row * 64 * PARITY + bit.astype(np.int64), minlength=rows * 64 * PARITY).reshape(rows, 64 * PARITY)
    return np.packbits((count & 1).astype(np.uint8), axis=1).view(U)


def wide(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """(n, m, w0, ..., p0, ...): the size of each text's set of shingles, WORDS fingerprints of it, by as many hashes, and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, h = _shingle_sets(part.column("text"), width, seed)
                total = np.bincount(row, minlength=part.num_rows)[:, None]
                cols = {"n": part.column("n"), "m": pa.array(total[:, 0])}
                for i in range(WORDS):
                    counts = bit_counts(mix(h + np.uint64(i)), row, part.num_rows)
                    cols[f"w{i}"] = pa.array(np.packbits(2 * counts > total, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64))
                odd = parities(row, h, part.num_rows)
                yield pa.record_batch(cols | {f"p{i}": pa.array(np.ascontiguousarray(odd[:, i]).view(np.int64)) for i in range(PARITY)})

    return texts.select("n", "text").mapInArrow(run, "n long, m long, " + ", ".join([f"w{i} long" for i in range(WORDS)] + [f"p{i} long" for i in range(PARITY)]))


def _close(x: str, y: str, similarity: float) -> Column:
    """Whether the wide fingerprints of `x` and `y` differ in FAR bits at most, and their parities in no more than sets of the similarity may."""

    def apart(kind: str, n: int) -> Column:
        bits = [F.bit_count(F.col(f"{x}.{kind}{i}").bitwiseXOR(F.col(f"{y}.{kind}{i}"))) for i in range(n)]
        return sum(bits[1:], bits[0])

    most = (1 - similarity) / (1 + similarity) * (F.col(f"{x}.m") + F.col(f"{y}.m")) + 1e-6
    return (apart("w", WORDS) <= FAR) & (apart("p", PARITY) <= most)


def across(members: DataFrame, roots: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of `members` (see shared_prefixes) all pairs that share a shingle, are in different components by `roots` (node,
    root), and may be similar by their sizes, what is left of their sets from the shingle on, and `known` (see wide). Pairs of one component could join nothing more."""
    of = members.join(roots.toDF("n", "root"), "n", "left").select("key", "n", "size", "place", F.coalesce("root", "n").alias("root"))
    mixed = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / SPLIT_KEY).cast("int").alias("parts")).where("lo < hi").select("key", "parts")
    of = Stored(of.join(mixed, "key").join(known, "n").withColumn("part", F.pmod(F.xxhash64("n"), "parts").cast("int"))).df
    every = of.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = of.alias("x"), every.alias("y").hint("merge")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.n") < F.col("y.n")) & (F.col("x.root") != F.col("y.root"))
    on &= F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-9
    # What sets of the similarity have in common, against what is left of both from their first common shingle on.
    on &= F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6
    return x.join(y, on & _close("x", "y", similarity)).select(F.col("x.n").alias("a"), F.col("y.n").alias("b")).distinct()


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_distance: int = 3, seed: int = 42) -> DataFrame:
    """(id, component_id): near duplicates by `width`-word shingles, with an exact check of the sets.

    Candidates are the links of the texts' fingerprints, texts of one fingerprint beside the least of them, and, as texts of
    the similarity may differ in more bits than an index can bridge, those that share a shingle of their prefixes, differ in
    FAR of 256 bits at most and have parities that allow the similarity: first with the least text of each shingle, then all pairs of texts that are not joined yet. A link is a candidate whose shingle sets have a Jaccard coefficient of `similarity` or more. Equal texts are one node.
    """
    with scratch() as keep:
        rows, texts = unique(df, id_col, text_col)
        fps = Stored(fingerprints(texts, "n", "text", width, seed, distinct=True)).df
        of = Stored(fps.groupBy("fp").agg(F.min("id").alias("node"))).df
        same = fps.join(of, "fp").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
        near = links(of.select("fp"), max_distance).join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        members = shared_prefixes(texts, width, similarity)
        known = Stored(wide(texts, width, seed)).df
        first = members.where("n <> least").select(F.col("least").alias("a"), F.col("n").alias("b")).distinct().alias("p")
        plausible = first.join(known.alias("x"), F.col("p.a") == F.col("x.n")).join(known.alias("y"), F.col("p.b") == F.col("y.n")).where(_close("x", "y", similarity)).select("p.a", "p.b")
        roots = Stored(_verified_roots(same.union(near).union(plausible), texts.select("n", "text"), width, similarity)).df
        release(df.sparkSession)
        more = _verified_roots(across(members, roots, known, similarity), texts.select("n", "text"), width, similarity)
        roots = components(roots.toDF("a", "b").union(more.toDF("a", "b")))
        grouped = texts.select("n", "t", "least_id").join(roots, F.col("n") == F.col("node"), "left").select("t", "least_id", F.coalesce("root", "n").alias("root"))
        named = keep(Stored(grouped.join(grouped.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("t", "component_id")))
    release(df.sparkSession)
    return rows.join(named.df, "t").select("id", "component_id")


def deduplicate(df: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `df` with one id of each of `groups` (id, component_id): the least. Rows that share an id are one document; null ids go with a group that has another."""
    kept = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_kept")).distinct()
    return df.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")), "left_semi")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, width=3, seed=42, max_distance=3)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
