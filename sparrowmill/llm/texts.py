"""What passages and near-dedup share: each different text once, and pairs of texts by the keys that several texts have.

paired() finds the keys as distributed string sorting finds duplicates before it exchanges strings: a task packs its
texts' keys for each cell (the leading bits of a key) into one message, sorted, as differences by byte planes, which
takes a few bytes a key where a row each takes twenty. A cell pairs what it finds in several texts; only pairs become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored, release
from .textnum import U, slices, trim

#: Keys of a cell, keys that a task holds before it packs them, bits of a key beyond its cell's, and occurrences of a key in a task beyond which they are paired there.
CELL, HELD, BITS, HOT = 1 << 19, 1 << 20, 40, 64


def unique(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows (id, t) for each row of `df`, t its text's hash; texts (n, t, least_id, copies, size, text) for each different text, stored.

    A null text is empty. The text is shuffled once; copies are dropped before that in each task, so many are no burden.
    """
    keyed = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    once = keyed.groupBy("t").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = Stored(once.select(F.monotonically_increasing_id().alias("n"), "t", "least_id", "copies", F.octet_length("text").alias("size"), "text")).df
    release(df.sparkSession)
    return keyed.select("id", "t"), texts


def _packed(columns: list[np.ndarray]) -> bytes:
    """Equally long arrays of whole numbers, the first ascending, as compressed byte planes; the second is counted from its least."""
    key, n, *more = columns
    least = n.min()
    parts = [np.diff(key, prepend=U(0)), (n - least).astype(U), *more]
    planes = b"".join(p.view(np.uint8).reshape(len(p), -1).T.tobytes() for p in parts)
    return np.array([len(key), least], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(data: bytes, extras: tuple) -> list[np.ndarray]:
    size, least = np.frombuffer(data, np.int64, 2).tolist()
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16:]), np.uint8)
    out, at = [], 0
    for kind in (U, U, *extras):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + width * size].reshape(width, size).T).view(kind)[:, 0])
        at += width * size
    out[0] = np.cumsum(out[0], dtype=U)
    out[1] = out[1].astype(np.int64) + least
    return out


def runs(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, several) of the runs of equal keys: whether the texts in it differ."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    several = np.minimum.reduceat(n, begin) != np.maximum.reduceat(n, begin) if len(key) else np.zeros(0, bool)
    return begin, size, several


def firsts(key: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
    """For each row of an ordered table the first with its key and, if given, its part."""
    if part is None:
        begin = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        return np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))
    order = np.lexsort((part, key))
    key, part = key[order], part[order]
    begin = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])) if len(key) else np.zeros(0, bool)
    out = np.empty(len(key), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))]
    return out


def stars(key: np.ndarray, n: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, row): each row beside the first of another text that has its key, and the first that also has each of its parts."""
    seen, left, right = [], [], []
    for part in (None, *parts):
        to = firsts(key, part)
        new = n[to] != n
        for x in seen:
            new &= to != x
        seen.append(to)
        left.append(to[new]), right.append(np.flatnonzero(new))
    return np.concatenate(left), np.concatenate(right)


def _messages(columns: list[np.ndarray], cells: int, parts: Callable | None) -> Iterator[tuple[int, bytes]]:
    """(cell, message) of one task's keys, texts and extras. Where very many of its texts have a key, they are paired by
    themselves, in cells below zero in turn, and only the first, for the key and its parts, meet those of other tasks.
    Without `parts` all of them meet in the key's cell."""
    order = np.lexsort((*columns[2:3], columns[1], columns[0]))
    for i, c in enumerate(columns):
        columns[i] = c[order]
    del order
    _, size, several = runs(*columns[:2])
    hot = np.repeat(several & (size > HOT) & (parts is not None), size)
    known = [c[hot] for c in columns]
    stay = ~hot
    if len(known[0]):
        lead = np.unique(np.concatenate([firsts(known[0], p) for p in (None, *parts(*known[2:]))]))
        stay[np.flatnonzero(hot)[lead]] = True
        begin, _, _ = runs(*known[:2])
        cuts = np.append(begin[np.searchsorted(begin, np.arange(0, len(known[0]), HELD // 8))[:-1]] if len(known[0]) > HELD // 8 else 0, len(known[0]))
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if a < z:
                yield -1 - (int(known[1][0]) + i) % cells, _packed([c[a:z] for c in known])
    columns = [c[stay] for c in columns]
    cuts = np.searchsorted(columns[0], np.arange(cells + 1, dtype=U) << U(BITS))
    for cell, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if a < z:
            yield cell, _packed([c[a:z] for c in columns])


def dealing(texts: DataFrame, each: int = 24) -> tuple[int, U]:
    """(cells, bits by which a key is shifted): how paired() deals the keys of `texts`."""
    total = texts.agg(F.sum("size")).first()[0] or 0
    cells = 1 << max(4, int(total // (each * CELL)).bit_length())
    return cells, U(64 - BITS - (cells.bit_length() - 1))


def paired(texts: DataFrame, extract: Callable[[pa.Array], tuple], extras: tuple, parts: Callable | None, pair: Callable, schema: str, each: int = 24) -> DataFrame:
    """What `pair` makes of the keys that several of `texts` (see unique) have.

    `extract` gives (row, 64-bit key, *extras) of a column of texts, extras being of the given numpy kinds; `pair` gets
    (key, n, *extras) of the occurrences of several keys, ordered by key, text and the first extra, and gives tables of
    `schema`; `parts` gives arrays of what, besides a key, tells occurrences apart, or is None. `each` is about how many bytes of text
    there are to a key. Keys are told apart by the bits of their cell and BITS more: different ones may rarely count as one.
    """
    cells, shift = dealing(texts, each)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def give():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            rows = list(_messages(columns, cells, parts))
            return pa.record_batch({"cell": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

        for batch in batches:
            for part in slices(batch, "text"):
                row, key, *more = extract(part.column("text"))
                held.append([key >> shift, part.column("n").to_numpy()[row], *(x.astype(kind) for x, kind in zip(more, extras))])
                size += len(key)
                if size > HELD:
                    yield give()
                    size = 0
        if size:
            yield give()
        trim()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*(_unpacked(d, extras) for b in batches for d in b.column("data").to_pylist()))]
        order = np.lexsort((*columns[2:3], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        _, size, several = runs(*columns[:2])
        keep = np.repeat(several, size)
        columns = [c[keep] for c in columns]
        for table in pair(*columns):
            yield from table.to_batches(max_chunksize=1 << 17)
        del columns, order, size, several, keep
        trim()

    found = Stored(texts.select("n", "text").mapInArrow(deal, "cell int, data binary").groupBy("cell").applyInArrow(settle, schema)).df
    release(texts.sparkSession)
    return found
