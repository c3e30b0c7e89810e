"""Best-fit packing by minimum bin slack.

Only the histogram of lengths decides: it has at most `capacity` entries, whatever the number of documents, so it is
planned on the driver. Per bin, the longest length left is taken and a bitset subset-sum over the others finds the
fullest feasible combination; it is removed as often as the counts allow. The bins' layout is then joined back to
the pieces by (length, rank), with ranks dealt by salted windows, so no length gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Stored
from .textnum import slices
from .tokens import word_bpe


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """{length: times} of one bin: the longest length left and, of the others, a combination that leaves the least slack."""
    first = max(counts)
    room = capacity - first
    mask, sums, layers = (1 << (room + 1)) - 1, 1, []
    for n in sorted(counts, reverse=True):
        left = min(counts[n] - (n == first), room // n)
        step = 1
        while left > 0 and not sums >> room & 1:
            t = min(step, left)
            layers.append((n, t, sums))
            sums |= (sums << (n * t)) & mask
            left, step = left - t, step * 2
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, {first: 1}
    for n, t, before in reversed(layers):
        if not before >> at & 1:
            at -= n * t
            out[n] = out.get(n, 0) + t
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(bin's lengths, how many such bins)] for all of `histogram` {length: count}."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    out = []
    while counts:
        bin_ = fullest(counts, capacity)
        times = min(counts[n] // t for n, t in bin_.items())
        for n, t in bin_.items():
            counts[n] -= t * times
            if not counts[n]:
                del counts[n]
        out.append((bin_, times))
    return out


def layout(bins: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """A row for each length of each kind of bin: the ranks that it takes, the first bin, how many to a bin, and where in it."""
    rows, ranks, base = [], {}, 0
    for bin_, times in bins:
        at = 0
        for n in sorted(bin_, reverse=True):
            t = bin_[n]
            lo = ranks.get(n, 0)
            ranks[n] = lo + t * times
            rows.append((n, lo, ranks[n], base, t, at))
            at += n * t
        base += times
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "base", "each", "at"]).astype("int64")


def token_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) : each text's ids and `end_id`, cut into pieces of `capacity` if longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, x in enumerate(bpe.encode([t or "" for t in part.column("t").to_pylist()])):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    for p, at in enumerate(range(0, len(x), capacity)):
                        y = x[at : at + capacity]
                        row.append(i), piece.append(p), start.append(at), length.append(len(y)), crc.append(zlib.crc32(y.tobytes()))
                        if keep_ids:
                            ids.append(y.astype(np.int32))
                cols = {"id": part.column("id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.record_batch(cols | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if keep_ids else {}))

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


#: About so many pieces share a salt; ranks are dealt within (length, salt).
RANKED = 4_000


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """`pieces` (id, piece, length, ids_crc32, ...) with sequence_id and offset: bins of at most `capacity`, gapless from 0.

    The lengths are counted twice: by (length, salt) for the ranks' bases and, summed, for the plan. `pieces` should be
    stored. Repeated rows are packed as often as they stand there; null ids are packed like others.
    """
    spark = pieces.sparkSession
    salts = pieces.count() // RANKED + 1
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    counts = Stored(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))).df
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    table = layout(plan(histogram, capacity))
    base = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    rank = F.row_number().over(W.partitionBy("length", "_salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_own", rank).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    # The layout grows with the number of different lengths (2,048 at most), not with the data.
    bins = F.broadcast(spark.createDataFrame(table, "length long, rank_from long, rank_to long, base long, each long, at long").toDF("_len", "_lo", "_hi", "_base", "_each", "_at"))
    placed = ranked.join(bins, (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    k = F.col("_rank") - F.col("_lo")
    return placed.select(
        *pieces.columns,
        (F.col("_base") + F.floor(k / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(k, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = Stored(token_pieces(docs, P.path("word_bpe_49k.json"), keep_ids=False)).df
    return pack(pieces).withColumnRenamed("id", "doc_id")
