"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride binary shards.

A keyed Feistel permutation over the next even power of two, walked along its cycles until it falls below the number
of sequences, gives every sequence its own global slot. Nothing is sorted by a random key and the order can be
computed again from the key alone. Slots are ranges of shards; each shard is written by one task, in slot order, so
record k of a shard begins at HEADER + k * stride bytes and a reader resumes by seeking.

Shard file: 32 bytes (8 magic, then little-endian unsigned: 4 version, 4 tokens to a record, 8 first slot, 8 records),
then records of 2 + 2 * tokens bytes: number of tokens, then the ids, padded with 0xFFFF, unsigned 16-bit.
"""

from __future__ import annotations

import atexit
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Stored, discard, shared_dir
from .textnum import mix, slices
from .tokens import byte_bpe

MAGIC = b"SPMILL01"
HEADER = 32
PAD = 0xFFFF
#: Bytes that a task gathers before it bundles them by shard.
BUNDLE = 64 << 20


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, applied to the values of `x`."""
    if n <= 0:
        return np.zeros(0, np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
        out = np.asarray(x).astype(np.uint64)
        walk = np.arange(len(out))
        while len(walk):
            a, b = out[walk] >> np.uint64(half), out[walk] & low
            for k in keys:
                a, b = b, a ^ (mix(b ^ k) & low)
            out[walk] = (a << np.uint64(half)) | b
            walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def stage(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 256, end_id: int = 50256) -> DataFrame:
    """(id, piece, n, ids): each text's ids and `end_id` in sequences of `tokens` at most, as little-endian 16-bit integers. Null texts: `end_id` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe(path, pattern)
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                row, piece, n, ids = [], [], [], []
                for i, t in enumerate(part.column("t").to_pylist()):
                    x = np.array([*enc.encode_ordinary(t or ""), end_id], "<u2")
                    for p, at in enumerate(range(0, len(x), tokens)):
                        y = x[at : at + tokens]
                        row.append(i), piece.append(p), n.append(len(y)), ids.append(y.tobytes())
                yield pa.record_batch({"id": part.column("id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "n": pa.array(n, pa.int32()), "ids": pa.array(ids, pa.binary())})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, piece int, n int, ids binary")


def slots(staged: DataFrame, key: int) -> tuple[DataFrame, int]:
    """`staged` (a table of files) with its sequences' slots, and their number.

    A sequence's number is its file's first number and its row in the file, both fixed once the table is written.
    """
    rows = staged.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    # One row for each file of the staged table, so a single window over them stays small (a file has 128 MB or so).
    base = files.select("_file", (F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    total = staged.count()

    @F.pandas_udf("long")
    def slot(x):
        import pandas as pd

        return pd.Series(feistel(x.to_numpy(), total, key))

    return rows.join(F.broadcast(base) if total < 1 << 32 else base, "_file").withColumn("slot", slot(F.col("_base") + F.col("_row"))).drop("_file", "_row", "_base"), total


def block(rows: pa.Table) -> bytes:
    """`rows` as one Arrow stream. At level 6 of zstandard a few hundred records take a sixth less than at Arrow's own level."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        w.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def write_shards(placed: DataFrame, total: int, out_dir: str, tokens: int = 256, shard: int = 8192) -> DataFrame:
    """Writes the shards and returns the manifest (id, piece, slot, shard, byte_offset, n_tokens, crc32), one row a sequence.

    The same rows give the same bytes. A shard is written under another name and moved into place when complete, so a
    task that runs again or twice does no harm. Evaluating the result writes the files.
    """
    record = np.dtype([("n", "<u2"), ("ids", "<u2", (tokens,))])
    kind = placed.schema["id"].dataType.simpleString()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task has for a shard travels as one compressed block: half the bytes of rows of their own."""

        def flush(held):
            t = pa.Table.from_batches(held)
            of = t.column("slot").to_numpy() // shard
            order = np.argsort(of, kind="stable")
            t, of = t.take(pa.array(order)), of[order]
            cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            blocks = [block(t.slice(x, y - x)) for x, y in zip(cut, np.append(cut[1:], len(of)))]
            return pa.record_batch({"shard": pa.array(of[cut]), "block": pa.array(blocks, pa.binary())})

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > BUNDLE:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(root, recursive=True)

        def write(at: int, blocks: list[bytes]) -> pa.RecordBatch:
            t = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blocks]).sort_by("slot").combine_chunks()
            slot = t.column("slot").to_numpy()
            rec = np.zeros(len(slot), record)
            rec["ids"] = PAD
            rec["n"] = t.column("n").to_numpy()
            crc = []
            for i, x in enumerate(t.column("ids").to_pylist()):
                rec["ids"][i, : len(x) // 2] = np.frombuffer(x, "<u2")
                crc.append(zlib.crc32(x))
            name = f"{root}/.shard-{at:08d}-{uuid.uuid4().hex}"
            with fs.open_output_stream(name) as sink:
                sink.write(struct.pack("<8sIIQQ", MAGIC, 1, tokens, at * shard, min(shard, total - at * shard)))
                sink.write(rec.tobytes())
            done = f"{root}/shard-{at:08d}.bin"
            if fs.get_file_info(done).type != pafs.FileType.NotFound:  # of a run before, with the same bytes; not all stores replace
                fs.delete_file(done)
            fs.move(name, done)
            one = lambda c: t.column(c).chunk(0) if t.column(c).num_chunks else pa.array([], t.column(c).type)
            return pa.record_batch({"id": one("id"), "piece": one("piece"), "slot": one("slot"), "shard": pa.array(np.full(len(slot), at)), "byte_offset": pa.array(HEADER + (slot - at * shard) * record.itemsize), "n_tokens": one("n"), "crc32": pa.array(crc, pa.int64())})

        at, blocks = -1, []
        for batch in batches:
            for k, x in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist()):
                if k != at and blocks:
                    yield write(at, blocks)
                    blocks = []
                at = k
                blocks.append(x)
        if blocks:
            yield write(at, blocks)

    bundled = placed.select("id", "piece", "n", "ids", "slot").mapInArrow(bundle, "shard long, block binary")
    dealt = bundled.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, f"id {kind}, piece int, slot long, shard long, byte_offset long, n_tokens int, crc32 long")


def read_shard(path: str, skip: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) of a shard in order, from its record `skip` on."""
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        magic, _, tokens, first, n = struct.unpack("<8sIIQQ", f.read(HEADER))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {path}")
        f.seek(HEADER + skip * (2 + 2 * tokens))
        for k in range(skip, n):
            x = np.frombuffer(f.read(2 + 2 * tokens), "<u2")
            yield first + k, x[1 : 1 + x[0]]


def materialise(df: DataFrame, out_dir: str, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", key: int = 42, tokens: int = 256, shard: int = 8192, end_id: int = 50256) -> DataFrame:
    """The whole operator: stage, number, permute, write. An empty table writes nothing. Repeated rows get slots of their own."""
    placed, total = slots(Stored(stage(df, path, pattern, id_col, text_col, tokens, end_id), level=9).df, key)
    return write_shards(placed, total, out_dir, tokens, shard)


def op6_materialise(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    atexit.register(discard, spark, out)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return materialise(docs, out, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).withColumnRenamed("id", "doc_id")
