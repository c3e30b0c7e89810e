"""Byte-level BPE by a monoid tree reduction.

A text is encoded by halves. Two neighbours x and y are joined by re-encoding a window around their border. A place
where white space follows another character is a sure border: no alternative of the pattern matches across it, no
alternative looks back, and what stands left of it ends its match there whatever follows. So tokens left of the last
sure border of x and right of the first of y can't change; the window between them, which grows (doubles) until it
reaches both or the texts' ends, is encoded anew. Decoding concatenates up the same tree.

A null text counts as empty: no ids. Very long texts cost n log n; a stretch without white space is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import slices
from .tokens import byte_bpe

#: A character that isn't white space, then white space. The regex module's \s is what the pattern's \s is.
_SURE = regex.compile(r"\S(?=\s)")
#: How much of each side a window takes at first.
_WINDOW = 64
#: Characters (or ids) that are encoded (or decoded) at once, at the tree's leaves.
LEAF = 1024


class Tree:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        self.enc, self.leaf = byte_bpe(path, pattern), leaf

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.enc.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, x: list[int], y: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        tail, head = self._last(text, lo, mid), self._first(text, mid, hi)
        left = len(self.enc.encode_ordinary(text[tail:mid]))
        right = len(self.enc.encode_ordinary(text[mid:head]))
        return x[: len(x) - left] + self.enc.encode_ordinary(text[tail:head]) + y[right:]

    @staticmethod
    def _last(text: str, lo: int, mid: int) -> int:
        n = _WINDOW
        while True:
            at = max(lo, mid - n)
            if found := [m.end() for m in _SURE.finditer(text, at, mid)]:
                return found[-1]
            if at == lo:
                return lo
            n *= 2

    @staticmethod
    def _first(text: str, mid: int, hi: int) -> int:
        n = _WINDOW
        while True:
            at = min(hi, mid + n)
            if found := _SURE.search(text, mid, at):
                return found.end()
            if at == hi:
                return hi
            n *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.enc.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id, ids array<int>) for each row of `df`: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(path, pattern, leaf)
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.record_batch({"id": part.column("id"), "ids": pa.array([tree.encode(t or "") for t in part.column("t").to_pylist()], pa.list_(pa.int32()))})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids", leaf: int = LEAF) -> DataFrame:
    """(id, bytes binary) for each row: the bytes of its ids. A null list counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(path, pattern, leaf)
        for batch in batches:
            yield pa.record_batch({"id": batch.column("id"), "bytes": pa.array([tree.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())})

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, digest and decode in one pass, so the ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(path, pattern, leaf)
        for batch in batches:
            for part in slices(batch, "t"):
                n, a, b = [], [], []
                for t in part.column("t").to_pylist():
                    ids = tree.encode(t or "")
                    n.append(len(ids))
                    a.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(tree.decode(ids)).hexdigest())
                yield pa.record_batch({"id": part.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).withColumnRenamed("id", "doc_id")
