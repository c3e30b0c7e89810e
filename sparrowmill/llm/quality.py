"""Quality rules: counts of words, lines and repeats, then compression bands.

zstandard's ratio (compressed to plain bytes) of the whole text and of each fixed chunk must lie within limits that
depend on the length: a low ratio means repetition, a high one text that is not language. Repeated words and lines
are found by 64-bit hashes of whole words, windows and lines within a text.

Defined cases: a null or empty text has no word and fails the base rule; a text below the smallest length of the
bands is judged by the base rule alone; a very long text is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import P1, Rolling, U, Words, mix, slices

#: (bytes from, least ratio, greatest ratio) of whole texts. Longer texts compress better, so limits fall with length.
BANDS = ((64, 0.35, 1.25), (128, 0.40, 1.05), (256, 0.45, 0.90), (512, 0.42, 0.82), (1024, 0.39, 0.77), (2048, 0.36, 0.72), (4096, 0.33, 0.70), (8192, 0.30, 0.68), (16384, 0.26, 0.66), (65536, 0.22, 0.66))
#: Chunks of so many bytes (a last one of half of it or more counts), their limits, and the share of them that may lie outside.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 1024, (0.30, 0.80), 0.25
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _per_row(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flag, dtype=np.int64))
    return total[off[1:]] - total[off[:-1]]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which values stand there twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order] = np.append(same, False) | np.append(False, same) if len(key) else out
    return out


def base_counts(column: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = Words(column)
    roll = Rolling(w.buf)
    inside = np.zeros(len(w.buf) + 1, np.int64)
    np.add.at(inside, w.start, 1), np.add.at(inside, w.end, -1)
    in_word = np.cumsum(inside[:-1]) > 0
    out = {"n_words": w.count.astype(np.int64), "word_chars": _per_row(in_word & ((w.buf & 0xC0) != 0x80), w.off), "n_symbols": _per_row(_SYMBOL[w.buf], w.off)}
    # Lines: from a row's start or after \n up to \n or the row's end.
    cut = np.flatnonzero(w.buf == 10)
    start = np.sort(np.concatenate([w.off[:-1][w.off[1:] > w.off[:-1]], cut + 1]))
    ends = np.sort(np.concatenate([w.off[1:][w.off[1:] > w.off[:-1]], cut]))
    words_before = np.append(0, np.cumsum(in_word))
    has = words_before[ends] > words_before[start]
    start, ends = start[has], ends[has]
    doc = np.searchsorted(w.off[1:], start, side="right")
    with np.errstate(over="ignore"):
        key = np.unique(roll.of(start, ends) ^ mix(doc.astype(U) * P1), return_index=True)[1]
        out["n_dup_lines"] = np.bincount(doc, minlength=w.rows) - np.bincount(doc[key], minlength=w.rows)
        # Words covered by windows that recur in the same row.
        h, n = roll.of(w.start, w.end), len(w.start)
        at = np.flatnonzero(w.doc[window - 1 :] == w.doc[: n - window + 1]) if n >= window else np.zeros(0, np.int64)
        acc = mix(w.doc[at].astype(U) * P1)
        for j in range(window):
            acc = mix(acc * U(0x9E3779B97F4A7C15) + h[at + j])
    cover = np.zeros(n + 1, np.int64)
    hit = at[_repeated(acc)]
    np.add.at(cover, hit, 1), np.add.at(cover, hit + window, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=w.rows)
    return out


def compression(texts: list[bytes], level: int = 3) -> tuple[list[float | None], list[float], list[bool]]:
    """Of each text: its ratio, the share of chunks outside the chunks' limits, and whether both are within the limits."""
    z = zstandard.ZstdCompressor(level=level)
    ratios, shares, fine = [], [], []
    for t in texts:
        if len(t) < BANDS[0][0]:
            ratios.append(None), shares.append(0.0), fine.append(True)
            continue
        _, low, high = next(b for b in reversed(BANDS) if len(t) >= b[0])
        r = len(z.compress(t)) / len(t)
        parts = [t[i : i + CHUNK] for i in range(0, len(t), CHUNK)]
        parts = [p for p in parts if 2 * len(p) >= CHUNK] if len(t) > CHUNK else []
        bad = sum(not CHUNK_BAND[0] <= len(z.compress(p)) / len(p) <= CHUNK_BAND[1] for p in parts)
        share = bad / len(parts) if parts else 0.0
        ratios.append(r), shares.append(share), fine.append(low <= r <= high and share <= CHUNK_SHARE)
    return ratios, shares, fine


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunks): one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                c = base_counts(part.column("t"))
                ratio, share, fine = compression([t or b"" for t in part.column("t").cast(pa.binary()).to_pylist()])
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                yield pa.record_batch({"id": part.column("id")} | {k: pa.array(v.astype(np.int64)) for k, v in c.items()} | {"base_failed": pa.array(failed), "kept": pa.array(~failed & np.array(fine, bool)), "ratio": pa.array(ratio, pa.float64()), "bad_chunks": pa.array(share, pa.float64())})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"
    )


def keep_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `df` that judge() keeps, with their columns, in one pass."""
    schema = df.schema
    if text_col not in df.columns:
        raise ValueError(f"no column {text_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                c = base_counts(part.column(text_col))
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                fine = compression([t or b"" for t in part.column(text_col).cast(pa.binary()).to_pylist()])[2]
                yield part.filter(pa.array(~failed & np.array(fine, bool)))

    return df.mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
