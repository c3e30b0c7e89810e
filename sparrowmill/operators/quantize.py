"""Symmetric quantization of a weight table (token_id, vec array<float>): scales, codes, packing and their errors.

All arithmetic is that of 32-bit floats (a double division rounded to a float is the float division), rounded half to
even. A table has a row for each token of a vocabulary, so it is small beside any corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least positive normal 32-bit float: no scale is smaller.
TINY = 1.1754943508222875e-38
VARIANTS = ((32, "dim"), (8, "dim"), (8, "row"), (4, "dim"), (4, "row"), (2, "row"))


def qmax(bits: int) -> int:
    if bits < 2:
        raise ValueError("at least 2 bits")
    return 2 ** (bits - 1) - 1


def cell_name(bits: int, axis: str | None) -> str:
    """fp32, or int{bits}_{axis}: the name of a cell, deployed or not."""
    return "fp32" if bits >= 32 else f"int{bits}_{axis}"


def variant(bits: int, axis: str) -> str:
    """The name of a deployed variant; any other cell is an error, among them two bits by dimension."""
    if bits < 32 and (bits, axis) not in VARIANTS:
        raise ValueError(f"{bits} bits by {axis} are not deployed")
    return cell_name(bits, axis)


def slice_table(w: DataFrame, dim: int) -> DataFrame:
    """The first `dim` dimensions: before any scale is taken."""
    return w.select("token_id", F.slice("vec", 1, dim).alias("vec"))


def row_scales(w: DataFrame, bits: int) -> DataFrame:
    amax = F.array_max(F.transform("vec", F.abs))
    return w.select("token_id", F.greatest((F.coalesce(amax, F.lit(0.0)) / qmax(bits)).cast("float"), F.lit(TINY).cast("float")).alias("scale"))


def dim_scales(w: DataFrame, bits: int) -> DataFrame:
    """(d, scale) from 0: one aggregation over (dimension, |weight|)."""
    x = w.select(F.posexplode("vec").alias("d", "x"))
    return x.groupBy("d").agg(F.greatest((F.max(F.abs("x")) / qmax(bits)).cast("float"), F.lit(TINY).cast("float")).alias("scale"))


def magnitudes(w: DataFrame) -> np.ndarray:
    """The greatest magnitude of each dimension, as 32-bit floats."""
    rows = w.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.max(F.abs("x")).alias("m")).orderBy("d").collect()
    return np.array([0.0 if r.m is None else r.m for r in rows], np.float32)


def scale_array(w: DataFrame, bits: int) -> DataFrame:
    """One row: the scales of all dimensions in order (as many as a vector has)."""
    return dim_scales(w, bits).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "scale"))), lambda s: s["scale"]).alias("scales"))


def _code(x: Column, scale: Column, bits: int) -> Column:
    q = qmax(bits)
    return F.greatest(F.lit(-q), F.least(F.lit(q), F.rint((x / scale).cast("float").cast("double")).cast("int")))


def quantize(w: DataFrame, bits: int, axis: str) -> DataFrame:
    """(token_id, vec, codes array<int>, scale or scales)."""
    if axis == "row":
        s = w.join(row_scales(w, bits), "token_id")
        return s.withColumn("codes", F.transform("vec", lambda x: _code(x, F.col("scale"), bits)))
    s = w.crossJoin(F.broadcast(scale_array(w, bits)))  # one row
    return s.withColumn("codes", F.zip_with("vec", "scales", lambda x, y: _code(x, y, bits)))


def dequantized(q: DataFrame, axis: str) -> DataFrame:
    """`quantize`'s rows with `back`, the weights as floats again."""
    if axis == "row":
        return q.withColumn("back", F.transform("codes", lambda c: (c * F.col("scale")).cast("float")))
    return q.withColumn("back", F.zip_with("codes", "scales", lambda c, s: (c * s).cast("float")))


def fake_quantize(w: DataFrame, bits: int, axis: str) -> DataFrame:
    """(token_id, vec, back): there and back again; 32 bits and more change nothing."""
    if bits >= 32:
        return w.withColumn("back", F.col("vec"))
    return dequantized(quantize(w, bits, axis), axis).select("token_id", "vec", "back")


def over_top(w: DataFrame) -> DataFrame:
    """(token_id, own, top, vec): rows over their greatest magnitude."""
    top = F.greatest(F.coalesce(F.array_max(F.transform("vec", F.abs)), F.lit(0.0)).cast("float"), F.lit(TINY).cast("float"))
    return w.select("token_id", F.col("vec").alias("own"), top.alias("top")).withColumn("vec", F.transform("own", lambda x: (x / F.col("top")).cast("float")))


def hybrid_quantize(w: DataFrame, bits: int) -> DataFrame:
    """Rows over their greatest magnitude first, then by dimension, then times it again."""
    back = dequantized(quantize(over_top(w), bits, "dim"), "dim")
    return back.select("token_id", F.col("own").alias("vec"), F.transform("back", lambda x: (x * F.col("top")).cast("float")).alias("back"))


def fake_rows(x: np.ndarray, bits: int, axis: str | None, largest: np.ndarray | None = None) -> np.ndarray:
    """`fake_quantize` or `hybrid_quantize` of rows of 32-bit floats. `largest`: by dimension, the magnitudes of the whole table (hybrid: of `over_top`)."""
    if bits >= 32:
        return x
    q, tiny, top = qmax(bits), np.float32(TINY), np.maximum(np.abs(x).max(1, initial=0), np.float32(TINY))[:, None]
    if axis == "row":
        largest = np.abs(x).max(1, initial=0)[:, None]
    elif axis == "hybrid":
        x = x / top  # of 32-bit floats: the double division rounded to a float
    scale = np.maximum((largest.astype(np.float64) / q).astype(np.float32), tiny)
    back = np.clip(np.rint(x / scale), -q, q) * scale
    return back * top if axis == "hybrid" else back


def pack(codes: Column, bits: int) -> Column:
    """Codes as bytes in hexadecimal: biased by qmax, the first code in the lowest bits. The dimension must fill the bytes."""
    per = 8 // bits
    biased = F.transform(codes, lambda c: c + qmax(bits))
    whole = F.when(F.size(codes) % per == 0, biased).otherwise(F.raise_error(F.lit("the dimension does not fill whole bytes")))
    byte = F.transform(
        F.sequence(F.lit(0), (F.size(codes) / per).cast("int") - 1),
        lambda i: sum((F.shiftleft(F.element_at(whole, i * per + j + 1), j * bits) for j in range(1, per)), F.element_at(whole, i * per + 1)),
    )
    return F.array_join(F.transform(byte, lambda b: F.lpad(F.hex(b), 2, "0")), "")


def unpack(packed_hex: Column, bits: int) -> Column:
    """The codes of `pack`."""
    per, mask = 8 // bits, 2**bits - 1
    n = (F.length(packed_hex) / 2).cast("int") * per
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: (F.conv(F.substr(packed_hex, F.floor(i / per).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int") / F.pow(F.lit(2), (i % per) * bits)).cast("int") % (mask + 1) - qmax(bits),
    )


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order."""
    b = (x + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))


def _number(b: int) -> float:
    b = b & ((1 << 63) - 1) if b >> 63 else ~b & ((1 << 64) - 1)
    return float(np.array([b], np.uint64).view(np.float64)[0])


def percentiles(x: DataFrame, shares: tuple[float, ...]) -> dict[str, list[float]]:
    """By `tag`, the exact percentiles, interpolated, of all numbers of `x` (tag, xs array<double>).

    They are selected by the digits of their order: each of four passes counts the next 16 bits of those numbers that share
    the bits found so far, so no task gathers the numbers.
    """
    at: dict[str, list] = {}  # of each wanted place: its rank among those that share its bits, these bits
    out: dict[str, list] = {}
    for shift in (48, 32, 16, 0):
        bits = {tag: np.unique(np.array([b for _, b in found], np.uint64)) for tag, found in at.items()}

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, bits: dict = bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tag in pc.unique(batch.column(0)):
                    own = batch.column(1).filter(pc.equal(batch.column(0), tag)).flatten().drop_null()
                    n = _ordered(own.to_numpy(zero_copy_only=False).astype(np.float64))
                    if bits:
                        n = n[np.isin(n >> np.uint64(shift + 16), bits[tag.as_py()])]
                    values, times = np.unique(n >> np.uint64(shift), return_counts=True)
                    yield pa.record_batch({"tag": pa.array([tag.as_py()] * len(values), pa.string()), "b": pa.array(values.view(np.int64)), "n": pa.array(times)})

        rows = x.select("tag", "xs").mapInArrow(count, "tag string, b bigint, n bigint").groupBy("tag", "b").agg(F.sum("n").alias("n")).toArrow()
        for tag in pc.unique(rows["tag"]):
            own = rows.filter(pc.equal(rows["tag"], tag))
            b, n = own["b"].to_numpy().view(np.uint64), own["n"].to_numpy()
            order = np.argsort(b)
            b, n = b[order], n[order]
            if tag.as_py() not in at:
                out[tag.as_py()] = [s * float(n.sum() - 1) for s in shares]
                at[tag.as_py()] = [(r, None) for place in out[tag.as_py()] for r in (math.floor(place), math.ceil(place))]
            found = []
            for rank, parent in at[tag.as_py()]:
                here = slice(None) if parent is None else b >> np.uint64(16) == np.uint64(parent)
                ends = np.cumsum(n[here])
                i = int(np.searchsorted(ends, rank, side="right"))
                found.append((rank - int(ends[i - 1] if i else 0), int(b[here][i])))
            at[tag.as_py()] = found
    for tag, places in out.items():
        v = [_number(b) for _, b in at[tag]]
        out[tag] = [lo if lo == hi else (math.ceil(p) - p) * lo + (p - math.floor(p)) * hi for p, lo, hi in zip(places, v[::2], v[1::2])]
    return out


def error_table(backs: dict[str, DataFrame]) -> DataFrame:
    """(variant, max_error, mean_error, p99_error): max, mean and 99th percentile of |vec - back|, exact, of each table."""
    own = F.zip_with("vec", "back", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    x = reduce(DataFrame.union, (back.select(F.lit(name).alias("tag"), own.alias("xs")) for name, back in backs.items()))
    p = percentiles(x, (0.99,))
    names = x.sparkSession.createDataFrame([(name, p.get(name, [None])[0]) for name in backs], "variant string, p double")
    s = x.select(F.col("tag").alias("variant"), F.explode("xs").alias("e")).groupBy("variant").agg(F.max("e").alias("m"), F.avg("e").alias("a"))
    return names.join(s, "variant", "left").select("variant", F.round("m", 6).alias("max_error"), F.round("a", 6).alias("mean_error"), F.round("p", 6).alias("p99_error"))


def error_stats(back: DataFrame) -> DataFrame:
    """max, mean and 99th percentile of |vec - back|, exact."""
    return error_table({"": back}).drop("variant")


def silent_rows(w: DataFrame, bits: tuple[int, ...] = (8, 4, 3, 2)) -> DataFrame:
    """(bits, n_silent): rows whose codes by dimension are all zero."""
    out = None
    for b in bits:
        s = w.crossJoin(F.broadcast(scale_array(w, b)))
        quiet = F.forall(F.zip_with("vec", "scales", lambda x, y: F.abs(x.cast("double")) < 0.5 * y.cast("double")), lambda ok: ok)
        one = s.agg(F.lit(b).alias("bits"), F.count_if(quiet).alias("n_silent"))
        out = one if out is None else out.union(one)
    return out


def silent_row_ids(w: DataFrame, bits: int) -> DataFrame:
    """(token_id) of the rows whose codes by dimension are all zero."""
    quiet = F.forall(F.zip_with("vec", "scales", lambda x, y: F.abs(x.cast("double")) < 0.5 * y.cast("double")), lambda ok: ok)
    return w.crossJoin(F.broadcast(scale_array(w, bits))).where(quiet).select("token_id")  # one row of scales


def weight_summary(w: DataFrame) -> DataFrame:
    """Percentiles and population deviation of rows' and columns' deviations, norms and greatest magnitudes."""
    mean = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("vec")
    var = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x.cast("double") - F.col("mean")) * (x.cast("double") - F.col("mean"))) / F.size("vec")
    sq = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = w.withColumn("mean", mean).select(F.sqrt(var).alias("row_std"), F.sqrt(sq).alias("row_norm"), F.array_max(F.transform("vec", F.abs)).cast("double").alias("row_max"))
    x = w.select(F.posexplode("vec").alias("d", "v")).withColumn("v", F.col("v").cast("double"))
    cols = x.groupBy("d").agg(F.stddev_pop("v").alias("col_std"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("col_norm"), F.max(F.abs("v")).alias("col_max"))
    x = reduce(DataFrame.union, (df.select(F.lit(c).alias("tag"), F.array(c).alias("xs")) for df in (rows, cols) for c in df.columns if c != "d"))
    names = ("p0", "p1", "p50", "p99", "p100")
    p = x.sparkSession.createDataFrame([(k, *v) for k, v in percentiles(x, (0.0, 0.01, 0.5, 0.99, 1.0)).items()], "what string, " + ", ".join(f"{n} double" for n in names))
    s = x.groupBy(F.col("tag").alias("what")).agg(F.stddev_pop(F.col("xs")[0]).alias("s"))
    return p.join(s, "what").select("what", *(F.round(n, 6).alias(n) for n in names), F.round("s", 6).alias("std"))


def dynamic_range(w: DataFrame) -> DataFrame:
    """Greatest over least of the rows' (zero rows aside) and of the columns' greatest magnitudes, and the zero rows."""
    top = F.array_max(F.transform("vec", F.abs)).cast("double")
    rows = w.select(top.alias("m")).agg(F.round(F.max("m") / F.min(F.when(F.col("m") > 0, F.col("m"))), 6).alias("row_range"), F.count_if(F.col("m") == 0).alias("zero_rows"))
    cols = w.select(F.posexplode("vec").alias("d", "v")).groupBy("d").agg(F.max(F.abs("v")).cast("double").alias("m")).agg(F.round(F.max("m") / F.min("m"), 6).alias("col_range"))
    return rows.crossJoin(cols)


REQUIRED = ("bits", "axis", "dim", "vocab_size", "variant", "tokenizer")


def artifact_errors(meta: DataFrame) -> DataFrame:
    """(artifact, ok, errors) for `meta` (artifact, metadata map<string,string>, n_rows, row_bytes, n_scales)."""
    m = lambda k: F.col("metadata")[k]
    number = lambda k: F.expr(f"try_cast(metadata['{k}'] AS bigint)")
    bits, dim, vocab = number("bits"), number("dim"), number("vocab_size")
    want = F.when(bits == 32, dim * 4).otherwise(F.ceil(dim * bits / 8))
    scales = F.when(bits == 32, 0).when(m("axis") == "row", vocab).otherwise(dim)
    per = F.when(bits < 8, 8 / bits).otherwise(1)
    tests = [F.when(~F.map_contains_key("metadata", k), f"no {k}") for k in REQUIRED]
    tests += [
        F.when(~bits.isin(2, 4, 8, 32), "bits must be 2, 4, 8 or 32"),
        F.when(~m("axis").isin("row", "dim"), "axis must be row or dim"),
        F.when((bits == 2) & (m("axis") == "dim"), "two bits by dimension are not deployed"),
        F.when(dim % per != 0, "the dimension does not fill whole bytes"),
        F.when(vocab != F.col("n_rows"), "rows differ from the vocabulary"),
        F.when(want != F.col("row_bytes"), "wrong bytes to a row"),
        F.when(scales != F.col("n_scales"), "wrong number of scales"),
    ]
    errors = F.array_compact(F.array(*tests))
    return meta.select("artifact", (F.size(errors) == 0).alias("ok"), F.array_join(errors, "; ").alias("errors"))
