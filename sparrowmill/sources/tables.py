"""Scans and sinks of data that grows: catalogs, pairs, lines, token tables, retrieval tasks, metrics."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import flatten, strip, title_and_text
from .files import delete_others, read_bytes, read_json, write_bytes, write_json, write_stream


def catalog(spark: SparkSession, listing: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(source, urls) of `listing` {source: {split: urls}}: the split `train`, else the first; sorted by source."""
    rows = [(k, sorted(v.get("train") or next(iter(v.values())))) for k, v in sorted(listing.items()) if v]
    return spark.createDataFrame(rows, "source string, urls array<string>")


def open_pairs(spark: SparkSession, urls: list[str], columns: tuple[str, ...] = ("query", "document")) -> DataFrame:
    """The named columns of Parquet files, as strings, with row_idx over the files in the given order. A missing or other column is an error.

    The number is the file's first one and the row's place in its file: one small count per file, no sort of the rows.
    """
    df = spark.read.parquet(*urls)
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds.get(c) != "string":
            raise ValueError(f"column {c} must be a string column, it is {kinds.get(c, 'missing')}")
    order = spark.createDataFrame([(u.rsplit("/", 1)[-1], i) for i, u in enumerate(urls)], "file string, ord int")
    rows = df.select(*columns, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.row_index").alias("at"))
    n = rows.groupBy("file").agg(F.count("*").alias("n")).join(order, "file")
    base = n.withColumn("base", F.sum("n").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).select("file", "base")
    return rows.join(base, "file").select((F.col("base") + F.col("at")).alias("row_idx"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns))


def rows_between(df: DataFrame, start: int, n: int, size: int | None = None) -> DataFrame:
    """Rows start .. start + n - 1 by row_idx; beyond `size` is an error."""
    if start < 0 or n < 0 or (size is not None and start + n > size):
        raise IndexError(f"rows {start} to {start + n} of {size}")
    return df.where((F.col("row_idx") >= start) & (F.col("row_idx") < start + n))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) for each line that ends in a line feed; one carriage return before it goes."""
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("text"))


def write_lines(df: DataFrame, path: str, text_col: str = "text", min_chars: int = 0, limit: int | None = None, order: str | None = None) -> None:
    """One text to a line: those of `min_chars` or more, then the first `limit`."""
    x = df.where(F.char_length(text_col) >= min_chars)
    x = x.orderBy(order).limit(limit) if limit is not None and order else x.limit(limit) if limit is not None else x
    x.select(flatten(F.col(text_col)).alias("value")).write.mode("overwrite").text(path)


def retrieval_task(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, text), (qid, text), (qid, id) of corpus(_id, title, text), queries(_id, text), qrels(query-id, corpus-id, score).

    Ids are strings; a positive has a score that truncates above 0; queries without a positive or a text are left out.
    """
    c = corpus.select(F.col("_id").cast("string").alias("id"), title_and_text(F.col("title") if "title" in corpus.columns else F.lit(""), F.col("text")).alias("text"))
    q = queries.where(F.col("text").isNotNull()).select(F.col("_id").cast("string").alias("qid"), strip(F.col("text")).alias("text"))
    r = qrels.where(F.expr("try_cast(try_cast(score AS double) AS int)") > 0).select(F.col("`query-id`").cast("string").alias("qid"), F.col("`corpus-id`").cast("string").alias("id")).distinct()
    r = r.join(q.select("qid"), "qid", "left_semi")
    return c, q.join(r.select("qid").distinct(), "qid", "left_semi"), r


def require_all(wanted: DataFrame, have: DataFrame, key: str) -> None:
    """An error if a key of `wanted` is missing in `have`."""
    missing = [r[0] for r in wanted.select(key).distinct().join(have.select(key), key, "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"missing {key}: {missing}")


# Token tables ----------------------------------------------------------------------------------------------------


def append_tokens(df: DataFrame, path: str, tokenizer: str, add_special_tokens: bool = False) -> int:
    """Appends the rows of `df` (source, row_idx, query_ids, doc_ids) that the table doesn't have; the number written.

    Ids must fit 16 bits. Rows are written to a batch of their own and count once the manifest, which is replaced as a whole,
    lists it: what a stopped run left is no part of the table, and the next append deletes it. The manifest states the
    committed rows and the policy; another policy is an error, and an old manifest without one counts as true.
    """
    from ..operators.embed import checked_ids

    spark = df.sparkSession
    meta = read_json(f"{path}/manifest.json")
    if meta and meta.get("add_special_tokens", True) != add_special_tokens:
        raise ValueError("the table has another special-token policy")
    batches = meta["batches"] if meta else []
    delete_others(f"{path}/tokens", {f"batch={b}" for b in batches})
    if meta:
        df = df.join(read_tokens(spark, path)[0].select("source", "row_idx"), ["source", "row_idx"], "left_anti")
    df = df.select("source", "row_idx", checked_ids(F.col("query_ids")).alias("query_ids"), checked_ids(F.col("doc_ids")).alias("doc_ids"))
    name = f"{len(batches):06d}-{uuid.uuid4().hex}"
    df.write.partitionBy("source").parquet(f"{path}/tokens/batch={name}")
    new = spark.read.schema(_TOKENS).parquet(f"{path}/tokens/batch={name}")
    n = dict(meta["sources"]) if meta else {}
    added = 0
    for r in new.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("query_ids")).alias("q"), F.sum(F.size("doc_ids")).alias("d")).collect():
        n[r.source] = [a + b for a, b in zip(n.get(r.source, [0, 0, 0]), [r.n, r.q or 0, r.d or 0])]
        added += r.n
    if added or not meta:
        write_json(f"{path}/manifest.json", {"tokenizer": tokenizer, "add_special_tokens": add_special_tokens, "sources": n, "batches": [*batches, name]})
    return added


_TOKENS = "row_idx bigint, query_ids array<int>, doc_ids array<int>, source string"


def read_tokens(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows, manifest) of a token table. Fewer rows of a source than the manifest commits to, or others, are an error."""
    meta = read_json(f"{path}/manifest.json")
    if meta is None:
        raise FileNotFoundError(path)
    rows = spark.read.schema(_TOKENS).option("basePath", f"{path}/tokens").parquet(*(f"{path}/tokens/batch={b}" for b in meta["batches"])).drop("batch")
    have = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    want = {s: v[0] for s, v in meta["sources"].items()}
    if have != {s: n for s, n in want.items() if n}:
        raise ValueError(f"the table's rows differ from its manifest: {sorted(set(want.items()) ^ set(have.items()))[:5]}")
    return rows, meta


def open_tier(spark: SparkSession, path: str, tiers: DataFrame, tier: str) -> DataFrame:
    """The rows of a token table that a tier takes. A source that isn't there, or that has fewer rows than the tier takes, is an error."""
    from ..operators.schedule import prefix

    rows, meta = read_tokens(spark, path)
    for r in tiers.where((F.col("tier") == tier) & (F.col("take_rows") > 0)).collect():  # a row for each source
        n = meta["sources"].get(r.source, [None])[0]
        if n is None:
            raise FileNotFoundError(f"source {r.source}, which tier {tier} takes, is not tokenized")
        if n < r.take_rows:
            raise ValueError(f"source {r.source} has {n} rows, tier {tier} takes {r.take_rows}")
    return prefix(rows, tiers, tier)


def write_triples(triples: DataFrame, path: str, source: str, negatives: int, add_special_tokens: bool = False) -> dict:
    """`triples` (see split.gather_triples) with pair_idx as Parquet, and what they are beside it, written last; ids must fit 16 bits."""
    from ..operators.embed import checked_ids

    x = triples.select("pair_idx", checked_ids(F.col("query_ids")).alias("query_ids"), checked_ids(F.col("positive_ids")).alias("positive_ids"), F.transform("negative_ids", lambda ids: checked_ids(ids)).alias("negative_ids"))
    x.write.mode("overwrite").parquet(f"{path}/triples")
    n = triples.sparkSession.read.parquet(f"{path}/triples").agg(
        F.count("*").alias("n_pairs"), F.sum(F.size("query_ids")).alias("total_query_tokens"), F.sum(F.size("positive_ids")).alias("total_positive_tokens"), F.sum(F.size(F.flatten("negative_ids"))).alias("total_negative_tokens")
    ).first().asDict()
    meta = {"source": source, "n_negatives_per_pair": negatives, "add_special_tokens": add_special_tokens} | {k: v or 0 for k, v in n.items()}
    write_json(f"{path}/meta.json", meta)
    return meta


def read_triples(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(triples, meta). Not as many pairs, numbered from 0, as the meta block says, or another number of negatives, is an error."""
    meta = read_json(f"{path}/meta.json")
    if meta is None:
        raise FileNotFoundError(path)
    one_policy([meta])
    x = spark.read.parquet(f"{path}/triples")
    n, k = meta["n_pairs"], meta["n_negatives_per_pair"]
    r = x.agg(F.count("*").alias("n"), F.countDistinct("pair_idx").alias("d"), F.min("pair_idx").alias("lo"), F.max("pair_idx").alias("hi"), F.count_if(F.size("negative_ids") != k).alias("bad")).first()
    if r.n != n or r.d != n or (n and (r.lo, r.hi) != (0, n - 1)):
        raise ValueError(f"{r.n} pairs, expected {n}")
    if r.bad:
        raise ValueError(f"{r.bad} pairs have not {k} negatives")
    return x, meta


def one_policy(metas: list[dict]) -> bool:
    """The special-token policy that all share; a missing one counts as true."""
    found = {m.get("add_special_tokens", True) for m in metas}
    if not all(isinstance(x, bool) for x in found):
        raise TypeError("the policy must be true or false")
    if len(found) > 1:
        raise ValueError("sources of both special-token policies are mixed")
    return found.pop() if found else False


def export_csr(df: DataFrame, path: str, ids_col: str = "ids", order: str = "row_idx") -> int:
    """Flat little-endian 16-bit ids and 64-bit offsets with a sentinel, in order; rows stream through the driver, one partition at a time, into the files."""
    n = at = 0
    with write_stream(f"{path}/tokens.bin") as tokens, write_stream(f"{path}/offsets.bin") as offsets:
        offsets.write(bytes(8))
        for r in df.select(ids_col, order).orderBy(order).toLocalIterator():
            x = np.array(r[0] or [], np.int64)
            if len(x) and (x.min() < 0 or x.max() >= 1 << 16):
                raise ValueError("an id doesn't fit 16 bits")
            tokens.write(x.astype("<u2").tobytes())
            n, at = n + 1, at + len(x)
            offsets.write(at.to_bytes(8, "little"))
    return n


def import_csr(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, ids) of a CSR pair; files that disagree are an error."""
    off, flat = np.frombuffer(read_bytes(f"{path}/offsets.bin"), "<u8").astype(np.int64), np.frombuffer(read_bytes(f"{path}/tokens.bin"), "<u2")
    if not len(off) or off[0] != 0 or (np.diff(off) < 0).any() or off[-1] != len(flat):
        raise ValueError("offsets and tokens disagree")
    return spark.createDataFrame([(i, flat[a:b].tolist()) for i, (a, b) in enumerate(zip(off, off[1:]))], "row_idx bigint, ids array<int>")


def export_matrix(df: DataFrame, path: str, vec_col: str = "embedding", order: str = "row_idx") -> int:
    """Little-endian 32-bit floats, row after row, without a header; rows stream through the driver into the file."""
    n = 0
    with write_stream(path) as out:
        for r in df.select(vec_col, order).orderBy(order).toLocalIterator():
            out.write(np.array(r[0], "<f4").tobytes())
            n += 1
    return n


# Tensor files ----------------------------------------------------------------------------------------------------

_KINDS = {"F32": "<f4", "I8": "i1", "U8": "u1"}


def write_tensors(path: str, tensors: dict[str, np.ndarray], metadata: dict[str, str]) -> None:
    """An 8-byte little-endian header length, the header as JSON, the bytes of the tensors."""
    names = {np.dtype(v): k for k, v in _KINDS.items()}
    head: dict = {"__metadata__": metadata}
    at, parts = 0, []
    for k, v in tensors.items():
        raw = np.ascontiguousarray(v).tobytes()
        head[k] = {"dtype": names[v.dtype], "shape": list(v.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    h = json.dumps(head).encode()
    write_bytes(path, len(h).to_bytes(8, "little") + h + b"".join(parts))


def read_tensors(path: str) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    raw = read_bytes(path)
    if raw is None:
        raise FileNotFoundError(path)
    n = int.from_bytes(raw[:8], "little")
    if len(raw) < 8 or n > len(raw) - 8:
        raise ValueError("not a tensor file")
    head = json.loads(raw[8 : 8 + n])
    meta = head.pop("__metadata__", {})
    out = {}
    for k, t in head.items():
        a, b = t["data_offsets"]
        x = np.frombuffer(raw[8 + n + a : 8 + n + b], _KINDS[t["dtype"]])
        if x.size != int(np.prod(t["shape"])):
            raise ValueError(f"tensor {k} has wrong bytes")
        out[k] = x.reshape(t["shape"])
    return out, meta


def pick_weight(tensors: dict[str, np.ndarray]) -> np.ndarray:
    """`embedding.weight`, else the only tensor."""
    if "embedding.weight" in tensors:
        return tensors["embedding.weight"]
    if len(tensors) != 1:
        raise ValueError("no embedding.weight and not one tensor alone")
    return next(iter(tensors.values()))


def checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(weights, metadata) of a tensor file. What the metadata doesn't say of vocabulary and dimension is the weight's shape; if it says otherwise, that is an error."""
    import pandas as pd

    tensors, meta = read_tensors(path)
    w = pick_weight(tensors)
    if w.ndim != 2:
        raise ValueError(f"the weight has {w.ndim} axes, not two")
    shape = {"vocab_size": str(w.shape[0]), "dim": str(w.shape[1])}
    for k, v in shape.items():
        if meta.get(k, v) != v:
            raise ValueError(f"the metadata say {k} {meta[k]}, the weight has {v}")
    return spark.createDataFrame(pd.DataFrame({"token_id": np.arange(len(w)), "vec": [x.tolist() for x in w]}), "token_id bigint, vec array<float>"), shape | meta


def weights_from_tensors(spark: SparkSession, path: str) -> DataFrame:
    return checkpoint(spark, path)[0]


def write_artifact(path: str, quantized: DataFrame, bits: int, axis: str, dim: int, metadata: dict[str, str]) -> None:
    """A quantized table as a tensor file: packed codes (two and four bits) or bytes, the scales, and its metadata."""
    rows = quantized.select("token_id", "codes" if bits < 32 else "vec", *(["scale"] if axis == "row" and bits < 32 else [])).orderBy("token_id").collect()
    meta = {"bits": str(bits), "axis": axis, "dim": str(dim), "vocab_size": str(len(rows))} | metadata
    if bits >= 32:
        return write_tensors(path, {"weight": np.array([r.vec for r in rows], "<f4")}, meta)
    codes = np.array([r.codes for r in rows], np.int64)
    if bits < 8:
        per, top = 8 // bits, 2 ** (bits - 1) - 1
        if dim % per:
            raise ValueError("the dimension does not fill whole bytes")
        shifted = (codes + top).reshape(len(rows), -1, per) << (np.arange(per) * bits)
        weight = shifted.sum(2).astype("u1")
    else:
        weight = codes.astype("i1")
    scale = [r.scale for r in rows] if axis == "row" else quantized.select("scales").first()[0]
    return write_tensors(path, {"weight": weight, "scale": np.array(scale, "<f4")}, meta)


def read_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(token_id, vec) dequantized, and the metadata; sizes that don't fit are an error."""
    import pandas as pd

    t, meta = read_tensors(path)
    bits, dim, vocab, axis = int(meta["bits"]), int(meta["dim"]), int(meta["vocab_size"]), meta["axis"]
    w = t["weight"]
    if w.nbytes != vocab * (dim * 4 if bits >= 32 else -(-dim * bits // 8)):
        raise ValueError("wrong bytes in weight")
    if bits < 32 and len(t["scale"]) != (vocab if axis == "row" else dim):
        raise ValueError("wrong number of scales")
    if bits < 8:
        per, top = 8 // bits, 2 ** (bits - 1) - 1
        w = ((w[:, :, None] >> (np.arange(per) * bits)) & (2**bits - 1)).reshape(vocab, dim).astype(np.int64) - top
    if bits < 32:
        w = (w * (t["scale"][:, None] if axis == "row" else t["scale"][None, :])).astype("f4")
    return spark.createDataFrame(pd.DataFrame({"token_id": np.arange(vocab), "vec": [x.tolist() for x in w]}), "token_id bigint, vec array<float>"), meta


# Metrics ---------------------------------------------------------------------------------------------------------


def throughput_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="variant string, dim int, size_mb double, wall_s double, docs_per_s double, tokens_per_s double, embed_us_per_doc double")


def quality_json(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(file, ndcg12) of result files: the aggregate at `dim`, null if it isn't there."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    agg = F.from_json(F.get_json_object("value", "$.aggregates"), "map<string,map<string,double>>")
    return raw.select("file", agg["12_mean_ndcg@10"][str(dim)].alias("ndcg12"))


def points_csv(points: DataFrame, path: str) -> None:
    points.orderBy("bits", "dim").coalesce(1).write.mode("overwrite").csv(path, header=True)
