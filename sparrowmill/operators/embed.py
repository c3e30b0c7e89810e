"""Static embeddings: token ids, one weight row for each, their mean, normalized.

Vocabularies and weight tables have any number of rows. Those of ids below NEAR are collected and broadcast; where there are
no others, documents are pooled in Arrow batches without a shuffle. The others, which are the rarer words, are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON
from ..session import stored

MOST_TOKENS, MOST_BYTES = 1 << 16, 1 << 28
#: Ids from here on are joined; all below go to every task, of weights as many as MOST_BYTES hold.
NEAR = 1 << 18
#: Token ids whose rows count as zero; they still count in the mean.
IGNORED = (101, 102)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores if its table has fewer splits than there are; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased runs of letters and digits of a column, and where each row's begin among them, and the end. A null text has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = pc.split_pattern_regex(pc.utf8_lower(column.fill_null("")), r"[^\p{L}\p{N}]+")
    flat = parts.flatten()
    some = pc.binary_length(flat).to_numpy() > 0  # before the first and after the last separator there may be nothing
    at = np.append(0, np.cumsum(parts.value_lengths().to_numpy()))
    return flat.filter(pa.array(some)), np.append(0, np.cumsum(some))[at]


def vocabulary(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """(token, token_id): the `size` - 1 most frequent words by (count, word) from 1; 0 is everything else.

    Up to MOST_TOKENS it is a top-n. Of more, the words that are frequent enough are sorted by ranges and numbered in two
    steps, by range and within it.
    """
    from pyspark.sql import Window as W

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.value_counts(split_words(batch.column(0))[0])
            yield pa.record_batch({"token": n.field(0).cast(pa.string()), "n": n.field(1)})

    counts = spread(df.select(F.col(text_col).cast("string"))).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    order = (F.desc("n"), "token")
    if size <= MOST_TOKENS:
        return counts.orderBy(*order).limit(size - 1).select("token", F.row_number().over(W.orderBy(*order)).alias("token_id"))
    counts = stored(counts)
    by_n = counts.groupBy("n").agg(F.count("*").alias("words"))
    before = F.sum("words").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)) - F.col("words")  # a row for each different count
    least = by_n.withColumn("before", before).where(F.col("before") < size - 1).agg(F.min("n")).first()[0]
    top = stored(counts.where(F.col("n") >= F.lit(least)).orderBy(*order).withColumn("part", F.spark_partition_id()))
    parts = top.groupBy("part").agg(F.count("*").alias("words"))
    parts = parts.select("part", (F.sum("words").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("before"))  # a row for each range
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order)) + F.col("before")
    return top.join(F.broadcast(parts), "part").select("token", rank.cast("int").alias("token_id")).where(F.col("token_id") < size)


class Words(NamedTuple):
    """A vocabulary: the words by id from 0, which is null: no word, as far as they go to every task; (token, token_id) of the others, or None."""

    near: pa.Array
    far: DataFrame | None = None


def collect_vocabulary(vocab: DataFrame) -> Words:
    """The vocabulary (token, token_id) with the words below NEAR collected. Every id to the last must be there."""
    rows = vocab.where(F.col("token_id") <= NEAR).select("token_id", "token").toArrow()
    words_ = dict(zip(rows["token_id"].to_pylist(), rows["token"].to_pylist()))
    near = pa.array([words_.get(i) for i in range(min(max(words_, default=0) + 1, NEAR))], pa.string())
    return Words(near, vocab.where(F.col("token_id") >= NEAR) if NEAR in words_ else None)


def known_ids(words_: pa.Array, vocab: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(words_, vocab, skip_nulls=True), 0).to_numpy()


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one after the other, and where each row's begin, and the end; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), _starts(column).to_numpy().astype(np.int64)


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """A column of equally long lists as rows."""
    flat, at = lists(column)
    wide = np.diff(at)
    if len(wide) and (wide != wide[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.astype(kind).reshape(len(wide), -1)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows over their norms; one whose norm is below the runtime's epsilon stays."""
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n < EPSILON, 1.0, n)


class Table(NamedTuple):
    """A weight table of `size` rows: those of ids below len(near), times their `scale` if there is one; (token_id, vec) of the others, or None."""

    near: np.ndarray
    scale: np.ndarray | None = None
    far: DataFrame | None = None
    size: int = 0

    @property
    def dim(self) -> int:
        return self.near.shape[1]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        m = self.near[ids].astype(np.float64)
        return m if self.scale is None else m * self.scale[ids][:, None]


def as_table(weights: np.ndarray | Table) -> Table:
    return weights if isinstance(weights, Table) else Table(weights, size=len(weights))


def pooled(weights: np.ndarray | Table, ids: np.ndarray, start: np.ndarray, divide: bool = True, far: pa.Array | None = None, each: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The mean (or sum) of each row's ids' weights; none give zeros, an id beyond the table is an error. `far`: lists of the
    rows of those that are not near, of which `each`, if given, makes the weights (from 32-bit floats)."""
    w = as_table(weights)
    if len(ids) and (ids.max() >= w.size or ids.min() < 0):
        raise ValueError("a token id is beyond the weight table")
    n = np.diff(start)
    out = np.zeros((len(n), w.dim))
    if w.size > len(w.near):
        here = ids < len(w.near)
        ids, near = ids[here], np.append(0, np.cumsum(here))[start]
        if far is not None:
            _add(out, _starts(far).to_numpy().astype(np.int64), lambda a, b, v=far.flatten(): matrix(v[a:b]) if each is None else each(matrix(v[a:b], np.float32)).astype(np.float64))
    else:
        near = start
    _add(out, near, lambda a, b: w.rows(ids[a:b]))
    if divide:
        some = np.flatnonzero(n)
        out[some] /= n[some][:, None]
    return out


def _add(out: np.ndarray, start: np.ndarray, rows: Callable[[int, int], np.ndarray]) -> None:
    """Adds to each row of `out` its rows, of which `rows` gives a range."""
    some = np.flatnonzero(np.diff(start))
    at = 0
    while at < len(some):  # bounds what is gathered at once
        end = max(at + 1, int(np.searchsorted(start[some + 1] - start[some[at]], 1 << 16, side="right")))
        k = some[at:end]
        out[k] += np.add.reduceat(rows(int(start[k[0]]), int(start[k[-1] + 1])), start[k] - start[k[0]], axis=0)
        at = end


def embed_texts(df: DataFrame, vocab: Words | pa.Array, weights: np.ndarray | Table, id_col: str = "id", text_col: str = "text", scales: np.ndarray | None = None, normalized: bool = True) -> DataFrame:
    """(id, n_tokens, embedding): words, ids and the mean of their rows in one pass over Arrow batches; `scales` multiply the
    mean afterwards, so that codes by dimension are summed as whole numbers. Words and rows that are not near are joined."""
    words, w = as_words(vocab), as_table(weights)
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))

    def finished(v: np.ndarray) -> np.ndarray:
        v = v * scales if scales is not None else v
        return unit(v) if normalized else v

    if words.far is not None or w.far is not None:
        x = pool(token_ids(texts, words, "text", keep_text=False), w, finish=finished)
        return x.select("id", F.size("ids").cast("bigint").alias("n_tokens"), "embedding")
    shared = df.sparkSession.sparkContext.broadcast((words.near, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, w = shared.value
        for batch in batches:
            words_, start = split_words(batch.column(1))
            v = finished(pooled(w, known_ids(words_, near), start))
            yield pa.record_batch({"id": batch.column(0), "n_tokens": pa.array(np.diff(start)), "embedding": as_lists(v)})

    kind = df.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, n_tokens bigint, embedding array<double>")


def as_lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def checked_ids(ids: Column, size: int = MOST_TOKENS) -> Column:
    """`ids`, or an error if one is out of range."""
    return F.when(F.forall(ids, lambda x: (x >= 0) & (x < size)), ids).otherwise(F.raise_error(F.lit("a token id is out of range")))


def as_words(vocab: DataFrame | pa.Array | Words) -> Words:
    return vocab if isinstance(vocab, Words) else Words(vocab) if isinstance(vocab, pa.Array) else collect_vocabulary(vocab)


def _keyed(df: DataFrame) -> DataFrame:
    """`df`, stored, with a number for each row, by which what is joined comes back to it."""
    return stored(df.withColumn("_key", F.monotonically_increasing_id()))


def token_ids(df: DataFrame, vocab: DataFrame | pa.Array | Words, text_col: str, out: str = "ids", keep_text: bool = True) -> DataFrame:
    """`df` with the ids of its words, in order; unknown words are 0. Words that are not near are joined with the rest of the vocabulary."""
    words = as_words(vocab)
    shared = df.sparkSession.sparkContext.broadcast(words.near)
    drop = () if keep_text else (text_col,)

    def encode(x: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        words_, start = split_words(x)
        ids = pc.index_in(words_, shared.value, skip_nulls=True)
        return words_, pa.array(start.astype(np.int32)), ids, ids.is_null()

    if words.far is None:

        @F.arrow_udf("array<int>")
        def known(x: pa.Array) -> pa.Array:
            _, start, ids, _ = encode(x)
            return pa.ListArray.from_arrays(start, ids.fill_null(0))

        return df.withColumn(out, known(F.col(text_col).cast("string"))).drop(*drop)

    @F.arrow_udf("struct<ids:array<int>,rest:array<string>>")
    def near(x: pa.Array) -> pa.Array:
        words_, start, ids, other = encode(x)
        at = np.append(0, np.cumsum(other.to_numpy(zero_copy_only=False)))[start.to_numpy()]
        rest = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words_.filter(other).cast(pa.string()))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(start, ids.fill_null(-1)), rest], ["ids", "rest"])

    @F.arrow_udf("array<int>")
    def merged(ids: pa.Array, at: pa.Array, far: pa.Array) -> pa.Array:
        flat, start = lists(ids)
        flat, gaps = flat.copy(), np.flatnonzero(flat < 0)
        flat[gaps] = 0
        place, of = lists(at)
        first = np.repeat(np.searchsorted(gaps, start[:-1]), np.diff(of))
        flat[gaps[first + place]] = lists(far)[0]
        return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat))

    x = _keyed(df.withColumn("_x", near(F.col(text_col).cast("string"))).drop(*drop))
    rest = x.select("_key", F.posexplode("_x.rest").alias("at", "token"))
    found = rest.join(words.far, "token").groupBy("_key").agg(F.collect_list(F.struct("at", F.col("token_id").cast("int").alias("id"))).alias("_far"))
    return x.join(found, "_key", "left").withColumn(out, merged("_x.ids", "_far.at", "_far.id")).drop("_key", "_x", "_far")


def _starts(x: pa.Array) -> pa.Array:
    """Where each list of a column begins among its values, and the end; a null list is empty."""
    n = x.value_lengths().fill_null(0).to_numpy()
    return pa.array(np.append(0, np.cumsum(n)).astype(np.int32))


def collect_weights(w: DataFrame) -> Table:
    """The table (token_id, vec[, scale]); every id from 0 must be there. Whole numbers and 32-bit floats stay as they are."""
    kind = {"float": np.float32, "int": np.int32}.get(w.schema["vec"].dataType.elementType.simpleString(), np.float64)
    n, least, most, ids, dim = w.agg(F.count("*"), F.min("token_id"), F.max("token_id"), F.countDistinct("token_id"), F.max(F.size("vec"))).first()
    if n and (least, most, ids) != (0, n - 1, n):
        raise ValueError("token ids must be 0 to n - 1")
    near = max(1, min(NEAR, MOST_BYTES // max(1, (dim or 0) * kind().itemsize)))
    rows = w.where(F.col("token_id") < near).toArrow().sort_by("token_id")
    m = matrix(rows["vec"], kind) if n else np.zeros((0, 0))
    scale = rows["scale"].to_numpy().astype(np.float64) if "scale" in w.columns else None
    rest = w.where(F.col("token_id") >= near)
    vec = F.col("vec") if scale is None else F.transform("vec", lambda c: c * F.col("scale").cast("double"))
    return Table(m, scale, rest.select("token_id", vec.alias("vec")) if n > near else None, n)


def with_far(df: DataFrame, w: Table, ids_col: str = "ids", ignored: tuple[int, ...] = ()) -> DataFrame:
    """`df` with `_far`, the lists of the rows of its ids that are not near."""
    x = _keyed(df)
    ids = x.select("_key", F.explode(ids_col).alias("token_id")).where(F.col("token_id") >= len(w.near))
    rows = w.far.where(~F.col("token_id").isin(*ignored)) if ignored else w.far
    return x.join(ids.join(rows, "token_id").groupBy("_key").agg(F.collect_list("vec").alias("_far")), "_key", "left").drop("_key")


def pool(df: DataFrame, weights: np.ndarray | Table, ids_col: str = "ids", out: str = "embedding", divide: bool = True, ignored: tuple[int, ...] = (), finish: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """`df` with the mean (or sum) of its ids' rows in double, as `finish` makes it; no ids give zeros; an id beyond the table is an error."""
    w = as_table(weights)
    if ignored:
        near = w.near.copy()
        near[[i for i in ignored if i < len(near)]] = 0
        w = w._replace(near=near)
    shared = df.sparkSession.sparkContext.broadcast(w._replace(far=None))

    @F.arrow_udf("array<double>")
    def mean(x: pa.Array) -> pa.Array:
        return made(x)

    @F.arrow_udf("array<double>")
    def mean_of_both(x: pa.Array, far: pa.Array) -> pa.Array:
        return made(x, far)

    def made(x: pa.Array, far: pa.Array | None = None) -> pa.Array:
        v = pooled(shared.value, *lists(x), divide, far)
        return as_lists(finish(v) if finish else v)

    if w.far is None:
        return df.withColumn(out, mean(F.col(ids_col)))
    return with_far(df, w, ids_col, ignored).withColumn(out, mean_of_both(F.col(ids_col), F.col("_far"))).drop("_far")


def quantized_weights(codes: DataFrame, axis: str) -> tuple[Table, np.ndarray | None]:
    """(table, scales) of quantize()'s rows. By dimension: the codes, summed as whole numbers, and the scales for the end; by row: scale times code."""
    if axis == "dim":
        first = codes.select("scales").first()
        return collect_weights(codes.select("token_id", F.col("codes").alias("vec"))), np.array(first.scales, np.float64) if first else np.zeros(0)
    return collect_weights(codes.select("token_id", F.col("codes").alias("vec"), "scale")), None


def pool_quantized(df: DataFrame, codes: DataFrame, axis: str, ids_col: str = "ids", out: str = "embedding") -> DataFrame:
    """Mean over quantized rows."""
    w, scales = quantized_weights(codes, axis)
    if scales is None:
        return pool(df, w, ids_col, out)
    summed = pool(df, w, ids_col, "_sum", divide=False)
    each = F.zip_with("_sum", F.array(*(F.lit(float(s)) for s in scales)), lambda x, s: x * s / F.greatest(F.size(ids_col), F.lit(1)))
    return summed.withColumn(out, each).drop("_sum")


def counters(df: DataFrame, ids_col: str = "ids", seconds: float | None = None) -> DataFrame:
    """Documents, tokens, empty documents and mean tokens of rows of ids; with the `seconds` that they took, also the rates."""
    n = F.size(ids_col)
    rates = [] if seconds is None else [(F.count("*") / seconds).alias("docs_per_s"), (F.sum(n) / seconds).alias("tokens_per_s")]
    return df.agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.count_if(n == 0).alias("n_empty"), F.round(F.avg(n), 6).alias("mean_tokens"), *rates)


_tokenizers: dict = {}
#: Bytes of text of a portion: the library holds some hundred bytes for each of its tokens.
PORTION = 1 << 20


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch's texts in order, in portions of PORTION bytes at most; a longer text is one of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right")))
        yield texts.slice(at, end - at)
        at = end


def wordpiece(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """`df` with the ids of a tokenizer file of the tokenizers library, without special tokens, in Arrow batches.

    The file is read by the driver, from any file system, and goes to the executors with the function: none of them needs it.
    """
    from ..sources.files import read_bytes

    raw = read_bytes(path)
    if raw is None:
        raise FileNotFoundError(path)
    shared = df.sparkSession.sparkContext.broadcast(raw.decode())

    @F.arrow_udf("array<int>")
    def encode(x: pa.Array) -> pa.Array:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        name = hash(shared.value)
        if name not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[name] = Tokenizer.from_str(shared.value)
        ids = [np.zeros(0, np.int32)]
        for part in portions(x):
            ids += [np.array(e.ids, np.int32) for e in _tokenizers[name].encode_batch_fast(["" if t is None else t for t in part.to_pylist()], add_special_tokens=False)]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([len(i) for i in ids]).astype(np.int32)), pa.array(np.concatenate(ids)))

    return df.withColumn(out, encode(F.col(text_col).cast("string")))


def _asked(queries: DataFrame, *columns: str) -> list:
    """A stated set of queries, its size checked."""
    rows = queries.select(*columns).collect()
    if sum(len(r[1]) * 8 for r in rows) > MOST_BYTES:
        raise ValueError("the query set is too large to broadcast; split it")
    return rows


def _directions(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n == 0, 1, n)


def best_of(ids: list, queries: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int, exclude_same: bool = False) -> tuple[list, list, list]:
    """(query, row, score) of the k rows of a batch with the greatest products for each query, ties by id; in blocks of queries."""
    q, i, score = [], [], []
    for at in range(0, len(ids), 1024):
        s = np.round(queries[at : at + 1024] @ rows.T, 9)
        for j, row in enumerate(s):
            if exclude_same:
                row = np.where(own == ids[at + j], -np.inf, row)
            cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            keep = np.flatnonzero((row >= cut) & (row > -np.inf))
            keep = keep[np.lexsort((own[keep], -row[keep]))[:k]]
            q.extend([ids[at + j]] * len(keep)), i.extend(own[keep].tolist()), score.extend(row[keep].tolist())
    return q, i, score


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", query_col: str = "qid", vec: str = "embedding", exclude_same: bool = False, part: str | None = None) -> DataFrame:
    """(qid, id, score, rank): the k corpus rows of greatest cosine for each query, ties by id; with `part`, (part, ...) for each part of the corpus.

    The queries are a stated set: collected, size-checked, and taken in blocks; each Arrow batch of the corpus gives its
    own k best of a block by one matrix product, and a window limited by rank merges them.
    """
    rows = _asked(queries, query_col, vec)
    shared = corpus.sparkSession.sparkContext.broadcast(([r[0] for r in rows], _directions(np.array([r[1] for r in rows], np.float64)) if rows else np.zeros((0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = shared.value
        for batch in batches:
            if not batch.num_rows or not ids:
                continue
            own, v = batch.column(0).to_numpy(zero_copy_only=False), _directions(matrix(batch.column(1)))
            parts = batch.column(2).dictionary_encode()
            at = parts.indices.fill_null(len(parts.dictionary)).to_numpy()
            for j, name in enumerate([*parts.dictionary.to_pylist(), None]):
                of = np.flatnonzero(at == j)
                if len(of):
                    q, i, score = best_of(ids, m, own[of], v[of], k, exclude_same)
                    yield pa.record_batch({"part": pa.array([name] * len(q), pa.string()), "qid": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(score, pa.float64())})

    from pyspark.sql import Window as W

    found = corpus.select(F.col(id_col).cast("bigint"), vec, (F.col(part) if part else F.lit("")).cast("string").alias("part")).mapInArrow(run, "part string, qid bigint, id bigint, score double")
    found, w = (found, W.partitionBy("part", "qid")) if part else (found.drop("part"), W.partitionBy("qid"))
    w = w.orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mined_negatives(corpus: DataFrame, queries: DataFrame, threshold: float = 0.95, n: int = 50, id_col: str = "id", query_col: str = "qid", vec: str = "embedding", tag: str = "label") -> DataFrame:
    """(query_id, positive, negatives, n_eligible, n_pre) for each of a stated set of queries, never itself among the rows.

    The positive is the row of the query's tag with the greatest cosine (rounded to six digits), else of any tag; ties by
    id. Eligible are the other rows strictly below threshold times its score; the `n` hardest come first, ties by the greater
    id. Two passes over the corpus: one for the positives, one that counts and keeps `n` of each batch; no query ever
    gathers its scores.
    """
    rows = _asked(queries, query_col, vec, tag)
    spark = corpus.sparkSession
    ids = np.array([r[0] for r in rows], np.int64)
    m, tags = _directions(np.array([r[1] for r in rows], np.float64)) if rows else np.zeros((0, 1)), np.array([r[2] for r in rows])
    shared = spark.sparkContext.broadcast((ids, m, tags))
    x = corpus.select(F.col(id_col).cast("bigint"), vec, tag)

    def scored(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
        ids, m, tags = shared.value
        own, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        s = np.round(m[at : at + 256] @ _directions(matrix(batch.column(1))).T, 6)
        return own, np.where(own[None, :] == ids[at : at + 256, None], -np.inf, s), tags[at : at + 256, None] == mark[None, :]

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value[0]
        for batch in batches:
            for at in range(0, len(ids) if batch.num_rows else 0, 256):
                own, s, same = scored(batch, at)
                for of, wanted in ((True, np.where(same, s, -np.inf)), (False, s)):
                    top = wanted.max(1)
                    first = np.where(wanted == top[:, None], own[None, :], np.iinfo(np.int64).max).min(1)
                    ok = top > -np.inf
                    yield pa.record_batch({"qid": pa.array(ids[at : at + 256][ok]), "same": pa.array(np.full(ok.sum(), of)), "score": pa.array(top[ok]), "id": pa.array(first[ok])})

    found = x.mapInArrow(positives, "qid bigint, same boolean, score double, id bigint").groupBy("qid").agg(F.max(F.struct("same", "score", (-F.col("id")).alias("i"))).alias("p")).collect()
    best = {r.qid: (r.p.score, -r.p.i) for r in found}
    top = spark.sparkContext.broadcast((np.array([best.get(i, (-np.inf, -1))[0] for i in ids.tolist()]), np.array([best.get(i, (-np.inf, -1))[1] for i in ids.tolist()], np.int64)))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value[0]
        score, positive = top.value
        for batch in batches:
            for at in range(0, len(ids) if batch.num_rows else 0, 256):
                own, s, _ = scored(batch, at)
                ok = (s < threshold * score[at : at + 256, None]) & (own[None, :] != positive[at : at + 256, None]) & (s > -np.inf)
                q, i, v = [], [], []
                for j in range(len(s)):
                    keep = np.flatnonzero(ok[j])
                    keep = keep[np.lexsort((-own[keep], -s[j][keep]))[:n]]
                    q.append(np.full(len(keep), ids[at + j])), i.append(own[keep]), v.append(s[j][keep])
                part = ids[at : at + 256]
                yield pa.record_batch({"qid": pa.array(np.concatenate([part, *q])), "n": pa.array(np.append(ok.sum(1), np.zeros(sum(map(len, q)), np.int64))), "id": pa.array(np.concatenate([np.zeros(len(part), np.int64), *i])), "score": pa.array(np.concatenate([np.full(len(part), np.nan), *v]))})

    from pyspark.sql import Window as W

    kept = x.mapInArrow(negatives, "qid bigint, n bigint, id bigint, score double")
    hard = F.when(~F.isnan("score"), F.struct("score", "id"))
    w = W.partitionBy("qid").orderBy(F.isnan("score").asc(), F.desc("score"), F.desc("id"))
    kept = kept.withColumn("rank", F.row_number().over(w))
    out = kept.groupBy("qid").agg(F.sum("n").alias("n_eligible"), F.sort_array(F.collect_list(F.when(F.col("rank") <= n, hard)), asc=False).alias("hard"))
    names = spark.createDataFrame([(i, p) for i, (_, p) in best.items()], "qid bigint, positive bigint")
    return out.join(F.broadcast(names), "qid").select(F.col("qid").alias("query_id"), "positive", F.transform("hard", lambda h: h["id"]).alias("negatives"), "n_eligible")


def containing(df: DataFrame, items: DataFrame, id_col: str = "id", text_col: str = "text", item_col: str = "qid", pattern_col: str = "item") -> DataFrame:
    """(item, id): the rows whose text contains an item's text, each pair once. One pass over each text with an automaton of all items.

    The items are a stated set: collected and size-checked. An empty item is in every text, a null one in none.
    """
    import ahocorasick

    rows = items.where(F.col(pattern_col).isNotNull()).select(item_col, pattern_col).distinct().collect()
    if sum(len(r[1]) for r in rows) > MOST_BYTES >> 2:
        raise ValueError("the items are too large to broadcast; split them")
    of: dict[str, list] = {}
    for r in rows:
        of.setdefault(r[1], []).append(r[0])
    tree = ahocorasick.Automaton()
    for text, names in of.items():
        if text:
            tree.add_word(text, names)
    if len(tree):
        tree.make_automaton()
    shared = df.sparkSession.sparkContext.broadcast((tree, of.get("", [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, always = shared.value
        for batch in batches:
            item, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    found = set(always).union(*(names for _, names in tree.iter(text))) if len(tree) else set(always)
                    item.extend(found), at.extend([i] * len(found))
            yield pa.record_batch({"item": pa.array(item, pa.int64()), "id": batch.column(0).take(pa.array(at, pa.int64()))})

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))).mapInArrow(run, f"item bigint, id {kind}").distinct()
