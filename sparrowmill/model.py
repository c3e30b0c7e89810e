"""The model as a library user sees it: load an artifact, encode, embed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import normalize
from .operators import embed as E
from .operators import quantize as Q
from .sources import tables


class Tokenizer:
    """Words over a vocabulary (token, token_id), or a tokenizer file; no special tokens."""

    def __init__(self, vocab: DataFrame | None = None, path: str | None = None):
        if (vocab is None) == (path is None):
            raise ValueError("either a vocabulary or a path")
        self.vocab, self.path = vocab, path

    def encode(self, df: DataFrame, text_col: str = "text", out: str = "ids") -> DataFrame:
        return E.wordpiece(df, self.path, text_col, out) if self.path else E.token_ids(df, self.vocab, text_col, out)


class Model:
    def __init__(self, weights: DataFrame, metadata: dict[str, str]):
        self.matrix, self.metadata = E.collect_weights(weights), metadata

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        weights, meta = tables.read_artifact(spark, path)
        if meta["bits"] == "2" and meta["axis"] == "dim":
            raise ValueError("two bits by dimension are not deployed")
        return cls(weights, meta)

    @property
    def bits(self) -> int:
        return int(self.metadata["bits"])

    @property
    def axis(self) -> str:
        return self.metadata["axis"]

    @property
    def dim(self) -> int:
        return self.matrix.dim

    @property
    def vocab_size(self) -> int:
        return self.matrix.size

    @property
    def variant(self) -> str:
        return Q.variant(self.bits, self.axis)

    def embed(self, df: DataFrame, ids_col: str = "ids", out: str = "embedding", unit: bool = True) -> DataFrame:
        """`df` with the mean of its ids' rows, normalized; no ids give the zero vector."""
        v = E.pool(df, self.matrix, ids_col, out)
        return v.withColumn(out, normalize(F.col(out))) if unit else v

    def embed_documents(self, df: DataFrame, tokenizer: Tokenizer, text_col: str = "text", unit: bool = True) -> DataFrame:
        return self.embed(tokenizer.encode(df, text_col), unit=unit)


def quantize_table(weights: DataFrame, path: str, dim: int, bits: int, axis: str, metadata: dict[str, str] | None = None, check: bool = True) -> dict:
    """Slices, quantizes and writes an artifact; returns the error of reading it back."""
    w = Q.slice_table(weights, dim)
    q = w if bits >= 32 else Q.quantize(w, bits, axis)
    tables.write_artifact(path, q, bits, axis, dim, {"variant": Q.variant(bits, axis), "tokenizer": "words"} | (metadata or {}))
    if not check:
        return {}
    back = tables.read_artifact(weights.sparkSession, path)[0].withColumnRenamed("vec", "back")
    return Q.error_stats(w.join(back, "token_id")).first().asDict()


def evaluate(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, embed: Callable[[DataFrame], DataFrame], dims: tuple[int, ...]) -> DataFrame:
    """(dim, ndcg10) of (id, text), (qid, text), (qid, id) by `embed`, which adds `embedding`: once in full, then cut to each dimension."""
    from .functions.vectors import truncate
    from .operators import retrieval
    from .session import stored

    c, q = stored(embed(corpus).select("id", "embedding")), stored(embed(queries).select("qid", "embedding"))
    out = None
    for d in dims:
        cut = lambda x, d=d: x.withColumn("embedding", truncate(F.col("embedding"), d))
        one = retrieval.per_query(E.nearest(cut(c), cut(q), 10), retrieval.scored(qrels, queries)).agg(F.lit(d).alias("dim"), F.avg("ndcg").alias("ndcg10"))
        out = one if out is None else out.union(one)
    return out
