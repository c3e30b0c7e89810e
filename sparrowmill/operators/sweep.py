"""The grid of quantized variants and its evaluation, with checks that every cell is there once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import slug
from . import embed, quantize

#: The grid's dimensions, bits and axes.
DIMS = (1024, 512, 256, 128, 64, 32)
BITS = (8, 4, 3, 2)
AXES = ("row", "dim", "hybrid")
#: The deployed variants by group, as (bits, axis, dim).
GROUPS = {
    "int8_dim": ((8, "dim", 1024), (8, "dim", 512), (8, "dim", 256), (8, "dim", 128)),
    "int4_dim": ((4, "dim", 1024), (4, "dim", 512), (4, "dim", 256), (4, "dim", 128)),
    "row": ((8, "row", 256), (4, "row", 512), (2, "row", 1024), (2, "row", 512)),
}


def scaled(most: int, full: int = DIMS[0]) -> dict:
    """GROUPS for weights of `most` dimensions: the same shares of them."""
    return {g: tuple((b, a, d * most // full) for b, a, d in cells_) for g, cells_ in GROUPS.items()}


def cells(dims: Iterable[int] = DIMS, bits: Iterable[int] = BITS, axes: Iterable[str] = AXES) -> list[tuple[int, str | None, int]]:
    """(bits, axis, dim): at 32 bits there is no axis."""
    return [c for d in dims for c in ((32, None, d), *((b, a, d) for b in bits for a in axes))]


def grid(spark: SparkSession, wanted: list[tuple[int, str | None, int]]) -> DataFrame:
    g = spark.createDataFrame(wanted, "bits int, axis string, dim int")
    return g.withColumn("name", F.when(F.col("bits") >= 32, "fp32").otherwise(F.concat(F.lit("int"), F.col("bits").cast("string"), F.lit("_"), F.col("axis"))))


def check(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """(bits, axis, dim, problem) for cells that are missing, unexpected or there twice; null axes are equal."""
    keys = ["bits", "axis", "dim"]
    both = done.select(*keys, F.lit(1).alias("d"), F.lit(0).alias("w")).union(wanted.select(*keys, F.lit(0), F.lit(1)))
    n = both.groupBy(*keys).agg(F.sum("d").alias("d"), F.sum("w").alias("w"))
    problem = F.when(F.col("d") == 0, "missing").when(F.col("w") == 0, "unexpected").when(F.col("d") > 1, "twice")
    return n.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def table(weights: DataFrame, bits: int, axis: str | None, dim: int) -> DataFrame:
    """The weights of a cell: sliced first, then there and back again."""
    w = quantize.slice_table(weights, dim)
    back = quantize.hybrid_quantize(w, bits) if axis == "hybrid" else quantize.fake_quantize(w, bits, axis or "dim")
    return back.select("token_id", F.col("back").alias("vec"))


def evaluate(weights: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, wanted: list[tuple[int, str | None, int]], k: int = 10) -> DataFrame:
    """(bits, axis, dim, ndcg10) for corpus (id, ids), queries (qid, ids), qrels (qid, id): one pass over the corpus for all cells.

    The weights are broadcast as they are, as far as they are near, and each cell's rows are made of them where they are
    summed, from those that a batch has; of the whole table a cell needs the greatest magnitude of each dimension. The query
    set's size is checked.
    """
    spark = weights.sparkSession
    plain = embed.collect_weights(weights.select("token_id", F.col("vec").cast("array<float>").alias("vec")))
    largest = {}
    for _, axis, dim in wanted:
        if axis in ("dim", "hybrid") and (axis, dim) not in largest:
            w = quantize.slice_table(weights, dim)
            largest[axis, dim] = quantize.magnitudes(quantize.over_top(w) if axis == "hybrid" else w)

    def reach(df: DataFrame) -> DataFrame:
        return embed.with_far(df, plain) if plain.far is not None else df.withColumn("_far", F.lit(None).cast("array<array<float>>"))

    def vectors(cell: tuple[int, str | None, int], near: np.ndarray, size: int, ids: np.ndarray, start: np.ndarray, far: pa.Array) -> np.ndarray:
        """The unit vectors of rows of ids by a cell's table."""
        bits, axis, dim = cell
        made = lambda x: quantize.fake_rows(np.ascontiguousarray(x[:, :dim]), bits, axis, largest.get((axis, dim)))
        here = np.zeros(len(near), bool)
        here[ids[ids < len(near)]] = True
        table = np.zeros((len(near), min(dim, near.shape[1])), np.float32)
        table[here] = made(near[here])
        return embed.unit(embed.pooled(embed.Table(table, size=size), ids, start, far=far, each=made))

    asked = reach(queries.select("qid", "ids")).select("qid", "ids", "_far").toArrow()
    qids, asked_ids, asked_far = asked["qid"].to_pylist(), embed.lists(asked["ids"]), asked["_far"].combine_chunks()
    if sum(len(qids) * c[2] * 8 for c in wanted) > embed.MOST_BYTES:
        raise ValueError("the cells and queries are too large to broadcast; evaluate fewer at once")
    shared = spark.sparkContext.broadcast((qids, plain.near, plain.size, [vectors(c, plain.near, plain.size, *asked_ids, asked_far) for c in wanted]))

    def run(batches):
        qids, near, size, asked = shared.value
        for batch in batches:
            if not batch.num_rows or not qids:
                continue
            own, ids = batch.column(0).to_numpy(), embed.lists(batch.column(1))
            for c, q in enumerate(asked):
                best = embed.best_of(qids, q, own, vectors(wanted[c], near, size, *ids, batch.column(2)), k)
                yield pa.record_batch({"cell": pa.array(np.full(len(best[0]), c, np.int32)), "qid": pa.array(best[0], pa.int64()), "id": pa.array(best[1], pa.int64()), "score": pa.array(best[2], pa.float64())})

    found = reach(corpus.select(F.col("id").cast("bigint"), "ids")).select("id", "ids", "_far").mapInArrow(run, "cell int, qid bigint, id bigint, score double")
    w = W.partitionBy("cell", "qid").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, *c) for i, c in enumerate(wanted)], "cell int, bits int, axis string, dim int")
    rel = qrels.groupBy("qid").agg(F.count("*").alias("n_rel"))
    hits = ranked.join(qrels, ["qid", "id"]).groupBy("cell", "qid").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    per = rel.crossJoin(F.broadcast(names)).join(hits, ["cell", "qid"], "left")  # a row for each scored query and cell
    return per.groupBy("bits", "axis", "dim").agg(F.round(F.avg(F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg10"))


def deployment(weights: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, groups: dict = GROUPS, k: int = 10) -> DataFrame:
    """(group, slug, bits, axis, dim, ndcg10) of the deployed variants that the weights' dimension has room for."""
    most = weights.select(F.size("vec").alias("d")).first().d
    rows = [(g, *c) for g, cells_ in groups.items() for c in cells_ if c[2] <= most]
    scores = evaluate(weights, corpus, queries, qrels, [r[1:] for r in rows], k)
    named = weights.sparkSession.createDataFrame(rows, "`group` string, bits int, axis string, dim int")
    return named.join(scores, ["bits", "axis", "dim"]).select("group", slug(F.col("bits"), F.col("axis"), F.col("dim")).alias("slug"), "bits", "axis", "dim", "ndcg10")
