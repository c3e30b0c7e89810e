"""Ranking metrics over (qid, id, rank), and tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct (qid, id) of positive qrels (score truncated to a whole number above 0) whose query has a text."""
    pos = qrels.where(F.col("score").cast("int") > 0) if "score" in qrels.columns else qrels
    return pos.select("qid", "id").distinct().join(queries.select("qid").distinct(), "qid", "left_semi")


def _within(n: int):
    return lambda r: r <= n


def per_query(ranked: DataFrame, qrels: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """(qid, n_rel, ndcg, mrr, map, and accuracy, precision, recall at 1, 3, 5, 10) for every query with a positive; one without a hit scores 0."""
    rel = qrels.groupBy("qid").agg(F.count("*").alias("n_rel"))
    hits = ranked.where(F.col("rank") <= deep).join(qrels, ["qid", "id"]).groupBy("qid").agg(F.sort_array(F.collect_list("rank")).alias("at"))
    x = rel.join(hits, "qid", "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    top = F.filter("at", lambda r: r <= k)
    dcg = F.aggregate(top, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    ap = F.aggregate(F.transform("at", lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, p: s + p) / F.least("n_rel", F.lit(deep))
    cols = [(dcg / ideal).alias("ndcg"), F.when(F.size(top) > 0, 1 / F.element_at("at", 1)).otherwise(0.0).alias("mrr"), ap.alias("map")]
    for n in (1, 3, 5, 10):
        found = F.size(F.filter("at", _within(n)))
        cols += [(found > 0).cast("double").alias(f"accuracy_{n}"), (found / n).alias(f"precision_{n}"), (found / F.col("n_rel")).alias(f"recall_{n}")]
    return x.select("qid", "n_rel", *cols)


def by_part(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, part: str, dims: tuple[int, ...], k: int = 10) -> DataFrame:
    """(part, dim, n_queries, ndcg10) of corpus (id, part, embedding), queries (qid, embedding), qrels (part, qid, id): each
    part's rows are a corpus of their own, searched by the queries that have a positive in it."""
    from ..functions.vectors import truncate
    from .embed import nearest

    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    rel = qrels.groupBy(part, "qid").agg(F.count("*").alias("n_rel")).withColumn("ideal", ideal)
    out = None
    for d in dims:
        c, q = (x.withColumn("embedding", truncate(F.col("embedding"), d)) for x in (corpus, queries))
        hits = nearest(c, q, k, part=part).withColumnRenamed("part", part).join(qrels, [part, "qid", "id"]).groupBy(part, "qid").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
        one = rel.join(hits, [part, "qid"], "left").groupBy(part).agg(F.lit(d).cast("bigint").alias("dim"), F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")), 6).alias("ndcg10"))
        out = one if out is None else out.union(one)
    return out


def means(per: DataFrame) -> DataFrame:
    return per.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in per.columns if c not in ("qid", "n_rel")))


def counts(corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """n_corpus, n_qrels, n_queries_scored; the last counts queries of qrels even without a text."""
    a = corpus.agg(F.countDistinct("id").alias("n_corpus"))
    return a.crossJoin(qrels.agg(F.countDistinct("qid", "id").alias("n_qrels"), F.countDistinct("qid").alias("n_queries_scored")))


def task_means(results: DataFrame, excluded: tuple[str, ...] = ("climate-fever", "fever")) -> DataFrame:
    """(dim, mean_headline, mean_all) of `results` (task, dim, ndcg); missing values are left out."""
    return results.groupBy("dim").agg(F.round(F.avg(F.when(~F.col("task").isin(*excluded), F.col("ndcg"))), 6).alias("mean_headline"), F.round(F.avg("ndcg"), 6).alias("mean_all"))


def weighted_means(results: DataFrame, weight: str = "n_queries") -> DataFrame:
    """Per dimension the mean, and the mean weighted by queries; null without weight."""
    w = F.sum(F.when(F.col("ndcg").isNotNull(), F.col(weight)))
    return results.groupBy("dim").agg(F.round(F.avg("ndcg"), 6).alias("mean"), F.round(F.sum(F.col("ndcg") * F.col(weight)) / F.nullif(w, F.lit(0)), 6).alias("weighted_mean"))


def pivot(results: DataFrame, dims: list[int]) -> DataFrame:
    p = results.groupBy("task").pivot("dim", dims).agg(F.first("ndcg"))
    return p.select("task", *(F.col(f"`{d}`").alias(f"dim_{d}") for d in dims))


def pareto(points: DataFrame) -> DataFrame:
    """Points that no other beats strictly in both speed and quality (an anti join by inequality; points are few)."""
    q = points.select(F.col("tok_s").alias("_s"), F.col("ndcg12").alias("_n"))
    return points.join(F.broadcast(q), (F.col("_s") > F.col("tok_s")) & (F.col("_n") > F.col("ndcg12")), "left_anti")


def deltas(measured: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Cells of both by null-safe keys, their difference, and whether it is within the tolerance."""
    e = expected.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("value").alias("expected"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    d = F.col("value") - F.col("expected")
    return measured.join(e, on).select(*keys, "value", "expected", F.round(d, 6).alias("delta"), (F.abs(d) < tolerance).alias("ok"))


def in_batch_loss(pairs: DataFrame, scale: float = 20.0, dim: int | None = None) -> DataFrame:
    """(batch, loss) of `pairs` (batch, i, q, d[, negatives]): the mean over a batch of log-sum-exp of the scaled cosines minus the own one's.

    Candidates are the documents of the batch's pairs and, if given, all of its pairs' negatives (an array of vectors). A
    batch's pairs meet within the batch alone, whose size is a training parameter.
    """
    from ..functions.vectors import dot, normalize, truncate

    unit = (lambda c: truncate(F.col(c), dim)) if dim else (lambda c: normalize(F.col(c)))
    candidates = pairs.select("batch", F.col("i").alias("j"), "d")
    if "negatives" in pairs.columns:
        candidates = candidates.union(pairs.select("batch", F.lit(None), F.explode("negatives")))
    s = pairs.select("batch", "i", unit("q").alias("q")).join(candidates.select("batch", "j", unit("d").alias("d")), "batch").select("batch", "i", "j", (scale * dot(F.col("q"), F.col("d"))).alias("s"))
    top = s.groupBy("batch", "i").agg(F.max("s").alias("top"), F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("own"), F.collect_list("s").alias("all"))
    row = F.col("top") + F.ln(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))) - F.col("own")
    return top.select("batch", row.alias("l")).groupBy("batch").agg(F.avg("l").alias("loss"))


def rank_mean(losses: DataFrame, step: str = "step", rank: str = "rank") -> DataFrame:
    """(step, loss): the mean over ranks of each rank's mean `loss`; every rank counts once."""
    per = losses.groupBy(step, rank).agg(F.avg("loss").alias("loss"))
    return per.groupBy(step).agg(F.avg("loss").alias("loss"))


def matryoshka_loss(pairs: DataFrame, dims: dict[int, float], scale: float = 20.0) -> DataFrame:
    """(batch, loss): the weighted mean of the losses at several dimensions."""
    total = sum(dims.values())
    out = None
    for d, w in dims.items():
        one = in_batch_loss(pairs, scale, d).select("batch", (F.col("loss") * w / total).alias("loss"))
        out = one if out is None else out.union(one)
    return out.groupBy("batch").agg(F.sum("loss").alias("loss"))
