"""Deterministic splits, samples and batch plans. Every order is a hash of the seed and the row, so it is stable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import order_key


def eval_ids(df: DataFrame, id_col: str, seed: int = 42, fraction: float = 0.2, cap: int = 100) -> DataFrame:
    """(source, id) of the held-out rows: per source the first min(round half even(n * fraction), cap) by hash.

    The rank is limited by the cap before the shuffle (a window group limit), so a source of any size sends few rows.
    """
    ids = df.select("source", F.col(id_col).alias("id")).distinct()
    n = ids.groupBy("source").agg(F.least(F.bround(F.count("*") * F.lit(fraction)).cast("bigint"), F.lit(cap).cast("bigint")).alias("n_eval"))
    w = W.partitionBy("source").orderBy(order_key(seed, F.col("source"), F.col("id")))
    top = ids.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    return top.join(n, "source").where(F.col("rn") <= F.col("n_eval")).select("source", "id")


def stratified_split(df: DataFrame, id_col: str, seed: int = 42, fraction: float = 0.2, cap: int = 100) -> DataFrame:
    """(source, id, split) for each distinct id of each source."""
    held = eval_ids(df, id_col, seed, fraction, cap).withColumn("held", F.lit(True))
    ids = df.select("source", F.col(id_col).alias("id")).distinct()
    return ids.join(held, ["source", "id"], "left").select("source", "id", F.when(F.col("held"), "eval").otherwise("train").alias("split"))


def split_summary(split: DataFrame) -> DataFrame:
    """Per source and in total: counts, the realized fraction, and ids in both splits (must be none)."""
    per = split.groupBy("source", "id").agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "eval").alias("e"))
    r = per.rollup("source").agg(F.grouping("source").alias("g"), F.sum("t").alias("n_train"), F.sum("e").alias("n_eval"), F.count_if((F.col("t") > 0) & (F.col("e") > 0)).alias("n_both"))
    return r.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "n_train", "n_eval", "n_both", F.round(F.col("n_eval") / (F.col("n_train") + F.col("n_eval")), 6).alias("fraction"))


def distractors(corpus: DataFrame, positives: DataFrame, id_col: str, n: int = 3000, seed: int = 42) -> DataFrame:
    """`n` ids of `corpus` that are no positive, by hash: a sample without replacement. One top-n, no full sort."""
    rest = corpus.select(F.col(id_col).alias("id")).join(positives.select(F.col(id_col).alias("id")), "id", "left_anti")
    return rest.orderBy(order_key(seed * 1000 + 7, F.col("id")), "id").limit(n)


def sample_negatives(df: DataFrame, key: str, negatives: str, k: int = 7, seed: int = 42) -> DataFrame:
    """k of each row's negatives without replacement, by hash of (seed, key, place), in the row."""
    pairs = F.transform(F.col(negatives), lambda x, j: F.struct(order_key(seed, F.col(key), j).alias("h"), x.alias("x")))
    checked = F.when(F.size(negatives) >= k, pairs).otherwise(F.raise_error(F.lit("more negatives wanted than a row has")))
    return df.withColumn("sampled", F.transform(F.slice(F.array_sort(checked), 1, k), lambda s: s["x"]))


def batch_windows(sizes: DataFrame, batch: int, drop_last: bool = True) -> DataFrame:
    """(source, start, n): windows 0, b, 2b, ... of each source (source, size); tails of one row are never given."""
    last = F.expr(f"size div {batch}") if drop_last else F.expr(f"(size + {batch} - 1) div {batch}")
    w = sizes.withColumn("b", last).where("b > 0").select("source", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b") - 1)).alias("k"))
    w = w.select("source", (F.col("k") * batch).alias("start"), F.least(F.lit(batch).cast("bigint"), F.col("size") - F.col("k") * batch).alias("n"))
    return w.where("n > 1")


def rank_plan(windows: DataFrame, epoch: int, world: int = 1, seed: int = 42) -> DataFrame:
    """(step, rank, source, start): the epoch's shuffle of the windows, dealt in turn and cut so that all ranks have as many.

    Numbered in two steps, within the 4,096 buckets of the order's leading digits and over the buckets' counts.
    """
    keyed = windows.withColumn("_key", order_key(seed + epoch, F.col("source"), F.col("start"))).withColumn("_bucket", F.substring("_key", 1, 3))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    every = W.orderBy("_bucket")
    base = counts.select("_bucket", (F.sum("_n").over(every.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_base"), F.sum("_n").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    own = F.row_number().over(W.partitionBy("_bucket").orderBy("_key", "source", "start")) - 1
    p = keyed.withColumn("_own", own).join(base, "_bucket").withColumn("p", F.col("_base") + F.col("_own"))
    p = p.withColumn("step", F.expr(f"p div {world}")).withColumn("rank", F.col("p") % world)
    return p.where(F.col("step") < F.expr(f"total div {world}")).select("step", "rank", "source", "start")


def step_count(sizes: DataFrame, batch: int, world: int = 1) -> DataFrame:
    return sizes.agg(F.expr(f"sum(size div {batch}) div {world}").alias("steps"))


def learning_rates(spark, total: int, peak: float, warmup_ratio: float) -> DataFrame:
    """(step, lr): linear warm-up over max(1, int(total * ratio)) steps, then linear decay to zero."""
    warm = max(1, int(total * warmup_ratio))
    s = F.col("id")
    lr = F.when(s < warm, peak * s / warm).otherwise(peak * F.greatest(F.lit(0.0), (total - s) / F.lit(max(1, total - warm))))
    return spark.range(total).select(s.alias("step"), F.round(lr, 9).alias("lr"))


def source_distribution(windows: DataFrame) -> DataFrame:
    n = windows.groupBy("source").agg(F.count("*").alias("batches"))
    return n.withColumn("fraction", F.round(F.col("batches") / F.sum("batches").over(W.partitionBy()), 6))


def hard_negatives(scores: DataFrame, threshold: float = 0.95, n: int = 50) -> DataFrame:
    """(query_id, positive, negatives, n_eligible) of `scores` (query_id, document_ids, scores), the positive first.

    A candidate is eligible if its score is strictly below threshold * the positive's; NaN never is. Kept are queries
    with `n` eligible or more; the hardest come first, ties by the greater id. Works within the row.
    """
    known = scores.where((F.coalesce(F.size("document_ids"), F.lit(0)) > 0) & (F.coalesce(F.size("scores"), F.lit(0)) > 0))
    m = F.least(F.size("document_ids"), F.size("scores"))
    pairs = F.arrays_zip(F.slice("scores", F.lit(2), F.greatest(m - 1, F.lit(0))).alias("s"), F.slice("document_ids", F.lit(2), F.greatest(m - 1, F.lit(0))).alias("d"))
    top = F.element_at("scores", 1) * threshold
    ok = F.filter(pairs, lambda x: ~F.isnan(x["s"]) & ~F.isnan(top) & (x["s"] < top))
    out = known.select("query_id", F.element_at("document_ids", 1).alias("positive"), F.sort_array(ok, asc=False).alias("ok"))
    return out.where(F.size("ok") >= n).select("query_id", "positive", F.transform(F.slice("ok", 1, n), lambda x: x["d"]).alias("negatives"), F.size("ok").cast("bigint").alias("n_eligible"))


def negatives_summary(scores: DataFrame, kept: DataFrame) -> DataFrame:
    """n_pre, n_kept, n_dropped; empty and null arrays count as dropped."""
    return scores.agg(F.count("*").alias("n_pre")).crossJoin(kept.agg(F.count("*").alias("n_kept"))).withColumn("n_dropped", F.col("n_pre") - F.col("n_kept"))


def dense_ids(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, rank): the place of each distinct id (a whole number) among all, from 0, numbered by chunks and within them."""
    from .schedule import offsets

    x = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().select(F.lit(0).alias("all"), "id", F.lit(1).cast("bigint").alias("one"))
    return offsets(x, "all", "id", "one").select("id", F.col("start").alias("rank"))


def gather_triples(pairs: DataFrame, queries: DataFrame, documents: DataFrame, negatives: int) -> DataFrame:
    """(query_id, positive, query_ids, positive_ids, negative_ids) for `pairs` (query_id, positive, negatives): the tokens of
    each text, encoded once, brought back to every pair that has it. An id without tokens, or another number of negatives than
    `negatives`, is an error."""

    def need(c: str):
        return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit("a pair's text has no tokens")))

    size = F.when(F.size("negatives") == negatives, F.col("negatives")).otherwise(F.raise_error(F.lit(f"a pair has not {negatives} negatives")))
    p = pairs.select("query_id", "positive", size.alias("negatives"))
    roles = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("positive").alias("id"))), F.transform("negatives", lambda x, i: F.struct(i.alias("at"), x.alias("id"))))
    each = p.select("query_id", "positive", F.explode(roles).alias("r")).select("query_id", "positive", "r.at", "r.id")
    each = each.join(documents.select("id", F.col("ids").alias("tokens")), "id", "left").select("query_id", "positive", "at", need("tokens").alias("tokens"))
    met = each.groupBy("query_id", "positive").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"]).alias("all"))
    met = met.join(queries.select(F.col("id").alias("query_id"), F.col("ids").alias("query_ids")), "query_id", "left")
    return met.select("query_id", "positive", need("query_ids").alias("query_ids"), F.element_at("all", 1).alias("positive_ids"), F.slice("all", 2, max(1, negatives)).alias("negative_ids"))
