"""Mixing many sources: a prefix-stable proportional schedule and the tiers that are its prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a chunk, and the targets of the tiers (null: all).
CHUNK = 10_000
TIERS = {"xs": 10_000_000, "small": 100_000_000, "medium": 275_000_000, "full": None}


def sizes(df: DataFrame, source_col: str = "source") -> DataFrame:
    return df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("size"))


def usable(sizes_: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Sources that are not excluded and not empty, with their index by name; a missing size is zero."""
    kept = sizes_.where(~F.col("source").isin(*excluded) if excluded else F.lit(True)).where(F.coalesce("size", F.lit(0)) > 0)
    return kept.withColumn("source_idx", (F.row_number().over(W.orderBy("source")) - 1).cast("bigint"))


def schedule(sources: DataFrame, chunk: int = CHUNK, target: int | None = None) -> DataFrame:
    """(chunk_no, source_idx, source, row_start, row_end, before): always the source that is least far along comes next.

    In closed form: all chunks by the share of their source before them, ties by index, cut at the target. There is a
    row for each `chunk` rows of input, so the one window over all of them is small.
    """
    starts = sources.select("source", "source_idx", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {chunk}"))).alias("k")).withColumn("row_start", F.col("k") * chunk)
    share = F.col("row_start").cast("decimal(20,0)") / F.col("size").cast("decimal(20,0)")
    w = W.orderBy(share, "source_idx")
    cut = starts.withColumn("len", F.least(F.lit(chunk).cast("bigint"), F.col("size") - F.col("row_start")))
    cut = cut.withColumn("chunk_no", (F.row_number().over(w) - 1).cast("bigint")).withColumn("before", F.sum("len").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("len"))
    if target is not None:
        cut = cut.where(F.col("before") < target).withColumn("len", F.least("len", F.lit(target) - F.col("before")))
    return cut.select("chunk_no", "source_idx", "source", "row_start", (F.col("row_start") + F.col("len")).alias("row_end"), "before")


def coalesced(chunks: DataFrame) -> DataFrame:
    """Adjacent chunks of one source as one (gaps and islands)."""
    w = W.orderBy("chunk_no")
    new = F.when(F.lag("source_idx").over(w) == F.col("source_idx"), 0).otherwise(1)
    runs = chunks.withColumn("run", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("run").agg(F.first("source_idx").alias("source_idx"), F.first("source").alias("source"), F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"))


def tiers(sources: DataFrame, chunk: int = CHUNK, targets: dict[str, int | None] = TIERS) -> DataFrame:
    """(tier, target_rows, actual_rows, source, take_rows): each tier is a prefix of one schedule, so tiers nest."""
    spark = sources.sparkSession
    full = schedule(sources, chunk)
    t = spark.createDataFrame([(k, v) for k, v in targets.items()], "tier string, target_rows bigint")
    length = F.col("row_end") - F.col("row_start")
    room = F.coalesce(F.col("target_rows"), F.lit(1 << 62)) - F.col("before")
    taken = full.crossJoin(F.broadcast(t)).withColumn("take", F.greatest(F.lit(0), F.least(length, room)))  # a row for each tier and chunk; tiers are a handful
    by = taken.groupBy("tier", "target_rows", "source").agg(F.sum("take").alias("take_rows"))
    return by.withColumn("actual_rows", F.sum("take_rows").over(W.partitionBy("tier"))).select("tier", "target_rows", "actual_rows", "source", "take_rows")


def tier_summary(tiers_: DataFrame) -> DataFrame:
    return tiers_.groupBy("tier").agg(F.max("target_rows").alias("target_rows"), F.max("actual_rows").alias("actual_rows"), F.count_if(F.col("take_rows") > 0).alias("sources_touched"))


def prefix(df: DataFrame, tiers_: DataFrame, tier: str, row_col: str = "row_idx") -> DataFrame:
    """The rows of `df` (source, row_idx, ...) that a tier takes: a filter by the source's take, no copy."""
    takes = tiers_.where((F.col("tier") == tier) & (F.col("take_rows") > 0)).select("source", "take_rows")
    return df.join(takes, "source").where(F.col(row_col) < F.col("take_rows")).drop("take_rows")


def subset_stats(tokenized: DataFrame) -> DataFrame:
    """(source, n_rows, n_tokens) with a TOTAL row; `tokenized` has source and n_tokens."""
    r = tokenized.rollup("source").agg(F.grouping("source").alias("g"), F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
    return r.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "n_rows", "n_tokens")


def offsets(df: DataFrame, key: str, order: str, size: str, chunk: int = 4096) -> DataFrame:
    """`df` with `start`, the sum of `size` before each row within `key` in `order` (an integer).

    Summed in two steps, by chunks of the order and within them, so that a key with most rows is dealt over many tasks.
    """
    c = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sums = c.groupBy(key, "_chunk").agg(F.sum(size).alias("_sum"))
    base = sums.withColumn("_base", F.sum("_sum").over(W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).drop("_sum")
    own = F.sum(size).over(W.partitionBy(key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(size)
    return c.withColumn("_own", own).join(base, [key, "_chunk"]).withColumn("start", F.col("_own") + F.col("_base")).drop("_own", "_base", "_chunk")
