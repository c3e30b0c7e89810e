"""Incremental work: streams over files that have come since, and tasks that are done once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(stream: DataFrame, write, checkpoint: str) -> None:
    """Runs `write`(batch, number) over all that is there, then stops; a later call goes on from the checkpoint."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def tokenized_stream(spark: SparkSession, path: str, schema: str, vocab: DataFrame, out: str, checkpoint: str, text_col: str = "text") -> None:
    """Token ids of a folder of Parquet files, appended as Parquet; files that were read are not read again.

    A batch that is written again after a failure replaces its own folder, so no row stands there twice.
    """
    from ..operators.embed import token_ids

    def write(batch: DataFrame, number: int) -> None:
        token_ids(batch, vocab, text_col, keep_text=False).write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(spark.readStream.schema(schema).parquet(path), write, checkpoint)


def embedded_lines(spark: SparkSession, path: str, embed, out: str, checkpoint: str) -> None:
    """Lines of text files as they come, embedded by `embed`(df with text) and appended."""
    lines = spark.readStream.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("text"))
    drain(lines, lambda batch, number: embed(batch).write.mode("overwrite").parquet(f"{out}/batch={number}"), checkpoint)


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a completion marker; null keys match null keys."""
    d = done.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = c if cond is None else cond & c
    return tasks.join(d, cond, "left_anti")


def upgrade(rows: DataFrame, have: DataFrame, tiers: DataFrame, tier: str) -> DataFrame:
    """The rows (source, row_idx, ...) that a larger tier adds to what is there."""
    from ..operators.schedule import prefix

    return prefix(rows, tiers, tier).join(have.select("source", "row_idx"), ["source", "row_idx"], "left_anti")
