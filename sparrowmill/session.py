"""Sessions and the shared folder in which intermediate tables live."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sparrowmill", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one, but only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparrowmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder at the end of a session, as far as that still can."""
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, path)
        elif path.startswith("file:") and os.path.isdir(path.removeprefix("file://")):
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass


_scopes: list[list] = []


@contextmanager
def scratch():
    """Deletes, at its end, the tables stored within, but for those given to the function that it gives."""
    mine: list[Stored] = []
    _scopes.append(mine)

    def keep(table: Stored) -> Stored:
        mine.remove(table)
        if len(_scopes) > 1:
            _scopes[-2].append(table)
        return table

    try:
        yield keep
    finally:
        _scopes.remove(mine)
        for table in mine:
            table.drop()


class Stored:
    """An intermediate table as Parquet in the shared folder: any executor can be lost and it stays readable.

    `df` reads it again with the lineage cut; `drop()` deletes the files early.
    """

    def __init__(self, df: DataFrame, compression: str = "zstd", level: int = 3):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/sparrowmill/{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", level).parquet(self.path)
        atexit.register(discard, self.spark, self.path)
        if _scopes:
            _scopes[-1].append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read again."""
    return Stored(df).df


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of jobs whose results are stored; nothing refers to them any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
