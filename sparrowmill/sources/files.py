"""Small driver-side files on any file system: atomic JSON, manifests with guards, resumable results."""

from __future__ import annotations

import json
import os
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def write_bytes(path: str, data: bytes) -> None:
    """Written beside `path` and moved into place, so a reader never sees half a file."""
    fs, at = _fs(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    tmp = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, at)


@contextmanager
def write_stream(path: str):
    """A file to write to, beside `path`; it is moved into place at the end, and deleted if there is none."""
    fs, at = _fs(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    tmp = f"{at}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(tmp) as f:
            yield f
        fs.move(tmp, at)
    except BaseException:
        fs.delete_file(tmp)
        raise


def delete_others(path: str, keep: set[str]) -> None:
    """Deletes the folders in `path` that aren't named in `keep`."""
    fs, at = _fs(path)
    for info in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if info.type == pafs.FileType.Directory and info.base_name not in keep:
            fs.delete_dir(info.path)


def read_bytes(path: str) -> bytes | None:
    fs, at = _fs(path)
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(at) as f:
        return f.read()


def write_json(path: str, value) -> None:
    write_bytes(path, json.dumps(value, indent=1, sort_keys=True).encode())


def read_json(path: str):
    raw = read_bytes(path)
    return None if raw is None else json.loads(raw)


def write_split(path: str, split: DataFrame, seed: int, fraction: float, cap: int, force: bool = False) -> dict:
    """The split as Parquet by source, and its summary beside it. Another seed, fraction or cap than the stored one needs `force`."""
    old = read_json(f"{path}/summary.json")
    new = {"seed": seed, "fraction": fraction, "cap": cap}
    if old and not force and {k: old.get(k) for k in new} != new:
        raise ValueError(f"a split with {old} is stored there")
    split.write.mode("overwrite").partitionBy("source").parquet(f"{path}/ids")
    rows = split.groupBy("source", "split").agg(F.count("*").alias("n")).collect()
    summary = new | {"counts": {f"{r.source}/{r.split}": r.n for r in rows}}
    write_json(f"{path}/summary.json", summary)
    return summary


def write_tiers(path: str, tiers: DataFrame) -> dict:
    """The tier map: a row for each tier and source, so it is small."""
    out: dict = {}
    for r in tiers.orderBy("tier", "source").collect():
        t = out.setdefault(r.tier, {"tier": r.tier, "target_rows": r.target_rows, "actual_rows": r.actual_rows, "per_source": []})
        t["per_source"].append({"source": r.source, "take_rows": r.take_rows})
    write_json(path, out)
    return out


def read_tiers(spark, path: str) -> DataFrame:
    rows = [(t["tier"], t["target_rows"], t["actual_rows"], s["source"], s["take_rows"]) for t in read_json(path).values() for s in t["per_source"]]
    return spark.createDataFrame(rows, "tier string, target_rows bigint, actual_rows bigint, source string, take_rows bigint")


def write_surface(path: str, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, meta: dict) -> None:
    """A held-out task as three Parquet tables and its meta block; ids are strings, qrels sorted as strings."""
    corpus.select(F.col("id").cast("string"), "text").write.mode("overwrite").parquet(f"{path}/corpus")
    queries.select(F.col("qid").cast("string"), "text").write.mode("overwrite").parquet(f"{path}/queries")
    by = qrels.select(F.col("qid").cast("string"), F.col("id").cast("string")).distinct().groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    by.write.mode("overwrite").parquet(f"{path}/qrels")
    write_json(f"{path}/meta.json", meta)


def read_surface(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    qrels = spark.read.parquet(f"{path}/qrels").select("qid", F.explode(F.array_distinct("ids")).alias("id"))
    return spark.read.parquet(f"{path}/corpus"), spark.read.parquet(f"{path}/queries"), qrels, read_json(f"{path}/meta.json")


class Results:
    """Per-task results that survive a stop: each is stored when done. A stored file of another configuration is an
    error (`strict`) or set aside with a message."""

    def __init__(self, path: str, config: dict, strict: bool = True):
        self.path, self.config, self.done, self.message = path, config, {}, ""
        try:
            old = read_json(path)
        except ValueError:
            old = {"config": "malformed"}
        if old is not None and old.get("config") != config:
            if strict:
                raise ValueError(f"results of another configuration are stored in {path}")
            self.message = f"set aside results of another configuration in {path}"
        elif old is not None:
            self.done = old.get("per_task", {})

    def todo(self, tasks: list[str]) -> list[str]:
        return [t for t in tasks if t not in self.done]

    def add(self, task: str, value: dict) -> None:
        self.done[task] = value
        write_json(self.path, {"config": self.config, "per_task": self.done})

    def check(self, tasks: list[str]) -> list[str]:
        """Tasks that are missing or unexpected."""
        return sorted(set(tasks) ^ set(self.done))
