"""What several operators share: durable intermediates and connected components."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import new_path


def stored(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at durable files.

    A lost executor costs only the tasks that were running on it, never the steps before. ``group``: rows of a Parquet row
    group at most, where a row has megabytes (the writer holds a group, and looks at its size every 100 rows only).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.row.count.limit", str(group)) if group else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Rows (of some tens of bytes) that a join may broadcast; with more of them it shuffles.
BROADCAST_ROWS = 1 << 20


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stored(), and the count of rows, observed while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count("*").alias("n")), name)
    return out, seen.get["n"]


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a join's side, for broadcast if its ``rows`` are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def write_file(folder: str, name: str, data: bytes) -> None:
    """Write one file through Arrow's file systems, by its final name only when it is whole."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/.{name}.part") as f:
        f.write(data)
    system.move(f"{path}/.{name}.part", f"{path}/{name}")


def map_file(folder: str) -> np.ndarray:
    """The bytes of the one file in a shared folder: mapped into memory where the folder is mounted, else read."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    (found,) = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith(".")]
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(found, np.uint8, "r")
    with system.open_input_stream(found) as f:
        return np.frombuffer(f.read(), np.uint8)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table of ``stored()`` that no later step reads."""
    path = getattr(df, "_stored_at", None)
    if path is None:
        return
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch on its way to Python. Spark's own bound is 10,000, whatever their size: long texts then fill a task's memory.
BATCH = 1000


@contextlib.contextmanager
def few_rows(spark: SparkSession, rows: int = 8) -> Iterator[None]:
    """What runs inside sends so few rows at a time to Python: for tables whose rows are packs of some megabytes."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(rows))
    try:
        yield
    finally:
        conf.set(name, before)


@contextlib.contextmanager
def few_read(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside decodes so few rows of Parquet at a time: for tables whose rows have megabytes."""
    conf, name = spark.conf, "spark.sql.parquet.columnarReaderBatchSize"
    before = conf.get(name)
    conf.set(name, str(rows))
    try:
        yield
    finally:
        conf.set(name, before)


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[Any]], Iterator[Any]], schema: str | StructType) -> DataFrame:
    """mapInArrow() for whole texts. The session's rows of a batch are lowered to BATCH where they are more (or unbounded), and
    as Python workers live on from task to task, each gives its free memory back at a task's end."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "0")) <= BATCH:
        conf.set(name, str(BATCH))

    def tidy(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from every column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def _summed(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """stored(), and the table's row count and checksum, observed while it is written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])


def contracted(edges: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """An edge table (a, b), a > b, of the same components as ``edges`` after so many rounds, and whether it is all stars.

    A round is a large-star and a small-star step. Each step is a partial aggregate and an equi-join, so a hub that
    holds a third of the edges is pre-aggregated on the map side and, in the join, split by adaptive execution. Only two numbers
    per step (row count, checksum) come to the driver.
    """
    e, now = _summed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    settled = not now[0]
    for k in range(0 if settled else rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large, met = _summed(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")
        drop_stored(e)
        if met == now and k:  # stars stay as they are
            e, settled = large, True
            break
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e, now = _summed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        drop_stored(large)
    return e.toDF("a", "b"), settled


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an edge table (a, b) as (id, component_id), component_id the least id. Nodes without edges are not returned."""
    e, settled = contracted(edges, max_rounds)
    if not settled:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return e.toDF("id", "component_id").unionByName(roots)
