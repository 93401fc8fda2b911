"""Tables and checkpoints in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder where it is unset, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="muralis-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: For each open block of ``passing``, the paths that go at its end.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``materialise`` writes within the block is deleted at its end, save what ``lasts``: for work whose result is written before the
    block ends, so that its steps take no room while the result is used."""
    paths: list[str] = []
    before = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(before)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, *, lasts: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back; ``lasts``: beyond the innermost block of ``passing``.

    Cuts the lineage, survives lost executors, and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _PASSING.get()[:-1][-1:] if lasts else _PASSING.get()[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table of the session's warehouse, bucketed by ``key``: groups and joins by the key move only their other side. The second
    value drops the table."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE IF EXISTS {name}") and None


def materialise_with(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and aggregates of the rows that were gathered as they were written (0 where there are none)."""
    seen = Observation()
    written = materialise(df.observe(seen, *(c.alias(k) for k, c in facts.items())), name)
    return written, {k: v or 0 for k, v in seen.get.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
