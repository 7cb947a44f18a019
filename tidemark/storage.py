"""Where intermediate tables go.

Lineage is cut by writing a table to the folder that the session names in
``spark.checkpoint.dir``: every executor sees it, so a lost executor costs
only the tasks that it ran.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session has no ``spark.checkpoint.dir`` (tests, one machine).
FALLBACK = "/tmp/checkpoints"
_staged: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; where none is named on one machine one is set, and removed when the driver ends. A cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own_dir()
    return path.rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = f"{FALLBACK}/tidemark-{os.getpid()}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._tidemark_path = path
    _staged.add(path)
    return staged


def filesystem(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path in it, through Spark: whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    files, where = filesystem(spark, path)
    files.delete(where, True)
    _staged.discard(path)


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        _delete(df.sparkSession, path)


def settle(df: DataFrame) -> None:
    """Have the driver drop what only finished jobs used, so that executors delete their shuffle files.

    Spark deletes them once the driver's garbage collector meets the plans; by itself that may take half an hour.
    """
    df.sparkSession.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every staged table of this driver, once no result of it is read any more."""
    for path in sorted(_staged):
        _delete(spark, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
