"""Shared plumbing: tables, the shared folder, joins on id sets."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship

#: Bytes that a broadcast side may take (estimated); beyond it a shuffled join does the same.
BROADCAST_BYTES = 64 << 20

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set."""
    at = checkpoint_dir(spark)
    if at:
        return at
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="tonespan-")
    return _local["dir"]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)  # type: ignore[attr-defined, union-attr]
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, which should be stored already, fits into a broadcast."""
    return df.count() * row_bytes <= limit


def join_ids(left: DataFrame, ids: DataFrame, on: list[str] | str, how: str, row_bytes: int = 64) -> DataFrame:
    """Joins with a stored set of ids: broadcast when its size allows, else shuffled."""
    return left.join(F.broadcast(ids) if small(ids, row_bytes) else ids, on, how)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    name, have = f"__{name}", {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def id_type(df: DataFrame, col: str) -> str:
    return dict(df.dtypes)[col]
