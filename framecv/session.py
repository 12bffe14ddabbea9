"""Shared folders and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a single machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="framecv-")
    sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, by: Sequence[str], mode: str = "errorifexists") -> DataFrameWriter:
    """Writer with one directory per value. The rows are gathered by value first, so that not every task
    writes to every directory; Spark splits a value that holds too many rows over several tasks."""
    return df.hint("rebalance", *by).write.mode(mode).partitionBy(*by)


def materialize(df: DataFrame, by: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """Cut the lineage with a table in the shared folder, in directories by the given columns.

    It outlives lost executors, and later reads take only the columns and rows they need. A writer sorts the rows of its task by directory, and gathered
    rows are split by bytes: where few bytes hold many rows, deal them to enough tasks before and say so (``dealt``); every task then writes to every directory.
    """
    path = scratch_path(df.sparkSession, "table")
    writer = df.write.partitionBy(*by) if dealt else write_partitioned(df, by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
