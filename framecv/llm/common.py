"""Column handling that the operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Leave out columns that carry the name of a result column, in any case: the result's own column wins."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def bounded_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hash of their id, all if there are fewer.

    A threshold on the hash, set from the row count, leaves about 2 * most rows before anything is sorted, so
    what is sorted and sent does not grow with the table.
    """
    key = F.xxhash64(quoted(id_col), F.lit(77))
    share = 2.0 * most / max(rows.count(), 1)
    thin = rows.where(key.cast("double") / F.lit(2.0 ** 64) + F.lit(0.5) < F.lit(share)) if share < 1 else rows
    return thin.orderBy(key, quoted(id_col)).limit(most)


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let Python tasks of this session get batches of `most` bytes, or of one longer row. A batch of 10,000 whole texts, as Spark
    makes them by default, takes tens of MB, and each task holds it several times: in the JVM's vectors, in the buffer to the
    worker and in the worker. A limit that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, most)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: the functions that run there import it. Spark distributes the file."""
    context = spark.sparkContext
    if getattr(context, "_framecv_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="framecv-"), "framecv-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("framecv", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._framecv_shipped = True
