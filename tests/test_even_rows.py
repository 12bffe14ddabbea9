import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from framecv.catalog import modelling
from framecv.plans import crossval
from framecv.plans.crossval import even_rows, fit_folds
from framecv.plans.models import build_estimator
from framecv.session import materialize


@pytest.fixture(scope="module")
def one_file(spark):
    """A table whose rows are all in one small file: one split, however many rows."""
    rows = spark.range(6000).select((F.col("id") % 300).alias("entity"), F.lit(0).alias("repeat"), (F.col("id") % 3).cast("int").alias("fold"),
                                    (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    return materialize(rows.coalesce(1))


def test_rows_are_dealt_evenly(one_file, monkeypatch):
    monkeypatch.setattr(crossval, "TASK_ROWS", 500)
    assert one_file.rdd.getNumPartitions() == 1
    with even_rows(one_file) as even:
        sizes = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6000 and len(sizes) == 12 and max(sizes) < 2 * min(sizes)
        assert even.exceptAll(one_file).count() == 0
    assert even.storageLevel == StorageLevel.NONE


def test_fits_pass_over_even_rows(one_file, monkeypatch):
    monkeypatch.setattr(crossval, "TASK_ROWS", 500)
    learner, seen = build_estimator("linear", "reg", ["x"], "y"), []

    class Watched:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count(), rows.select("fold").distinct().count()))
            return learner.fit(rows)

    assert sorted(fit_folds(one_file, Watched())) == [(0, 0), (0, 1), (0, 2)]
    assert seen == [(12, 4000, 2)] * 3


def test_known_rows_are_stored_in_even_files(spark):
    folded = modelling._known(spark, "/root/testdata/sf0.01")
    per_file = [r["count"] for r in folded.groupBy("fold", F.input_file_name()).count().collect()]
    assert sum(per_file) == 60000 and len(per_file) == 3 * spark.sparkContext.defaultParallelism
    assert max(per_file) < 2 * min(per_file)
