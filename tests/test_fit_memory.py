import contextlib

import pytest
from pyspark.sql import functions as F

from framecv.catalog import modelling
from framecv.plans import crossval
from framecv.plans.crossval import even_rows, fit_folds
from framecv.plans.models import build_estimator
from framecv.session import materialize


def test_blocks_of_a_fit_are_small_and_dealt_rows_leave_the_memory_to_the_learners(spark):
    rows = materialize(spark.range(6_000_000).select(F.lit(0).alias("repeat"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 7).cast("double").alias("x")))
    stored = spark.sparkContext._jsc.sc().getRDDStorageInfo
    before = {i.id() for i in stored()}
    with even_rows(rows) as even:
        sizes = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6_000_000 and max(sizes) < 520_000
        own = [i for i in stored() if i.id() not in before]
        assert len(own) == 1 and own[0].memSize() == 0 and own[0].diskSize() > 0


def test_forests_fit_on_smaller_blocks_than_other_learners(spark, monkeypatch):
    monkeypatch.setattr(crossval, "TASK_ROWS", 500)
    monkeypatch.setattr(crossval, "FOREST_ROWS", 125)
    rows = materialize(spark.range(6000).select(F.lit(0).alias("repeat"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 2).cast("double").alias("x"),
                                                (F.col("id") % 2).cast("double").alias("y")))
    seen = []
    for kind in ("rf", "linear"):
        learner = build_estimator(kind, "reg", ["x"], "y", {"n_estimators": 2, "max_depth": 2} if kind == "rf" else {})

        class Watched:
            def getStages(self):
                return learner.getStages()

            def fit(self, train):
                seen.append((kind, train.rdd.getNumPartitions(), train.count(), train.select("fold").distinct().count()))
                return learner.fit(train)

        assert sorted(fit_folds(rows, Watched())) == [(0, 0), (0, 1), (0, 2)]
    assert seen == [("rf", 48, 4000, 2)] * 3 + [("linear", 12, 4000, 2)] * 3


def test_only_columns_of_the_learners_are_dealt(spark, monkeypatch):
    class Seen(Exception):
        pass

    @contextlib.contextmanager
    def watched(rows):
        raise Seen(rows.columns)
        yield

    monkeypatch.setattr(modelling, "even_rows", watched)
    with pytest.raises(Seen) as seen:
        modelling.separable_classes(spark, "/root/testdata/sf0.001")
    assert sorted(seen.value.args[0]) == ["a", "c1", "c2", "c3", "fold", "repeat", "y_bin", "y_cls"]
