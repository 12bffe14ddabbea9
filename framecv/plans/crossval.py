"""Fold-wise fitting and scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from framecv.operators.metrics import class_metrics, entity_predictions, regression_metrics, score_vote

Models = dict[tuple[int, int], PipelineModel]

#: Rows of one task of a fit. The learners keep the rows of a task as one block, of 16 to 50 bytes a row.
TASK_ROWS = 2_000_000
#: The same of a forest, which keeps objects of some 150 bytes a row. A block is held beside the memory counted for blocks while it is built, pushed out or
#: read back, once for every core: it has to be small next to an executor. More tasks cost it little, as it passes over its rows a few times only.
FOREST_ROWS = 500_000


def with_folds(matrix: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """Every row once per repeat, with the fold in which it is validated."""
    return matrix.join(assignment, key)


def present_folds(folded: DataFrame) -> list[tuple[int, int]]:
    """The (repeat, fold) pairs that hold rows; missing ones are skipped."""
    pairs = folded.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()
    return [(r["repeat"], r["fold"]) for r in pairs]


def _task_count(folded: DataFrame, most: int | None = None) -> int:
    """Tasks for a fit: one a core, and no more than ``most`` (``TASK_ROWS``) rows in each."""
    return max(folded.sparkSession.sparkContext.defaultParallelism, -(-folded.count() // (most or TASK_ROWS)))


def _is_forest(estimator) -> bool:
    return isinstance((getattr(estimator, "getStages", list)() or [estimator])[-1], (RandomForestClassifier, RandomForestRegressor))


@contextmanager
def even_rows(folded: DataFrame) -> Iterator[DataFrame]:
    """The rows in partitions of even length, small enough for forests, kept while the learners pass over them.

    Files are split by bytes: few distinct values fill few bytes, so a split may hold tens of millions of rows, or a whole table of one file be one task.
    The draw is seeded: rows read again from a stored table go to the same partitions. They are kept on disk: every learner keeps a copy of its own in memory,
    which it passes over many times, and reads these a few times only.
    """
    even = folded.repartition(_task_count(folded, min(FOREST_ROWS, TASK_ROWS)), F.rand(0)).persist(StorageLevel.DISK_ONLY)
    try:
        yield even
    finally:
        even.unpersist()


def fit_folds(folded: DataFrame, estimator, parallelism: int = 4) -> Models:
    """One model per (repeat, fold), trained on the other folds of the repeat.

    Each fit is a distributed job; a few are submitted at a time, fewer where one of them fills the cores. The rows are dealt evenly (``even_rows``) unless
    the table is persisted already, as it should be for several fits. A fold that is alone in its repeat has no training rows and no model. Learners other
    than forests take some partitions together: they pass over their rows up to hundreds of times, and every task of a pass has its cost.
    """
    if folded.storageLevel == StorageLevel.NONE:
        with even_rows(folded) as even:
            return fit_folds(even, estimator, parallelism)
    pairs = present_folds(folded)
    pairs = [(r, f) for r, f in pairs if sum(r == other for other, _ in pairs) > 1]
    tasks = _task_count(folded)
    # a fit keeps a copy of its rows; several of large tables at a time would drive each other out of memory
    at_once = min(parallelism, max(1, 4 * folded.sparkSession.sparkContext.defaultParallelism // tasks))
    rows = folded if _is_forest(estimator) else folded.coalesce(tasks)

    def fit(pair):
        repeat, fold = pair
        return pair, estimator.fit(rows.where((F.col("repeat") == repeat) & (F.col("fold") != fold)))

    with ThreadPool(at_once) as pool:
        return dict(pool.map(inheritable_thread_target(folded.sparkSession)(fit), pairs))


def _scores(scored: DataFrame) -> DataFrame:
    """Class scores as an array: probabilities where there are any, else raw decision values."""
    for name in ("probability", "rawPrediction"):
        if name in scored.columns:
            return scored.withColumn("scores", vector_to_array(name))
    return scored


def score_folds(models: Models, folded: DataFrame, key: str, label: str) -> DataFrame:
    """Out-of-fold predictions of every repeat: ``key, repeat, fold, predicted, true[, scores]``."""
    out = None
    for (repeat, fold), model in sorted(models.items()):
        rows = folded.where((F.col("repeat") == repeat) & (F.col("fold") == fold))
        scored = _scores(model.transform(rows))
        extra = ["scores"] if "scores" in scored.columns else []
        part = scored.select(key, "repeat", "fold", F.col("prediction").alias("predicted"),
                             F.col(label).cast("double").alias("true"), *extra)
        out = part if out is None else out.unionByName(part)
    return out


def score_holdout(models: Models, rows: DataFrame, key: str, label: str) -> DataFrame:
    """Predictions of every fold model on the held-out rows, which are read once."""
    scored, picks = rows, []
    for (repeat, fold), model in sorted(models.items()):
        staged = _scores(model.transform(scored))
        name = f"_p_{repeat}_{fold}"
        scores = F.col("scores") if "scores" in staged.columns else F.lit(None).cast("array<double>")
        scored = staged.withColumn(name, F.struct(
            F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), F.col("prediction").alias("predicted"),
            scores.alias("scores"))).select(*rows.columns, *picks, name)
        picks.append(name)
    return scored.select(key, F.col(label).cast("double").alias("true"), F.inline(F.array(*picks)))


def fold_metrics(predictions: DataFrame, key: str, task: str, by: Sequence[str] = ("repeat", "fold"),
                 threshold: float = 0.0) -> DataFrame:
    """Entity-level metrics of each fold: votes or means per entity first, then the metrics."""
    entities = entity_predictions(predictions, key, task, by=by)
    if task == "mclass" and "scores" in predictions.columns:
        votes = score_vote(predictions, key, "scores", by)
        entities = entities.drop("avg_predicted").join(votes, [*by, key]).withColumnRenamed("voted", "avg_predicted")
    if task == "reg":
        return regression_metrics(entities, by, "avg_predicted", "avg_true", threshold)
    return class_metrics(entities, by, "avg_predicted", "avg_true", guard=True)


def with_clean_truth(predictions: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Score against undisturbed labels: by default the truth is what the models were trained on."""
    clean = labels.select(key, F.col(label).cast("double").alias("true"))
    return predictions.drop("true").join(clean, key).select(*predictions.columns)


def pooled_entities(predictions: DataFrame, key: str, task: str) -> DataFrame:
    """One prediction per entity from all folds and repeats."""
    return entity_predictions(predictions, key, task)


def save_models(models: Models, path: str) -> None:
    for (repeat, fold), model in models.items():
        model.write().save(f"{path}/repeat={repeat}/fold={fold}")


def load_model(path: str, repeat: int, fold: int) -> PipelineModel:
    return PipelineModel.load(f"{path}/repeat={repeat}/fold={fold}")


def importances(spark: SparkSession, models: Models, features: Sequence[str]) -> DataFrame:
    """``repeat, fold, feature, importance`` of tree models; model metadata, one row per feature and model."""
    rows = [(r, f, name, float(v)) for (r, f), m in models.items()
            for name, v in zip(features, m.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "repeat int, fold int, feature string, importance double")

