"""Hyper-parameter trials: sampled settings, their losses and the best of them."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framecv.functions.hashing import uniform
from framecv.operators.metrics import regression_metrics
from framecv.plans.crossval import fit_folds, fold_metrics, score_folds, with_folds
from framecv.plans.linear import add_moments, entity_scores, fit_moments, row_moments
from framecv.plans.prepare import standardize_by_setting, tail_blocks_by_setting
from framecv.session import materialize, scratch_path

log = logging.getLogger(__name__)
FAILED = 1e6

# The data-preparation axes that every search shares, and those of each model kind.
# A block size of 0 would fail every trial, so the smallest is 1. Only axes that a learner here takes are drawn: learning
# rates, dropout, split sizes and kernels have no counterpart.
COMMON_SPACE = {"keep_last_percent": ("quniform", 5, 100, 5), "navg": ("quniform", 1, 400, 20)}
SPACES = {
    "rf": {**COMMON_SPACE, "n_estimators": ("quniform", 50, 500, 50), "max_depth": ("choice", [None, 10, 15, 20, 25, 30]),
           "max_features": ("choice", ["auto", "sqrt", "log2", None, "0.5"]), "min_samples_leaf": ("quniform", 1, 20, 1)},
    "mlp": {**COMMON_SPACE, "hidden_layers": ("choice", [1, 2, 3, 4, 5, 6]), "hidden_size": ("quniform", 4, 116, 4)},
    "linear": {**COMMON_SPACE, "wt_decay": ("loguniform", 1e-10, 1e-3)},
    "svm": {**COMMON_SPACE, "C": ("loguniform", 1e-3, 1e3)},
}


def _draw(name: str, spec: tuple, trial: Column, seed: int) -> Column:
    u = uniform(trial, name, seed)
    kind, *args = spec
    if kind == "choice":
        options = args[0]
        pick = F.floor(u * F.lit(float(len(options)))).cast("int")
        return F.get(F.array(*[F.lit(o) for o in options]), pick)
    lo, hi = float(args[0]), float(args[1])
    if kind == "uniform":
        return F.lit(lo) + u * F.lit(hi - lo)
    if kind == "loguniform":
        return F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi) - math.log(lo)))
    step = float(args[2])
    return F.greatest(F.lit(1.0), F.bround((F.lit(lo) + u * F.lit(hi - lo)) / F.lit(step), 0) * F.lit(step))


def sample_space(spark: SparkSession, space: dict[str, tuple], n: int, seed: int) -> DataFrame:
    """``n`` trials, each a seeded draw of every parameter."""
    trials = spark.range(n).withColumnRenamed("id", "trial")
    return trials.select("trial", *[_draw(k, v, F.col("trial"), seed).alias(k) for k, v in space.items()])


def trial_loss(task: str, kind: str = "rf") -> Column:
    """Loss from the metric columns; an undefined metric fails the trial."""
    if task == "reg":
        loss = F.lit(1.0) - F.col("pear")
        if kind != "rf":
            loss = F.lit(0.5) * loss + F.lit(0.5) * F.col("mse")
        defined = F.col("pear").isNotNull() & F.col("mse").isNotNull()
    else:
        loss = F.lit(0.5) * (F.lit(1.0) - F.col("accuracy")) + F.lit(0.5) * (F.lit(1.0) - F.col("mcc"))
        defined = F.col("accuracy").isNotNull() & F.col("mcc").isNotNull()
    return F.coalesce(F.when(defined, loss), F.lit(FAILED))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the smallest loss, the first of them on ties; one row."""
    best = F.min_by(F.struct(*trials.columns), F.struct("loss", "trial"))
    return trials.agg(best.alias("b")).select("b.*")


def settings_of(trials: DataFrame) -> DataFrame:
    """Distinct data-preparation settings of the trials."""
    return trials.select(F.concat_ws("_", F.col("keep_last_percent").cast("int"), F.col("navg").cast("int")).alias("setting"),
                         F.col("keep_last_percent").alias("keep"), F.col("navg").cast("bigint").alias("navg")).distinct()


LOG_SCHEMA = "trial bigint, loss double, status string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``trial, loss, status`` of the trials that were committed to the log below a path; no rows if there is none yet."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{path.rstrip('/')}/trial=*").select("trial", "loss", "status")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def commit_trial(spark: SparkSession, path: str, trial: int, loss: float) -> None:
    """One trial's result, written whole or not at all. A trial that is done again replaces its entry."""
    row = spark.createDataFrame([(trial, loss, "fail" if loss == FAILED else "ok")], LOG_SCHEMA)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/trial={trial}")


def open_trials(trials: DataFrame, path: str) -> DataFrame:
    return trials.join(read_log(trials.sparkSession, path).select("trial"), "trial", "left_anti")


def _setting(row) -> str:
    return f"{int(row['keep_last_percent'])}_{int(row['navg'])}"


def run_trials(frames: DataFrame, trials: DataFrame, assignment: DataFrame, key: str, order: Sequence[str], label: str,
               features: Sequence[str], task: str, kind: str, estimator_for: Callable[[dict], object], seed: int, log_path: str | None = None,
               parallelism: int = 4) -> DataFrame:
    """Prepares the data of all open trials in one job, then evaluates them, a few at a time.

    Returns the trial log: ``trial``, its parameters, ``loss`` and ``status``. With a ``log_path`` the log outlives the job: every trial is
    committed when it is done, and trials that the log holds are not run again. Each trial's jobs run in a scheduler pool of their own.
    Linear regressions need no jobs of their own: the moments of all settings come from one pass, see ``linear_trials``.
    """
    spark = frames.sparkSession
    log_path = log_path or scratch_path(spark, "trials")
    todo = open_trials(trials, log_path).orderBy("trial").collect()  # one row per trial
    if not todo:
        return trials.join(read_log(spark, log_path), "trial")
    settings = settings_of(open_trials(trials, log_path))
    blocks = materialize(tail_blocks_by_setting(frames, settings, key, order, seed, label, features))
    scaled = with_folds(standardize_by_setting(blocks, features), assignment, key)
    if kind == "linear" and task == "reg":
        losses = linear_trials(scaled, todo, key, label, features)
        for row in todo:
            commit_trial(spark, log_path, row["trial"], losses[row["trial"]])
        return trials.join(read_log(spark, log_path), "trial")
    prepared = materialize(scaled, ["setting", "repeat", "fold"])

    def run(row):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{row['trial']}")
        part = prepared.where(F.col("setting") == _setting(row))
        try:
            models = fit_folds(part, estimator_for(row.asDict()), parallelism=2)
            loss = FAILED
            if models:
                metrics = fold_metrics(score_folds(models, part, key, label), key, task)
                mean = metrics.agg(*[F.avg(c).alias(c) for c in metrics.columns if c not in ("repeat", "fold")])
                loss = mean.select(trial_loss(task, kind).alias("loss")).first()["loss"]
        except (IllegalArgumentException, ValueError) as failure:
            # a setting that the learner refuses gets the penalty; a failed job ends the search, and the log keeps the trials before it
            log.warning("trial %s failed: %s", row["trial"], failure)
            loss = FAILED
        commit_trial(spark, log_path, row["trial"], float(loss))

    with ThreadPool(parallelism) as pool:
        list(pool.imap_unordered(inheritable_thread_target(spark)(run), todo))
    return trials.join(read_log(spark, log_path), "trial")


def linear_trials(scaled: DataFrame, todo: Sequence, key: str, label: str, features: Sequence[str]) -> dict[int, float]:
    """Loss of every linear trial from the moments of its setting: one pass over the blocks of all settings, then a few numbers per
    trial and fold."""
    entities = materialize(row_moments(scaled, features, label, ["setting", "repeat", "fold", key]))
    wanted = {(_setting(row), float(row.asDict().get("wt_decay") or 0.0)) for row in todo}
    ridges = F.create_map(*[x for name in sorted({n for n, _ in wanted}) for x in (
        F.lit(name), F.array(*[F.lit(v) for v in sorted(v for n, v in wanted if n == name)]))])
    folds = add_moments(entities, ["setting", "repeat", "fold"]).withColumn("ridge", F.explode(F.element_at(ridges, F.col("setting"))))
    models = fit_moments(folds, ["setting", "ridge"], "ridge")
    scores = entity_scores(entities.join(models, ["setting", "repeat", "fold"]), len(features))
    metrics = regression_metrics(scores, ["setting", "ridge", "repeat", "fold"], "avg_predicted", "avg_true")
    mean = metrics.groupBy("setting", "ridge").agg(F.avg("pear").alias("pear"), F.avg("mse").alias("mse"))
    found = {(r["setting"], r["ridge"]): r["loss"] for r in mean.select("setting", "ridge", trial_loss("reg", "linear").alias("loss")).collect()}
    return {row["trial"]: float(found.get((_setting(row), float(row.asDict().get("wt_decay") or 0.0)), FAILED)) for row in todo}
