"""A whole study: one reduction of the frames, then training and test predictions at every level of a sweep."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from framecv.functions.scalars import numeric_features
from framecv.operators.perturb import add_label_noise, scramble_labels
from framecv.operators.split import assign_folds, split_entities, subsample_entities, sweep_levels
from framecv.operators.stats import fit_stats, standardize
from framecv.plans.crossval import fit_folds, save_models, score_folds, score_holdout, with_folds
from framecv.session import materialize, scratch_path
from framecv.sources.tables import model_matrix

Perturb = Callable[[DataFrame, float], DataFrame]


def scrambling(key: str, label: str, seed: int) -> Perturb:
    return lambda train, level: scramble_labels(train, key, label, level, seed)


def label_noise(key: str, label: str, seed: int, task: str) -> Perturb:
    return lambda train, level: add_label_noise(train, key, label, level, seed + int(level * 1000), task, [key, "block"])


def subsampling(key: str, seed: int, min_entities: int) -> Perturb:
    return lambda train, level: subsample_entities(train, key, level, seed + int(level * 1000), min_entities)


def run_levels(blocks: DataFrame, key: str, label: str, task: str, estimator, levels: Sequence[float], perturb: Perturb,
               level_name: str = "scr_frac", k: int = 5, repeats: int = 1, seed: int = 42, test_fraction: float = 0.2,
               features: Sequence[str] | None = None, model_path: str | None = None) -> DataFrame:
    """Row predictions of all levels: ``key, <level_name>, is_test, repeat, fold, predicted, true``.

    ``blocks`` are block averages with labels, read again at every level (written or materialized).
    The split is the same at every level, and only the training side is disturbed. The loop is over
    levels; every fit and score in it is a distributed job. Predictions are written level by level, and the models too if ``model_path`` is given, below
    ``<level_name>=<level>/repeat=.../fold=...``, so the driver holds the models of one level at a time.
    """
    features = features or numeric_features(blocks, [key, label, "block"])
    stratify = None if task == "reg" else label
    sided = materialize(blocks.join(split_entities(blocks, key, test_fraction, seed, stratify), key), ["is_test"])
    test = sided.where(F.col("is_test")).drop("is_test")
    path, schema = scratch_path(blocks.sparkSession, "levels"), None
    for level in sweep_levels(levels):
        train = perturb(sided.where(~F.col("is_test")).drop("is_test"), level)
        stats = materialize(fit_stats(train, features))
        matrix = model_matrix(standardize(train, stats, features), key, label, features, task)
        folded = materialize(with_folds(matrix, assign_folds(train, key, k, repeats, seed, stratify), key), ["repeat", "fold"])
        models = fit_folds(folded, estimator)
        held = model_matrix(standardize(test, stats, features), key, label, features, task)
        columns = [key, "is_test", "repeat", "fold", "predicted", "true"]
        both = score_folds(models, folded, key, label).withColumn("is_test", F.lit(False)).select(*columns).unionByName(
            score_holdout(models, held, key, label).withColumn("is_test", F.lit(True)).select(*columns))
        both = both.withColumn(level_name, F.lit(float(level)))
        both.write.mode("append").parquet(path)
        schema = both.schema
        if model_path is not None:
            save_models(models, f"{model_path.rstrip('/')}/{level_name}={level}")
    if schema is None:
        raise ValueError("no levels")
    return blocks.sparkSession.read.schema(schema).parquet(path)
