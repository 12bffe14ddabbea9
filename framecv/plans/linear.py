"""Fold-wise least squares for all levels of a sweep at once, from additive moments.

The sums of products of a fold's rows say all that a linear fit needs, and the sums of the training rows are those of all folds less
the held-out one. So the rows are read once: they are added up by entity, the entities by level, repeat and fold, and each
model is solved from a handful of numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from framecv.functions.hashing import gaussian, hash52
from framecv.functions.scalars import truncated_count
from framecv.operators.perturb import donor_table
from framecv.operators.split import assign_folds, entity_table, hash_rank, split_entities, sweep_levels
from framecv.operators.stats import fit_stats, standardize
from framecv.session import materialize, write_partitioned

#: Column of the sums of an entity or fold: count, sums of the features and the label, sums of their products (upper triangle, row by row).
MOMENTS = "moments"


def _products(features: Sequence[str], label: str) -> list[Column]:
    z = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in features], F.col(f"`{label}`").cast("double")]
    return [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]


def row_moments(rows: DataFrame, features: Sequence[str], label: str, by: Sequence[str]) -> DataFrame:
    """One row per ``by`` key with its moments. Rows with a NULL feature or label take no part. The features should be centred (standardised),
    as the fits subtract products of their means."""
    whole = rows
    for c in [*features, label]:
        whole = whole.where(F.col(f"`{c}`").isNotNull())
    sums = whole.groupBy(*by).agg(*[p.alias(f"_m{i}") for i, p in enumerate(_products(features, label))])
    n = len(sums.columns) - len(by)
    return sums.select(*by, F.array(*[f"_m{i}" for i in range(n)]).alias(MOMENTS))


def add_moments(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of the moments of each ``by`` key."""
    first = parts.select(F.size(MOMENTS).alias("n")).first()
    sums = [F.sum(F.get(MOMENTS, F.lit(i))).alias(f"_m{i}") for i in range(first.n if first else 0)]
    if not sums:
        return parts.select(*by, MOMENTS)
    return parts.groupBy(*by).agg(*sums).select(*by, F.array(*[f"_m{i}" for i in range(len(sums))]).alias(MOMENTS))


def solve_moments(moments: Sequence[float], ridge: float = 0.0) -> tuple[float, list[float]]:
    """Intercept and coefficients. The ridge is that of the linear learner: on coefficients times the feature's population deviation, over that of the label.
    A feature without spread gets 0, dependent features the shortest solution."""
    p = int((np.sqrt(8 * len(moments) + 1) - 1) / 2)
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = moments
    full += np.triu(full, 1).T
    n, sums = full[0, 0], full[0, 1:]
    spread = full[1:, 1:] / n - np.outer(sums, sums) / n**2
    xx, xy, yy = spread[:-1, :-1], spread[:-1, -1], max(spread[-1, -1], 0.0)
    if ridge and yy > 0:
        xx = xx + np.diag(np.diag(xx)) * ridge / np.sqrt(yy)
    scale = np.sqrt(np.maximum(np.diag(xx), 0.0))
    used = scale > 1e-12 * max(1.0, float(np.abs(full[0, 1:]).max()) / n)
    beta = np.zeros(p - 2)
    if used.any():
        unit = xx[np.ix_(used, used)] / np.outer(scale[used], scale[used])
        beta[used] = np.linalg.lstsq(unit, xy[used] / scale[used], rcond=1e-12)[0] / scale[used]
    return float(sums[-1] / n - beta @ sums[:-1] / n), beta.tolist()


def fit_moments(folds: DataFrame, by: Sequence[str] = (), ridge: float | str = 0.0) -> DataFrame:
    """Model table ``by, repeat, fold, intercept, coefficients, n_train`` from moments of ``by, repeat, fold``: one model per fold, trained on the other
    folds of its repeat; a fold without others has none. ``ridge`` may name one of the ``by`` columns.

    The driver gets one row of moments per level, repeat and fold, whatever the number of rows or entities.
    """
    keys = [*by, "repeat"]
    rows = folds.select(*keys, "fold", MOMENTS).collect()
    groups: dict[tuple, list] = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append((r["fold"], np.array(r[MOMENTS], float)))
    out = []
    for key, parts in groups.items():
        for fold, _ in parts:
            # added up anew rather than subtracted, so that nothing cancels
            others = [m for f, m in parts if f != fold]
            if others and (total := np.sum(others, axis=0))[0] > 0:
                out.append((*key, fold, *solve_moments(total, key[keys.index(ridge)] if isinstance(ridge, str) else ridge), int(total[0])))
    schema = T.StructType([*[folds.schema[k] for k in keys], folds.schema["fold"], T.StructField("intercept", T.DoubleType()),
                           T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("n_train", T.LongType())])
    return folds.sparkSession.createDataFrame(sorted(out, key=lambda r: str(r[:len(keys) + 1])), schema)


def fit_whole(rows: DataFrame, features: Sequence[str], label: str, ridge: float = 0.0) -> DataFrame:
    """One model of all rows: ``intercept, coefficients, n_train``; no row without any. The driver gets one row of moments."""
    found = row_moments(rows, features, label, []).first()[MOMENTS]
    out = [] if found[0] is None else [(*solve_moments(found, ridge), int(found[0]))]
    return rows.sparkSession.createDataFrame(out, "intercept double, coefficients array<double>, n_train bigint")


def write_models(models: DataFrame, path: str, by: Sequence[str] = ("repeat", "fold"), mode: str = "errorifexists") -> None:
    """The model table as a store with one directory per level, repeat and fold."""
    write_partitioned(models, by, mode).parquet(path)


def read_models(spark: SparkSession, path: str, repeat: int | None = None, fold: int | None = None) -> DataFrame:
    """All models of a store, or those of a repeat or fold; only their directories are read."""
    models = spark.read.parquet(path)
    for name, value in (("repeat", repeat), ("fold", fold)):
        if value is not None:
            models = models.where(F.col(name) == value)
    return models


def linear_prediction(features: Sequence[str]) -> Column:
    out = F.col("intercept")
    for i, c in enumerate(features):
        out = out + F.get("coefficients", F.lit(i)) * F.col(f"`{c}`").cast("double")
    return out


def score_models(rows: DataFrame, models: DataFrame, key: str, label: str, features: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Row predictions ``on, key, repeat, fold, predicted, true`` of all models in one scan of the rows.

    With ``repeat`` and ``fold`` in ``on`` every row meets the model that has not seen it; without them all models of its level, as
    on held-out rows.
    """
    table = models.select(*dict.fromkeys([*on, "repeat", "fold"]), "intercept", "coefficients")
    joined = rows.join(table, list(on)) if on else rows.crossJoin(F.broadcast(table))  # one row per model
    return joined.select(*[c for c in on if c not in ("repeat", "fold")], key, "repeat", "fold", linear_prediction(features).alias("predicted"),
                         F.col(f"`{label}`").cast("double").alias("true"))


# ---- levels ----------------------------------------------------------------------------------

def _level_column(levels: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in sweep_levels(levels)])


def scrambled_levels(train: DataFrame, key: str, label: str, levels: Sequence[float], seed: int, min_count: int = 0) -> DataFrame:
    """``key, level, label``: the entities' labels at every level of scrambling, from one ranking and one join with the donors."""
    donors = donor_table(train, key, label, seed)
    spread = donors.withColumn("level", F.explode(_level_column(levels)))
    count = F.greatest(truncated_count(F.col("n"), F.col("level")), F.lit(min_count).cast("bigint"))
    taken = (F.col("rank") < count) & (F.col("n") > 1)
    return spread.select(key, "level", F.when(taken, F.col("donated")).otherwise(F.col(label)).alias(label))


def noisy_levels(train: DataFrame, label: str, levels: Sequence[float], seed: int, row_id: Sequence[str]) -> DataFrame:
    """Every row at every level, its label with Gaussian noise of ``level`` times the label's population deviation."""
    spread = train.agg(F.stddev_pop(label)).scalar()
    marked = train.withColumns({"_sd": spread, "level": F.explode(_level_column(levels))})
    shift = (F.lit(seed) + (F.col("level") * 1000).cast("int")).cast("string")
    draw = gaussian(*[F.col(c) for c in row_id], shift, "noise")
    noisy = F.when(F.col("level") > 0, F.col(label) + draw * F.col("level") * F.col("_sd")).otherwise(F.col(label))
    return marked.withColumn(label, noisy).drop("_sd")


def kept_levels(train: DataFrame, key: str, levels: Sequence[float], seed: int, min_entities: int = 1) -> DataFrame:
    """``key, level`` for the entities that each subsample keeps; smaller subsamples lie inside larger ones."""
    ranked = hash_rank(entity_table(train, key), key, hash52(F.col(key), seed, "subsample"))
    spread = ranked.withColumn("level", F.explode(_level_column(levels)))
    count = F.greatest(truncated_count(F.col("n"), F.col("level")), F.lit(min_entities).cast("bigint"))
    return spread.where((F.col("level") >= 1.0) | (F.col("rank") < count)).select(key, "level")


def linear_study(blocks: DataFrame, key: str, label: str, features: Sequence[str], levels: Sequence[float], kind: str, k: int = 5, repeats: int = 5,
                 seed: int = 42, test_fraction: float = 0.2, ridge: float = 0.0, min_entities: int = 1) -> tuple[DataFrame, DataFrame]:
    """A robustness study with linear models: ``scramble``, ``noise`` or ``subsample`` at all levels, validated fold by fold and on the held-out entities.

    Returns entity predictions ``level, is_test, repeat, fold, key, avg_predicted, avg_true`` and the model table by ``level, repeat, fold``.
    Only the training side is disturbed. The folds are those of the whole training side at every level, so that levels differ by their training data alone.
    ``blocks``: ``key, block, features, label``, written or materialized. The rows are read once for their moments, also at many levels; as a linear
    model's mean over an entity is its value at the entity's mean, everything after that works on one row per entity and level.
    """
    sided = materialize(blocks.join(split_entities(blocks, key, test_fraction, seed), key), ["is_test"])
    train, test = (sided.where(F.col("is_test") == side).drop("is_test") for side in (False, True))
    stats = materialize(fit_stats(train, features))
    scaled = standardize(train, stats, features)
    folds = assign_folds(train, key, k, repeats, seed)
    if kind == "scramble":
        # the label is the entity's: its products follow from the sums of the features
        own = row_moments(scaled.withColumn(label, F.lit(0.0)), features, label, [key])
        given = scrambled_levels(train, key, label, levels, seed).where(F.col(label).isNotNull())
        entities = _with_label(own.join(given, key), label, len(features))
    elif kind == "noise":
        entities = row_moments(noisy_levels(scaled, label, levels, seed, [key, "block"]), features, label, ["level", key])
    elif kind == "subsample":
        entities = row_moments(scaled, features, label, [key]).join(kept_levels(train, key, levels, seed, min_entities), key)
    else:
        raise ValueError(f"unknown study {kind}")
    entities = materialize(entities.select("level", key, MOMENTS).join(folds, key))
    models = fit_moments(add_moments(entities, ["level", "repeat", "fold"]), ["level"], ridge)
    held = row_moments(standardize(test, stats, features), features, label, [key])
    solved = models.select("level", "repeat", "fold", "intercept", "coefficients")
    # one row per model: levels x repeats x folds of them
    validated = entity_scores(entities.join(F.broadcast(solved), ["level", "repeat", "fold"]), len(features)).withColumn("is_test", F.lit(False))
    tested = entity_scores(held.crossJoin(F.broadcast(solved)), len(features)).withColumn("is_test", F.lit(True))
    names = ["level", "is_test", "repeat", "fold", key, "avg_predicted", "avg_true"]
    return validated.select(*names).unionByName(tested.select(*names)), models


def _with_label(entities: DataFrame, label: str, p: int) -> DataFrame:
    """Moments that were taken with a label of 0, with the label of the entity instead."""
    def at(i: int) -> Column:
        return F.get(MOMENTS, F.lit(i))

    y, out, i = F.col(f"`{label}`").cast("double"), [], 0
    for a in range(p + 2):
        for b in range(a, p + 2):
            if b < p + 1:
                out.append(at(i))
            else:  # 1, features or label against the label: the sums of the first row of the triangle times the label
                out.append(at(a) * y if a < p + 1 else at(0) * y * y)
            i += 1
    return entities.withColumn(MOMENTS, F.array(*out))


def entity_scores(rows: DataFrame, p: int) -> DataFrame:
    """Mean prediction and mean label of an entity from its moments."""
    n = F.get(MOMENTS, F.lit(0))
    mean = F.col("intercept")
    for i in range(p):
        mean = mean + F.get("coefficients", F.lit(i)) * F.get(MOMENTS, F.lit(1 + i)) / n
    return rows.withColumns({"avg_predicted": mean, "avg_true": F.get(MOMENTS, F.lit(1 + p)) / n})
