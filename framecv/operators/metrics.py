"""Entity roll-ups and metrics. Undefined values are NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def entity_predictions(df: DataFrame, key: str, task: str = "reg", pred: str = "predicted", truth: str = "true",
                       by: Sequence[str] = ()) -> DataFrame:
    """Mean (reg) or majority vote with the smallest class on ties (bin, mclass), per entity."""
    if task == "reg":
        aggs = [F.avg(pred).alias("avg_predicted"), F.avg(truth).alias("avg_true")]
    else:
        # the state of mode() is one counter per class
        aggs = [F.mode(pred, True).alias("avg_predicted"), F.mode(truth, True).alias("avg_true")]
    return df.groupBy(*by, key).agg(*aggs)


def score_vote(df: DataFrame, key: str, scores: str, by: Sequence[str] = ()) -> DataFrame:
    """Class with the largest sum of scores per entity, the lowest class on ties."""
    spread = df.select(*by, key, F.posexplode(F.col(scores)).alias("_class", "_score"))
    sums = spread.groupBy(*by, key, "_class").agg(F.sum("_score").alias("_score"))
    best = F.max_by(F.col("_class"), F.struct("_score", (-F.col("_class")).alias("_low")))
    return sums.groupBy(*by, key).agg(best.cast("int").alias("voted"))


def entity_consensus(df: DataFrame, key: str, pred: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Entity means of class numbers, rounded half to even."""
    return df.groupBy(*by, key).agg(*[F.bround(F.avg(c), 0).cast("int").alias(c) for c in (truth, pred)])


def _rk_mcc(n: Column, hits: Column, tp: Column, tt: Column, pp: Column) -> Column:
    """Matthews correlation from total, hits and the sums of T*P, T*T and P*P; 0 for a zero denominator."""
    spread = (n * n - pp) * (n * n - tt)
    return F.when(spread > 0, (hits * n - tp) / F.sqrt(F.when(spread > 0, spread))).otherwise(F.lit(0.0))


def _binary_mcc(n: Column, both: Column, t1: Column, p1: Column) -> Column:
    n, both, t1, p1 = (c.cast("double") for c in (n, both, t1, p1))
    t0, p0 = n - t1, n - p1
    hits = both + (n - t1 - p1 + both)
    return _rk_mcc(n, hits, t1 * p1 + t0 * p0, t1 * t1 + t0 * t0, p1 * p1 + p0 * p0)


def regression_metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "predicted", truth: str = "true",
                       threshold: float = 0.0, guard: bool = True) -> DataFrame:
    """``n, mse, r2, pear, sign_acc, mcc, accuracy`` per group, in one aggregation.

    ``mcc`` and ``accuracy`` compare truth and prediction cut at the threshold; with ``guard`` both are
    NULL when the truth falls into one class. ``by`` keys may be NULL.
    """
    t, p = F.col(truth), F.col(pred)
    tc, pc = (t > threshold).cast("int"), (p > threshold).cast("int")
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((p - t) * (p - t)).alias("mse"),
        F.var_pop(t).alias("_vt"), F.var_pop(p).alias("_vp"), F.covar_pop(t, p).alias("_cov"),
        F.avg(((t > 0) == (p > 0)).cast("int")).alias("sign_acc"),
        F.sum(tc).alias("_t1"), F.sum(pc).alias("_p1"), F.sum(tc * pc).alias("_both"),
        F.avg((tc == pc).cast("int")).alias("_acc"),
    )
    n, t1 = F.col("n"), F.col("_t1")
    flat = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(n < 2, F.lit(None)).when(F.col("_vt") == 0, flat).otherwise(
        F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_vt")))
    pear = F.when(n >= 2, F.try_divide(F.col("_cov"), F.sqrt(F.col("_vt") * F.col("_vp"))))
    defined = (t1 > 0) & (t1 < n) if guard else F.lit(True)
    return base.select(
        *by, "n", "mse", r2.alias("r2"), pear.alias("pear"), "sign_acc",
        F.when(defined, _binary_mcc(n, F.col("_both"), t1, F.col("_p1"))).alias("mcc"),
        F.when(defined, F.col("_acc")).alias("accuracy"),
    )


def class_metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "predicted", truth: str = "true",
                  positive: int = 1, guard: bool = False) -> DataFrame:
    """``n, accuracy, mcc, f1`` (of the positive class) and ``f1_macro`` per group, from confusion counts."""
    cells = df.groupBy(*by, F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    hit = F.when(F.col("_t") == F.col("_p"), F.col("_c")).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_t").alias("cls"), F.col("_c").alias("t"), zero.alias("p"), hit.alias("hit")),
        F.struct(F.col("_p").alias("cls"), zero.alias("t"), F.col("_c").alias("p"), zero.alias("hit")),
    )
    per_class = cells.select(*by, F.inline(sides)).groupBy(*by, "cls").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("t", "p", "hit")])
    t, p, h = F.col("t"), F.col("p"), F.col("hit")
    f1 = F.try_divide(2 * h, t + p)
    sums = per_class.groupBy(*by).agg(
        F.sum(t).alias("_n"), F.sum(h).alias("_hits"), F.sum(t * p).alias("_tp"), F.sum(t * t).alias("_tt"),
        F.sum(p * p).alias("_pp"), F.sum((t > 0).cast("int")).alias("_classes"),
        F.max(F.when(F.col("cls") == positive, f1)).alias("_f1"), F.avg(f1).alias("f1_macro"),
    )
    defined = F.col("_classes") > 1 if guard else F.lit(True)
    mcc = _rk_mcc(F.col("_n"), F.col("_hits"), F.col("_tp"), F.col("_tt"), F.col("_pp"))
    return sums.select(
        *by, F.col("_n").cast("bigint").alias("n"),
        F.when(defined, F.col("_hits") / F.col("_n")).alias("accuracy"), F.when(defined, mcc).alias("mcc"),
        F.coalesce(F.col("_f1"), F.lit(0.0)).alias("f1"), "f1_macro",
    )


def summarize_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each metric, skipping undefined values."""
    aggs = []
    for m in metrics:
        x = F.col(m).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.avg(x).alias(f"{m}_mean"), F.stddev_samp(x).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*aggs)


def mean_metrics_long(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Fold means as ``metric, value`` rows."""
    means = df.groupBy(*by).agg(*[F.avg(F.when(~F.isnan(F.col(m)), F.col(m))).alias(m) for m in metrics])
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return means.select(*by, F.inline(entries))


def confusion(df: DataFrame, labels: Sequence[int], pred: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts on the full label grid, with the percentage of each true class. A group whose classes are all off the list
    has a grid of zeros."""
    listed = F.coalesce(F.col(truth).isin(*labels) & F.col(pred).isin(*labels), F.lit(False))
    cells = df.groupBy(*by, F.when(listed, F.col(truth)).alias("true_class"), F.when(listed, F.col(pred)).alias("pred_class")).agg(
        F.count(F.lit(1)).alias("n"))
    # one map of counts per group: at most len(labels) squared entries
    entry = F.when(F.col("true_class").isNotNull(), F.struct(F.concat_ws("|", "true_class", "pred_class"), "n"))
    row = F.map_from_entries(F.collect_list(entry))
    grid = cells.groupBy(*by).agg(row.alias("_cells"))
    grid = grid.withColumn("true_class", F.explode(F.array(*[F.lit(v) for v in labels])))
    grid = grid.withColumn("pred_class", F.explode(F.array(*[F.lit(v) for v in labels])))
    found = F.try_element_at("_cells", F.concat_ws("|", "true_class", "pred_class"))
    filled = grid.select(*by, "true_class", "pred_class", F.coalesce(found, F.lit(0)).cast("bigint").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "true_class"))
    return filled.withColumn("pct", F.try_divide(F.lit(100.0) * F.col("n"), total))


def metric_curves(df: DataFrame, axis: str, by: Sequence[str] = (), pred: str = "predicted", truth: str = "true") -> DataFrame:
    """Pearson and MSE against a sweep axis, sorted for a report."""
    return regression_metrics(df, [*by, axis], pred, truth).select(*by, axis, "pear", "mse").orderBy(*by, axis)


def joint_extent(df: DataFrame, columns: Sequence[str], pad: float = 0.1) -> DataFrame:
    lows, highs = [F.min(c) for c in columns], [F.max(c) for c in columns]
    low, high = (F.least(*lows), F.greatest(*highs)) if len(columns) > 1 else (lows[0], highs[0])
    return df.agg((low - pad).alias("low"), (high + pad).alias("high"))


def entity_spread(df: DataFrame, key: str, pred: str, truth: str) -> DataFrame:
    """Mean and sample standard deviation of truth and prediction per entity."""
    return df.groupBy(key).agg(F.avg(truth).alias("t_mean"), F.stddev_samp(truth).alias("t_std"),
                               F.avg(pred).alias("p_mean"), F.stddev_samp(pred).alias("p_std"))


def split_summary(df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Rows and distinct entities per group."""
    pairs = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_rows"))
    return pairs.groupBy(*by).agg(F.sum("_rows").alias("n_rows"), F.count(F.col(key)).alias("n_entities"))


def importance_summary(importances: DataFrame) -> DataFrame:
    """Mean and population standard deviation over models of (feature, importance) rows, largest first."""
    return importances.groupBy("feature").agg(
        F.avg("importance").alias("mean_importance"), F.stddev_pop("importance").alias("std_importance"),
    ).orderBy(F.desc("mean_importance"), "feature")
