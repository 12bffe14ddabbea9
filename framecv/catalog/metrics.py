"""Votes, metrics, summaries, sweeps, scores and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecv.catalog.base import (FEATURES, KEY, ORDER, ORDER_SQL, SEED, frames, h, labelled, labels, predictions, query, rounded,
                                  sql, table)
from framecv.functions.scalars import argmax_class, binarize, clean_feature_name, is_close, logit_class
from framecv.operators.metrics import (class_metrics, confusion, entity_consensus, entity_predictions, entity_spread,
                                       importance_summary, joint_extent, mean_metrics_long, metric_curves, regression_metrics,
                                       score_vote, split_summary, summarize_metrics)
from framecv.operators.quantiles import quantiles
from framecv.operators.score import best_threshold, nearest_mean, reference_state_score, threshold_sweep
from framecv.session import materialize

GROUPS = ["scr_frac", "is_test", "rep", "fold"]
GROUPS_SQL = ", ".join(GROUPS)


def reg_sql(by: str, pred: str, truth: str, source: str, guard: bool, threshold: str = "0") -> str:
    """Regression metrics of each group."""
    lead = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    ok = "count(DISTINCT t > thr) > 1" if guard else "true"
    n, both = "count(*)::DOUBLE", "sum((t > thr AND p > thr)::INTEGER)::DOUBLE"
    t1, p1 = "sum((t > thr)::INTEGER)::DOUBLE", "sum((p > thr)::INTEGER)::DOUBLE"
    return f"""SELECT {lead}n, mse, r2, pear, sign_acc, CASE WHEN ok THEN coalesce((hits * nn - (t1 * p1 + (nn - t1) * (nn - p1)))
            / nullif(sqrt(greatest((nn * nn - p1 * p1 - (nn - p1) * (nn - p1)) * (nn * nn - t1 * t1 - (nn - t1) * (nn - t1)), 0)), 0), 0) END AS mcc,
        CASE WHEN ok THEN acc END AS accuracy FROM (
        SELECT {lead}count(*) AS n, avg((p - t) * (p - t)) AS mse,
        CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(t) = 0 THEN (avg((p - t) * (p - t)) = 0)::DOUBLE
            ELSE 1 - avg((p - t) * (p - t)) / var_pop(t) END AS r2,
        CASE WHEN count(*) >= 2 THEN covar_pop(t, p) / nullif(sqrt(var_pop(t) * var_pop(p)), 0) END AS pear,
        avg(((t > 0) = (p > 0))::INTEGER) AS sign_acc, {n} AS nn, {t1} AS t1, {p1} AS p1,
        2 * {both} + {n} - {t1} - {p1} AS hits, avg(((t > thr) = (p > thr))::INTEGER) AS acc, {ok} AS ok
        FROM (SELECT *, {truth} AS t, {pred} AS p, {threshold}::DOUBLE AS thr FROM {source}) {tail})"""


def cls_sql(by: str, pred: str, truth: str, source: str, guard: bool, positive: int = 1) -> str:
    """Class metrics of each group, from the confusion counts."""
    lead = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    ok = "sum((t > 0)::INTEGER) > 1" if guard else "true"
    return f"""SELECT {lead}n, CASE WHEN ok THEN hits / nn END AS accuracy, CASE WHEN ok THEN
            coalesce((hits * nn - tp) / nullif(sqrt((nn * nn - pp) * (nn * nn - tt)), 0), 0) END AS mcc, coalesce(f1, 0) AS f1, f1_macro FROM (
        SELECT {lead}CAST(sum(t) AS BIGINT) AS n, sum(t)::DOUBLE AS nn, sum(hit)::DOUBLE AS hits, sum(t * p)::DOUBLE AS tp, sum(t * t)::DOUBLE AS tt,
            sum(p * p)::DOUBLE AS pp, max(CASE WHEN cls = {positive} THEN 2 * hit / (t + p) END) AS f1, avg(2 * hit / (t + p)) AS f1_macro, {ok} AS ok FROM (
            SELECT {lead}cls, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p, sum(hit)::DOUBLE AS hit FROM (
                SELECT {lead}{truth} AS cls, 1 AS t, 0 AS p, ({truth} = {pred})::INTEGER AS hit FROM {source}
                UNION ALL SELECT {lead}{pred}, 0, 1, 0 FROM {source}) GROUP BY {lead}cls) {tail})"""


REG_COLS, CLS_COLS = "mse r2 pear sign_acc mcc accuracy", "accuracy mcc f1 f1_macro"


def smallest_mode(column: str, name: str, source: str, by: str = "entity") -> str:
    return f"""SELECT {by}, {column} AS {name} FROM (SELECT {by}, {column}, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, {column}) AS r
        FROM {source} GROUP BY {by}, {column}) WHERE r = 1"""


# ---- entity roll-ups -------------------------------------------------------------------------

@query(sql("SELECT entity, avg(pred_reg) AS avg_predicted, avg(true_reg) AS avg_true FROM preds GROUP BY entity", "preds",
           rounds="avg_predicted avg_true"))
def entity_means(spark, sf_dir):
    return rounded(entity_predictions(predictions(spark, sf_dir), KEY, "reg", "pred_reg", "true_reg"))


@query(sql(f"SELECT * FROM ({smallest_mode('pred_cls', 'avg_predicted', 'preds')}) JOIN ({smallest_mode('true_cls', 'avg_true', 'preds')}) USING (entity)", "preds"))
def entity_votes(spark, sf_dir):
    """Majority vote, the smallest class on ties."""
    return entity_predictions(predictions(spark, sf_dir), KEY, "mclass", "pred_cls", "true_cls")


@query("""WITH spread AS (SELECT label, unnest(embedding)::DOUBLE AS s, generate_subscripts(embedding, 1) - 1 AS cls FROM embeddings),
    sums AS (SELECT label, cls, sum(s) AS s FROM spread GROUP BY label, cls)
    SELECT label, CAST(cls AS INTEGER) AS voted FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, cls) AS r FROM sums) WHERE r = 1""")
def score_sum_votes(spark, sf_dir):
    """Class with the largest sum of scores; the vector entries are the class scores."""
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return score_vote(rows, "label", "embedding")


@query("""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top_class,
    CAST(embedding[1] > 0 AS INTEGER) AS logit_class FROM embeddings""")
def row_classes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", argmax_class(F.col("embedding")).alias("top_class"), logit_class(F.get("embedding", F.lit(0))).alias("logit_class"))


@query(sql("""SELECT is_test, CAST(round_even(avg(true_cls), 0) AS INTEGER) AS true_cls, CAST(round_even(avg(pred_cls), 0) AS INTEGER) AS pred_cls, entity
    FROM preds GROUP BY entity, is_test""", "preds"))
def entity_consensus_classes(spark, sf_dir):
    """Mean class per entity, rounded half to even."""
    return entity_consensus(predictions(spark, sf_dir), KEY, "pred_cls", "true_cls", ["is_test"])


@query(sql("""SELECT entity, avg(true_reg) AS t_mean, stddev_samp(true_reg) AS t_std, avg(pred_reg) AS p_mean, stddev_samp(pred_reg) AS p_std
    FROM preds WHERE scr_frac = 0 GROUP BY entity""", "preds", rounds="t_mean t_std p_mean p_std"))
def entity_mean_and_spread(spark, sf_dir):
    rows = predictions(spark, sf_dir).where(F.col("scr_frac") == 0.0)
    return rounded(entity_spread(rows, KEY, "pred_reg", "true_reg"))


# ---- metrics ---------------------------------------------------------------------------------

@query(sql(reg_sql(GROUPS_SQL, "pred_reg", "true_reg", "preds", False), "preds", rounds=REG_COLS))
def regression_metrics_by_fold(spark, sf_dir):
    """Row-level metrics; the test rows have no repeat and fold and form one group per level."""
    return rounded(regression_metrics(predictions(spark, sf_dir), GROUPS, "pred_reg", "true_reg", guard=False))


@query(sql(cls_sql(GROUPS_SQL, "pred_bin", "true_bin", "preds", False), "preds", rounds=CLS_COLS))
def binary_metrics_by_fold(spark, sf_dir):
    return rounded(class_metrics(predictions(spark, sf_dir), GROUPS, "pred_bin", "true_bin"))


@query(sql(cls_sql(GROUPS_SQL, "pred_cls", "true_cls", "preds", False, 0), "preds", rounds=CLS_COLS))
def multiclass_metrics_by_fold(spark, sf_dir):
    return rounded(class_metrics(predictions(spark, sf_dir), GROUPS, "pred_cls", "true_cls", positive=0))


_ENTITY_MEANS = {"means": "SELECT rep, fold, entity, avg(pred_reg) AS mean_pred, avg(true_reg) AS mean_true FROM preds WHERE NOT is_test GROUP BY rep, fold, entity"}


@query(sql(reg_sql("rep, fold", "mean_pred", "mean_true", "means", True), "preds", _ENTITY_MEANS, REG_COLS))
def entity_regression_metrics(spark, sf_dir):
    """Entity means first, then the metrics of each fold; cut at zero and guarded for one-class truth."""
    rows = predictions(spark, sf_dir).where(~F.col("is_test"))
    means = entity_predictions(rows, KEY, "reg", "pred_reg", "true_reg", ["rep", "fold"])
    return rounded(regression_metrics(means, ["rep", "fold"], "avg_predicted", "avg_true"))


@query(sql(cls_sql("entity", "pred_bin", "true_bin", "preds", True), "preds", rounds=CLS_COLS))
def guarded_metrics(spark, sf_dir):
    """Per entity the truth has one class: accuracy and correlation are undefined."""
    return rounded(class_metrics(predictions(spark, sf_dir), [KEY], "pred_bin", "true_bin", guard=True))


_SUMMARY = {"by_fold": reg_sql(GROUPS_SQL, "pred_reg", "true_reg", "preds", False)}


@query(sql("""SELECT scr_frac, is_test, avg(pear) AS pear_mean, stddev_samp(pear) AS pear_std, avg(mse) AS mse_mean, stddev_samp(mse) AS mse_std,
    avg(r2) AS r2_mean, stddev_samp(r2) AS r2_std, avg(sign_acc) AS sign_acc_mean, stddev_samp(sign_acc) AS sign_acc_std,
    avg(rep) AS rep_mean, stddev_samp(rep) AS rep_std, avg(fold) AS fold_mean, stddev_samp(fold) AS fold_std
    FROM by_fold GROUP BY scr_frac, is_test""", "preds", _SUMMARY,
           " ".join(f"{m}_{s}" for m in ("pear", "mse", "r2", "sign_acc", "rep", "fold") for s in ("mean", "std"))))
def metric_summary(spark, sf_dir):
    """Mean and standard deviation over the folds of every level."""
    folds = regression_metrics(predictions(spark, sf_dir), GROUPS, "pred_reg", "true_reg", guard=False)
    return rounded(summarize_metrics(folds, ["scr_frac", "is_test"], ["pear", "mse", "r2", "sign_acc", "rep", "fold"]))


@query(sql("SELECT unnest(['mse', 'pear', 'r2']) AS metric, unnest([avg(mse), avg(pear), avg(r2)]) AS value FROM by_fold", "preds", _SUMMARY, "value"))
def fold_means_long(spark, sf_dir):
    folds = regression_metrics(predictions(spark, sf_dir), GROUPS, "pred_reg", "true_reg", guard=False)
    return rounded(mean_metrics_long(folds, ["mse", "pear", "r2"]))


_CELLS = {"grid": "SELECT * FROM (SELECT DISTINCT is_test FROM preds) CROSS JOIN (SELECT unnest([2, 1, 0])::INTEGER AS true_class) CROSS JOIN (SELECT unnest([2, 1, 0])::INTEGER AS pred_class)",
          "cells": "SELECT is_test, true_cls AS true_class, pred_cls AS pred_class, count(*) AS n FROM preds GROUP BY ALL"}


@query(sql("""SELECT is_test, true_class, pred_class, n, 100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY is_test, true_class), 0) AS pct
    FROM (SELECT grid.*, coalesce(n, 0) AS n FROM grid LEFT JOIN cells USING (is_test, true_class, pred_class))""", "preds", _CELLS, "pct"))
def confusion_matrix(spark, sf_dir):
    """Counts on the full grid of classes and row percentages."""
    return rounded(confusion(predictions(spark, sf_dir), [2, 1, 0], "pred_cls", "true_cls", ["is_test"]))


@query(sql("""SELECT noise_level, is_test, covar_pop(true_reg, pred_reg) / nullif(sqrt(var_pop(true_reg) * var_pop(pred_reg)), 0) AS pear,
    avg((pred_reg - true_reg) * (pred_reg - true_reg)) AS mse FROM preds GROUP BY noise_level, is_test""", "preds", rounds="noise_level pear mse"))
def metric_curves_by_noise(spark, sf_dir):
    return rounded(metric_curves(predictions(spark, sf_dir), "noise_level", ["is_test"], "pred_reg", "true_reg"))


@query(sql("SELECT least(min(true_reg), min(pred_reg)) - 0.1 AS low, greatest(max(true_reg), max(pred_reg)) + 0.1 AS high FROM preds", "preds", rounds="low high"))
def plot_extent(spark, sf_dir):
    return rounded(joint_extent(predictions(spark, sf_dir), ["true_reg", "pred_reg"]))


@query(sql("SELECT is_test, scr_frac, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM preds GROUP BY is_test, scr_frac", "preds"))
def split_row_counts(spark, sf_dir):
    return split_summary(predictions(spark, sf_dir), KEY, ["is_test", "scr_frac"])


@query(sql("""SELECT CAST(pred_reg > 0 AS INTEGER) AS above_zero, CAST(pred_reg > 1 AS INTEGER) AS above_one, count(*) AS n FROM preds
    WHERE scr_frac = 0.25 AND NOT is_test GROUP BY ALL""", "preds"))
def binarized_predictions(spark, sf_dir):
    """Equality filter on level and side, then both thresholds."""
    rows = predictions(spark, sf_dir).where((F.col("scr_frac") == 0.25) & ~F.col("is_test"))
    return rows.groupBy(binarize(F.col("pred_reg")).alias("above_zero"), binarize(F.col("pred_reg"), 1.0).alias("above_one")).agg(
        F.count("*").alias("n"))


@query("""SELECT l_returnflag, count(*) AS n FROM lineitem WHERE abs(l_discount * 3 - 0.15::DOUBLE) <= 1e-8 + 1e-5 * abs(0.15::DOUBLE) GROUP BY l_returnflag""")
def tolerant_level_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(is_close(F.col("l_discount") * 3, 0.15))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


_IMPORTANCE = {"per_fold": "SELECT * FROM labelled", "imp": " UNION ALL ".join(
    f"SELECT '{name}' AS feature, abs(corr({c}, y)) AS importance FROM labelled GROUP BY {h('run', SEED, chr(39) + 'part' + chr(39))} % 4"
    for name, c in (("Price", "price"), ("Quantity", "quantity"), ("Tax", "tax"), ("Discount", "discount")))}


@query(sql("SELECT feature, avg(importance) AS mean_importance, stddev_pop(importance) AS std_importance FROM imp GROUP BY feature",
           "labelled", _IMPORTANCE, "mean_importance std_importance"))
def feature_importance_summary(spark, sf_dir):
    """Mean and spread over folds of a per-fold importance (absolute correlation), with cleaned names."""
    from framecv.functions.hashing import hash52
    rows = labelled(spark, sf_dir).withColumn("fold", hash52(F.col("run"), SEED, "part") % 4)
    names = {"price": "Price Energy", "quantity": "Delta_Quantity", "tax": "Tax Energy", "discount": "Discount"}
    corr = rows.groupBy("fold").agg(*[F.abs(F.corr(c, "y")).alias(c) for c in names])
    long = corr.select(F.inline(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(c).alias("importance")) for c, v in names.items()])))
    return rounded(importance_summary(long.withColumn("feature", clean_feature_name(F.col("feature")))))


# ---- quantiles -------------------------------------------------------------------------------

@query(sql("""SELECT is_test, count(pred_reg) AS n, min(pred_reg) AS low, quantile_cont(pred_reg, 0.25) AS q25, quantile_cont(pred_reg, 0.5) AS q50,
    quantile_cont(pred_reg, 0.75) AS q75, max(pred_reg) AS high FROM preds GROUP BY is_test""", "preds", rounds="low q25 q50 q75 high"))
def prediction_quartiles(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rounded(quantiles(rows, "pred_reg", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["is_test"]))


def _plotting(p: float) -> str:
    return f"""(SELECT sum(CASE WHEN r = k THEN (1 - g) * v WHEN r = k + 1 THEN g * v END) FROM (SELECT v, r, floor(greatest(least(a, n - 1), 1)) AS k,
        least(greatest(a - floor(greatest(least(a, n - 1), 1)), 0), 1) AS g FROM (SELECT price AS v, row_number() OVER (ORDER BY price) AS r,
        count(*) OVER () AS n, count(*) OVER () * {p}::DOUBLE + (0.4::DOUBLE + {p}::DOUBLE * 0.2::DOUBLE) AS a FROM frames)))"""


@query(sql(f"SELECT (SELECT count(*) FROM frames) AS n, (SELECT min(price) FROM frames) AS low, {_plotting(0.05)} AS lo, {_plotting(0.95)} AS hi, (SELECT max(price) FROM frames) AS high",
           "frames", rounds="low lo hi high", digits=4))
def central_range(spark, sf_dir):
    """5th and 95th percentile at plotting position 0.4, the ends of a dependence grid."""
    return rounded(quantiles(frames(spark, sf_dir), "price", {"lo": 0.05, "hi": 0.95}, alphap=0.4, betap=0.4), 4)


# ---- score and sweep -------------------------------------------------------------------------

_Z = " + ".join(f"({c} - (SELECT avg({c}) FROM frames)) / (SELECT stddev_pop({c}) FROM frames)" for c in FEATURES)
_SCORE = {
    "scored": f"SELECT entity, {_Z} AS z FROM frames",
    "ref": "SELECT entity FROM (SELECT DISTINCT entity, y FROM labelled) ORDER BY abs(y), entity LIMIT 1",
    "origin": "SELECT avg(z) AS o FROM scored WHERE entity = (SELECT entity FROM ref)",
    "per": "SELECT entity, avg(z) AS m, coalesce(stddev_pop(z), 0) AS yerr FROM scored GROUP BY entity",
}
_SCORED = _SCORE | {"final": "SELECT entity, m - o AS pred_mean, -(m - o) AS y_pred, yerr, y AS y_true FROM per CROSS JOIN origin JOIN (SELECT DISTINCT entity, y FROM labelled) USING (entity)"}


def _score(spark, sf_dir):
    return reference_state_score(frames(spark, sf_dir), labels(spark, sf_dir), KEY, "y", FEATURES, train=frames(spark, sf_dir).select("entity"))


@query(sql("SELECT * FROM final", "labelled", _SCORED, "pred_mean y_pred yerr y_true"))
def reference_scores(spark, sf_dir):
    """Summed z-scores relative to the reference entity, next to the truth."""
    return rounded(_score(spark, sf_dir))


def sweep_sql(steps: int) -> dict[str, str]:
    return {"ends": "SELECT min(s) AS lo, max(s) AS hi, count(*) AS n FROM pts",
            "grid": f"SELECT i::INTEGER AS step, CASE WHEN i = {steps - 1} THEN hi ELSE lo + i * ((hi - lo) / {steps - 1}::DOUBLE) END AS threshold, n FROM ends CROSS JOIN range({steps}) AS r(i)",
            "sweep": "SELECT step, threshold, sum(((s > threshold) = (t = 1))::INTEGER)::DOUBLE / n AS accuracy FROM grid CROSS JOIN pts GROUP BY step, threshold, n"}


@query(sql("SELECT step, threshold, accuracy FROM sweep", "preds",
           {"pts": "SELECT pred_reg AS s, CAST(true_reg > 0 AS INTEGER) AS t FROM preds"} | sweep_sql(1000), "threshold accuracy"))
def threshold_accuracy(spark, sf_dir):
    """Accuracy at 1000 thresholds from one histogram of the rows."""
    rows = predictions(spark, sf_dir).select("pred_reg", (F.col("true_reg") > 0).cast("int").alias("t"))
    return rounded(threshold_sweep(rows, "pred_reg", "t", 1000))


_BEST = {"pts": "SELECT y_pred AS s, CAST(y_true > 0 AS INTEGER) AS t, y_true, entity FROM final"} | sweep_sql(1000) | {
    "best": "SELECT step, threshold, accuracy FROM sweep ORDER BY accuracy DESC, step LIMIT 1"}


def _thresholded(spark, sf_dir):
    points = materialize(_score(spark, sf_dir).withColumn("t", (F.col("y_true") > 0).cast("int")))
    return points, materialize(best_threshold(threshold_sweep(points, "y_pred", "t", 1000)))


@query(sql("""SELECT step, threshold, accuracy, (SELECT 2.0::DOUBLE * sum((t = 0 AND NOT s > threshold)::INTEGER) / nullif(sum((t = 0)::INTEGER) + sum((NOT s > threshold)::INTEGER), 0) FROM pts) AS f1_negative,
    (SELECT avg(y_true) FROM (SELECT y_true FROM pts ORDER BY abs(s - threshold), entity LIMIT 5)) AS nearest_mean, least(5, (SELECT count(*) FROM pts)) AS k FROM best""",
           "labelled", _SCORED | _BEST, "threshold accuracy f1_negative nearest_mean"))
def best_threshold_report(spark, sf_dir):
    """First best threshold, F1 of the negative class there, and the mean truth of the five nearest entities."""
    points, best = _thresholded(spark, sf_dir)
    at = best.select("threshold").scalar()
    cut = points.withColumn("p", (F.col("y_pred") > at).cast("int"))
    f1 = class_metrics(cut, [], "p", "t", positive=0).select("f1").scalar()
    near = nearest_mean(points, KEY, "y_pred", at, "y_true", 5)
    return rounded(near.withColumn("b", best.select(F.struct("step", "threshold", "accuracy")).scalar()).select(
        "b.*", f1.alias("f1_negative"), "nearest_mean", "k"))


@query(sql("""SELECT true_class, pred_class, coalesce(n, 0) AS n, 100.0::DOUBLE * coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY true_class), 0) AS pct FROM
    (SELECT unnest([1, 1, 0, 0])::INTEGER AS true_class, unnest([1, 0, 1, 0])::INTEGER AS pred_class) LEFT JOIN
    (SELECT t AS true_class, CAST(s > (SELECT threshold FROM best) AS INTEGER) AS pred_class, count(*) AS n FROM pts GROUP BY ALL) USING (true_class, pred_class)""",
           "labelled", _SCORED | _BEST, "pct"))
def best_threshold_confusion(spark, sf_dir):
    points, best = _thresholded(spark, sf_dir)
    cut = points.withColumn("p", (F.col("y_pred") > best.select("threshold").scalar()).cast("int"))
    return rounded(confusion(cut, [1, 0], "p", "t"))
