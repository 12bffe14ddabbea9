"""Whole studies with linear models on one feature, which SQL can repeat: sweeps, held-out scoring, stored models, search."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framecv.catalog.base import KEY, ORDER, SEED, blocks_cte, count_of, frames, h, labelled, labels, normal, predictions, query, rounded, sql, table, tail_cte, unit
from framecv.catalog.metrics import _plotting, cls_sql, reg_sql
from framecv.catalog.splits import balanced, ranked
from framecv.functions.hashing import hash52
from framecv.operators.frames import tail_blocks
from framecv.operators.metrics import class_metrics, regression_metrics, summarize_metrics
from framecv.operators.split import assign_folds, split_entities
from framecv.operators.stats import fit_stats, standardize
from framecv.plans.crossval import fold_metrics
from framecv.plans.dependence import feature_grid, linear_curves, linear_dependence
from framecv.plans.linear import (add_moments, fit_moments, fit_whole, linear_study, read_models, row_moments, score_models, write_models)
from framecv.plans.search import SPACES, run_trials, sample_space, trial_loss
from framecv.session import materialize, scratch_path
from framecv.sources.tables import load_fold, read_csv, write_splits, write_trials

FOLDS, REPEATS = 5, 5
SCRAMBLE, NOISE, SUBSAMPLE = [0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 0.05, 0.1, 0.2, 0.3], [1.0, 0.75, 0.5, 0.25]


def price_blocks(spark, sf_dir):
    """Block averages of one feature with the label, written once."""
    given = labels(spark, sf_dir).select(KEY, "y")
    return materialize(tail_blocks(frames(spark, sf_dir), KEY, ORDER, 60, 5, SEED, "y", ["price"], given))


def _levels(values) -> str:
    return "SELECT unnest([" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]) AS level"


_DATA = tail_cte(60) | blocks_cte(5, SEED) | {"bents": "SELECT entity, count(*) AS n_rows, min(y) AS y FROM blocks GROUP BY entity"} | ranked(
    "split", source="bents", name="sides") | {
    "tents": f"SELECT entity, n_rows, y FROM sides WHERE rank < {count_of('n', 0.8)}",
    "tests": f"SELECT entity FROM sides WHERE rank >= {count_of('n', 0.8)}",
    "repeated": f"SELECT e.*, r.repeat FROM tents e CROSS JOIN (SELECT unnest(range({REPEATS}))::INTEGER AS repeat) r"} | balanced(FOLDS)
_SCRAMBLED = ranked("scramble", source="tents", name="shuffled") | {
    "levels": _levels(SCRAMBLE),
    "donated": f"""SELECT a.entity, a.rank, a.n, a.y, d.y AS given FROM shuffled a JOIN shuffled d
        ON d.rank = (a.rank + 1 + {h('a.entity', SEED, "'donor'")} % greatest(a.n - 1, 1)) % a.n""",
    "given": "SELECT entity, level, CASE WHEN rank < CAST(trunc(n::DOUBLE * level) AS BIGINT) AND n > 1 THEN given ELSE y END AS y FROM donated CROSS JOIN levels",
    "rows": "SELECT level, repeat, fold, entity, price AS x, g.y FROM blocks b JOIN given g USING (entity) JOIN folds USING (entity)"}
_NOISY = {
    "levels": _levels(NOISE),
    "rows": f"""SELECT level, repeat, fold, entity, price AS x, CASE WHEN level > 0 THEN b.y + {normal('entity', 'block', f'({SEED} + CAST(trunc(level * 1000) AS INTEGER))', "'noise'")}
        * level * s ELSE b.y END AS y FROM blocks b JOIN folds USING (entity) CROSS JOIN levels
        CROSS JOIN (SELECT stddev_pop(b.y) AS s FROM blocks b JOIN tents USING (entity))"""}
_SUBSAMPLED = ranked("subsample", source="tents", name="shuffled") | {
    "levels": _levels(SUBSAMPLE),
    "rows": """SELECT level, repeat, fold, entity, price AS x, b.y FROM blocks b JOIN shuffled USING (entity) JOIN folds USING (entity)
        JOIN levels ON level >= 1 OR rank < greatest(CAST(trunc(n::DOUBLE * level) AS BIGINT), 5)"""}
_FITS = {
    "fits": f"""SELECT level, repeat, held AS fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM rows
        JOIN (SELECT unnest(range({FOLDS}))::INTEGER AS held) ON fold <> held GROUP BY ALL""",
    "means": """SELECT level, false AS is_test, repeat, fold, entity, avg(a * x + b) AS mean_pred, avg(y) AS mean_true FROM rows JOIN fits USING (level, repeat, fold) GROUP BY ALL
        UNION ALL SELECT level, true, repeat, fold, entity, avg(a * price + b), avg(y) FROM blocks JOIN tests USING (entity) CROSS JOIN fits GROUP BY level, repeat, fold, entity""",
    "by_fold": reg_sql("level, is_test, repeat, fold", "mean_pred", "mean_true", "means", True)}
_MEASURES = ["mse", "r2", "pear"]
_SUMMARY = "SELECT level, is_test, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in _MEASURES) + " FROM by_fold GROUP BY level, is_test"
_ROUNDS = " ".join(f"{m}_mean {m}_std" for m in _MEASURES)


def _study(spark, sf_dir, levels, kind, **more):
    scores, _ = linear_study(price_blocks(spark, sf_dir), KEY, "y", ["price"], levels, kind, FOLDS, REPEATS, SEED, **more)
    by_fold = regression_metrics(scores, ["level", "is_test", "repeat", "fold"], "avg_predicted", "avg_true")
    return rounded(summarize_metrics(by_fold, ["level", "is_test"], _MEASURES), 4)


@query(sql(_SUMMARY, "labelled", _DATA | _SCRAMBLED | _FITS, _ROUNDS, 4))
def linear_scramble_study(spark, sf_dir):
    """Five levels of label scrambling, 5 x 5 folds: validation and held-out metrics, from one pass over the blocks."""
    return _study(spark, sf_dir, SCRAMBLE, "scramble")


@query(sql(_SUMMARY, "labelled", _DATA | _NOISY | _FITS, _ROUNDS, 4))
def linear_noise_study(spark, sf_dir):
    """Five levels of label noise, 5 x 5 folds."""
    return _study(spark, sf_dir, NOISE, "noise")


@query(sql(_SUMMARY, "labelled", _DATA | _SUBSAMPLED | _FITS, _ROUNDS, 4))
def linear_subsample_study(spark, sf_dir):
    """Four training sizes, 5 x 5 folds."""
    return _study(spark, sf_dir, SUBSAMPLE, "subsample", min_entities=5)


# ---- stored models ---------------------------------------------------------------------------

def _sides(spark, sf_dir):
    """Standardised training rows with folds, and held-out rows."""
    blocks = price_blocks(spark, sf_dir)
    split = split_entities(blocks, KEY, 0.2, SEED)
    sided = materialize(blocks.join(split, KEY))
    train, test = (sided.where(F.col("is_test") == side).drop("is_test") for side in (False, True))
    stats = materialize(fit_stats(train, ["price"]))
    folds = assign_folds(train, KEY, FOLDS, REPEATS, SEED)
    return standardize(train, stats, ["price"]).join(folds, KEY), standardize(test, stats, ["price"])


def _store(spark, folded) -> str:
    entities = row_moments(folded, ["price"], "y", ["repeat", "fold"])
    path = scratch_path(spark, "models")
    write_models(fit_moments(add_moments(materialize(entities), ["repeat", "fold"])), path)
    return path


_PLAIN = {"rows": "SELECT repeat, fold, entity, block, price AS x, b.y FROM blocks b JOIN folds USING (entity)",
          "fits": f"""SELECT repeat, held AS fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM rows
              JOIN (SELECT unnest(range({FOLDS}))::INTEGER AS held) ON fold <> held GROUP BY ALL"""}
_HELD = {"means": """SELECT repeat, fold, entity, avg(a * price + b) AS mean_pred, avg(y) AS mean_true FROM blocks JOIN tests USING (entity)
    CROSS JOIN fits GROUP BY repeat, fold, entity"""}


@query(sql(reg_sql("repeat, fold", "mean_pred", "mean_true", "means", True), "labelled", _DATA | _PLAIN | _HELD, "mse r2 pear sign_acc mcc accuracy", 4))
def linear_holdout_metrics(spark, sf_dir):
    """The 25 fold models, stored by repeat and fold, read back and applied to the held-out entities in one scan."""
    folded, test = _sides(spark, sf_dir)
    models = read_models(spark, _store(spark, folded))
    return rounded(fold_metrics(score_models(test, models, KEY, "y", ["price"]), KEY, "reg"), 4)


@query(sql("SELECT entity, avg(a * x + b) AS predicted, count(*) AS n FROM rows JOIN fits USING (repeat) WHERE repeat = 2 AND fits.fold = 3 AND rows.fold <> 3 GROUP BY entity",
           "labelled", _DATA | _PLAIN, "predicted", 4))
def reloaded_linear_model(spark, sf_dir):
    """One stored model and its stored training rows, scored again."""
    folded, _ = _sides(spark, sf_dir)
    folded = materialize(folded)
    rows = scratch_path(spark, "rows")
    write_splits(folded, rows)
    train = load_fold(spark, rows, 2, 3, validation=False).select(KEY, "price", "y")
    scored = score_models(train, read_models(spark, _store(spark, folded), 2, 3), KEY, "y", ["price"])
    return rounded(scored.groupBy(KEY).agg(F.avg("predicted").alias("predicted"), F.count("*").alias("n")), 4)


# ---- search ----------------------------------------------------------------------------------

N_TRIALS, SEARCH_FOLDS = 20, 3


def supplier_frames(spark, sf_dir):
    """Frames of suppliers, with hundreds of rows each: enough for the largest blocks of the search space."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("frame"), F.col("l_partkey").alias("replica"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.sqrt("l_extendedprice").alias("price"))
    targets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_acctbal") / 1000).alias("y"))
    return rows.join(targets, "entity")


def _drawn(name: str) -> str:
    kind, *args = SPACES["linear"][name]
    u = unit("trial", f"'{name}'", SEED)
    if kind == "loguniform":
        lo, hi = math.log(args[0]), math.log(args[1])
        return f"exp({lo!r}::DOUBLE + {u} * {hi - lo!r}::DOUBLE) AS {name}"
    lo, hi, q = args
    return f"greatest(1, round_even(({lo}::DOUBLE + {u} * {hi - lo}::DOUBLE) / {q}::DOUBLE, 0) * {q}) AS {name}"


_ORDER = ", ".join(ORDER)
_SEARCH = {
    "trials": f"SELECT trial, {', '.join(_drawn(n) for n in SPACES['linear'])} FROM range({N_TRIALS}) AS t(trial)",
    "rowsof": """SELECT l_suppkey AS entity, l_orderkey AS run, l_linenumber AS frame, l_partkey AS replica, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
        sqrt(l_extendedprice) AS price, s_acctbal / 1000 AS y FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
    "ents": "SELECT entity, CAST(min(y) > 4.5::DOUBLE AS INTEGER) AS cls FROM rowsof GROUP BY entity",
    "folds": f"""SELECT entity, (row_number() OVER (ORDER BY cls, {h('entity', SEED, "'fold'")}, entity) - 1) % {SEARCH_FOLDS} AS fold FROM ents""",
    "placed": f"SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {_ORDER}) - 1 AS pos, count(*) OVER (PARTITION BY entity) AS n FROM rowsof",
    "kept": """SELECT trial, navg, wt_decay, placed.* EXCLUDE (pos, n) FROM placed JOIN trials ON keep_last_percent >= 100 OR
        pos >= n - greatest(1, CAST(trunc(n::DOUBLE * (keep_last_percent / 100::DOUBLE)) AS BIGINT))""",
    "drawn": f"SELECT *, row_number() OVER (PARTITION BY trial, entity ORDER BY {h(*ORDER, SEED, chr(39) + 'block' + chr(39))}, {_ORDER}) - 1 AS pos, count(*) OVER (PARTITION BY trial, entity) AS n FROM kept",
    "blocks": """SELECT trial, wt_decay, entity, pos // CAST(navg AS BIGINT) AS block, avg(price) AS x, min(y) AS y FROM drawn
        WHERE pos // CAST(navg AS BIGINT) < n // CAST(navg AS BIGINT) GROUP BY ALL""",
    "rows": "SELECT trial, wt_decay, entity, fold, x, y FROM blocks JOIN folds USING (entity)",
    "fits": f"""SELECT trial, held AS fold, covar_pop(x, y) / (var_pop(x) + var_pop(x) * any_value(wt_decay) / stddev_pop(y)) AS a, avg(x) AS mx, avg(y) AS my
        FROM rows JOIN (SELECT unnest(range({SEARCH_FOLDS})) AS held) ON fold <> held GROUP BY trial, held""",
    "means": "SELECT trial, fold, entity, avg(a * (x - mx) + my) AS p, avg(y) AS t FROM rows JOIN fits USING (trial, fold) GROUP BY ALL",
    "scores": "SELECT trial, fold, avg((p - t) * (p - t)) AS mse, covar_pop(t, p) / nullif(sqrt(var_pop(t) * var_pop(p)), 0) AS pear FROM means GROUP BY ALL",
}


@query(sql("""SELECT trial, keep_last_percent, navg, wt_decay, coalesce(0.5::DOUBLE * (1 - avg(pear)) + 0.5::DOUBLE * avg(mse), 1e6) AS loss,
    CASE WHEN avg(pear) IS NULL THEN 'fail' ELSE 'ok' END AS status
    FROM trials LEFT JOIN scores USING (trial) GROUP BY trial, keep_last_percent, navg, wt_decay""", "", _SEARCH, "loss wt_decay", 4))
def search_trials(spark, sf_dir):
    """Twenty trials of the whole linear space: one preparation for all of them, fold-wise fits, losses; the log is stored and read back."""
    trials = materialize(sample_space(spark, SPACES["linear"], N_TRIALS, SEED))
    rows = supplier_frames(spark, sf_dir)
    folds = assign_folds(rows.withColumn("cls", (F.col("y") > 4.5).cast("int")), KEY, SEARCH_FOLDS, 1, SEED, "cls")
    log = run_trials(rows, trials, folds, KEY, ORDER, "y", ["price"], "reg", "linear", lambda p: None, SEED)
    path = scratch_path(spark, "trials")
    write_trials(log, path)
    return rounded(read_csv(spark, path, log.schema), 4)


_BY_NOISE = cls_sql("noise_level", "pred_bin", "true_bin", "preds", True)


@query(sql(f"SELECT noise_level, coalesce(0.5::DOUBLE * (1 - accuracy) + 0.5::DOUBLE * (1 - mcc), 1e6) AS loss FROM ({_BY_NOISE})", "preds", rounds="noise_level loss"))
def class_losses(spark, sf_dir):
    """The loss of a classification trial at every noise level: accuracy and correlation in equal parts."""
    by_level = class_metrics(predictions(spark, sf_dir), ["noise_level"], "pred_bin", "true_bin", guard=True)
    return rounded(by_level.select("noise_level", trial_loss("bin").alias("loss")))


# ---- dependence ------------------------------------------------------------------------------

_PAIR = ["price", "quantity"]
_WHOLE = {"sums": """SELECT var_pop(price) AS s11, var_pop(quantity) AS s22, covar_pop(price, quantity) AS s12, covar_pop(price, y) AS s1y, covar_pop(quantity, y) AS s2y,
              avg(price) AS m1, avg(quantity) AS m2, avg(y) AS my, count(*) AS n FROM labelled""",
          "slopes": "SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM sums",
          "model": "SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM slopes",
          "ends": f"SELECT {_plotting(0.05)} AS lo, {_plotting(0.95)} AS hi"}


@query(sql("SELECT lo + i * ((hi - lo) / 49) AS grid, b0 + b1 * (lo + i * ((hi - lo) / 49)) + b2 * m2 AS average, n FROM ends CROSS JOIN model CROSS JOIN range(50) AS t(i)",
           "labelled", _WHOLE, "grid average", 4))
def linear_dependence_on_price(spark, sf_dir):
    """Mean prediction of a linear model over all frames at 50 grid values of one of its two features."""
    rows = labelled(spark, sf_dir)
    return rounded(linear_dependence(rows, fit_whole(rows, _PAIR, "y"), _PAIR, "price", feature_grid(rows, "price")), 4)


@query(sql("""SELECT entity, count(*) AS n, avg(b0 + b2 * quantity + b1 * lo) AS at_low, avg(b0 + b2 * quantity + b1 * hi) AS at_high, min(b0 + b2 * quantity) AS least
    FROM labelled CROSS JOIN model CROSS JOIN ends GROUP BY entity""", "labelled", _WHOLE, "at_low at_high least", 4))
def linear_price_curves(spark, sf_dir):
    """The line of every frame in one feature, summed up by entity at both ends of the grid."""
    rows = labelled(spark, sf_dir)
    curves = linear_curves(rows, fit_whole(rows, _PAIR, "y"), _PAIR, "price", [KEY])
    ends = feature_grid(rows, "price").agg(F.struct(F.min("grid").alias("lo"), F.max("grid").alias("hi"))).scalar()
    return rounded(curves.withColumn("_e", ends).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("base") + F.col("slope") * F.col("_e.lo")).alias("at_low"),
        F.avg(F.col("base") + F.col("slope") * F.col("_e.hi")).alias("at_high"), F.min("base").alias("least")), 4)
