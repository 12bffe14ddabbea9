import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framecv.operators.perturb import scramble_labels
from framecv.operators.split import assign_folds, subsample_sweep
from framecv.plans.crossval import fit_folds, with_folds
from framecv.plans.linear import (add_moments, fit_moments, kept_levels, linear_study, noisy_levels, read_models, row_moments, score_models, scrambled_levels,
                                  solve_moments, write_models)
from framecv.plans.models import build_estimator
from framecv.plans.prepare import tail_blocks_by_setting
from framecv.plans.search import FAILED, commit_trial, linear_trials, open_trials, read_log, run_trials, sample_space, settings_of


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(2)
    data = []
    for e in range(45):
        y = rng.normal()
        for b in range(rng.integers(2, 9)):
            x, z = y + rng.normal(), rng.normal()
            data.append((f"e{e:02d}", b, float(x), float(z), 3.0, float(y)))
    return spark.createDataFrame(data, "entity string, block int, x double, z double, flat double, y double").cache()


def _moments(x, y):
    z = np.column_stack([np.ones(len(x)), x, y])
    return [float((z[:, i] * z[:, j]).sum()) for i in range(z.shape[1]) for j in range(i, z.shape[1])]


def test_solutions_against_least_squares():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1]
    y = x @ [1.0, -2.0, 3.0] + 4 + rng.normal(size=300)
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    intercept, beta = solve_moments(_moments(x, y))
    assert [intercept, *beta] == pytest.approx(want.tolist(), abs=1e-9)
    flat = np.column_stack([x, np.full(300, 0.0)])
    assert solve_moments(_moments(flat, y))[1] == pytest.approx([*want[1:], 0.0], abs=1e-9)
    twice = solve_moments(_moments(np.column_stack([x[:, :1], x[:, :1]]), y))[1]
    assert twice[0] == pytest.approx(twice[1])


@pytest.mark.parametrize("ridge", [0.0, 0.3])
def test_models_equal_the_linear_learner(spark, blocks, ridge, tmp_path):
    folded = with_folds(blocks, assign_folds(blocks, "entity", 3, 2, 1), "entity").cache()
    features = ["x", "z", "flat"]
    store = str(tmp_path / "models")
    write_models(fit_moments(row_moments(folded, features, "y", ["repeat", "fold"]), (), ridge), store)
    fitted = fit_folds(folded, build_estimator("linear", "reg", features, "y", {"wt_decay": ridge}))
    rows = {(r["repeat"], r["fold"]): r for r in read_models(spark, store).collect()}
    assert sorted(rows) == sorted(fitted)
    for key, model in fitted.items():
        assert rows[key]["intercept"] == pytest.approx(model.stages[-1].intercept, abs=1e-6)
        assert rows[key]["coefficients"] == pytest.approx(model.stages[-1].coefficients.toArray().tolist(), abs=1e-6)
    one = read_models(spark, store, 1, 2)
    assert [(r["repeat"], r["fold"]) for r in one.collect()] == [(1, 2)]
    # every row meets the model that has not seen it; held-out rows meet all
    out = score_models(folded, read_models(spark, store), "entity", "y", features, ["repeat", "fold"])
    assert out.count() == folded.count()
    assert score_models(blocks, read_models(spark, store), "entity", "y", features).count() == 6 * blocks.count()


def test_rows_with_missing_values_take_no_part(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0), (0, None, 5.0), (1, 2.0, None), (1, 3.0, 4.0)], "fold int, x double, y double")
    got = {r["fold"]: r["moments"] for r in row_moments(rows, ["x"], "y", ["fold"]).collect()}
    assert got == {0: [1.0, 1.0, 2.0, 1.0, 2.0, 4.0], 1: [1.0, 3.0, 4.0, 9.0, 12.0, 16.0]}
    assert add_moments(row_moments(rows.limit(0), ["x"], "y", ["fold"]), ["fold"]).count() == 0
    lone = fit_moments(row_moments(rows.where("fold = 0").withColumn("repeat", F.lit(0)), ["x"], "y", ["repeat", "fold"]))
    assert lone.count() == 0


def test_levels_equal_the_single_operators(blocks):
    got = {(r["entity"], r["level"]): r["y"] for r in scrambled_levels(blocks, "entity", "y", [0.0, 0.5, 1.0], 7).collect()}
    for level in (0.0, 0.5, 1.0):
        want = {r["entity"]: r["y"] for r in scramble_labels(blocks, "entity", "y", level, 7).collect()}
        assert {e: y for (e, v), y in got.items() if v == level} == want
    kept = kept_levels(blocks, "entity", [1.0, 0.5, 0.01], 7, 4)
    sweep = subsample_sweep(blocks, "entity", [1.0, 0.5, 0.01], 7, 4).select("entity", F.col("sub_frac").alias("level")).distinct()
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in sweep.collect()}
    noisy = noisy_levels(blocks, "y", [0.0, 0.2], 7, ["entity", "block"])
    spread = noisy.join(blocks.select("entity", "block", F.col("y").alias("own")), ["entity", "block"]).groupBy("level").agg(F.stddev_pop(F.col("y") - F.col("own")))
    found = {r[0]: r[1] for r in spread.collect()}
    assert found[0.0] == 0.0 and found[0.2] == pytest.approx(0.2 * blocks.agg(F.stddev_pop("y")).first()[0], rel=0.25)


def test_a_study_reads_the_rows_once_for_all_levels(blocks):
    scores, models = linear_study(blocks, "entity", "y", ["x", "z"], [0.0, 1.0], "scramble", k=3, repeats=2)
    assert models.count() == 12
    rows = scores.collect()
    true = {r["entity"]: r["y"] for r in blocks.collect()}
    pear = {level: np.corrcoef(*zip(*[(r["avg_predicted"], r["avg_true"]) for r in rows if r["is_test"] and r["level"] == level]))[0, 1] for level in (0.0, 1.0)}
    assert pear[0.0] > 0.6
    assert all(r["avg_true"] == pytest.approx(true[r["entity"]]) for r in rows if r["is_test"] or r["level"] == 0.0)
    assert any(abs(r["avg_true"] - true[r["entity"]]) > 1e-6 for r in rows if not r["is_test"] and r["level"] == 1.0)
    with pytest.raises(ValueError):
        linear_study(blocks, "entity", "y", ["x"], [0.0], "other")


# ---- search ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    data = []
    for e in range(30):
        level = rng.normal()
        for f in range(200 if e == 0 else 24):
            data.append((f"e{e:02d}", f, float(level + rng.normal()), None if f % 11 == 3 else float(rng.normal()), float(2 * level)))
    return spark.createDataFrame(data, "entity string, frame int, x double, z double, y double").cache()


@pytest.mark.parametrize("max_rows", [2_000_000, 60])
def test_blocks_of_all_settings(spark, frames, max_rows):
    """Every setting as if it had been prepared alone, with and without an entity that is cut into slices."""
    from framecv.operators.frames import tail_blocks
    table = [("a", 100.0, 1), ("b", 100.0, 4), ("c", 60.0, 4), ("d", 60.0, 6), ("e", 0.0, 20), ("f", 35.0, 3), ("g", 1.0, 1), ("h", 60.0, 500), ("i", 50.0, 0)]
    settings = spark.createDataFrame(table, "setting string, keep double, navg bigint")
    got = tail_blocks_by_setting(frames, settings, "entity", ["frame"], 3, "y", ["x", "z"], max_rows).collect()
    for name, keep, n in table:
        own = {(r["entity"], r["block"]): (r["x"], r["z"], r["y"]) for r in got if r["setting"] == name}
        want = {} if n < 1 else {(r["entity"], r["block"]): (r["x"], r["z"], r["y"]) for r in tail_blocks(
            frames, "entity", ["frame"], keep, n, 3, "y", ["x", "z"]).collect()}
        assert set(own) == set(want)
        for k, cells in want.items():
            assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-9) for a, b in zip(own[k], cells))


def test_the_frames_are_shuffled_once(spark, frames):
    settings = [(f"s{i}_{n}", float(k), n) for i, k in enumerate((20, 40, 60, 80, 100)) for n in (1, 2, 4, 6)]
    few = tail_blocks_by_setting(frames, spark.createDataFrame(settings[:1], "setting string, keep double, navg bigint"), "entity", ["frame"], 3, "y", ["x"])
    many = tail_blocks_by_setting(frames, spark.createDataFrame(settings, "setting string, keep double, navg bigint"), "entity", ["frame"], 3, "y", ["x"])
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in (few, many)]
    executed = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (few, many)]
    assert executed == [1, 1] and all(plans)


def _search(frames, trials, folds, log, kind="linear", **more):
    return run_trials(frames, trials, folds, "entity", ["frame"], "y", ["x"], "reg", kind, more.pop("estimator", lambda p: None), 1, log, **more)


def test_linear_trials_equal_fitted_ones(spark, frames, tmp_path):
    space = {"keep_last_percent": ("quniform", 20, 100, 20), "navg": ("quniform", 1, 30, 6), "wt_decay": ("loguniform", 1e-2, 1.0)}
    trials = sample_space(spark, space, 6, 2).cache()
    folds = assign_folds(frames, "entity", 3, 1, 1)
    fast = {r["trial"]: r["loss"] for r in _search(frames, trials, folds, str(tmp_path / "a")).collect()}
    slow = {r["trial"]: r["loss"] for r in run_trials(frames, trials.withColumn("n_estimators", F.lit(None)), folds, "entity", ["frame"], "y", ["x"], "reg", "svm",
                                                      lambda p: build_estimator("linear", "reg", ["x"], "y", {"wt_decay": p["wt_decay"]}), 1).collect()}
    assert len(fast) == 6 and FAILED not in (min(fast.values()),)
    for t, loss in slow.items():
        assert fast[t] == pytest.approx(loss, abs=1e-5)


def test_a_killed_search_goes_on(spark, frames, tmp_path):
    """The search dies at its fourth trial; started again it runs the open ones only and ends with the same log."""
    trials = sample_space(spark, {"keep_last_percent": ("quniform", 60, 100, 20), "navg": ("quniform", 1, 5, 2), "n_estimators": ("quniform", 2, 4, 1)}, 6, 3).cache()
    folds = assign_folds(frames, "entity", 2, 1, 1)

    def forest(p):
        return build_estimator("rf", "reg", ["x"], "y", {"n_estimators": p["n_estimators"], "max_depth": 2})

    whole = {tuple(r) for r in _search(frames, trials, folds, str(tmp_path / "whole"), "rf", estimator=forest).collect()}
    ran = []

    def dying(p):
        if len(ran) == 3:
            raise RuntimeError("killed")
        ran.append(p["trial"])
        return forest(p)

    log = str(tmp_path / "log")
    with pytest.raises(RuntimeError):
        _search(frames, trials, folds, log, "rf", estimator=dying, parallelism=1)
    assert sorted(r["trial"] for r in read_log(spark, log).collect()) == sorted(ran) and len(ran) == 3
    assert {r["trial"] for r in open_trials(trials, log).collect()} == set(range(6)) - set(ran)
    again = []
    rest = _search(frames, trials, folds, log, "rf", estimator=lambda p: again.append(p["trial"]) or forest(p))
    assert {tuple(r) for r in rest.collect()} == whole and set(again) == set(range(6)) - set(ran)
    # all done: nothing is prepared or run
    assert {tuple(r) for r in _search(frames, trials, folds, log, "rf", estimator=dying).collect()} == whole


def test_log_entries_are_replaced(spark, tmp_path):
    log = str(tmp_path / "log")
    assert read_log(spark, log).count() == 0
    commit_trial(spark, log, 4, 0.5)
    commit_trial(spark, log, 5, FAILED)
    commit_trial(spark, log, 4, 0.25)
    assert {tuple(r) for r in read_log(spark, log).collect()} == {(4, 0.25, "ok"), (5, FAILED, "fail")}
