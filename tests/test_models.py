import numpy as np
import pytest
from pyspark.sql import functions as F

from framecv.operators.frames import tail_blocks
from framecv.operators.split import assign_folds
from framecv.plans.crossval import (fit_folds, fold_metrics, importances, load_model, present_folds, save_models, score_folds,
                                    score_holdout, with_clean_truth, with_folds)
from framecv.plans.dependence import individual_curves, partial_dependence, with_grid
from framecv.plans.experiment import label_noise, run_levels, scrambling, subsampling
from framecv.plans.models import build_estimator
from framecv.session import materialize
from framecv.plans.search import FAILED, SPACES, best_trial, run_trials, sample_space, settings_of, trial_loss


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for e in range(40):
        level = rng.normal()
        for f in range(8):
            x = level + 0.1 * rng.normal()
            data.append((f"e{e:02d}", f, float(x), float(rng.normal()), float(2 * level), int(level > 0), int(np.digitize(level, [-0.5, 0.5]))))
    return spark.createDataFrame(data, "entity string, frame int, x double, noise double, y double, b int, c int").cache()


@pytest.fixture(scope="module")
def folded(rows):
    return with_folds(rows, assign_folds(rows, "entity", 3, 2, 1), "entity").cache()


@pytest.mark.parametrize("kind, task, params", [
    ("linear", "reg", {}), ("rf", "reg", {"n_estimators": 5, "max_depth": None}), ("linear", "bin", {"wt_decay": 1e-3}),
    ("rf", "bin", {"n_estimators": 5, "max_features": None}), ("svm", "bin", {"max_iter": 10, "n_train": 200}), ("linear", "mclass", {"max_iter": 20}),
    ("mlp", "mclass", {"n_classes": 3, "max_iter": 40, "hidden_size": 6}), ("svm", "mclass", {"max_iter": 10, "n_train": 200})])
def test_fold_models_learn(folded, kind, task, params):
    label = {"reg": "y", "bin": "b", "mclass": "c"}[task]
    one = folded.where("repeat = 0")
    models = fit_folds(one, build_estimator(kind, task, ["x", "noise"], label, params))
    assert sorted(models) == [(0, 0), (0, 1), (0, 2)]
    out = score_folds(models, one, "entity", label)
    assert out.count() == one.count()
    metrics = fold_metrics(out, "entity", task).collect()
    assert len(metrics) == 3 and np.mean([m["accuracy"] for m in metrics]) > 0.7
    if task == "reg":
        assert np.mean([m["pear"] for m in metrics]) > 0.8


def test_scrambled_labels_destroy_the_skill(rows):
    from framecv.operators.perturb import scramble_labels
    wild = scramble_labels(rows, "entity", "y", 1.0, 3)
    table = with_folds(wild, assign_folds(wild, "entity", 3, 1, 1), "entity").cache()
    out = score_folds(fit_folds(table, build_estimator("linear", "reg", ["x"], "y")), table, "entity", "y")
    assert np.mean([m["pear"] or 0.0 for m in fold_metrics(out, "entity", "reg").collect()]) < 0.5


def test_holdout_and_reload(spark, rows, folded, tmp_path):
    models = fit_folds(folded, build_estimator("rf", "bin", ["x", "noise"], "b", {"n_estimators": 3, "max_depth": 3}))
    assert present_folds(folded) == sorted(models) and len(models) == 6
    held = rows.where("entity < 'e05'")
    out = score_holdout(models, held, "entity", "b")
    assert out.count() == 6 * held.count()
    save_models({(1, 2): models[(1, 2)]}, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"), 1, 2).transform(held).agg(F.sum("prediction")).first()[0]
    assert again == out.where("repeat = 1 and fold = 2").agg(F.sum("predicted")).first()[0]
    imp = importances(spark, models, ["x", "noise"])
    assert imp.count() == 12 and imp.where("feature = 'x'").agg(F.min("importance")).first()[0] > 0.5
    # a fold without rows is skipped
    assert present_folds(folded.where("not (repeat = 1 and fold = 0)")) == [p for p in sorted(models) if p != (1, 0)]


def test_partial_dependence(rows):
    model = build_estimator("linear", "reg", ["x", "noise"], "y").fit(rows)
    curve = partial_dependence(model, rows, "x", points=11).orderBy("grid").collect()
    assert len(curve) == 11 and {r["n"] for r in curve} == {320}
    grid = np.array([r["grid"] for r in curve])
    assert np.diff(grid) == pytest.approx([grid[1] - grid[0]] * 10)
    slope = model.stages[-1].coefficients[0]
    assert np.diff([r["average"] for r in curve]) == pytest.approx(slope * np.diff(grid))
    assert individual_curves(model, rows, "x", ["entity", "frame"], points=5).count() == 5 * 320
    few = with_grid(rows.limit(1), rows.withColumn("k", F.col("frame") % 4), "k", points=50).first()["_grid"]
    assert few == [0.0, 1.0, 2.0, 3.0]


def test_search(spark, rows):
    space = {"keep_last_percent": ("quniform", 50, 100, 25), "navg": ("quniform", 1, 12, 4)}
    trials = sample_space(spark, space, 4, 1).cache()
    assert [r["trial"] for r in trials.orderBy("trial").collect()] == [0, 1, 2, 3]
    assert settings_of(trials).count() <= 4
    log = run_trials(rows, trials, assign_folds(rows, "entity", 3, 1, 1), "entity", ["frame"], "y", ["x"], "reg", "linear",
                     lambda p: build_estimator("linear", "reg", ["x"], "y"), 1).collect()
    for r in log:
        assert (r["loss"] == FAILED) == (r["status"] == "fail")
        assert (r["status"] == "fail") == (int(8 * r["keep_last_percent"] / 100) < r["navg"])
    table = spark.createDataFrame([(0, 3.0, "a"), (1, 1.0, None), (2, 1.0, "c")], "trial int, loss double, p string")
    assert best_trial(table).first()["trial"] == 1


def test_spaces_stay_in_bounds(spark):
    for kind, space in SPACES.items():
        rows = sample_space(spark, space, 200, 7).collect()
        assert all(r["navg"] >= 1 and 5 <= r["keep_last_percent"] <= 100 and r["keep_last_percent"] % 5 == 0 for r in rows)
        if kind == "rf":
            assert {r["max_depth"] for r in rows} == {None, 10, 15, 20, 25, 30}
        if kind == "svm":
            assert all(1e-3 <= r["C"] <= 1e3 for r in rows)


def test_losses(spark):
    reg = spark.createDataFrame([(0.5, 2.0), (None, 2.0)], "pear double, mse double")
    assert [r[0] for r in reg.select(trial_loss("reg", "rf")).collect()] == [0.5, FAILED]
    assert reg.select(trial_loss("reg", "svm")).first()[0] == pytest.approx(0.5 * 2.0 + 0.5 * 0.5)
    cls = spark.createDataFrame([(0.8, 0.6), (0.8, None)], "accuracy double, mcc double")
    assert [r[0] for r in cls.select(trial_loss("bin")).collect()] == [pytest.approx(0.3), FAILED]


def test_wrong_tasks_are_refused():
    with pytest.raises(ValueError):
        build_estimator("mlp", "reg", ["x"], "y", {"n_classes": 2})
    with pytest.raises(ValueError):
        build_estimator("svm", "reg", ["x"], "y")


NAMES = ["Delta_Entropy", "HB Energy", "Pi-Pi Energy"]


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(5)
    data, truth = [], []
    for e in range(60):
        level = rng.normal()
        truth.append((f"s{e:02d}", float(level), int(level > 0)))
        data += [(f"s{e:02d}", f % 3, f, float(level + 0.3 * rng.normal()), float(rng.normal()), 1.0) for f in range(20)]
    frames = spark.createDataFrame(data, "sequence string, run int, frame int, `Delta_Entropy` double, `HB Energy` double, `Pi-Pi Energy` double")
    labels = spark.createDataFrame(truth, "sequence string, bind_avg double, improving int")
    return frames, labels


@pytest.mark.parametrize("task, label", [("reg", "bind_avg"), ("bin", "improving")])
def test_scrambling_study(study, task, label):
    frames, labels = study
    blocks = materialize(tail_blocks(frames, "sequence", ["run", "frame"], 80, 4, 1, label, NAMES, labels.select("sequence", label)))
    assert blocks.count() == 60 * 4
    rows = run_levels(blocks, "sequence", label, task, build_estimator("linear", task, NAMES, label), [1.0, 0.0],
                      scrambling("sequence", label, 3), k=3, seed=3).cache()
    metric = "pear" if task == "reg" else "mcc"
    by = ["scr_frac", "is_test", "repeat", "fold"]
    mean = {(r["scr_frac"], r["is_test"]): r["m"] for r in fold_metrics(rows, "sequence", task, by).groupBy("scr_frac", "is_test").agg(F.avg(metric).alias("m")).collect()}
    assert mean[0.0, False] > 0.7 and mean[0.0, True] > 0.7
    assert mean[1.0, False] < 0.5
    sides = rows.groupBy("sequence").agg(F.count_distinct("is_test").alias("d"))
    assert sides.where("d > 1").count() == 0
    clean = with_clean_truth(rows, labels.withColumn(label, F.col(label).cast("double")), "sequence", label)
    assert clean.count() == rows.count() and clean.columns == rows.columns
    true = {r["sequence"]: float(r[label]) for r in labels.collect()}
    assert all(r["true"] == pytest.approx(true[r["sequence"]]) for r in clean.collect())


def test_noise_and_subsample_studies(study):
    frames, labels = study
    blocks = materialize(tail_blocks(frames, "sequence", ["run", "frame"], 80, 4, 1, "improving", NAMES, labels.select("sequence", "improving")))
    estimator = build_estimator("linear", "bin", NAMES, "improving")
    noisy = run_levels(blocks, "sequence", "improving", "bin", estimator, [0.0, 0.2], label_noise("sequence", "improving", 1, "bin"),
                       "noise_level", k=3, seed=3).cache()
    true = {r["sequence"]: r["improving"] for r in labels.collect()}
    changed = {(r["noise_level"], r["is_test"]) for r in noisy.collect() if r["true"] != true[r["sequence"]]}
    assert changed == {(0.2, False)}
    small = run_levels(blocks, "sequence", "improving", "bin", estimator, [1.0, 0.5], subsampling("sequence", 1, 3), "sub_frac", k=3, seed=3)
    counts = {(r["sub_frac"], r["is_test"]): r["n"] for r in small.groupBy("sub_frac", "is_test").agg(F.count_distinct("sequence").alias("n")).collect()}
    assert counts[0.5, False] == counts[1.0, False] // 2 and counts[0.5, True] == counts[1.0, True]


@pytest.mark.parametrize("kind,task,params", [("rf", "reg", {"max_depth": 60}), ("rf", "bin", {"min_samples_split": 4}), ("linear", "reg", {"lrn_rate": 0.1}),
                                              ("svm", "bin", {"gamma": 1.0})])
def test_parameters_without_a_counterpart_are_refused(kind, task, params):
    with pytest.raises(ValueError):
        build_estimator(kind, task, ["x"], "y", params)
