import numpy as np
import pytest
from pyspark.sql import functions as F

from framecv.operators.split import assign_folds
from framecv.plans.crossval import fit_folds, importances, save_models, with_folds
from framecv.plans.dependence import feature_grid, individual_curves, linear_curves, linear_dependence, partial_dependence
from framecv.plans.experiment import run_levels, scrambling
from framecv.plans.forests import curves_at, dependence_steps, forest_curves, forest_dependence, forest_of, node_importances, read_nodes
from framecv.plans.linear import fit_whole
from framecv.plans.models import build_estimator

FEATURES = ["x", "z", "w"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, f"e{i % 20}", float(a), float(b), float(c), float(np.sin(a) + 0.3 * b * (c > 0) + 0.1 * d), int(a + b > 0))
            for i, (a, b, c, d) in enumerate(rng.normal(size=(300, 4)))]
    return spark.createDataFrame(data, "id int, entity string, x double, z double, w double, y double, b int").cache()


@pytest.mark.parametrize("task, label", [("reg", "y"), ("bin", "b")])
def test_importances_from_the_node_tables(spark, rows, task, label, tmp_path):
    folded = with_folds(rows, assign_folds(rows, "entity", 2, 2, 1), "entity").cache()
    models = fit_folds(folded, build_estimator("rf", task, FEATURES, label, {"n_estimators": 4, "max_depth": 4}))
    save_models(models, str(tmp_path / "m"))
    got = {(r["repeat"], r["fold"], r["feature"]): r["importance"] for r in node_importances(read_nodes(spark, str(tmp_path / "m"), task), FEATURES).collect()}
    want = {(r["repeat"], r["fold"], r["feature"]): r["importance"] for r in importances(spark, models, FEATURES).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_importances_without_a_split(spark, rows, tmp_path):
    model = build_estimator("rf", "reg", FEATURES, "flat", {"n_estimators": 2}).fit(rows.withColumn("flat", F.lit(1.0)))
    save_models({(0, 0): model}, str(tmp_path / "m"))
    assert {r["importance"] for r in node_importances(read_nodes(spark, str(tmp_path / "m")), FEATURES).collect()} == {0.0}


@pytest.mark.parametrize("feature", ["x", "w"])
def test_forest_dependence_equals_prediction_at_every_point(spark, rows, feature):
    model = build_estimator("rf", "reg", FEATURES, "y", {"n_estimators": 6, "max_depth": 5}).fit(rows)
    trees = forest_of(model, spark)
    want = {r["grid"]: (r["average"], r["n"]) for r in partial_dependence(model, rows, feature, points=12).collect()}
    got = {r["grid"]: (r["average"], r["n"]) for r in forest_dependence(trees, rows, FEATURES, feature, feature_grid(rows, feature, 12)).collect()}
    assert len(got) == 12 and {g: n for g, (_, n) in got.items()} == {g: n for g, (_, n) in want.items()}
    assert all(got[g][0] == pytest.approx(v, abs=1e-9) for g, (v, _) in want.items())
    # the split points themselves: at a threshold a row still goes left
    cuts = sorted(r["threshold"] for r in dependence_steps(trees, rows, FEATURES, feature).collect())
    assert cuts[0] == -np.inf and len(cuts) == len(set(cuts)) > 3
    grid = spark.createDataFrame([(c,) for c in cuts[1:]], "grid double")
    at = {r["grid"]: r["average"] for r in forest_dependence(trees, rows, FEATURES, feature, grid).collect()}
    for c in cuts[1:4]:
        there = model.transform(rows.withColumn(feature, F.lit(c))).agg(F.avg("prediction")).first()[0]
        assert at[c] == pytest.approx(there, abs=1e-9)


def test_forest_curves_equal_prediction_row_by_row(spark, rows):
    model = build_estimator("rf", "reg", FEATURES, "y", {"n_estimators": 5, "max_depth": 4}).fit(rows)
    curves = forest_curves(forest_of(model, spark), rows, FEATURES, "z", ["id"])
    want = {(r["id"], r["grid"]): r["predicted"] for r in individual_curves(model, rows, "z", ["id"], points=7).collect()}
    grid = sorted({g for _, g in want})
    got = {(r["id"], r["grid"]): r["predicted"] for r in curves_at(curves, grid, ["id"]).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert forest_curves(forest_of(model, spark), rows.limit(0), FEATURES, "z", ["id"]).count() == 0


def test_dependence_on_a_class(spark, rows):
    """The share of a class, averaged over the trees."""
    model = build_estimator("rf", "bin", FEATURES, "b", {"n_estimators": 4, "max_depth": 3}).fit(rows)
    trees = forest_of(model, spark, "bin", 1)
    grid = spark.createDataFrame([(-0.5,), (0.7,)], "grid double")
    got = {r["grid"]: r["average"] for r in forest_dependence(trees, rows, FEATURES, "x", grid).collect()}
    for g in got:
        scored = model.transform(rows.withColumn("x", F.lit(g))).select("probability").collect()
        assert got[g] == pytest.approx(np.mean([r["probability"][1] for r in scored]), abs=1e-9)


def test_linear_dependence_and_curves(rows):
    model = build_estimator("linear", "reg", FEATURES, "y").fit(rows)
    own = fit_whole(rows, FEATURES, "y")
    want = {r["grid"]: r["average"] for r in partial_dependence(model, rows, "x", points=9).collect()}
    got = {r["grid"]: r["average"] for r in linear_dependence(rows, own, FEATURES, "x", feature_grid(rows, "x", 9)).collect()}
    assert got == {g: pytest.approx(v, abs=1e-9) for g, v in want.items()}
    lines = {r["id"]: (r["base"], r["slope"]) for r in linear_curves(rows, own, FEATURES, "x", ["id"]).collect()}
    for r in individual_curves(model, rows, "x", ["id"], points=3).collect():
        base, slope = lines[r["id"]]
        assert base + slope * r["grid"] == pytest.approx(r["predicted"], abs=1e-9)
    assert fit_whole(rows.limit(0), FEATURES, "y").count() == 0


def test_a_study_stores_its_models(spark, rows, tmp_path):
    blocks = rows.withColumn("block", F.col("id")).drop("id", "b").cache()
    store = str(tmp_path / "models")
    out = run_levels(blocks, "entity", "y", "reg", build_estimator("rf", "reg", FEATURES, "y", {"n_estimators": 2, "max_depth": 2}), [0.0, 1.0],
                     scrambling("entity", "y", 1), k=2, features=FEATURES, model_path=store)
    assert {(r["scr_frac"], r["is_test"], r["fold"]) for r in out.select("scr_frac", "is_test", "fold").distinct().collect()} == {
        (s, t, f) for s in (0.0, 1.0) for t in (True, False) for f in (0, 1)}
    assert read_nodes(spark, f"{store}/scr_frac=1.0").select("fold").distinct().count() == 2
