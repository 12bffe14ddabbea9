import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framecv.functions.scalars import argmax_class, binarize, is_close, logit_class
from framecv.operators.metrics import (class_metrics, confusion, entity_consensus, entity_predictions, entity_spread, importance_summary,
                                       joint_extent, mean_metrics_long, metric_curves, regression_metrics, score_vote, summarize_metrics)
from framecv.operators.quantiles import quantiles, value_distribution
from framecv.operators.score import (best_threshold, nearest_mean, reference_state_score, threshold_sweep)


def brute_mcc(t, p):
    classes = sorted(set(t) | set(p))
    c = np.array([[sum(a == i and b == j for a, b in zip(t, p)) for j in classes] for i in classes], dtype=float)
    n, hits, tk, pk = c.sum(), np.trace(c), c.sum(1), c.sum(0)
    den = math.sqrt((n * n - (pk ** 2).sum()) * (n * n - (tk ** 2).sum()))
    return (hits * n - (tk * pk).sum()) / den if den else 0.0


def brute_f1(t, p, cls):
    tp = sum(a == b == cls for a, b in zip(t, p))
    den = sum(a == cls for a in t) + sum(b == cls for b in p)
    return 2 * tp / den if den else 0.0


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = []
    for g in (None, 0, 1):
        for i in range(60):
            t = rng.gauss(0, 1)
            c = rng.randrange(3)
            rows.append((g, f"e{i % 12}", t, t * 0.7 + rng.gauss(0, 1), c, c if rng.random() < 0.6 else rng.randrange(4)))
    return spark.createDataFrame(rows, "fold int, entity string, true double, predicted double, tc int, pc int").cache()


def test_regression_metrics(scored):
    rows = scored.collect()
    for r in regression_metrics(scored, ["fold"]).collect():
        t = np.array([x["true"] for x in rows if x["fold"] == r["fold"]])
        p = np.array([x["predicted"] for x in rows if x["fold"] == r["fold"]])
        assert r["mse"] == pytest.approx(((t - p) ** 2).mean())
        assert r["r2"] == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        assert r["pear"] == pytest.approx(np.corrcoef(t, p)[0, 1])
        assert r["sign_acc"] == pytest.approx(((t > 0) == (p > 0)).mean())
        assert r["mcc"] == pytest.approx(brute_mcc(list(t > 0), list(p > 0)))
        assert r["accuracy"] == pytest.approx(r["sign_acc"])
        assert r["n"] == 60
    assert regression_metrics(scored, ["fold"]).count() == 3


def test_undefined_regression_metrics(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "true double, predicted double")
    r = regression_metrics(one).first()
    assert (r["mse"], r["r2"], r["pear"], r["mcc"], r["accuracy"]) == (1.0, None, None, None, None)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "true double, predicted double")
    r = regression_metrics(flat, guard=False).first()
    assert (r["r2"], r["pear"], r["mcc"], r["accuracy"]) == (0.0, None, 0.0, 1.0)
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "true double, predicted double")
    assert regression_metrics(same).first()["r2"] == 1.0
    constant = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0)], "true double, predicted double")
    r = regression_metrics(constant).first()
    assert (r["pear"], r["mcc"], r["accuracy"]) == (None, 0.0, 0.5)


def test_class_metrics(scored):
    rows = scored.collect()
    for r in class_metrics(scored, ["fold"], "pc", "tc", positive=0).collect():
        t = [x["tc"] for x in rows if x["fold"] == r["fold"]]
        p = [x["pc"] for x in rows if x["fold"] == r["fold"]]
        assert r["accuracy"] == pytest.approx(np.mean([a == b for a, b in zip(t, p)]))
        assert r["mcc"] == pytest.approx(brute_mcc(t, p))
        assert r["f1"] == pytest.approx(brute_f1(t, p, 0))
        assert r["f1_macro"] == pytest.approx(np.mean([brute_f1(t, p, c) for c in set(t) | set(p)]))


def test_one_class_truth(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "true int, predicted int")
    guarded, plain = class_metrics(df, guard=True).first(), class_metrics(df).first()
    assert (guarded["mcc"], guarded["accuracy"]) == (None, None)
    assert (plain["mcc"], plain["accuracy"]) == (0.0, 0.5)
    assert class_metrics(df, positive=7).first()["f1"] == 0.0


def test_votes(spark):
    df = spark.createDataFrame([("a", v, 1) for v in (0, 0, 2, 2)] + [("b", v, 0) for v in (1, 2, 2)], "entity string, predicted int, true int")
    got = {r["entity"]: (r["avg_predicted"], r["avg_true"]) for r in entity_predictions(df, "entity", "bin").collect()}
    assert got == {"a": (0, 1), "b": (2, 0)}
    scores = spark.createDataFrame([("a", [0.2, 0.3, 0.5]), ("a", [0.3, 0.5, 0.2]), ("b", [0.25, 0.5, 0.25]), ("b", [0.5, 0.25, 0.25])],
                                   "entity string, s array<double>")
    assert {r["entity"]: r["voted"] for r in score_vote(scores, "entity", "s").collect()} == {"a": 1, "b": 0}
    assert scores.select(argmax_class(F.col("s"))).first()[0] == 2


def test_means_and_spread(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0), ("b", 5.0, 1.0)], "entity string, predicted double, true double")
    assert {tuple(r) for r in entity_predictions(df, "entity").collect()} == {("a", 2.0, 3.0), ("b", 5.0, 1.0)}
    got = {r["entity"]: r["p_std"] for r in entity_spread(df, "entity", "predicted", "true").collect()}
    assert got == {"a": pytest.approx(math.sqrt(2)), "b": None}


def test_consensus_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 1, 2), ("b", 2, 3)], "entity string, p int, t int")
    got = {r["entity"]: (r["p"], r["t"]) for r in entity_consensus(df, "entity", "p", "t").collect()}
    assert got == {"a": (0, 2), "b": (2, 2)}


def test_confusion_fills_the_grid(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (0, 5)], "t int, p int")
    got = {(r["true_class"], r["pred_class"]): (r["n"], r["pct"]) for r in confusion(df, [1, 0], "p", "t").collect()}
    assert got == {(1, 1): (1, pytest.approx(100 / 3)), (1, 0): (2, pytest.approx(200 / 3)), (0, 1): (0, None), (0, 0): (0, None)}


def test_summaries_skip_undefined(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", float("nan")), ("m", None), ("m", 3.0), ("k", 2.0)], "model string, x double")
    got = {r["model"]: (r["x_mean"], r["x_std"]) for r in summarize_metrics(df, ["model"], ["x"]).collect()}
    assert got == {"m": (2.0, pytest.approx(math.sqrt(2))), "k": (2.0, None)}
    assert mean_metrics_long(df.where("model = 'm'"), ["x"]).first().asDict() == {"metric": "x", "value": 2.0}


def test_small_reports(spark, scored):
    ext = joint_extent(scored, ["true", "predicted"]).first()
    rows = scored.collect()
    assert ext["low"] == pytest.approx(min(min(r["true"], r["predicted"]) for r in rows) - 0.1)
    assert [r["fold"] for r in metric_curves(scored, "fold").collect()] == [None, 0, 1]
    imp = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 0.7)], "feature string, importance double")
    got = [tuple(r) for r in importance_summary(imp).collect()]
    assert got == [("b", 0.7, 0.0), ("a", pytest.approx(0.3), pytest.approx(0.1))]
    x = spark.createDataFrame([(0.1 + 0.2,), (0.4,)], "x double")
    assert [r[0] for r in x.select(is_close(F.col("x"), 0.3)).collect()] == [True, False]
    assert [r[0] for r in x.select(binarize(F.col("x"), 0.4)).collect()] == [0, 0]
    assert [r[0] for r in x.select(logit_class(F.col("x") - 0.35)).collect()] == [0, 1]


@pytest.mark.parametrize("max_rows", [2_000_000, 10])
def test_quantiles(spark, max_rows):
    rng = random.Random(1)
    data = [("hot" if i % 3 else "cold", float(rng.randrange(80))) for i in range(500)] + [("one", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    for r in value_distribution(df, "g", "v", max_rows).collect():
        v = np.array([x for g, x in data if g == r["g"]])
        assert (r["n"], r["low"], r["high"]) == (len(v), v.min(), v.max())
        assert [r["q25"], r["q50"], r["q75"]] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.75])))
    v = np.sort([x for _, x in data])
    r = quantiles(df, "v", {"p": 0.05, "q": 0.95}, alphap=0.4, betap=0.4, max_rows=max_rows).first()
    for name, prob in (("p", 0.05), ("q", 0.95)):
        at = len(v) * prob + 0.4 + prob * 0.2
        k = math.floor(min(max(at, 1), len(v) - 1))
        g = min(max(at - k, 0), 1)
        assert r[name] == pytest.approx((1 - g) * v[k - 1] + g * v[k])


def brute_sweep(s, t, steps):
    return [(thr, np.mean((s > thr) == (t == 1))) for thr in np.linspace(s.min(), s.max(), steps)]


@pytest.mark.parametrize("seed, steps", [(0, 1000), (1, 7), (2, 2)])
def test_threshold_sweep(spark, seed, steps):
    rng = np.random.default_rng(seed)
    s = np.concatenate([rng.normal(size=300), np.linspace(-1, 1, 41)])
    t = (s + rng.normal(size=s.size) > 0).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, t)], "s double, t int")
    got = threshold_sweep(df, "s", "t", steps).orderBy("step").collect()
    want = brute_sweep(s, t, steps)
    assert [r["threshold"] for r in got] == pytest.approx([w[0] for w in want])
    assert [r["accuracy"] for r in got] == pytest.approx([w[1] for w in want])
    best = best_threshold(threshold_sweep(df, "s", "t", steps)).first()
    assert best["step"] == int(np.argmax([w[1] for w in want]))


def test_sweep_of_equal_scores(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (1.0, 0)], "s double, t int")
    assert [r["accuracy"] for r in threshold_sweep(df, "s", "t", 10).collect()] == pytest.approx([2 / 3] * 10)


def test_sweep_is_strict_at_grid_points(spark):
    df = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "s double, t int")
    best = best_threshold(threshold_sweep(df, "s", "t", 10)).first()
    assert (best["threshold"], best["accuracy"]) == (4.0, 1.0)


def test_nearest_mean_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(3, 1.0, 30.0), (1, -1.0, 10.0), (2, 1.0, 20.0), (4, 9.0, 99.0)], "k int, x double, y double")
    assert nearest_mean(df, "k", "x", F.lit(0.0), "y", 2).first()["nearest_mean"] == 15.0
    few = nearest_mean(df, "k", "x", F.lit(0.0), "y", 50).first()
    assert few["k"] == 4


def test_reference_state_score(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{i % 6}", float(rng.normal()), float(rng.normal() * 5), 4.0) for i in range(120)]
    frames = spark.createDataFrame(rows, "e string, a double, b double, c double")
    y = {"e0": 2.0, "e1": -0.3, "e2": 0.3, "e3": 5.0, "e4": -4.0, "zz": 0.0}
    labels = spark.createDataFrame(list(y.items()) * 2, "e string, y double")
    train = frames.select("e").where("e <> 'e5'")
    got = {r["e"]: r for r in reference_state_score(frames, labels, "e", "y", ["a", "b", "c"], train).collect()}
    kept = [r for r in rows if r[0] != "e5"]
    m = np.array([r[1:] for r in kept])
    sd = m.std(0)
    z = ((m - m.mean(0)) / np.where(sd == 0, 1, sd)).sum(1)
    by = {e: np.array([v for v, r in zip(z, kept) if r[0] == e]) for e in y if e != "zz"}
    assert set(got) == set(by)
    for e, v in by.items():
        # e1 and e2 tie on the absolute label, the first key is the reference
        assert got[e]["y_pred"] == pytest.approx(-(v.mean() - by["e1"].mean()))
        assert got[e]["yerr"] == pytest.approx(v.std())
        assert got[e]["y_true"] == y[e]


def test_confusion_keeps_a_group_without_listed_classes(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 7), ("b", 7, 8), ("b", None, 1)], "g string, t int, p int")
    got = {(r["g"], r["true_class"], r["pred_class"]): r["n"] for r in confusion(df, [0, 1], "p", "t", ["g"]).collect()}
    assert len(got) == 8 and got["a", 1, 1] == 1 and sum(got.values()) == 1


def test_threshold_sweep_leaves_out_unknown_truth(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1), (0.2, None), (0.8, None), (None, 1)], "s double, t int")
    curve = threshold_sweep(df, "s", "t", 5).collect()
    assert max(r["accuracy"] for r in curve) == 1.0
