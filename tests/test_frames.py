import hashlib
from collections import defaultdict
from statistics import mean

import pytest
from pyspark.sql import functions as F

from framecv.functions.scalars import keep_existing, numeric_features, ordered_columns
from framecv.operators.frames import block_average, frame_positions, join_labels, tail_blocks, tail_percent
from framecv.operators.position import order_slices, ordered_position, split_hot, with_position
from framecv.operators.stats import fit_stats, fold_train_stats, standardize, standardize_by_fold, stats_long, stats_wide
from framecv.plans.prepare import prepare_experiment, standardize_by_setting, tail_blocks_by_setting

ORDER = ["run", "frame"]
LIMITS = [2_000_000, 20, 3]


def groups(df):
    out = defaultdict(list)
    for r in df.collect():
        if r["entity"] is not None:
            out[r["entity"]].append(r)
    return {k: sorted(v, key=lambda r: (r["run"], r["frame"])) for k, v in out.items()}


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def brute_tail(rows, pct):
    keep = max(1, int(len(rows) * (pct / 100)))
    return rows[-keep:]


def brute_blocks(rows, n, seed):
    mixed = sorted(rows, key=lambda r: (draw(r["run"], r["frame"], seed, "block"), r["run"], r["frame"]))
    return [mixed[i * n:(i + 1) * n] for i in range(len(mixed) // n)]


@pytest.mark.parametrize("max_rows", LIMITS)
@pytest.mark.parametrize("pct", [10, 37.5, 99])
def test_tail_matches_brute_force(skewed, max_rows, pct):
    want = {k: [(r["run"], r["frame"]) for r in brute_tail(v, pct)] for k, v in groups(skewed).items()}
    got = {k: [(r["run"], r["frame"]) for r in v] for k, v in groups(tail_percent(skewed, "entity", ORDER, pct, max_rows)).items()}
    assert got == want
    assert len(got["single"]) == 1


@pytest.mark.parametrize("pct", [0, -5, 100, 250])
def test_tail_without_effect(skewed, pct):
    assert tail_percent(skewed, "entity", ORDER, pct).count() == skewed.where("entity is not null").count()


@pytest.mark.parametrize("max_rows", LIMITS)
def test_positions_match_brute_force(skewed, max_rows):
    want = {(k, r["run"], r["frame"]): (i, len(v)) for k, v in groups(skewed).items() for i, r in enumerate(v)}
    rows = frame_positions(skewed, "entity", ORDER, max_rows).collect()
    assert {(r["entity"], r["run"], r["frame"]): (r["position"], r["group_size"]) for r in rows} == want


def test_slices_do_not_grow_with_small_windows(spark):
    rows = spark.range(20_000).select(F.lit("s").alias("entity"), (F.col("id") * 7919 % 20_000).alias("at"), "id")
    _, warm, _ = split_hot(rows, ["entity"], 3)
    sliced = order_slices(warm, ["entity"], ["at"], 3)
    assert 1 < sliced.select("_slice").distinct().count() <= spark.sparkContext.defaultParallelism
    placed = ordered_position(sliced, ["entity"])
    assert placed.where((F.col("_pos") != F.col("at")) | (F.col("_n") != 20_000)).isEmpty() and placed.count() == 20_000


@pytest.mark.parametrize("max_rows", LIMITS)
def test_weighted_positions(spark, max_rows):
    df = spark.createDataFrame([("a", i, 1 + i % 3) for i in range(50)], "k string, v int, w int")
    rows = {r["v"]: r for r in with_position(df, ["k"], ["v"], "w", max_rows).collect()}
    total = 0
    for i in range(50):
        assert rows[i]["_pos"] == total
        total += 1 + i % 3
    assert rows[0]["_n"] == total


@pytest.mark.parametrize("max_rows", LIMITS)
@pytest.mark.parametrize("n", [1, 4, 10])
def test_blocks_match_brute_force(skewed, max_rows, n):
    want = {(k, i): (len(b), mean(r["a"] for r in b)) for k, v in groups(skewed).items() for i, b in enumerate(brute_blocks(v, n, 7))}
    rows = block_average(skewed, "entity", ORDER, n, 7, "y", ["a", "flat"], max_rows).collect()
    got = {(r["entity"], r["block"]): r for r in rows}
    assert set(got) == set(want)
    for k, (_, a) in want.items():
        assert got[k]["a"] == pytest.approx(a)
        assert got[k]["flat"] == 2.0
    if n > 1:
        assert not any(k[0] == "single" for k in got)


@pytest.mark.parametrize("max_rows", LIMITS)
def test_tail_blocks_match_the_two_steps(skewed, spark, max_rows):
    labels = spark.createDataFrame([("big", 1.5), ("e07", -1.0), ("absent", 0.0)], "entity string, z double")
    both = tail_blocks(skewed, "entity", ORDER, 60, 4, 3, "z", ["a"], labels, max_rows)
    steps = block_average(tail_percent(join_labels(skewed, labels, "entity"), "entity", ORDER, 60), "entity", ORDER, 4, 3, "z", ["a"])
    key = lambda r: (r["entity"], r["block"])
    got, want = sorted(both.collect(), key=key), sorted(steps.collect(), key=key)
    assert [(*key(r), r["z"]) for r in got] == [(*key(r), r["z"]) for r in want]
    assert [r["a"] for r in got] == pytest.approx([r["a"] for r in want])
    assert {r["entity"] for r in got} == {"big", "e07"}


@pytest.mark.parametrize("pct, n, blocks", [(90, 280, 5), (55, 320, 2), (40, 280, 2)])
def test_block_counts_of_a_full_entity(spark, pct, n, blocks):
    df = spark.range(1620).select(F.lit("s").alias("entity"), (F.col("id") % 20).cast("int").alias("run"),
                                  F.col("id").cast("int").alias("frame"), F.rand(1).alias("a"))
    assert tail_blocks(df, "entity", ORDER, pct, n, 1, None, ["a"]).count() == blocks


def test_block_size_is_checked(skewed):
    with pytest.raises(ValueError):
        block_average(skewed, "entity", ORDER, 0, 1)


@pytest.mark.parametrize("max_rows", LIMITS)
def test_many_settings_match_single_ones(spark, skewed, max_rows):
    settings = [("60_4", 60.0, 4), ("100_7", 100.0, 7), ("10_50", 10.0, 50)]
    table = spark.createDataFrame(settings, "setting string, keep double, navg bigint")
    rows = tail_blocks_by_setting(skewed, table, "entity", ORDER, 5, "y", ["a"], max_rows).collect()
    for name, keep, n in settings:
        single = {(r["entity"], r["block"]): r["a"] for r in tail_blocks(skewed, "entity", ORDER, keep, n, 5, "y", ["a"]).collect()}
        got = {(r["entity"], r["block"]): r["a"] for r in rows if r["setting"] == name}
        assert set(got) == set(single)
        assert all(got[k] == pytest.approx(v) for k, v in single.items())


def test_standardize_centres_flat_columns(spark, skewed):
    known = skewed.where("entity is not null")
    rows = standardize(known, fit_stats(known, ["a", "flat"]), ["a", "flat"]).agg(
        F.avg("a").alias("m"), F.stddev_samp("a").alias("s"), F.max("flat").alias("f")).first()
    assert (rows["m"], rows["s"], rows["f"]) == (pytest.approx(0, abs=1e-12), pytest.approx(1), 0.0)
    one = known.limit(1)
    assert standardize(one, fit_stats(one, ["a"]), ["a"]).first()["a"] == 0.0


def test_statistics_round_trip(skewed):
    names = ["a", "flat"]
    stats = fit_stats(skewed, names)
    assert stats_wide(stats_long(stats, names), names).first().asDict() == pytest.approx(stats.first().asDict())


@pytest.mark.parametrize("by", [[], ["grp"]])
def test_fold_statistics(skewed, by):
    rows = skewed.withColumn("fold", F.col("frame") % 4).withColumn("grp", F.col("run") % 2).withColumn("a", F.col("a") + 1e6)
    got = fold_train_stats(rows, ["a"], by)
    for r in got.collect():
        train = rows.where(F.col("fold") != r["fold"])
        if by:
            train = train.where(F.col("grp") == r["grp"])
        want = train.agg(F.avg("a").alias("m"), F.stddev_samp("a").alias("s")).first()
        assert (r["mean_a"], r["std_a"]) == (pytest.approx(want["m"], rel=1e-12), pytest.approx(want["s"], rel=1e-9))
    assert standardize_by_fold(rows, got, ["a"], by).count() == rows.count()


def test_setting_statistics(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(5)] + [("t", 3.0)], "setting string, a double")
    rows = standardize_by_setting(df, ["a"])
    assert rows.where("setting = 't'").first()["a"] == 0.0
    assert rows.where("setting = 's'").agg(F.stddev_samp("a")).first()[0] == pytest.approx(1.0)


def test_columns(skewed):
    assert numeric_features(skewed.drop("run"), ["entity", "y"]) == ["frame", "a", "flat"]
    assert keep_existing(skewed, ["flat", "none", "a"]) == ["flat", "a"]
    assert ordered_columns(skewed, "run").columns == ["run", "a", "entity", "flat", "frame", "y"]


def test_prepare_experiment_keeps_sides_apart(spark, skewed):
    labels = skewed.where("entity is not null").groupBy("entity").agg(F.crc32(F.col("entity").cast("binary")).cast("double").alias("t"))
    out = prepare_experiment(skewed.drop("y"), labels, "entity", "t", ORDER, ["a", "flat"], 80, 3, 1, test_fraction=0.25, scramble=0.5)
    train = {r["entity"] for r in out.train.select("entity").distinct().collect()}
    test = {r["entity"] for r in out.test.select("entity").distinct().collect()}
    assert train and test and not train & test
    true = {r["entity"]: r["t"] for r in labels.collect()}
    assert all(r["t"] == true[r["entity"]] for r in out.test.collect())
    assert any(r["t"] != true[r["entity"]] for r in out.train.collect())
    assert out.train.agg(F.avg("a")).first()[0] == pytest.approx(0.0, abs=1e-12)
