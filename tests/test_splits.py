from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framecv.functions.hashing import gaussian, hash52, uniform
from framecv.operators.metrics import split_summary
from framecv.session import scratch_path
from framecv.operators.perturb import add_label_noise, flipped_labels, scramble_labels, scrambled_labels
from framecv.operators.split import (_deal_heavy, _fill_bounds, assign_folds, entity_table, experiment_grid, hash_rank, seeded_order, split_entities,
                                     subsample_entities, subsample_sweep, sweep_levels, test_rows as held_out_rows, train_rows)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i % 137 if i % 3 else 999, i, (i % 137) % 3 if i % 3 else 0) for i in range(3000)]
    return spark.createDataFrame(data, "entity int, row int, cls int").cache()


def test_draws(spark):
    r = spark.range(20000).select(uniform(F.col("id"), 1).alias("u"), gaussian(F.col("id"), 1).alias("z")).agg(
        F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z")).first()
    assert 0 < r[0] and r[1] < 1
    assert (r[2], r[3], r[4]) == (pytest.approx(0.5, abs=0.01), pytest.approx(0, abs=0.03), pytest.approx(1, abs=0.03))


@pytest.mark.parametrize("ranges", [1, 4, 1024])
def test_hash_rank_is_a_permutation(rows, ranges):
    ents = entity_table(rows, "entity")
    got = hash_rank(ents, "entity", hash52(F.col("entity"), 1), ranges=ranges).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(len(got))) and {r["n"] for r in got} == {len(got)}
    one = hash_rank(ents, "entity", hash52(F.col("entity"), 1), ranges=1).orderBy("rank").collect()
    assert [r["entity"] for r in got] == [r["entity"] for r in one]


def test_hash_rank_keeps_a_null_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(40)], "entity int, s string")
    got = hash_rank(df, "entity", hash52(F.col("entity")), ["s"]).collect()
    assert len(got) == 40 and {r["n"] for r in got} == {20}


def test_split_counts(rows):
    split = split_entities(rows, "entity", 0.2, 5)
    n = split.count()
    assert split.where("not is_test").count() == int(0.8 * n)
    a, b = train_rows(rows, split, "entity"), held_out_rows(rows, split, "entity")
    assert a.count() + b.count() == rows.count()
    assert not {r[0] for r in a.select("entity").distinct().collect()} & {r[0] for r in b.select("entity").distinct().collect()}


def test_stratified_split_takes_a_seventh_of_each_class(rows):
    split = split_entities(rows, "entity", 0.2, 5, stratify="cls").join(entity_table(rows, "entity", "cls"), "entity")
    for r in split.groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect():
        assert r["t"] == -(-r["n"] // 7)


@pytest.mark.parametrize("stratify", [None, "cls"])
def test_folds_cover_every_entity_once(rows, stratify):
    folds = assign_folds(rows, "entity", 5, 3, 1, stratify)
    n = rows.select("entity").distinct().count()
    seen = Counter((r["entity"], r["repeat"]) for r in folds.collect())
    assert len(seen) == 3 * n and set(seen.values()) == {1}
    assert {r["fold"] for r in folds.collect()} == set(range(5))
    per_repeat = defaultdict(dict)
    for r in folds.collect():
        per_repeat[r["repeat"]][r["entity"]] = r["fold"]
    assert per_repeat[0] != per_repeat[1]


def test_stratified_folds_are_even(rows):
    folds = assign_folds(rows, "entity", 5, 2, 1, "cls").join(entity_table(rows, "entity", "cls"), "entity")
    counts = folds.groupBy("repeat", "fold", "cls").count().groupBy("repeat", "cls").agg(F.max("count") - F.min("count")).collect()
    assert all(r[2] <= 1 for r in counts)


@pytest.mark.parametrize("k", [2, 5])
def test_plain_folds_are_balanced_by_rows(spark, k):
    df = spark.range(20000).select((F.pow(F.col("id") % 211, 2) % 97).cast("int").alias("entity"))
    folds = assign_folds(df, "entity", k, 1, 1)
    sizes = [r["n_rows"] for r in split_summary(df.join(folds, "entity"), "entity", ["fold"]).collect()]
    assert sum(sizes) == 20000 and max(sizes) / (20000 / k) <= 1.05


def test_a_huge_entity_gets_a_fold_of_its_own(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 5 < 2, -1).otherwise(F.col("id") % 400).cast("int").alias("entity"))
    for repeat in (0, 1):
        folds = assign_folds(df, "entity", 5, 2, 1).where(F.col("repeat") == repeat)
        sizes = {r["fold"]: r["n_rows"] for r in split_summary(df.join(folds, "entity"), "entity", ["fold"]).collect()}
        own = folds.where("entity = -1").first()["fold"]
        assert sizes.pop(own) == 12000
        assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) <= 150


def test_fill_bounds():
    assert _fill_bounds([0, 0], 10) == [5.0]
    assert _fill_bounds([100, 0, 10], 30) == [0.0, 20.0]
    assert _fill_bounds([3, 3, 3], 0) == [0.0, 0.0]
    assert _deal_heavy([5, 4, 3, 3], 2, 0) == ([0, 1, 1, 0], [8, 7])
    assert _deal_heavy([5, 4, 3, 3], 2, 1) == ([1, 0, 0, 1], [7, 8])


def test_subsample(rows):
    n = rows.select("entity").distinct().count()
    count = lambda df: df.select("entity").distinct().count()
    assert count(subsample_entities(rows, "entity", 0.5, 3)) == int(0.5 * n)
    assert count(subsample_entities(rows, "entity", 0.001, 3, min_entities=5)) == 5
    assert subsample_entities(rows, "entity", 1.0, 3).count() == rows.count()
    assert sweep_levels([0.5, 1.0, 0.5], True) == [1.0, 0.5]
    sweep = subsample_sweep(rows, "entity", [1.0, 0.5, 0.001], 3, 5)
    for level in (1.0, 0.5, 0.001):
        single = subsample_entities(rows, "entity", level, 3, 5)
        assert sweep.where(F.col("sub_frac") == level).count() == single.count()


def test_seeded_order_is_a_shuffle(rows):
    a = [r["row"] for r in seeded_order(rows, ["row"], 1).collect()]
    assert sorted(a) == list(range(3000)) and a != sorted(a)
    assert a != [r["row"] for r in seeded_order(rows, ["row"], 2).collect()]


def test_grid(spark):
    grid = experiment_grid(spark.range(1), {"scr": [0.0, 0.5], "rep": [0, 1, 2]}).drop("id")
    assert {tuple(r) for r in grid.collect()} == {(s, r) for s in (0.0, 0.5) for r in (0, 1, 2)}


@pytest.mark.parametrize("fraction, minimum, want", [(0.0, 0, 0), (0.001, 0, 0), (0.001, 1, 1), (0.5, 0, 69), (1.0, 0, 138)])
def test_scramble_touches_exactly_the_planned_entities(rows, fraction, minimum, want):
    df = rows.withColumn("y", F.col("entity").cast("double"))
    got = scrambled_labels(df, "entity", "y", fraction, 3, minimum).collect()
    assert sum(r["scrambled"] for r in got) == want
    assert all((r["y"] != r["entity"]) == r["scrambled"] for r in got)
    after = scramble_labels(df, "entity", "y", fraction, 3, minimum)
    assert after.count() == df.count() and after.columns == df.columns
    assert after.groupBy("entity").agg(F.count_distinct("y").alias("d")).where("d > 1").count() == 0


def test_scramble_of_one_entity_changes_nothing(spark):
    df = spark.createDataFrame([("a", 1.0)] * 3, "entity string, y double")
    assert {r["y"] for r in scramble_labels(df, "entity", "y", 1.0, 1).collect()} == {1.0}


def test_gaussian_noise_has_the_planned_spread(rows):
    df = rows.withColumn("y", F.col("entity").cast("double"))
    noisy = add_label_noise(df.withColumn("z", F.col("y")), "entity", "z", 0.3, 1, "reg", ["row"])
    sd = df.agg(F.stddev_pop("y")).first()[0]
    diff = noisy.agg(F.stddev_pop(F.col("z") - F.col("y"))).first()[0]
    assert diff == pytest.approx(0.3 * sd, rel=0.1)
    assert add_label_noise(df, "entity", "y", 0.0, 1) is df


def test_flips(rows):
    binary = rows.withColumn("b", (F.col("entity") % 2).cast("int"))
    got = flipped_labels(binary, "entity", "b", 0.1, 1, "bin").collect()
    assert sum(r["flipped"] for r in got) == int(138 * 0.1)
    assert all((r["b"] != r["entity"] % 2) == r["flipped"] for r in got)
    assert sum(r["flipped"] for r in flipped_labels(binary, "entity", "b", 0.0001, 1, "bin").collect()) == 1
    old = {r["entity"]: r["cls"] for r in entity_table(rows, "entity", "cls").collect()}
    many = flipped_labels(rows, "entity", "cls", 0.5, 1, "mclass").collect()
    assert all((r["cls"] != old[r["entity"]]) == r["flipped"] and r["cls"] in (0, 1, 2) for r in many)
    noisy = add_label_noise(rows, "entity", "cls", 0.5, 1, "mclass")
    assert noisy.count() == rows.count() and noisy.columns == rows.columns


def test_heavy_entities_are_dealt_anew_in_each_repeat(spark):
    rows = spark.createDataFrame([(f"e{i:02d}", j) for i in range(30) for j in range(20 + i)], "entity string, row int")
    folds = assign_folds(rows, "entity", 3, 4, 42).collect()
    by_repeat = [{r["entity"]: r["fold"] for r in folds if r["repeat"] == k} for k in range(4)]
    assert all(len(f) == 30 and set(f.values()) == {0, 1, 2} for f in by_repeat)
    for a in range(4):
        for b in range(a):
            pairs = {(x, y) for x in by_repeat[a] for y in by_repeat[a] if x < y and by_repeat[a][x] == by_repeat[a][y]}
            other = {(x, y) for x in by_repeat[b] for y in by_repeat[b] if x < y and by_repeat[b][x] == by_repeat[b][y]}
            assert pairs != other
    for f in by_repeat:
        loads = [sum(20 + int(e[1:]) for e, g in f.items() if g == k) for k in range(3)]
        assert max(loads) < 1.2 * min(loads)


@pytest.mark.parametrize("k", [2, 3])
def test_heavy_and_light_entities_fill_the_folds_of_every_repeat(spark, k):
    sizes = {"a": 500, "b": 260, **{f"s{i}": 1 for i in range(240)}}
    rows = spark.createDataFrame([(e, j) for e, n in sizes.items() for j in range(n)], "entity string, row int")
    folds = assign_folds(rows, "entity", k, 8, 42).collect()
    for repeat in range(8):
        own = {r["entity"]: r["fold"] for r in folds if r["repeat"] == repeat}
        assert set(own) == set(sizes)
        loads = [sum(n for e, n in sizes.items() if own[e] == f) for f in range(k)]
        assert sorted(loads) == ([500, 500] if k == 2 else [240, 260, 500])


def test_regression_noise_needs_row_ids(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0)], "entity string, row int, y double")
    with pytest.raises(ValueError):
        add_label_noise(rows, "entity", "y", 0.3, 1)
    moved = {r["row"]: r["y"] - (r["row"] + 1) for r in add_label_noise(rows, "entity", "y", 0.3, 1, row_id=["row"]).collect()}
    assert len({round(v, 9) for v in moved.values()}) == 3


def test_label_operators_read_the_frames_once(spark):
    rows = spark.range(2000).selectExpr("concat('e', id % 50) entity", "id row", "cast(id % 3 as double) y")
    rows.write.mode("overwrite").parquet(path := scratch_path(spark, "frames"))
    rows = spark.read.parquet(path)

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count(path.rsplit("/", 1)[-1])
    assert scans(scramble_labels(rows, "entity", "y", 0.5, 1)) <= 2
    assert scans(subsample_entities(rows, "entity", 0.5, 1)) <= 2
    assert scans(split_entities(rows, "entity", 0.2, 1)) <= 1
