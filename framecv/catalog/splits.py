"""Entity splits, folds, subsamples and the experiment grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecv.catalog.base import KEY, ORDER, SEED, count_of, frames, h, labelled, predictions, query, rounded, sql, table
from framecv.functions.hashing import hash52
from framecv.operators.metrics import split_summary
from framecv.operators.split import (assign_folds, experiment_grid, hash_rank, entity_table, seeded_order, split_entities, stored_order, subsample_entities,
                                     subsample_sweep, sweep_levels, test_rows, train_rows)

ENTITIES = {"entities": "SELECT entity, count(*) AS n_rows, min(y) AS y, min(y_bin) AS y_bin, min(y_cls) AS y_cls FROM labelled GROUP BY entity"}


def ranked(purpose: str, seed: int = SEED, name: str = "ranked", source: str = "entities") -> dict[str, str]:
    return {name: f"""SELECT *, row_number() OVER (ORDER BY {h('entity', seed, f"'{purpose}'")}, entity) - 1 AS rank,
        count(*) OVER () AS n FROM {source}"""}


@query(sql("SELECT entity, n_rows, rank, n FROM ranked", "labelled", ENTITIES | ranked("order")))
def seeded_entity_order(spark, sf_dir):
    """Seeded shuffle of the entities as an exact global rank."""
    return hash_rank(entity_table(frames(spark, sf_dir), KEY), KEY, hash52(F.col(KEY), SEED, "order"))


@query(sql(f"""SELECT {', '.join(ORDER)}, row_number() OVER (ORDER BY {h(*ORDER, SEED, "'order'")}, {', '.join(ORDER)}) - 1 AS position FROM frames""", "frames"))
def seeded_row_order(spark, sf_dir):
    """Seeded shuffle of all rows, stored in that order and numbered by their place in the files."""
    return stored_order(seeded_order(frames(spark, sf_dir).select(*ORDER), ORDER, SEED))


_SPLIT = ENTITIES | ranked("split") | {"split": f"SELECT entity, rank >= {count_of('n', 0.8)} AS is_test FROM ranked"}


@query(sql("SELECT entity, is_test FROM split", "labelled", _SPLIT))
def entity_split(spark, sf_dir):
    return split_entities(frames(spark, sf_dir), KEY, 0.2, SEED)


@query(sql(f"""SELECT entity, (row_number() OVER (PARTITION BY y_cls ORDER BY {h('entity', SEED, "'split'")}, entity) - 1) % 7 = 0 AS is_test
    FROM entities""", "labelled", ENTITIES))
def stratified_entity_split(spark, sf_dir):
    return split_entities(labelled(spark, sf_dir), KEY, 0.2, SEED, stratify="y_cls")


@query(sql("""SELECT is_test, count(*) AS n_rows, count(DISTINCT entity) AS n_entities, sum(quantity) AS quantity
    FROM frames JOIN split USING (entity) GROUP BY is_test""", "labelled", _SPLIT, "quantity"))
def train_and_test_rows(spark, sf_dir):
    """Membership by entity: training rows and their complement."""
    rows = frames(spark, sf_dir)
    split = split_entities(rows, KEY, 0.2, SEED)
    sides = [side(rows, split, KEY).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("q")).withColumn("is_test", F.lit(test))
             for side, test in ((train_rows, False), (test_rows, True))]
    both = sides[0].unionByName(sides[1]).groupBy("is_test")
    return rounded(both.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_entities"), F.sum("q").alias("quantity")))


def _repeats(n):
    return {"repeated": f"SELECT e.*, r.repeat FROM entities e CROSS JOIN (SELECT unnest(range({n}))::INTEGER AS repeat) r"}


_STRATIFIED = {"folds": f"""SELECT entity, repeat, CAST((row_number() OVER (PARTITION BY repeat ORDER BY y_cls,
    {h('entity', f'({SEED} + 100 * repeat)', "'fold'")}, entity) - 1) % 5 AS INTEGER) AS fold FROM repeated"""}


def balanced(k: int) -> dict[str, str]:
    """Rows laid end to end in seeded order; no entity of these tables is large enough to be dealt alone."""
    return {"laid": f"""SELECT *, coalesce(sum(n_rows) OVER (PARTITION BY repeat ORDER BY {h('entity', f'({SEED} + 100 * repeat)', "'fold'")}, entity
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_rows) OVER (PARTITION BY repeat) AS total FROM repeated""",
            "folds": "SELECT entity, repeat, n_rows, CAST(" + " + ".join(
                f"(before * {k} >= total * {f})::INTEGER" for f in range(1, k)) + " AS INTEGER) AS fold FROM laid"}


@query(sql("SELECT entity, repeat, fold FROM folds", "labelled", ENTITIES | _repeats(3) | _STRATIFIED))
def stratified_group_folds(spark, sf_dir):
    return assign_folds(labelled(spark, sf_dir), KEY, 5, 3, SEED, stratify="y_cls")


@query(sql("SELECT entity, repeat, fold FROM folds", "labelled", ENTITIES | _repeats(3) | balanced(5)))
def balanced_group_folds(spark, sf_dir):
    """Repeated group folds of equal row counts, shuffled anew in each repeat."""
    return assign_folds(frames(spark, sf_dir), KEY, 5, 3, SEED)


@query(sql("SELECT repeat, fold, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM frames JOIN folds USING (entity) GROUP BY repeat, fold",
           "labelled", ENTITIES | _repeats(3) | balanced(5)))
def fold_sizes(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return split_summary(rows.join(assign_folds(rows, KEY, 5, 3, SEED), KEY), KEY, ["repeat", "fold"])


@query(sql(f"SELECT entity, {', '.join(ORDER)} FROM frames JOIN ranked USING (entity) WHERE rank < greatest({count_of('n', 0.35)}, 5)",
           "labelled", ENTITIES | ranked("subsample", 7)))
def subsampled_entities(spark, sf_dir):
    return subsample_entities(frames(spark, sf_dir), KEY, 0.35, 7, 5).select("entity", *ORDER)


_LEVELS = [0.5, 1.0, 0.75, 0.5, 0.001]
_SWEEP = {"levels": "SELECT unnest([1.0, 0.75, 0.5, 0.001])::DOUBLE AS sub_frac"}


@query(sql("""SELECT sub_frac, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM frames JOIN ranked USING (entity)
    JOIN levels ON sub_frac >= 1 OR rank < greatest(CAST(trunc(n::DOUBLE * sub_frac) AS BIGINT), 5) GROUP BY sub_frac""",
           "labelled", ENTITIES | ranked("subsample", 7) | _SWEEP))
def subsample_levels(spark, sf_dir):
    """All subsample fractions, each once, with at least five entities kept."""
    return split_summary(subsample_sweep(frames(spark, sf_dir), KEY, sweep_levels(_LEVELS, True), 7, 5), KEY, ["sub_frac"])


_GRID = {"cells": "SELECT scr_frac, noise_level, rep, fold, count(*) AS n FROM preds WHERE NOT is_test GROUP BY ALL",
         "grid": """SELECT * FROM (SELECT DISTINCT scr_frac FROM preds) CROSS JOIN (SELECT DISTINCT noise_level FROM preds)
            CROSS JOIN (SELECT unnest([0, 1])::INTEGER AS rep) CROSS JOIN (SELECT unnest([0, 1, 2, 3])::INTEGER AS fold)"""}


def _grid(rows):
    levels = rows.agg(F.array_sort(F.collect_set("scr_frac")).alias("_scr"), F.array_sort(F.collect_set("noise_level")).alias("_noise"))
    return experiment_grid(levels, {"scr_frac": F.col("_scr"), "noise_level": F.col("_noise"), "rep": [0, 1], "fold": [0, 1, 2, 3]}
                           ).drop("_scr", "_noise")


@query(sql("SELECT grid.*, coalesce(n, 0) AS n FROM grid LEFT JOIN cells USING (scr_frac, noise_level, rep, fold)", "preds", _GRID))
def experiment_grid_counts(spark, sf_dir):
    """Every combination of the sweep levels found in the data, with its rows; the fourth fold is empty."""
    rows = predictions(spark, sf_dir)
    keys = ["scr_frac", "noise_level", "rep", "fold"]
    cells = rows.where(~F.col("is_test")).groupBy(*keys).agg(F.count("*").alias("n"))
    return _grid(rows).join(cells, keys, "left").na.fill(0, ["n"])


@query(sql("SELECT grid.* FROM grid JOIN cells USING (scr_frac, noise_level, rep, fold)", "preds", _GRID))
def present_combinations(spark, sf_dir):
    """Combinations without rows are skipped."""
    rows = predictions(spark, sf_dir)
    keys = ["scr_frac", "noise_level", "rep", "fold"]
    return _grid(rows).join(rows.where(~F.col("is_test")).select(*keys).distinct(), keys, "inner")


@query("""SELECT repeat, count(DISTINCT l_discount) AS n_entities, count(*) AS n_rows, 4::BIGINT AS n_folds, true AS even
    FROM lineitem CROSS JOIN (SELECT unnest(range(3))::INTEGER AS repeat) GROUP BY repeat""")
def heavy_group_folds(spark, sf_dir):
    """Folds of a few large entities: all entities and rows in each repeat, all folds used, none twice the size of another."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("entity"))
    sizes = split_summary(rows.join(assign_folds(rows, "entity", 4, 3, SEED), "entity"), "entity", ["repeat", "fold"])
    return sizes.groupBy("repeat").agg(
        F.sum("n_entities").alias("n_entities"), F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_folds"),
        (F.max("n_rows") < 2 * F.min("n_rows")).alias("even"))


@query("""WITH keyed AS (SELECT CASE WHEN l_linenumber % 4 = 0 THEN l_returnflag ELSE l_partkey::VARCHAR END AS entity FROM lineitem)
    SELECT repeat, count(DISTINCT entity) AS n_entities, count(*) AS n_rows, 3::BIGINT AS n_folds, true AS even
    FROM keyed CROSS JOIN (SELECT unnest(range(8))::INTEGER AS repeat) GROUP BY repeat""")
def heavy_and_light_group_folds(spark, sf_dir):
    """Folds of a few large entities and a tail of small ones: in each repeat no fold has over 1/20 more rows than its share."""
    entity = F.when(F.col("l_linenumber") % 4 == 0, F.col("l_returnflag")).otherwise(F.col("l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(entity.alias("entity"))
    sizes = split_summary(rows.join(assign_folds(rows, "entity", 3, 8, SEED), "entity"), "entity", ["repeat", "fold"])
    return sizes.groupBy("repeat").agg(
        F.sum("n_entities").alias("n_entities"), F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_folds"),
        (F.max("n_rows") * 60 <= F.sum("n_rows") * 21).alias("even"))
