"""Entity-level ranks, train/test splits and repeated group folds.

All of them rank entities by a seeded hash. The hash is uniform, so equal ranges of it
hold equal shares of the entities: a rank is the number of entities in lower ranges plus
the rank inside the range. No task ever sees more than one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framecv.functions.hashing import HASH_SPAN, hash52
from framecv.functions.scalars import truncated_count
from framecv.session import materialize

# Entities that one window of a rank is meant to hold.
RANGE_ENTITIES = 50_000


def entity_table(df: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """One row per entity: row count and, if asked, its label."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if label is not None:
        aggs.append(F.min(label).alias(label))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def _match(df: DataFrame, nullable: Sequence[str], always: Sequence[str] = ()) -> Column:
    """Join condition on columns of which some may be NULL; plain equality keeps the partitioning of a window."""
    cond = F.lit(True)
    for c in [*nullable, *always]:
        safe = c in nullable and df.schema[c].nullable
        cond = cond & (F.col(c).eqNullSafe(F.col(f"_k_{c}")) if safe else F.col(c) == F.col(f"_k_{c}"))
    return cond


def hash_rank(entities: DataFrame, key: str, draw: Column, by: Sequence[str] = (), ranges: int | None = None,
              weight: str | None = None) -> DataFrame:
    """Adds ``rank`` (zero-based, by ``draw`` then key) and ``n``, inside each ``by`` group.

    With a weight they are the weight of the earlier entities and that of all. The entities are written
    once, as the rank reads them twice; the number of ranges follows from their count.
    """
    entities = materialize(entities)
    ranges = ranges or 8 + entities.count() // RANGE_ENTITIES
    width = HASH_SPAN // ranges
    unit = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    drawn = entities.withColumn("_draw", draw).withColumn("_range", F.expr(f"_draw div {width}"))
    counts = drawn.groupBy(*by, "_range").agg(F.sum(unit).alias("_size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = (Window.unboundedPreceding, -1)
    lower = F.sum("_size").over(group.orderBy("_range").rowsBetween(*earlier))
    offsets = counts.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_range"]],
                            F.coalesce(lower, F.lit(0)).alias("_before"), F.sum("_size").over(group).alias("_n"))
    inside = F.sum(unit).over(Window.partitionBy(*by, "_range").orderBy("_draw", key).rowsBetween(*earlier))
    placed = drawn.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    joined = placed.join(offsets, _match(placed, by, ["_range"]), "inner")
    return joined.select(*entities.columns, (F.col("_inside") + F.col("_before")).cast("bigint").alias("rank"),
                         F.col("_n").cast("bigint").alias("n"))


def stratum_rank(entities: DataFrame, key: str, draw: Column, stratum: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank by (stratum, draw) inside each ``by`` group: strata in order, seeded shuffle inside a stratum."""
    entities = materialize(entities)
    sizes = entities.groupBy(*by, stratum).agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    lower = F.sum("_size").over(group.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, stratum]],
                          F.coalesce(lower, F.lit(0)).alias("_start"))
    ranked = hash_rank(entities, key, draw, [*by, stratum])
    joined = ranked.join(starts, _match(ranked, [*by, stratum]), "inner")
    return joined.select(*entities.columns, (F.col("rank") + F.col("_start")).cast("bigint").alias("rank"),
                         F.col("rank").alias("stratum_rank"), F.col("n").alias("stratum_n"))


def seeded_order(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Seeded full shuffle of the rows (a range-partitioned sort by the hash of the keys)."""
    draw = hash52(*[F.col(k) for k in keys], seed, "order")
    return df.orderBy(draw, *keys)


def stored_order(df: DataFrame) -> DataFrame:
    """Writes rows in the order they have and reads them back with ``position`` (from 0): their place in their file, after the rows of the files before it.

    An order that has to outlive a job needs such a number; a table read again promises none. One count per file is added up.
    """
    stored = materialize(df)
    named = stored.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = named.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return named.join(starts, "_file").select(*df.columns, (F.col("_before") + F.col("_row")).alias("position"))


def split_entities(df: DataFrame, key: str, test_fraction: float, seed: int, stratify: str | None = None,
                   strata_folds: int = 7) -> DataFrame:
    """One row per entity with ``is_test``.

    Plain: exactly ``int((1 - test_fraction) * n)`` entities train. Stratified: one entity in
    ``strata_folds`` of every class is test and ``test_fraction`` is not used.
    """
    draw = hash52(F.col(key), seed, "split")
    if stratify is None:
        ranked = hash_rank(entity_table(df, key), key, draw)
        return ranked.select(key, (F.col("rank") >= truncated_count(F.col("n"), 1.0 - test_fraction)).alias("is_test"))
    ranked = hash_rank(entity_table(df, key, stratify), key, draw, [stratify])
    return ranked.select(key, (F.col("rank") % strata_folds == 0).alias("is_test"))


def train_rows(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    return df.join(split.where(~F.col("is_test")).select(key), key, "left_semi")


def test_rows(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Complement of the training entities."""
    return df.join(split.where(~F.col("is_test")).select(key), key, "left_anti")


def _deal_heavy(sizes: Sequence[int], k: int, first: int) -> tuple[list[int], list[int]]:
    """Each size in the given order to the fold with the fewest rows so far (on ties the next one from ``first`` on);
    folds and final loads."""
    loads, folds = [0] * k, []
    for size in sizes:
        fold = min(range(k), key=lambda f: (loads[f], (f - first) % k))
        loads[fold] += size
        folds.append(fold)
    return folds, loads


def _fill_bounds(loads: Sequence[int], rest: int) -> list[float]:
    """Where the remaining rows, laid end to end, change fold so that all folds fill to one level."""
    low = sorted(loads)
    level = min((rest + sum(low[:m])) / m for m in range(1, len(low) + 1))
    room = [max(0.0, level - load) for load in loads]
    return [sum(room[:i + 1]) for i in range(len(room) - 1)]


def _balanced_folds(df: DataFrame, key: str, k: int, repeats: int, seed: int) -> DataFrame:
    """Entities with more than 1/20 of a fold (fewer than 20 k of them) are dealt one by one: larger powers of two first,
    sizes within one power in an order drawn for the repeat, so that repeats differ. All others are laid end to end in
    seeded order and cut where the folds are full."""
    entities = materialize(entity_table(df, key))
    total = entities.agg(F.sum("n_rows")).first()[0] or 0
    limit = total / (20 * k)
    repeated = entities.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draw = hash52(F.col(key), F.lit(seed) + F.lit(100) * F.col("repeat"), "fold")
    heavy = repeated.where(F.col("n_rows") > limit).withColumn("_draw", draw).collect()
    dealt, bounds = [], []
    for repeat in range(repeats):
        own = sorted((r for r in heavy if r["repeat"] == repeat), key=lambda r: (-r["n_rows"].bit_length(), r["_draw"]))
        folds, loads = _deal_heavy([r["n_rows"] for r in own], k, (own[0]["_draw"] if own else 0) % k)
        dealt += [(r[key], repeat, fold) for r, fold in zip(own, folds)]
        bounds.append(_fill_bounds(loads, total - sum(loads)))
    light = hash_rank(repeated.where(F.col("n_rows") <= limit), key, draw, ["repeat"], weight="n_rows")
    fold = F.lit(0)
    for ends in zip(*bounds):  # the end of one fold in each repeat
        end = F.get(F.array(*[F.lit(e) for e in ends]), F.col("repeat"))
        fold = fold + (F.col("rank") >= end).cast("int")
    out = light.select(key, "repeat", fold.alias("fold"))
    if not dealt:
        return out
    schema = T.StructType([entities.schema[key], T.StructField("repeat", T.IntegerType()), T.StructField("fold", T.IntegerType())])
    return out.unionByName(df.sparkSession.createDataFrame(dealt, schema))


def assign_folds(df: DataFrame, key: str, k: int, repeats: int, seed: int, stratify: str | None = None) -> DataFrame:
    """``(key, repeat, fold)``: every entity in exactly one fold of every repeat.

    Stratified: entities are dealt class by class, so class and entity counts of the folds differ by
    one at the most. Otherwise folds hold equal numbers of rows, to 1/20, unless one entity alone is larger.
    """
    if stratify is None:
        return _balanced_folds(df, key, k, repeats, seed)
    entities = entity_table(df, key, stratify).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draw = hash52(F.col(key), F.lit(seed) + F.lit(100) * F.col("repeat"), "fold")
    ranked = stratum_rank(entities, key, draw, stratify, ["repeat"])
    return ranked.select(key, "repeat", (F.col("rank") % k).cast("int").alias("fold"))


def subsample_entities(df: DataFrame, key: str, fraction: float, seed: int, min_entities: int = 1) -> DataFrame:
    """Rows of ``max(int(n * fraction), min_entities)`` entities; a fraction of 1 keeps all."""
    if fraction >= 1.0:
        return df
    ranked = hash_rank(entity_table(df, key), key, hash52(F.col(key), seed, "subsample"))
    keep = F.greatest(truncated_count(F.col("n"), fraction), F.lit(min_entities).cast("bigint"))
    return df.join(ranked.where(F.col("rank") < keep).select(key), key, "left_semi")


def sweep_levels(levels: Sequence[float], descending: bool = False) -> list[float]:
    return sorted(set(levels), reverse=descending)


def subsample_sweep(df: DataFrame, key: str, fractions: Sequence[float], seed: int, min_entities: int = 1) -> DataFrame:
    """All subsample levels in one table with the column ``sub_frac``; the rows are read once."""
    levels = sweep_levels(fractions, descending=True)
    ranked = hash_rank(entity_table(df, key), key, hash52(F.col(key), seed, "subsample"))
    n, rank = F.col("n"), F.col("rank")
    kept = [
        F.when(F.lit(f >= 1.0) | (rank < F.greatest(truncated_count(n, f), F.lit(min_entities).cast("bigint"))), F.lit(float(f)))
        for f in levels
    ]
    chosen = ranked.select(key, F.array_compact(F.array(*kept)).alias("_levels"))
    return df.join(chosen, key).withColumn("sub_frac", F.explode("_levels")).drop("_levels")


def experiment_grid(df: DataFrame, axes: dict[str, Sequence | Column]) -> DataFrame:
    """Every combination of the axis values next to each row of ``df`` (usually one row)."""
    for name, values in axes.items():
        column = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
        df = df.withColumn(name, F.explode(column))
    return df
