"""Fitted forests as tables of nodes: importances, and dependence on one feature at the split points only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framecv.session import scratch_path

#: A forest of more nodes is refused where it is sent to the tasks: 40 bytes a node.
MOST_NODES = 5_000_000


def read_nodes(spark: SparkSession, path: str, task: str = "reg", positive: int = 1) -> DataFrame:
    """Nodes of every forest saved below a path (``save_models``): ``repeat, fold, tree, node, value, weight, gain, left, right, feature, threshold``.

    ``repeat`` and ``fold`` come from the directories, NULL without them. ``value`` is the prediction of a regression node, or the share of the class ``positive``; ``weight`` the
    rows it was fitted on, counted as often as they were drawn. Leaves have no children (-1). Categorical splits have no threshold and are not read here.
    """
    raw = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).schema(
        "treeID int, nodeData struct<id: int, prediction: double, impurityStats: array<double>, gain: double, leftChild: int, rightChild: int, "
        "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>").parquet(path)
    nodes = raw.withColumn("_path", F.col("_metadata.file_path")).where(F.contains("_path", F.lit("/data/")) & F.col("nodeData").isNotNull())
    stats = F.col("nodeData.impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    # regression keeps count, sum and sum of squares; classification one count a class
    weight = F.get(stats, F.lit(0)) if task == "reg" else total
    value = F.col("nodeData.prediction") if task == "reg" else F.try_divide(F.get(stats, F.lit(positive)), total)

    def part(name):
        return F.nullif(F.regexp_extract("_path", rf"/{name}=(\d+)/", 1), F.lit("")).cast("int").alias(name)

    split = F.col("nodeData.split")
    return nodes.select(
        part("repeat"), part("fold"), F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), value.alias("value"), weight.alias("weight"),
        F.col("nodeData.gain").alias("gain"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        split["featureIndex"].alias("feature"), F.when(split["numCategories"] == -1, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"))


def node_importances(nodes: DataFrame, features: Sequence[str], by: Sequence[str] = ("repeat", "fold")) -> DataFrame:
    """``by, feature, importance``: gains times weights summed per feature, each tree scaled to one, then the forest. Features without a split have 0."""
    splits = nodes.where(F.col("left") >= 0)
    per_tree = splits.groupBy(*by, "tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("own"))
    totals = per_tree.groupBy(*by, "tree").agg(F.sum("own").alias("whole"))
    keys = [*by, "tree"]
    joined = per_tree.alias("p").join(totals.alias("t"), [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    shares = joined.select(*[F.col(f"p.{k}").alias(k) for k in by], "feature", F.when(F.col("whole") > 0, F.col("own") / F.col("whole")).otherwise(0.0).alias("share"))
    sums = [F.sum(F.when(F.col("feature") == i, F.col("share")).otherwise(0.0)) for i in range(len(features))]
    wide = shares.groupBy(*by).agg(*[s.alias(f"_s{i}") for i, s in enumerate(sums)], F.sum("share").alias("_all"))
    # a forest of single leaves has no split, and no importance either
    every = nodes.select(*by).distinct().alias("e").join(wide.alias("w"), [F.col(f"e.{k}").eqNullSafe(F.col(f"w.{k}")) for k in by], "left") if by else wide
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.try_divide(F.col(f"_s{i}"), F.col("_all")), F.lit(0.0)).alias("importance"))
                        for i, c in enumerate(features)])
    return every.select(*[F.col(f"e.{k}").alias(k) for k in by], F.inline(entries))


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def load_trees(nodes: DataFrame) -> list[Tree]:
    """The trees of one forest. Its size follows from its parameters, not from the data, and is checked."""
    if nodes.count() > MOST_NODES:
        raise ValueError(f"the forest has more than {MOST_NODES} nodes")
    table = nodes.select("tree", "node", "feature", "threshold", "left", "right", "value").toPandas().sort_values(["tree", "node"])
    out = []
    for _, t in table.groupby("tree"):
        if (t["node"].to_numpy() != np.arange(len(t))).any() or t.loc[t["left"] >= 0, "threshold"].isna().any():
            raise ValueError("not the nodes of one forest with thresholds only")
        out.append(Tree(*[t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value")]))
    return out


def forest_of(model: PipelineModel, spark: SparkSession, task: str = "reg", positive: int = 1) -> list[Tree]:
    """The trees of a fitted model, by way of its saved nodes."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    return load_trees(read_nodes(spark, path, task, positive))


def _pieces(tree: Tree, x: np.ndarray, feature: int) -> Iterator[tuple[np.ndarray, float, float, float]]:
    """(rows, low, high, value): for values of the feature in (low, high] and their own other features, these rows end in one leaf."""
    todo = [(0, np.arange(len(x)), -np.inf, np.inf)]
    while todo:
        node, rows, low, high = todo.pop()
        if tree.left[node] < 0:
            yield rows, low, high, float(tree.value[node])
        elif tree.feature[node] == feature:
            cut = tree.threshold[node]
            if low < min(cut, high):
                todo.append((tree.left[node], rows, low, min(cut, high)))
            if max(cut, low) < high:
                todo.append((tree.right[node], rows, max(cut, low), high))
        else:
            under = x[rows, tree.feature[node]] <= tree.threshold[node]
            for child, own in ((tree.left[node], rows[under]), (tree.right[node], rows[~under])):
                if len(own):
                    todo.append((child, own, low, high))


def _matrix(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in columns])


def dependence_steps(trees: list[Tree], rows: DataFrame, features: Sequence[str], feature: str) -> DataFrame:
    """The mean prediction over all rows as a step function of one feature: ``threshold, change``, and the number of rows.

    A forest's answer changes at its split points only, so each row is sent down its paths once, whatever the number of points to predict at. The result has at most one row per split
    of the feature, and one (threshold minus infinity) with the mean left of all splits. The changes apply to values above the threshold.
    """
    spot, shared, count = list(features).index(feature), rows.sparkSession.sparkContext.broadcast(trees), len(trees)

    def run(batches):
        for batch in batches:
            x = _matrix(batch, range(len(features)))
            change: dict[float, float] = {}
            for tree in shared.value:
                for own, low, high, value in _pieces(tree, x, spot):
                    change[low] = change.get(low, 0.0) + value * len(own) / count
                    if high < np.inf:
                        change[high] = change.get(high, 0.0) - value * len(own) / count
            yield pa.RecordBatch.from_arrays([pa.array(list(change), pa.float64()), pa.array(list(change.values()), pa.float64()),
                                              pa.array([batch.num_rows if t == -np.inf else 0 for t in change], pa.int64())], ["threshold", "change", "n"])

    parts = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features]).mapInArrow(run, "threshold double, change double, n bigint")
    return parts.groupBy("threshold").agg(F.sum("change").alias("change"), F.sum("n").alias("n"))


def forest_dependence(trees: list[Tree], rows: DataFrame, features: Sequence[str], feature: str, grid: DataFrame) -> DataFrame:
    """Mean prediction at every value of ``grid`` (one column ``grid``): ``grid, average, n``. The rows are read once and never copied to the grid."""
    steps = dependence_steps(trees, rows, features, feature)
    # one entry per split of the feature
    table = steps.agg(F.collect_list(F.struct("threshold", "change")).alias("steps"), F.sum("n").alias("n"))
    marked = grid.withColumn("_t", table.select(F.struct("steps", "n")).scalar())
    total = F.aggregate(F.filter("_t.steps", lambda s: s["threshold"] < F.col("grid")), F.lit(0.0), lambda a, s: a + s["change"])
    return marked.select("grid", (total / F.col("_t.n")).alias("average"), F.col("_t.n").alias("n")).where("n is not null")


def forest_curves(trees: list[Tree], rows: DataFrame, features: Sequence[str], feature: str, row_id: Sequence[str]) -> DataFrame:
    """The prediction of every row as a step function of one feature: ``row_id, thresholds, values``.

    values[i] holds above thresholds[i]; the first threshold is minus infinity. A row has as many values as there are splits of the feature on its own paths.
    """
    spot, shared, count = list(features).index(feature), rows.sparkSession.sparkContext.broadcast(trees), len(trees)
    wide = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)], *row_id)
    schema = T.StructType([*[wide.schema[c] for c in row_id], T.StructField("thresholds", T.ArrayType(T.DoubleType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = _matrix(batch, range(len(features)))
                who, where, change = [], [], []
                for tree in shared.value:
                    for own, low, high, value in _pieces(tree, x, spot):
                        for edge, sign in ((low, 1.0), (high, -1.0)):
                            if edge < np.inf:
                                who.append(own)
                                where.append(np.full(len(own), edge))
                                change.append(np.full(len(own), sign * value / count))
                row, edge, step = np.concatenate(who), np.concatenate(where), np.concatenate(change)
                order = np.lexsort((edge, row))
                row, edge, step = row[order], edge[order], step[order]
                heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (edge[1:] != edge[:-1])))
                row, edge, step = row[heads], edge[heads], np.add.reduceat(step, heads)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                running = np.append(0.0, np.cumsum(step))
                value = running[1:] - np.repeat(running[ends[:-1]], np.diff(ends))
                offsets = pa.array(ends.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(len(features) + i) for i in range(len(row_id))], pa.ListArray.from_arrays(offsets, pa.array(edge)),
                                                  pa.ListArray.from_arrays(offsets, pa.array(value))], [*row_id, "thresholds", "values"])

    return wide.mapInArrow(run, schema)


def curves_at(curves: DataFrame, grid: Sequence[float], row_id: Sequence[str]) -> DataFrame:
    """Values of step curves at some points: ``row_id, grid, predicted``."""
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("grid")
    spread = curves.select(*row_id, "thresholds", "values", points)
    below = F.size(F.filter("thresholds", lambda t: t < F.col("grid")))
    return spread.select(*row_id, "grid", F.get("values", below - 1).alias("predicted"))
