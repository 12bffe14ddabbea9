"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is put into one leaf of each tree. A query searches all trees through
one priority queue, nearest branch first, and the rows of the leaves it reaches are ranked exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framecv.llm.common import bounded_sample, quoted
from framecv.session import materialize


@dataclass
class Tree:
    """Inner nodes: normal and offset; children >= 0 are inner nodes, others are the leaf -1 - child."""
    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int


def _grow(points: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(points)), None)]
    while todo:
        rows, parent = todo.pop()
        if len(rows) > leaf:
            number = len(normals)
            a, b = points[rng.choice(rows, 2, replace=False)]
            normal = a - b
            if not np.any(normal):
                normal = rng.standard_normal(points.shape[1])
            normal = normal / np.linalg.norm(normal)
            side = points[rows] @ normal
            offset = float(np.median(side))
            right = side > offset
            if right.all() or not right.any():
                right = np.arange(len(rows)) % 2 == 0  # equal points: any halves will do
            normals.append(normal)
            offsets.append(offset)
            children.append([0, 0])
            todo += [(rows[~right], (number, 0)), (rows[right], (number, 1))]
        else:
            leaves += 1
            number = -leaves
        if parent is not None:
            children[parent[0]][parent[1]] = number
    width = points.shape[1] if points.ndim == 2 else 0
    return Tree(np.array(normals).reshape(-1, width), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def grow_forest(points: np.ndarray, trees: int, leaf: int, seed: int = 7) -> list[Tree]:
    return [_grow(points, leaf, np.random.default_rng(seed + t)) for t in range(trees)]


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), np.int64) if len(tree.offsets) else np.full(len(points), -1)
    while True:
        inner = np.flatnonzero(at >= 0)
        if not len(inner):
            return -1 - at
        node = at[inner]
        right = np.einsum("ij,ij->i", points[inner], tree.normals[node]) > tree.offsets[node]
        at[inner] = tree.children[node, right.astype(np.int64)]


def search_leaves(forest: list[Tree], sides: list[np.ndarray], visits: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the first `visits` leaves off the shared queue. sides: the query's signed distances to the
    planes of each tree. A branch's priority is its smallest margin on the way from the root."""
    queue = [(-np.inf, t, 0 if len(tree.offsets) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    out = []
    while queue and len(out) < visits:
        margin, t, node = heapq.heappop(queue)
        if node < 0:
            out.append((t, -1 - node))
            continue
        side = sides[t][node]
        left, right = forest[t].children[node]
        heapq.heappush(queue, (max(margin, side), t, int(left)))
        heapq.heappush(queue, (max(margin, -side), t, int(right)))
    return out


def usable(vector: Column) -> Column:
    """Neither null, empty, zero, nor with null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = 12,
            sample_rows: int = 32_768, leaf: int = 256, visits: int = 120, block: int = 8_192) -> DataFrame:
    """(query_id, rank, id_col, score): for each row of queries the k rows of df with the largest inner product in double
    precision, nearest first and ties to the smaller id, the row of the same id left out. All candidates if fewer.

    The forest is fitted on the sample_rows vectors with the smallest hash of their id (a bound, not a share); every
    vector is indexed. Raise sample_rows with the table: a leaf holds leaf / sample_rows of all vectors. Equal
    vectors are one point of the index that keeps its k + 1 smallest ids, which is all that a result can show, so
    a very common vector fills no leaf. Leaves are split into blocks of about `block` points, each with the
    queries that reach the leaf, so no task holds a leaf that grows with the input. The nearest of each block are taken with
    a matrix product and then rescored one by one.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do those of another length
    than most vectors have (ties: the longer), nor rows with a null id. Repeated rows count once. Other columns are left out. Empty tables give an empty result.
    """
    def vectors(rows):
        return rows.select(quoted(id_col).alias("id"), quoted(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())

    kind = dict(df.dtypes)[id_col]
    result = f"query_id {kind}, rank int, `{id_col}` {kind}, score double"
    spark = df.sparkSession
    length = vectors(df).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], result)
    rows = vectors(df).where(F.size("v") == length.n)
    asked = vectors(queries).where(F.size("v") == length.n).distinct()
    spots = rows.withColumn("at", F.expr("dense_rank() over (partition by v order by id)")).where(F.col("at") <= k + 1)
    points = materialize(spots.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("point"), "ids", "v"))
    picked = bounded_sample(points, "point", sample_rows).select("v").toArrow().column("v").combine_chunks()
    forest = spark.sparkContext.broadcast(grow_forest(_matrix(picked), trees, leaf))  # sample_rows * trees / leaf planes

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(2))
            for t, tree in enumerate(forest.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(leaf_of(tree, m)), *batch.columns[:2], batch.column(2)],
                                                 ["tree", "leaf", "point", "ids", "v"])

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            sides = [m @ tree.normals.T - tree.offsets if len(tree.offsets) else np.zeros((len(m), 0)) for tree in forest.value]
            for i in range(0, len(m), 256):
                found = [(j, t, x) for j in range(i, min(i + 256, len(m))) for t, x in search_leaves(forest.value, [s[j] for s in sides], visits)]
                own, tree, leaves = (np.array(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(leaves.astype(np.int64)), batch.column(0).take(pa.array(own)),
                                                  batch.column(1).take(pa.array(own))], ["tree", "leaf", "query_id", "q"])

    placed = materialize(points.mapInArrow(assign, f"tree int, leaf bigint, point {kind}, ids array<{kind}>, v array<double>"))
    reached = asked.select("id", "v").mapInArrow(visit, f"tree int, leaf bigint, query_id {kind}, q array<double>")
    blocks = placed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    blocks = materialize(blocks)
    cells = placed.join(blocks.toDF("tree", "leaf", "blocks"), ["tree", "leaf"]).withColumn("cell", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    visits_in = reached.join(blocks.toDF("tree", "leaf", "parts"), ["tree", "leaf"]).withColumn(
        "cell", F.explode(F.expr("sequence(0, parts - 1)")))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            m = np.array(left["v"].tolist(), np.float64)
            for i in range(0, len(right), 512):
                q = np.array(right["q"].iloc[i:i + 512].tolist(), np.float64)
                near = q @ m.T
                take = min(k + 1, len(m))
                low = np.partition(near, len(m) - take, axis=1)[:, len(m) - take]
                a, b = np.nonzero(near >= (low - 1e-9 * (1 + np.abs(low)))[:, None])
                out.append(pd.DataFrame({"query_id": right["query_id"].iloc[i:i + 512].to_numpy()[a], "ids": left["ids"].to_numpy()[b],
                                         "point": left["point"].to_numpy()[b], "score": (q[a] * m[b]).sum(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "ids": [], "point": [], "score": []}, dtype=object)

    ranked = cells.groupBy("tree", "leaf", "cell").cogroup(visits_in.groupBy("tree", "leaf", "cell")).applyInPandas(
        rank, f"query_id {kind}, ids array<{kind}>, point {kind}, score double")
    near = ranked.groupBy("query_id", "point").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    near = near.select("query_id", F.explode("ids").alias("id"), "score").where("id != query_id")
    last = near.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, id)")).where(F.col("rank") <= k)
    return last.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
