"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. Every step is one pass over the distributed rows that multiplies it with a thin
block: V Q = sum of x (x'Q) / n over centred rows. A Chebyshev recurrence of such passes damps the part of the spectrum below the
block, then QR and Rayleigh-Ritz turn the block into eigenvector estimates, until their residuals certify them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framecv.llm.common import quoted
from framecv.llm.words import summed
from framecv.session import materialize

#: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: An entry of which x has a larger magnitude is as good as infinite: its row is left out.
LARGEST = float(1 << 52)
#: Rows of a block in the numpy steps.
ROWS = 4096


@dataclass
class Whitening:
    """The fit: row count, sums by dimension, largest magnitude of an entry, eigenvectors (columns), eigenvalues, residuals of V q = e q, trace of V, passes."""
    n: int
    sums: list[int]
    most: int
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the rows whose vector is not null, has no null, non-finite or too large entry and is as long as most vectors are
    (ties: the longer), with x as long numbers. Ids may be null or repeat; every row counts. Empty vectors have no dimension to whiten and are
    left out. Written once, as every pass reads it."""
    vector = quoted(vector_col).cast("array<double>")
    scaled = F.transform(F.col("v"), lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT))
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c * F.lit(float(SCALE))) < F.lit(LARGEST), F.lit(False)))  # NaN compares as larger
    rows = df.select(quoted(id_col).alias("id"), vector.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    x = materialize(rows.select("id", scaled.cast("array<bigint>").alias("x")))
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x if length is None else x.where(F.size("x") == length.d)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _exact_deviations(x: np.ndarray, n: int, sums: list[int], most: int) -> np.ndarray:
    """n x - S, exactly: as int64 where that holds it, else as Python integers."""
    if n * most < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(deviations: np.ndarray) -> list[int]:
    """Sum of the squares of each row, exactly. Numbers below 2^52 are cut in halves of 26 bits, so that the sums fit 64 bits."""
    if deviations.dtype == object or deviations.shape[1] > 512 or (len(deviations) and np.abs(deviations).max() >= 1 << 52):
        return [sum(int(d) * int(d) for d in row) for row in deviations.tolist()]
    low, high = deviations & np.int64((1 << 26) - 1), deviations >> np.int64(26)
    parts = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(hh << 52) + (hl << 27) + ll for hh, hl, ll in zip(*parts)]


def _blocks(batches: Iterable[pa.RecordBatch], at: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, _matrix(part.column(at), width)


def _centred(x: np.ndarray, n: int, sums: list[int], most: int) -> np.ndarray:
    """x minus the mean, each entry rounded once."""
    return (_exact_deviations(x, n, sums, most) / n).astype(float)


class _Covariance:
    """Products of the covariance with thin blocks, one distributed pass each."""

    def __init__(self, rows: DataFrame, n: int, sums: list[int], most: int):
        self.rows, self.n, self.sums, self.most, self.passes = rows.select("x"), n, sums, most, 0

    def times(self, block: np.ndarray) -> np.ndarray:
        n, sums, most, width = self.n, self.sums, self.most, len(self.sums)

        def task(batches):
            total = None
            for _, x in _blocks(batches, 0, width):
                c = _centred(x, n, sums, most)
                part = c.T @ (c @ block)
                total = part if total is None else total + part
            return total

        self.passes += 1
        return summed(self.rows, task, block.size).reshape(block.shape) / n


def _totals(rows: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Row count, exact sums by dimension and the largest magnitude of an entry. Entries are summed in halves of 26 bits."""
    mask = np.int64((1 << 26) - 1)

    def run(batches):
        low, high, n, most = np.zeros(width, np.int64), np.zeros(width, np.int64), 0, 0
        for _, x in _blocks(batches, 0, width):
            low, high = low + (x & mask).sum(axis=0), high + (x >> np.int64(26)).sum(axis=0)
            n, most = n + len(x), max(most, int(np.abs(x).max()))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high), pa.array(np.full(width, n)),
                                              pa.array(np.full(width, most))], ["at", "low", "high", "n", "most"])

    found = rows.select("x").mapInArrow(run, "at bigint, low bigint, high bigint, n bigint, most bigint").groupBy("at").agg(
        F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("at").collect()
    return found[0].n, [(r.high << 26) + r.low for r in found], max(r.most for r in found)


def fit_whitening(rows: DataFrame, components: int = 8, spare: int = 24, degree: int = 12, most_rounds: int = 40, seed: int = 5) -> Whitening:
    """The leading eigenvectors of the covariance (divisor n) of integer_vectors rows, by falling eigenvalue.

    The block has `components` + `spare` columns (all dimensions, if there are fewer; then one pass is enough). A round is a filter of `degree`
    passes on the interval from zero to the least Ritz value, then one pass for QR and Rayleigh-Ritz. It ends when the
    residuals of the components are at rounding level, 1e-14 of the largest eigenvalue times the root of the dimensions, or when a round
    no longer halves them and they are below 1e-11 of it; otherwise, after `most_rounds`, it raises an error. What a task holds is a block of rows and two thin blocks; the
    driver gets dimensions x columns numbers a pass. Equal eigenvalues have no eigenvectors of their own: any basis of theirs may result.
    """
    width = rows.select(F.size("x").alias("d")).first()
    if width is None:
        return Whitening(0, [], 0, np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, 0)
    width = width.d
    n, sums, most = _totals(rows, width)

    def spread(batches):
        total = np.zeros(1)
        for _, x in _blocks(batches, 0, width):
            total += (_centred(x, n, sums, most) ** 2).sum()
        return total

    trace = float(summed(rows.select("x"), spread, 1)[0]) / n
    covariance = _Covariance(rows, n, sums, most)
    count, columns = min(components, width), min(width, components + spare)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, columns)))[0]
    if trace == 0.0:
        return Whitening(n, sums, most, block[:, :count], np.zeros(count), np.zeros(count), 0.0, 0)
    before = np.inf
    for _ in range(most_rounds):
        product = covariance.times(block)
        values, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        residuals = np.linalg.norm(product - block * values, axis=0)[:count]
        worst = residuals.max() / values[0]
        if columns == width or worst <= 1e-14 * np.sqrt(width) or (worst > before / 2 and worst < 1e-11):
            return Whitening(n, sums, most, block[:, :count], values[:count], residuals, trace, covariance.passes)
        before = worst
        # T_k of the interval [0, edge] mapped to [-1, 1], scaled at the largest eigenvalue so that nothing overflows
        half = max(values[-1], 1e-300) / 2
        sigma = first = half / (values[0] - half) if values[0] > 2 * half else 1.0
        older, newer = block, (product - half * block) * (sigma / half)
        for _ in range(degree - 1):
            scale = 1.0 / (2.0 / first - sigma)
            older, newer = newer, (covariance.times(newer) - half * newer) * (2.0 * scale / half) - older * (sigma * scale)
            sigma = scale
        block = np.linalg.qr(newer)[0]
    raise ValueError(f"not certified after {covariance.passes} passes: residuals {residuals.tolist()}")


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", **more) -> DataFrame:
    """One row per remaining row of df and component: id_col, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows remain as integer_vectors says; the mean, the covariance and the components are those of all of them. deviation is the sum of
    (n x - S)^2, an exact decimal; whitened the centred row on the component over the root of its eigenvalue; explained the component's share
    of the total variance; identity_error the largest entry of the whitened rows' covariance minus the identity, measured in a pass of its own.
    Vectors of fewer dimensions than `components` have a component per dimension. A component without variance (an eigenvalue of no more than 1e-13 of the largest,
    as for a single row or equal rows) whitens to 0 and takes no part in identity_error. Other columns are left out. An empty table, or one without a
    remaining row, gives an empty result.
    """
    rows = integer_vectors(df, id_col, vector_col)
    fit = fit_whitening(rows, components, **more)
    kind = df.select(quoted(id_col)).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not fit.n:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, most, width, count = fit.n, fit.sums, fit.most, len(fit.sums), len(fit.values)
    live = fit.values > 1e-13 * fit.values.max(initial=0.0) if fit.trace > 0 else np.zeros(count, bool)
    projection = fit.vectors * np.where(live, 1 / np.sqrt(np.where(live, fit.values, 1.0)), 0.0)

    def moments(batches):
        total = np.zeros((count, count + 1))
        for _, x in _blocks(batches, 0, width):
            w = _centred(x, n, sums, most) @ projection
            total += np.hstack([w.T @ w, w.sum(axis=0)[:, None]])
        return total

    sums_of = summed(rows.select("x"), moments, count * (count + 1)).reshape(count, count + 1) / n
    mean = sums_of[:, -1]
    apart = np.abs(sums_of[:, :-1] - np.outer(mean, mean) - np.eye(count))[np.ix_(live, live)]
    error = float(apart.max()) if apart.size else 0.0
    explained = (fit.values / fit.trace if fit.trace > 0 else np.zeros(count)).tolist()

    def run(batches):
        for part, x in _blocks(batches, 1, width):
            deviations = _exact_deviations(x, n, sums, most)
            w = (deviations / n).astype(float) @ projection
            size = len(x)
            spread = pa.array(_squares(deviations), pa.decimal128(38, 0))
            ids = part.column(0)
            each = np.repeat(np.arange(size), count)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)), pa.array(np.full(size * count, n)),
                spread.take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * count, error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(run, schema)
