"""Quality rules: plain counts with fixed limits, and logistic regression on hashed word and character n-grams.

The regression is trained on labelled rows by passes over their distributed features, calibrated on a fifth of them that it has
not seen, and scored in Arrow batches. A document is kept if the counts are within their limits and its probability reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framecv.llm.common import bounded_sample, quoted, without
from framecv.llm.shingles import CHUNK, GOLDEN, chunks, mix, numbers, text_bytes
from framecv.llm.words import hash_words, separators, summed, word_bounds
from framecv.session import materialize

#: White space between words, and the characters that count as symbols.
SPACE = separators(b" \t\n\x0b\x0c\r")
SYMBOLS = separators(b"#*$%&|<>")
#: A document fails the base rules with fewer words, or with a larger percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SIZES = (3, 4)
WIDTH = 1 << 16
#: n-gram kinds: one per size of characters, words, pairs of words. A feature is the share of its n-gram in the kind, times SCALE.
KINDS = len(SIZES) + 2
SCALE = 16.0
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")


@dataclass
class QualityModel:
    """Weights by slot (the bias last), and the calibration: the probability is the logistic function of slope * score + offset."""
    weights: np.ndarray
    slope: float
    offset: float


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the marks of each text."""
    ends = np.append(0, np.cumsum(marks, dtype=np.float64 if marks.dtype.kind == "f" else np.int64))
    return ends[offsets[1:]] - ends[offsets[:-1]]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (case counts), and offsets into them by text."""
    starts, ends = word_bounds(data, offsets, SPACE)
    return hash_words(data, starts, ends, 3), np.searchsorted(starts, offsets)


def _repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of three words found twice or more in the text."""
    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        factors = numbers(4, 3) | np.uint64(1)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        same = text[2:] == text[:-2]
        with np.errstate(over="ignore"):
            window = mix(hashes[:-2] * factors[0] + hashes[1:-1] * factors[1] + hashes[2:] * factors[2] + text[2:].astype(np.uint64) * GOLDEN)
        at = np.flatnonzero(same)
        _, back, times = np.unique(window[at], return_inverse=True, return_counts=True)
        twice = at[times[back] > 1]
        for k in range(3):
            covered[twice + k] = True
    return _per_text(covered, bounds)


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _grams(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, offsets into them by text): the n-grams of each kind, in parts of at most about CHUNK n-grams.

    Characters are bytes of UTF-8, in their case, white space as blanks. A word that equals the one before makes one and the same pair, so
    that repetition is a feature whatever the word.
    """
    plain = np.where(SPACE[data], np.uint8(32), data).astype(np.uint32)
    for size in SIZES:
        n = max(0, len(data) - size + 1)
        for at in range(0, n, CHUNK):
            to = min(n, at + CHUNK)
            code = np.full(to - at, size, np.uint32)
            with np.errstate(over="ignore"):
                for k in range(size):
                    code = (code ^ plain[at + k:to + k]) * np.uint32(0x01000193)
                code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            # windows that start in the last bytes of a text reach into the next one
            inner = np.clip(offsets - at, 0, to - at)
            whole = np.clip(offsets[1:] - (size - 1) - at, inner[:-1], to - at)
            keep = np.zeros(to - at + 1, np.int32)
            np.add.at(keep, inner[:-1], 1)
            np.add.at(keep, whole, -1)
            marks = np.cumsum(keep[:-1]) > 0
            slots = (code >> np.uint32(16)).astype(np.int32)[marks]
            yield slots, np.append(0, np.cumsum(whole - inner[:-1]))
    with np.errstate(over="ignore"):
        yield (mix(hashes ^ np.uint64(5)) >> np.uint64(48)).astype(np.int32), bounds
        pairs = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    pairs[hashes[:-1] == hashes[1:]] = np.uint64(11)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    same = text[1:] == text[:-1]
    yield (pairs[same] >> np.uint64(48)).astype(np.int32), np.append(0, np.cumsum(np.maximum(np.diff(bounds) - 1, 0)))


def _kind_totals(offsets: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Number of n-grams of each text, kind by kind."""
    chars, words = np.diff(offsets), np.diff(bounds)
    return [*[np.maximum(chars - size + 1, 0) for size in SIZES], words, np.maximum(words - 1, 0)]


def _kind_of_parts(size: int) -> list[int]:
    """Kind of each part that _grams gives for so many bytes."""
    kinds = [k for k, s in enumerate(SIZES) for _ in range(0, max(0, size - s + 1), CHUNK)]
    return [*kinds, len(SIZES), len(SIZES) + 1]


def _scores(data, offsets, hashes, bounds, weights: np.ndarray) -> np.ndarray:
    score = np.full(len(offsets) - 1, weights[-1])
    totals = _kind_totals(offsets, bounds)
    for kind, (slots, ends) in zip(_kind_of_parts(len(data)), _grams(data, offsets, hashes, bounds)):
        score += _per_text(weights[slots], ends) * (SCALE / np.maximum(totals[kind], 1))
    return score


def _features(data, offsets, hashes, bounds) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text; the last slot is the bias."""
    totals = _kind_totals(offsets, bounds)
    dense = np.zeros(WIDTH + 1)
    parts = list(zip(_kind_of_parts(len(data)), _grams(data, offsets, hashes, bounds)))
    for i in range(len(offsets) - 1):
        dense[:] = 0
        dense[-1] = 1.0
        for kind, (slots, ends) in parts:
            if totals[kind][i]:
                dense[:WIDTH] += np.bincount(slots[ends[i]:ends[i + 1]], minlength=WIDTH) * (SCALE / totals[kind][i])
        at = np.flatnonzero(dense)
        yield at, dense[at]


def _text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for at, to in chunks(offsets):
        own = offsets[at:to + 1]
        yield at, to, data[own[0]:own[-1]], own - own[0]


def quality_features(rows: DataFrame) -> DataFrame:
    """(good, unseen, text) to (good, unseen, slots, values)."""
    def run(batches):
        for batch in batches:
            for at, to, data, offsets in _text_chunks(batch.column(2)):
                found = list(_features(data, offsets, *_words(data, offsets)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at),
                    pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
                    ["good", "unseen", "slots", "values"])

    return rows.select("good", "unseen", "text").mapInArrow(run, "good boolean, unseen boolean, slots array<int>, values array<float>")


def _linear(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values, row lengths and scores of a batch of features (slots, values in columns 0 and 1)."""
    slots, values = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
    sizes = np.diff(batch.column(0).offsets.to_numpy())
    score = np.add.reduceat(weights[slots] * values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)  # the bias is always there
    return slots, values, sizes, score


def _objective(rows: DataFrame, n: int, ridge: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean log loss with a ridge on all but the bias, and its gradient: one distributed pass a call."""
    rows = rows.select("slots", "values", "good")

    def evaluate(weights):
        def task(batches):
            total = np.zeros(WIDTH + 2)
            for batch in batches:
                if not batch.num_rows:
                    continue
                slots, values, sizes, score = _linear(batch, weights)
                sign = np.where(batch.column(2).to_numpy(zero_copy_only=False), 1.0, -1.0)
                margin = sign * score
                total[-1] += np.logaddexp(0.0, -margin).sum()
                pull = -sign / (1.0 + np.exp(np.clip(margin, -500, 500)))
                total[:-1] += np.bincount(slots, weights=values * np.repeat(pull, sizes), minlength=WIDTH + 1)
            return total

        total = summed(rows, task, WIDTH + 2) / n
        inner = np.append(weights[:-1], 0.0)
        return total[-1] + ridge / 2 * float(inner @ inner), total[:-1] + ridge * inner

    return evaluate


def minimise(evaluate, start: np.ndarray, rounds: int, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving until the objective falls enough; usually one evaluation a round."""
    point, (value, slope) = start, evaluate(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.linalg.norm(slope) <= tolerance:
            break
        step, kept = -slope, []
        for s, y in reversed(pairs):
            a = (s @ step) / (s @ y)
            step = step - a * y
            kept.append(a)
        step = step * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0 / max(1.0, np.linalg.norm(slope)))
        for (s, y), a in zip(pairs, reversed(kept)):
            step = step + (a - (y @ step) / (s @ y)) * s
        length, fall = 1.0, float(slope @ step)
        for _ in range(20):
            new_value, new_slope = evaluate(point + length * step)
            if new_value <= value + 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        move, turn = length * step, new_slope - slope
        if move @ turn > 1e-12:
            pairs = [*pairs, (move, turn)][-memory:]
        point, value, slope = point + move, new_value, new_slope
    return point


def calibrate(scores: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the scores of unseen rows, with smoothed targets, by Newton steps.
    A curve that falls, or cannot be fitted because only one class was seen, is not used: then slope 1, offset 0."""
    n, up = len(scores), int(good.sum())
    if not 0 < up < n:
        return 1.0, 0.0
    target = np.where(good, (up + 1) / (up + 2), 1 / (n - up + 2))
    a, b = 1.0, 0.0

    def loss(a, b):
        z = a * scores + b
        return (np.logaddexp(0.0, z) - target * z).sum()

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -500, 500)))
        gap, w = p - target, np.maximum(p * (1 - p), 1e-12)
        g = np.array([gap @ scores, gap.sum()])
        h = np.array([[w @ scores ** 2, w @ scores], [w @ scores, w.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        length = 1.0
        while loss(a - length * step[0], b - length * step[1]) > loss(a, b) and length > 1e-6:
            length /= 2
        a, b = a - length * step[0], b - length * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def unseen(id_col: Column) -> Column:
    """The fifth of the labelled ids that only calibrates."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 4096,
                  rounds: int = 20, ridge: float = 1e-4) -> QualityModel | None:
    """Fit and calibrate on the rows of docs that have a label of 0 or 1.

    At most `most` labels take part, those with the smallest hash of the id; they are broadcast to docs, so texts are not
    shuffled. Their features are written once, and every training step is a distributed pass over them; the driver gets one number a slot a step, and
    one score an unseen row. Labels that are null or neither 0 nor 1 do not count; an id labelled or found more than once counts each time. Null texts
    are empty ones. None if the rows to be learned from are not of both classes.
    """
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    chosen = materialize(bounded_sample(known, "id", most))
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `most` rows
    features = materialize(quality_features(rows.select((F.col("label") == 1).alias("good"), unseen(F.col("id")).alias("unseen"), "text")))
    seen = features.where(~F.col("unseen"))
    counts = {r.good: r.n for r in seen.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    weights = minimise(_objective(seen, sum(counts.values()), ridge), np.zeros(WIDTH + 1), rounds, tolerance=1e-3)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(_linear(batch, weights)[3])], ["good", "score"])

    apart = features.where("unseen").select("slots", "values", "good").mapInArrow(score, "good boolean, score double").toArrow()
    order = np.argsort(apart.column("score").to_numpy(), kind="stable")
    return QualityModel(weights, *calibrate(apart.column("score").to_numpy()[order], apart.column("good").to_numpy()[order]))


def apply_quality(df: DataFrame, model: QualityModel | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability and kept.

    Counts are of the whole text: words, code points in words, symbols, lines with a word that equal an earlier line, and words in windows of three words
    found twice or more. base_failed: fewer than LEAST_WORDS words, or over MOST_REPEATED percent of the words in repeated windows. kept: not base_failed,
    and the calibrated probability is `least` or more. Windows are compared by 64-bit hashes within a text. Without a model the probability is null and the base
    rules decide. A null text has no words, as an empty one. Repeated rows are judged each by itself. Columns of df with a result's name are left
    out; an empty table gives an empty result.
    """
    base = without(df, RESULT)
    names = base.columns
    at_text = names.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at, to, data, offsets in _text_chunks(batch.column(at_text)):
                hashes, bounds = _words(data, offsets)
                n_words = np.diff(bounds)
                lead = ~SPACE[data] & ((data & 0xC0) != 0x80)
                repeated = _repeated_words(hashes, bounds)
                lines = [_dup_lines(data[a:b].tobytes()) if b > a else 0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
                if known is None:
                    probability, fine = pa.nulls(to - at, pa.float64()), ~failed
                else:
                    z = known.slope * _scores(data, offsets, hashes, bounds, known.weights) + known.offset
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    probability, fine = pa.array(p), ~failed & (p >= least)
                yield pa.RecordBatch.from_arrays([
                    *[c.slice(at, to - at) for c in batch.columns], pa.array(n_words), pa.array(_per_text(lead, offsets)),
                    pa.array(_per_text(SYMBOLS[data], offsets)), pa.array(lines, pa.int64()), pa.array(repeated), pa.array(failed), probability, pa.array(fine)],
                    [*names, *RESULT])

    kinds = [*[T.LongType()] * 5, T.BooleanType(), T.DoubleType(), T.BooleanType()]
    return base.mapInArrow(run, T.StructType(base.schema.fields + [T.StructField(n, k) for n, k in zip(RESULT, kinds)]))
