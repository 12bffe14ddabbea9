"""Language-model scoring by masked pseudo-likelihood.

A word's probability is that of its bucket given its neighbours, times that of the word in its bucket. The buckets are the upper
levels of a tree of words: a small window network predicts which of 4096 a word belongs to from two words on either side, as a
product of three choices among 16. The leaves are all words of the documents, with their counts in a table that grows with
them. A document's score is the sum of the log probabilities of its words, each given its neighbours (and never itself).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from framecv.llm.common import quoted, without
from framecv.llm.shingles import chunks, mix, text_bytes, word_hashes
from framecv.session import materialize

FAN, LEVELS, WIDTH = 16, 3, 16
BUCKETS = FAN ** LEVELS
PLACES = (-2, -1, 1, 2)
BATCH = 8192
#: Rows of one matrix product.
PIECE = 1024
#: Values of the model that one row carries on its way to the average.
BLOCK = 16_384
#: Words with more than this part of all occurrences, fewer than so many, are looked up in each task; the others are joined.
COMMON = 1 << 16
#: Distinct words that a task gathers before it hands over their counts.
HELD = 1 << 20
RESULT = ("n_tokens", "log_prob", "mean_log_prob")

_SHAPES = {"embed": (len(PLACES), BUCKETS + 1, WIDTH), "bias": (WIDTH,), "out": (LEVELS, WIDTH, FAN),
           "chance": (1 + FAN + FAN ** 2, FAN), "node": (1 + FAN + FAN ** 2, WIDTH)}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def initial() -> np.ndarray:
    return np.random.default_rng(17).normal(0, 0.1, SIZE).astype(np.float32)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes + np.uint64(99)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of texts: number of the first one, words per text, 64-bit hash of each word."""
    data, offsets = text_bytes(column)
    for at, to in chunks(offsets):
        own = offsets[at:to + 1]
        hashes, counts = word_hashes(data[own[0]:own[-1]], own - own[0])
        yield at, counts, hashes


def windows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts: number of the first one, words per text, bucket of each word, buckets around it (BUCKETS: none)."""
    for at, counts, hashes in hashed_words(column):
        yield at, counts, *_around(bucket_of(hashes), counts)


def _around(word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.repeat(counts, counts)
    # 16 bits hold a bucket, and numbers of 16 bits are sorted by radix
    word = word.astype(np.uint16)
    around = np.full((len(PLACES), len(word)), BUCKETS, np.uint16)
    for k, step in enumerate(PLACES):
        there = np.flatnonzero((place + step >= 0) & (place + step < length))
        around[k, there] = word[there + step]
    return word, around


def _levels(word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(node, choice) of each word on each level; nodes are numbered from the root."""
    first, second, third = word // FAN ** 2, word // FAN % FAN, word % FAN
    return [(np.zeros_like(word), first), (1 + first, second), (1 + FAN + word // FAN, third)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, PIECE rows at a time: products of this size run in one thread, and more threads only wait for each other."""
    whole = len(a) // PIECE * PIECE
    out = np.empty((len(a), b.shape[1]), np.result_type(a, b))
    np.matmul(a[:whole].reshape(-1, PIECE, a.shape[1]), b, out=out[:whole].reshape(-1, PIECE, b.shape[1]))
    np.matmul(a[whole:], b, out=out[whole:])
    return out


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, in the same pieces."""
    whole = len(a) // PIECE * PIECE
    parts = np.matmul(a[:whole].reshape(-1, PIECE, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, PIECE, b.shape[1]))
    return parts.sum(axis=0) + a[whole:].T @ b[whole:]


def forward(model: dict, word: np.ndarray, around: np.ndarray):
    hidden = np.tanh(sum(model["embed"][k][around[k]] for k in range(len(PLACES))) + model["bias"])
    steps, total = [], np.zeros(len(word), np.float32)
    for level, (node, choice) in enumerate(_levels(word)):
        z = hidden + model["node"][node]
        logits = _times(z, model["out"][level]) + model["chance"][node]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        total += np.log(p[np.arange(len(word)), choice] + 1e-30)
        steps.append((node, choice, z, p))
    return hidden, steps, total


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    held = rows[order]
    heads = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    return held[heads], np.add.reduceat(values[order], heads)


class Trainer:
    """Gradient ascent with a step of its own for each value (Adagrad)."""

    def __init__(self, flat: np.ndarray, rate: float = 0.1):
        self.model, self.rate = views(flat), rate
        self.seen = views(np.full(SIZE, 1e-6, np.float32))

    def _step(self, name, index, grad):
        seen, model = self.seen[name], self.model[name]
        seen[index] += grad * grad
        model[index] -= self.rate * grad / np.sqrt(seen[index])

    def batch(self, word: np.ndarray, around: np.ndarray) -> None:
        hidden, steps, _ = forward(self.model, word, around)
        n = np.float32(len(word))
        to_hidden = np.zeros_like(hidden)
        for level, (node, choice, z, p) in enumerate(steps):
            p[np.arange(len(word)), choice] -= 1
            p /= n
            back = _times(p, self.model["out"][level].T)
            to_hidden += back
            out = _crossed(z, p)
            rows, grad = _sums(node, np.concatenate([p, back], axis=1))
            self._step("chance", rows, grad[:, :FAN])
            self._step("node", rows, grad[:, FAN:])
            self._step("out", level, out)
        to_hidden *= 1 - hidden * hidden
        self._step("bias", slice(None), to_hidden.sum(axis=0))
        for k in range(len(PLACES)):
            rows, grad = _sums(around[k], to_hidden)
            self._step("embed", (k, rows), grad)


def train_window_model(docs: DataFrame, text_col: str = "text", rounds: int = 1) -> np.ndarray:
    """Train on every word of every row. In each round each task starts from the same values, trains on its own rows and
    hands over its values; they are averaged, weighted by words, block by block and in two steps, so that neither a task nor the driver
    holds more than one model and a share of one block. The driver gets the average only. No rows: the initial values.
    """
    spark = docs.sparkSession
    texts = docs.select(quoted(text_col).cast("string").alias("text"))
    flat = initial()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(flat)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, words = shared.value.copy(), 0
            trainer = Trainer(own)
            for batch in batches:
                for _, _, word, around in windows(batch.column(0)):
                    order = np.random.default_rng(5).permutation(len(word))
                    for i in range(0, len(word), BATCH):
                        part = order[i:i + BATCH]
                        trainer.batch(word[part], around[:, part])
                    words += len(word)
            if words:
                cuts = range(0, SIZE, BLOCK)
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cuts)), pa.int32()), pa.array([part] * len(cuts), pa.int32()), pa.array([words] * len(cuts), pa.int64()),
                     pa.array([own[c:c + BLOCK].tobytes() for c in cuts], pa.binary())], ["block", "part", "words", "held"])

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("part")
            total = int(rows["words"].sum())
            mean = sum(np.frombuffer(h, np.float32).astype(np.float64) * (w / total) for h, w in zip(rows["held"], rows["words"]))
            return pd.DataFrame({"block": rows["block"].iloc[:1], "part": rows["part"].iloc[:1], "words": [total], "held": [mean.astype(np.float32).tobytes()]})

        schema = "block int, part int, words bigint, held binary"
        trained = texts.mapInArrow(run, schema)
        some = trained.groupBy("block", F.pmod("part", F.lit(64))).applyInPandas(average, schema)
        blocks = some.groupBy("block").applyInPandas(average, schema).select("block", "held").collect()  # one model
        if blocks:
            flat = np.concatenate([np.frombuffer(r.held, np.float32) for r in sorted(blocks, key=lambda r: r.block)])
        shared.unpersist()
    return flat


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, bucket, n): how often each word of all rows occurs, written once. Words are told apart by 64-bit hashes. Tasks add up what
    they read before the shuffle; the table has a row for each distinct word, however many there are."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times, held = [], [], 0

        def out() -> pa.RecordBatch:
            own, n = _sums(np.concatenate(words), np.concatenate(times))
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(bucket_of(own).astype(np.int32)), pa.array(n)], ["word", "bucket", "n"])

        for batch in batches:
            for _, _, hashes in hashed_words(batch.column(0)):
                own, n = np.unique(hashes, return_counts=True)
                words.append(own)
                times.append(n)
                held += len(own)
                if held >= HELD:
                    yield out()
                    words, times, held = [], [], 0
        if held:
            yield out()

    parts = docs.select(quoted(text_col).cast("string").alias("text")).mapInArrow(run, "word bigint, bucket int, n bigint")
    return materialize(parts.groupBy("word", "bucket").agg(F.sum("n").alias("n")))


def text_scores(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log probability of the buckets of each text."""
    n, total = np.zeros(len(column), np.int64), np.zeros(len(column))
    for at, counts, word, around in windows(column):
        n[at:at + len(counts)] = counts
        total[at:at + len(counts)] = _per_text(_bucket_logs(model, word, around), counts)
    return n, total


def _bucket_logs(model: dict, word: np.ndarray, around: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[forward(model, word[i:i + BATCH], around[:, i:i + BATCH])[2].astype(np.float64)
                                          for i in range(0, len(word), BATCH)]])


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends, total = np.append(0, np.cumsum(counts)), np.append(0.0, np.cumsum(values))
    return total[ends[1:]] - total[ends[:-1]]


def score_texts(df: DataFrame, flat: np.ndarray, text_col: str = "text", counts: DataFrame | None = None, keep_text: bool = True) -> DataFrame:
    """df with n_tokens, log_prob and mean_log_prob of each whole text. Null texts are empty; texts without words have
    n_tokens 0, log_prob 0 and no mean. Columns of df with a result's name are left out, and the text unless keep_text.

    With counts (see word_counts) the scores are those of words: a word that occurs n times has n / (b + 1) of its bucket with b
    occurrences, and all words that never occur share what is left, 1 / (b + 1). Without counts they are those of buckets alone.
    What is broadcast: the network, one number per bucket and the words with more than 1 / COMMON of all occurrences, fewer than
    COMMON. The other words of a text meet their counts in a join; each of them has few rows there.
    """
    base = without(df, RESULT)
    names, spark = base.columns, df.sparkSession
    at = names.index(text_col)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())]
    left = [i for i in range(len(names)) if keep_text or i != at]
    kept = [base.schema.fields[i] for i in left]
    if counts is None:
        shared = spark.sparkContext.broadcast(flat)  # SIZE values

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = views(shared.value)
            for batch in batches:
                n, total = text_scores(batch.column(at), model)
                mean = pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in left], pa.array(n), pa.array(total), mean], [*[names[i] for i in left], *RESULT])

        return base.mapInArrow(run, T.StructType(kept + fields))

    held = np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        held[r.bucket] = r.n
    limit = int(held.sum()) // COMMON
    common = counts.where(F.col("n") > limit).select("word", "n").collect()  # fewer than COMMON
    common_words = np.array([r.word for r in common], np.int64).view(np.uint64)
    order = np.argsort(common_words)
    both = spark.sparkContext.broadcast((flat, np.log(held + 1.0), common_words[order], np.log(np.array([r.n for r in common], np.float64)[order])))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, bucket_log, known, known_log = both.value
        model, row = views(flat), TaskContext.get().partitionId() << 40
        for batch in batches:
            n, total, seldom, sizes = np.zeros(len(batch), np.int64), np.zeros(len(batch)), [np.zeros(0, np.uint64)], np.zeros(len(batch) + 1, np.int64)
            for head, own, hashes in hashed_words(batch.column(at)):
                word, around = _around(bucket_of(hashes), own)
                value = _bucket_logs(model, word, around) - bucket_log[word]
                place = np.searchsorted(known, hashes)
                place[place == len(known)] = 0
                found = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                value[found] += known_log[place[found]]
                n[head:head + len(own)] = own
                total[head:head + len(own)] = _per_text(value, own)
                sizes[head + 1:head + 1 + len(own)] = np.bincount(np.repeat(np.arange(len(own)), own)[~found], minlength=len(own))
                seldom.append(hashes[~found])
            lists = pa.LargeListArray.from_arrays(pa.array(np.cumsum(sizes)), pa.array(np.concatenate(seldom).view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in left], pa.array(n), pa.array(total), pa.array(np.arange(row, row + len(batch))), lists],
                                             [*[names[i] for i in left], "n_tokens", "log_prob", "_row", "_words"])
            row += len(batch)

    own = [*fields[:2], T.StructField("_row", T.LongType()), T.StructField("_words", T.ArrayType(T.LongType()))]
    part = materialize(base.mapInArrow(first, T.StructType(kept + own)))  # once: _row is the same for whoever reads it
    # words that occur once or never have the logarithm 0
    seldom = counts.where(F.col("n").between(2, limit)).select("word", F.log("n").alias("_log"))
    added = part.select("_row", F.explode("_words").alias("word")).join(seldom, "word").groupBy("_row").agg(F.sum("_log").alias("_added"))
    total = F.col("log_prob") + F.coalesce("_added", F.lit(0.0))
    return part.drop("_words").join(added, "_row", "left").select(
        *[quoted(f.name) for f in kept], "n_tokens", total.alias("log_prob"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))
