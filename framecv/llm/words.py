"""Words of Arrow text columns by a table of separators, with 64-bit hashes, in numpy; and sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framecv.llm.shingles import CHUNK, mix, numbers

_STEP = 0x5851F42D4C957F2D
_POWERS = np.cumprod(np.full(CHUNK, _STEP, np.uint64))


def separators(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of several texts; no word spans two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~apart[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    heads = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[heads] |= word[heads]
    last[heads - 1] |= word[heads - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes. What is held at once is a few arrays of about CHUNK bytes' words, however long a word is."""
    values = numbers(seed, 256)
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            if sizes[at] > CHUNK:  # block by block
                total = 0
                for k in range(0, int(sizes[at]), CHUNK):
                    block = data[starts[at] + k:min(starts[at] + k + CHUNK, ends[at])]
                    total += int((values[block] * _POWERS[:len(block)]).sum()) * pow(_STEP, k, 1 << 64)
                out[at] = np.uint64(total & 0xFFFFFFFFFFFFFFFF)
                at += 1
                continue
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
            own = sizes[at:to]
            heads = np.cumsum(own) - own
            place = np.arange(int(own.sum())) - np.repeat(heads, own)
            out[at:to] = np.add.reduceat(values[data[place + np.repeat(starts[at:to], own)]] * _POWERS[place], heads)
            at = to
        return mix(out)


def take_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as strings."""
    sizes = ends - starts
    offsets = np.append(0, np.cumsum(sizes))
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(starts, sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[place])]
                                            ).cast(pa.large_string()).cast(pa.string())


def summed(rows: DataFrame, task: Callable[[Iterable[pa.RecordBatch]], np.ndarray | None], size: int) -> np.ndarray:
    """task(batches) gives one array of `size` doubles a task, or None; their sum goes to the driver.

    The arrays are added up by place in the shuffle, places with zero left out, so the driver gets at most `size` rows whatever the number of tasks.
    """
    def run(batches):
        total = task(batches)
        if total is not None:
            total = total.ravel()
            places = np.flatnonzero(total)
            for k in range(0, len(places), 100_000):
                part = places[k:k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["at", "value"])

    table = rows.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[table.column("at").to_numpy()] = table.column("value").to_numpy()
    return out
