"""Word shingles of Arrow text columns, as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in chunks of about this many bytes.
CHUNK = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * GOLDEN)


_BYTE = numbers(1, 256)
_BYTE[_SPACE] = 0
_PLACE = [np.cumprod(np.full(64, 0x5851F42D4C957F2D, np.uint64))]


def _powers(n: int) -> np.ndarray:
    if len(_PLACE[0]) < n:
        with np.errstate(over="ignore"):
            _PLACE[0] = np.cumprod(np.full(max(n, 2 * len(_PLACE[0])), 0x5851F42D4C957F2D, np.uint64))
    return _PLACE[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and len + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes; a longer text is a chunk of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def text_parts(batch: pa.RecordBatch, at: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about size bytes in its text column `at`; a longer text is in a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(at).cast(pa.large_string())), 0).to_numpy()
    for first, end in chunks(np.append(0, np.cumsum(lengths, dtype=np.int64)), size):
        yield batch.slice(first, end - first)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, and the number of words of each text."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    data = _LOWER[data]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        value = _BYTE[data[starts[0]:]] * _powers(int(lengths.max()))[place]
        hashes = mix(np.add.reduceat(value, starts - starts[0]))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted. A text of fewer words gives its whole sequence as one; one
    without words gives none."""
    data, offsets = text_bytes(column)
    factors = numbers(2, words) | np.uint64(1)
    for at, to in chunks(offsets, CHUNK // 4):
        own = offsets[at:to + 1]
        hashes, counts = word_hashes(data[own[0]:own[-1]], own - own[0])
        with np.errstate(over="ignore"):
            rows = max(0, len(hashes) - words + 1)
            joined = np.zeros(rows, np.uint64)
            for k in range(words):
                joined += hashes[k:k + rows] * factors[k]
            joined = mix(joined)
            start = 0
            for c in counts.tolist():
                if c >= words:
                    yield np.unique(joined[start:start + c - words + 1])
                elif c:
                    yield mix(np.array([(hashes[start:start + c] * factors[:c]).sum() + np.uint64(c) * GOLDEN]))
                else:
                    yield np.zeros(0, np.uint64)
                start += c
