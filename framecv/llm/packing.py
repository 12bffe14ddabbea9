"""Packing documents into token sequences: best fit, then swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framecv.llm.common import quoted
from framecv.llm.near_dedup import by_key
from framecv.llm.tokens import encoded
from framecv.session import materialize

CAPACITY = 2048
#: Id after each document.
STOP = 0


def cut_points(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document start: whole capacities, the first one may be shorter."""
    head = length % capacity or capacity
    return [0, *range(head, length, capacity)] if length > capacity else [0]


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 with_ids: bool = False, added: bool = False, group: Column | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the ids of each whole text and STOP at the end, cut into pieces.

    vocabulary is the path of the tokenizer file on every machine. ids_crc32 is over the ids as little-endian unsigned
    32-bit numbers. with_ids adds them as an array of ids; added: see encoded. Null counts as empty and gives one piece with STOP.
    A group is carried along as _group.
    """
    kind, grouped = dict(docs.dtypes)[id_col], group is not None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, ids in enumerate(encoded(batch.column(1).to_pylist(), vocabulary, added)):
                ids += STOP.to_bytes(4, "little")
                starts = cut_points(len(ids) // 4, capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4])):
                    part = ids[4 * a:4 * b]
                    rows.append((i, piece, a, b - a, zlib.crc32(part), np.frombuffer(part, "<u4") if with_ids else None))
            own, piece, start, length, crc, parts = zip(*rows) if rows else [()] * 6
            out = [batch.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array(parts, pa.list_(pa.int64())))
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"][:len(out)]
            if grouped:
                out.append(batch.column(2).take(pa.array(own, pa.int64())))
                names.append("_group")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    given = [] if not grouped else [group.cast("bigint").alias("_group")]
    return docs.select(quoted(id_col), quoted(text_col).cast("string"), *given).mapInArrow(run, schema + (", _group bigint" if given else ""))


# ---- one group of pieces ---------------------------------------------------------------------

def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each piece: longest first, each into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    free = 0  # bit r is set if some bin has the free room r
    bins, out = 0, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        fitting = free >> need
        if fitting:
            r = need + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            b, r, bins = bins, capacity, bins + 1
        out[i] = b
        room[r - need].append(b)
        free |= 1 << (r - need)
    return out


def local_search(lengths: list[int], bins: list[int], capacity: int) -> list[int]:
    """Empty the emptiest bins: a piece moves to another bin, or one or two of its pieces are exchanged for a shorter one of
    a bin that is at least as full, so that the other bin stays within the capacity and the sum of squared fills
    grows. It ends when the bins are as few as the total allows or no exchange is left."""
    size, bin_of = np.array(lengths), np.array(bins)
    fill = np.bincount(bin_of, size).astype(np.int64)
    least = -(-int(size.sum()) // capacity)
    used = int((fill > 0).sum())
    open_bins = fill < capacity
    rows = np.flatnonzero(open_bins[bin_of])  # pieces of underfull bins
    size, held = size[rows], bin_of[rows]

    def step(donor: int) -> bool:
        own = np.flatnonzero(held == donor)
        spare = capacity - fill
        for d in own[np.argsort(-size[own], kind="stable")].tolist():  # moves
            fits = np.flatnonzero((spare >= size[d]) & (fill > 0) & (fill + size[d] > fill[donor]))
            fits = fits[fits != donor]
            if len(fits):
                to = fits[np.argmin(spare[fits])]
                fill[donor] -= size[d]
                fill[to] += size[d]
                held[d] = to
                return True
        # one document of each length, and each pair of lengths: a bin of distinct lengths holds few, as their sum is bounded
        lengths: dict[int, list[int]] = {}
        for d in own.tolist():
            lengths.setdefault(int(size[d]), []).append(d)
        gives = {n: (ds[0],) for n, ds in lengths.items()}
        for (n, ds), (m, es) in combinations(lengths.items(), 2):
            gives.setdefault(n + m, (ds[0], es[0]))
        for n, ds in lengths.items():
            if len(ds) > 1:
                gives.setdefault(2 * n, (ds[0], ds[1]))
        for total, given in sorted(gives.items(), reverse=True):
            ok = np.flatnonzero((held != donor) & (size < total) & (size + spare[held] >= total) & (fill[held] >= fill[donor]))
            if len(ok):
                x = ok[np.argmin(size[ok])]
                to = held[x]
                gain = total - size[x]
                fill[to] += gain
                fill[donor] -= gain
                held[list(given)] = to
                held[x] = donor
                return True
        return False

    stuck: set[int] = set()
    while used > least:
        live = [b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b not in stuck]
        if not live:
            break
        donor = min(live, key=lambda b: (fill[b], b))
        if step(donor):
            stuck.clear()
            used -= fill[donor] == 0
        else:
            stuck.add(donor)
    bin_of[rows] = held
    return bin_of.tolist()


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin (numbered without gaps) and offset of each piece."""
    bins = local_search(lengths, best_fit(lengths, capacity), capacity) if lengths else []
    number: dict[int, int] = {}
    at: dict[int, int] = {}
    places, offsets = [], []
    for length, b in zip(lengths, bins):
        places.append(number.setdefault(b, len(number)))
        offsets.append(at.get(b, 0))
        at[b] = offsets[-1] + length
    return places, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = 16_384) -> DataFrame:
    """pieces(id, piece, length, ...) of at most `capacity` each, with sequence_id and offset; without _group.

    Pieces with a _group (a number below 2^39) are packed in it, and sequence ids rise with the group; all others are dealt into groups.

    Full pieces are sequences of their own. The others are dealt by hash into groups of about group_rows, each packed
    in one task; a group leaves about one sequence that is not full. Groups are as many as the input needs, so what a task
    holds does not grow. Null ids and repeated rows are packed like any other row. An empty table gives an empty result.
    """
    own_groups = "_group" in pieces.columns
    groups = 1 if own_groups else max(1, -(-pieces.agg(F.count(F.lit(1))).first()[0] // group_rows))
    names = [c for c in pieces.columns if c != "_group"]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id bigint, offset bigint"

    def run(batches):
        for table in by_key(batches):
            keys = table.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for head, end in zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist()):
                part = table.slice(head, end - head).combine_chunks()
                places, offsets = pack_group(part.column("length").to_pylist(), capacity)
                first = int(keys[head]) << 24
                own = part.select(names).append_column("sequence_id", pa.array([first + p for p in places], pa.int64()))
                yield from own.append_column("offset", pa.array(offsets, pa.int64())).to_batches()

    # rows that repeat are told apart by their place, so that they do not all fall into one group
    drawn = F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    dealt = pieces.select(F.col("_group") if own_groups else drawn.alias("_group"), *[quoted(n) for n in names])
    return dealt.repartition("_group").sortWithinPartitions("_group", F.desc("length"), "id", "piece").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   group_rows: int = 16_384, with_ids: bool = False, added: bool = False, group: Column | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every document with STOP at its end is packed whole, only longer ones than capacity are cut. The pieces without
    their texts are written once, then packed. Other columns of docs are left out. `group`, a number for each document, packs the documents of a group
    together, with sequence ids that rise with it.
    """
    pieces = materialize(token_pieces(docs, vocabulary, id_col, text_col, capacity, with_ids, added, group))
    packed = pack_pieces(pieces, capacity, group_rows)
    return packed.withColumnRenamed("id", id_col)
