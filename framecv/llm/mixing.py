"""Mixing sources to target weights by Pfair scheduling.

A source with the share w gets its i-th block (from 0) released at slot floor(i / w) and due at slot ceil((i + 1) / w).
Earliest deadline first over the released blocks fills one slot after the other, and after any number of
slots no source is a whole block away from its share.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F

from framecv.llm.common import quoted, without
from framecv.session import materialize

RESULT = ("slot", "position", "release", "deadline", "in_mix")


def whole_shares(weights: dict, period: int) -> dict:
    """Weights as whole slots of a period, by largest remainder, at least one for each positive weight."""
    positive = {s: float(w) for s, w in weights.items() if w and w > 0}
    if not positive:
        return {}
    if period < len(positive):
        raise ValueError("the period needs a slot for each source")
    total = sum(positive.values())
    exact = {s: period * w / total for s, w in positive.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(positive, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    while sum(shares.values()) < period:
        for s in order:
            if sum(shares.values()) < period:
                shares[s] += 1
    while sum(shares.values()) > period:
        shares[max(shares, key=lambda s: (shares[s] - exact[s] if shares[s] > 1 else -period, str(s)))] -= 1
    return shares


def pfair_period(shares: dict) -> list[tuple[object, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one period. The schedule repeats after it, as shares are whole."""
    period = sum(shares.values())
    waiting = [(i * period // n, -(-(i + 1) * period // n), s, i) for s, n in shares.items() for i in range(n)]
    waiting.sort(key=lambda b: (b[0], b[1], str(b[2]), b[3]))
    ready: list = []
    out, at = [], 0
    for slot in range(period):
        while at < len(waiting) and waiting[at][0] <= slot:
            release, due, s, i = waiting[at]
            heapq.heappush(ready, (due, str(s), i, release, s))
            at += 1
        due, _, i, release, s = heapq.heappop(ready)
        out.append((s, i, slot, release, due))
    return out


#: A schedule of at most so many slots is made from the weights themselves; longer mixes repeat a period of as many slots.
LONGEST = 1 << 20


def whole_weights(weights: dict) -> dict:
    """The positive weights as whole numbers in exactly their proportions (doubles are binary fractions)."""
    exact = {s: Fraction(float(w)) for s, w in weights.items() if w and w > 0}
    scale = math.lcm(*[w.denominator for w in exact.values()]) if exact else 1
    return {s: int(w * scale) for s, w in exact.items()}


def pfair_slots(weights: dict, length: int) -> list[tuple[object, int, int, int, int]]:
    """(source, block, slot, release, deadline) of the first slots under the exact weights, earliest deadline first.

    Each source waits with one block at a time: the next is ready once the one before has its slot and its own release has come.
    """
    whole = whole_weights(weights)
    total = sum(whole.values())
    names = sorted(whole, key=str)
    later = [(0, k, 0) for k in range(len(names))]  # (release, source, block)
    ready: list = []
    out = []
    for slot in range(length if names else 0):
        while later and later[0][0] <= slot:
            release, k, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(i + 1) * total // whole[names[k]]), k, i, release))
        due, k, i, release = heapq.heappop(ready)
        out.append((names[k], i, slot, release, due))
        heapq.heappush(later, ((i + 1) * total // whole[names[k]], k, i + 1))
    return out


def tempered_weights(docs: DataFrame, source_col: str = "source", power: float = 0.7) -> dict:
    """Target weights: the number of documents of a source to the given power. One row per source goes to the driver."""
    rows = docs.groupBy(quoted(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.source: r.n ** power for r in sorted(rows, key=lambda r: (r.source is None, r.source or ""))}


def horizon(counts: dict, shares: dict, block: int, slack: float = 0.01) -> int:
    """Number of slots of the mix: the most for which the slots of sources that have run out are at most the
    share `slack` of all. Sources run out one by one; between two such points the empty slots grow evenly."""
    period = sum(shares.values())
    ends = sorted((-(-counts.get(s, 0) // block) * period / n, n) for s, n in shares.items())
    best, empty_rate, owed = 0.0, 0.0, 0.0
    for k, (end, n) in enumerate(ends):
        empty_rate += n / period
        owed += end * n / period
        until = ends[k + 1][0] if k + 1 < len(ends) else end
        # empty slots at t: empty_rate * t - owed
        reach = owed / (empty_rate - slack) if empty_rate > slack else until
        best = max(best, min(max(reach, end), until))
        if reach < until:
            break
    return int(best + 1e-9)


def mix_sources(docs: DataFrame, weights: dict, id_col: str = "doc_id", source_col: str = "source", block: int = 16, period: int | None = None,
                slack: float = 0.01, seed: int = 7, cell_rows: int = 20_000) -> DataFrame:
    """Every row and column of docs and its place in the mix: slot, position inside the slot's block, release, deadline
    and in_mix.

    Sources are dealt in blocks of `block` rows in the order of a seeded hash of the id. A row's slot follows from its number in its source. A mix of up to LONGEST slots is
    scheduled slot by slot with the weights as they are, so that after any number of slots every source is less than a block from its target. A longer one, or one with a given
    `period`, repeats the schedule of a period, with weights rounded to whole slots of it (one at least): then a source is less than a block, and the rounding of up to a slot a
    period for each source, from its target. All rows find their slots at the same time. Rows beyond the mix's end (see horizon) have in_mix false; under exact weights their slot is the
    last one before their deadline, which others may have too. Sources without a positive weight have a null slot. Nothing is dropped or repeated.

    Row numbers within a source: hash ranges of about cell_rows rows are numbered apart and offset by the ranges
    before them, so a source with a third of all rows is spread like any other. What is broadcast: one row per
    source and slot of the period. The weights name the sources, null included. Null ids come first. Columns of
    docs with a result's name are left out. An empty table gives an empty result.
    """
    base = without(docs, RESULT)
    spark = docs.sparkSession
    names = [quoted(c) for c in base.columns]
    src = quoted(source_col)
    counts = {r.source: r.n for r in base.groupBy(src.alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()}
    given = {s: float(w) for s, w in weights.items() if counts.get(s) and w and w > 0}
    length = horizon(counts, given, block, slack) if given else 0
    exact = period is None and length <= LONGEST
    if exact:
        shares, table = given, pfair_slots(given, length)
    else:
        shares = whole_shares(given, max(period or LONGEST, len(given)))
        length = horizon(counts, shares, block, slack) if shares else 0
        table = pfair_period(shares)
    cycle = sum(shares.values())
    cells = max(1, -(-sum(counts.values()) // cell_rows))
    ordered = base.withColumns({"_key": F.xxhash64(quoted(id_col), F.lit(seed)), "_tie": quoted(id_col)}).withColumn(
        "_cell", F.floor(F.shiftrightunsigned(F.col("_key"), 33) * F.lit(cells) / F.lit(2 ** 31)))
    sizes = ordered.groupBy(src.alias("_s"), F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = materialize(sizes.withColumn("_before", F.expr("sum(_n) over (partition by _s order by _c) - _n")).drop("_n"))
    row = F.expr("row_number() over (partition by _s, _cell order by shiftrightunsigned(_key, 33), _key, _tie) - 1")
    numbered = ordered.join(before, src.eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c"))).withColumn(
        "_at", F.col("_before") + row)
    kind = dict(base.dtypes)[source_col]
    slots = spark.createDataFrame(table, f"_src {kind}, _block bigint, _slot bigint, _release bigint, _due bigint")
    per_source = spark.createDataFrame([(s, float(w)) for s, w in shares.items()], f"_src {kind}, _share double")
    block_no, share = F.floor(F.col("_at") / block), F.col("_share")
    with_share = numbered.join(F.broadcast(per_source), F.col("_s").eqNullSafe(F.col("_src")), "left").drop("_src")
    turn = F.lit(0).cast("bigint") if exact else F.floor(block_no / share)
    with_share = with_share.withColumns({"_turn": turn, "_in": block_no if exact else (block_no % share.cast("bigint"))})
    # at most LONGEST rows, or those of the given period
    placed = with_share.join(F.broadcast(slots), F.col("_s").eqNullSafe(F.col("_src")) & (F.col("_in") == F.col("_block")), "left")
    shift = F.col("_turn") * F.lit(int(cycle)) if not exact else F.lit(0)
    release, due = F.col("_release") + shift, F.col("_due") + shift
    slot = (F.col("_slot") + shift).cast("bigint")
    if exact:  # beyond the schedule: the block's own release and deadline
        release = F.coalesce(release, F.floor(block_no * (F.lit(cycle) / share)))
        due = F.coalesce(due, F.ceil((block_no + 1) * (F.lit(cycle) / share)))
        slot = F.coalesce(slot, F.when(share.isNotNull(), F.greatest(due - 1, F.lit(length)))).cast("bigint")
    return placed.select(*names, slot.alias("slot"), (F.col("_at") % block).cast("int").alias("position"),
                         release.cast("bigint").alias("release"), due.cast("bigint").alias("deadline"),
                         F.coalesce((slot < length) & (F.col("_slot").isNotNull() | F.lit(not exact)), F.lit(False)).alias("in_mix"))


def keep_mix(docs: DataFrame, power: float = 0.7, id_col: str = "doc_id", source_col: str = "source", seed: int = 7, **more) -> DataFrame:
    """The rows of docs that are in the mix under tempered weights, with the columns of docs.

    A source's rows in the mix are its first ones in the order of the hash, so only ids and sources are numbered; the last
    row of each source (one row per source is broadcast) then decides row by row, and texts are not shuffled.
    Rows that repeat an id stay or go together.
    """
    placed = mix_sources(docs.select(quoted(id_col), quoted(source_col)), tempered_weights(docs, source_col, power), id_col, source_col,
                         seed=seed, **more)
    key = F.xxhash64(quoted(id_col), F.lit(seed))
    spot = F.struct(F.shiftrightunsigned(key, 33).alias("high"), key.alias("key"), quoted(id_col).alias("id"))
    last = materialize(placed.where("in_mix").groupBy(quoted(source_col).alias("_source")).agg(F.max(spot).alias("_last")))
    return docs.join(F.broadcast(last), quoted(source_col).eqNullSafe(F.col("_source"))).where(spot <= F.col("_last")).select(
        *[quoted(c) for c in docs.columns])


def mix_all(docs: DataFrame, power: float = 0.7, id_col: str = "doc_id", source_col: str = "source", **more) -> DataFrame:
    """Every row of docs, with the columns of docs, sorted by its place in the mix under tempered weights.

    A source that has run out leaves the schedule: its slots are skipped, so the others fill them in proportion to their
    shares, and the mix ends with the last row of the last source. Rows without a slot, of which tempered weights leave none,
    come last. The schedule's slots keep their order when some are skipped, so the order of mix_sources is the result's.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(source_col).alias("source"), F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    placed = mix_sources(rows, tempered_weights(docs, source_col, power), "id", "source", **more)
    return placed.orderBy(F.col("slot").asc_nulls_last(), "position").select("row.*")
