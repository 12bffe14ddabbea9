"""Phrase collocations counted by direct-address tiling.

Words are ranked by frequency. A pair of ranks is a cell of a square tile; tiles that are hit often are arrays that numpy's bincount
adds to, all other pairs are sorted coordinates with run lengths. Frequent pairs are ranked in turn and paired with the next word, and so on
up to the longest phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from framecv.llm.bloom import BITMAP_BITS
from framecv.llm.common import quoted
from framecv.llm.shingles import chunks, mix, numbers, text_bytes
from framecv.llm.words import hash_words, separators, take_words, word_bounds
from framecv.session import materialize

#: What ends a piece of text, and what separates words inside it.
ENDS = separators(b".,;:!?\n\x0b\x0c\r")
APART = separators(b" \t.,;:!?\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Language of a document without one.
NONE = "und"
#: A tile has TILE x TILE cells. So many words, and so many phrases of each length, have ranks; all others are counted by their hashes.
TILE = 1024
RANKED = 1 << 16
#: A tile is an array while a chunk of text hits at least one in SPARSE of its cells; a task holds so many arrays at a time.
SPARSE, ARRAYS = 64, 6
CHUNK = 1 << 20
#: Rows that are copied out of a batch at a time.
ROWS = 1024
#: Most bits of the filter of frequent phrases (16 MB). Beyond it more infrequent phrases are counted and then left out.
MOST_BITS = 1 << 27


@dataclass
class Level:
    """Frequent phrases of one length. ranked: for a language, its most frequent ones by rank, one row of word hashes each, and the order
    of their keys; filter: one bit for the key of every frequent phrase, ranked or not."""
    ranked: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
    filter: np.ndarray


def _key(words: list[np.ndarray]) -> np.ndarray:
    """One hash for the words of a phrase."""
    if len(words) == 1:
        return words[0]
    with np.errstate(over="ignore"):
        return mix(sum(w * f for w, f in zip(words, numbers(6, len(words)) | np.uint64(1))))


def _of_language(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Word hashes that tell languages apart too, so that counts need no other key."""
    salt = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
    with np.errstate(over="ignore"):
        return mix(hashes ^ np.uint64(salt))


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        wide = mix(keys * np.uint64(0x9E3779B97F4A7C15))
    return [(wide & np.uint64(bits - 1)).astype(np.int64), ((wide >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)]


def _held(level: Level, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for place in _places(keys, len(level.filter) * 8):
        out &= (level.filter[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _ranks(level: Level, words: list[np.ndarray], lang: str) -> np.ndarray:
    """Rank of each phrase, -1 without one. Word hashes decide, not the key alone."""
    if lang not in level.ranked:
        return np.full(len(words[0]), -1, np.int64)
    rows, keys, order = level.ranked[lang]
    at = np.minimum(np.searchsorted(keys, key := _key(words)), len(keys) - 1)
    rank = order[at]
    same = keys[at] == key
    for k, w in enumerate(words):
        same &= rows[rank, k] == w
    return np.where(same, rank, -1)


def _spans(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, bytes, word starts, ends, hashes, piece numbers) of chunks of whole texts of one language."""
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            data, offsets = text_bytes(batch.column(1).filter(pc.equal(langs.indices, k)))
            for at, to in chunks(offsets, CHUNK):
                own = offsets[at:to + 1]
                part = _LOWER[data[own[0]:own[-1]]]
                own = own - own[0]
                starts, ends = word_bounds(part, own, APART)
                if len(starts):
                    cuts = np.cumsum(ENDS[part], dtype=np.int32)
                    # a text's own number on top, so that no piece spans two texts
                    piece = cuts[starts] + np.searchsorted(own, starts, "right")
                    yield lang, part, starts, ends, _of_language(hash_words(part, starts, ends, seed), lang), piece


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of equally long columns and how often each occurs, by sorting."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    heads = np.flatnonzero(new)
    return [c[heads] for c in columns], np.diff(np.append(heads, len(order)))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, text) to (lang, hash, word, n): occurrences of every word."""
    def run(batches):
        for lang, data, starts, ends, hashes, _ in _spans(batches, seed):
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            for k in range(0, len(found), 50_000):
                own = first[k:k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), _signed(found[k:k + 50_000]), take_words(data, starts[own], ends[own]),
                                                  pa.array(n[k:k + 50_000])], ["lang", "hash", "word", "n"])

    return texts.mapInArrow(run, "lang string, hash bigint, word string, n bigint").groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))


def level_of(frequent: DataFrame, length: int) -> Level:
    """Ranks and filter of the frequent phrases (lang, w0, w1, ..., n) of a length. The driver gets RANKED rows, and the filter's bytes."""
    words = [f"w{k}" for k in range(length)]
    # the most frequent ones by bins of the count's logarithm, as many whole bins as RANKED holds: which phrases have ranks changes no result
    bin_of = F.floor(F.log(F.col("n").cast("double")) * 64)
    bins = sorted(((r.bin, r.n) for r in frequent.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    held = [b for (b, _), total in zip(bins, np.cumsum([n for _, n in bins])) if total <= RANKED]
    top = frequent.where(bin_of >= min(held)) if held else frequent.limit(0)
    top = top.select("lang", *words, "n").toPandas().sort_values(["n", "lang", *words], ascending=[False] + [True] * (length + 1))
    ranked = {}
    for lang, own in top.groupby("lang", sort=False):
        rows = own[words].to_numpy().astype(np.int64).view(np.uint64).reshape(-1, length)
        keys = _key([rows[:, k] for k in range(length)])
        order = np.argsort(keys, kind="stable")
        ranked[lang] = (rows, keys[order], order)
    bits = BITMAP_BITS
    most = sum(n for _, n in bins)
    while bits < 16 * most and bits < MOST_BITS:
        bits *= 2

    def places(batches):
        for batch in batches:
            keys = _key([batch.column(k).to_numpy().view(np.uint64) for k in range(length)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(keys, bits)))], ["at"])

    # bitmap functions count bits from 1
    maps = (frequent.select(*words).mapInArrow(places, "at bigint").distinct().groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("map")).collect())
    table = np.zeros(bits // 8, np.uint8)
    for r in maps:
        size = BITMAP_BITS // 8
        table[(r.bucket - 1) * size:r.bucket * size] = np.frombuffer(r.map, np.uint8)
    return Level(ranked, table)


class _Tiles:
    """Counts of (row rank, column rank) cells of one language: arrays for tiles that are hit often, sorted coordinates for the rest."""

    def __init__(self):
        self.arrays: dict[tuple[str, int, int], np.ndarray] = {}
        self.hits = 0

    def add(self, lang: str, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds to arrays; gives back the sparse rest as distinct (row, column) with counts."""
        across = RANKED // TILE
        tile = (rows // TILE) * across + columns // TILE
        hits = np.bincount(tile, minlength=1)
        dense = np.flatnonzero(hits >= TILE * TILE // SPARSE)
        sparse = np.ones(len(tile), bool)
        for t in dense.tolist():
            own = tile == t
            sparse &= ~own
            cells = np.bincount((rows[own] % TILE) * TILE + columns[own] % TILE, minlength=TILE * TILE).astype(np.uint32)
            self.hits += int(hits[t])
            key = (lang, t // across, t % across)
            if key in self.arrays:
                self.arrays[key] += cells
            else:
                self.arrays[key] = cells
        codes, n = np.unique(rows[sparse] * RANKED + columns[sparse], return_counts=True)
        return codes // RANKED, codes % RANKED, n

    def flush(self, least: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """The cells of all arrays, if there are `least` arrays or more, or before a cell could overflow."""
        if len(self.arrays) >= least or self.hits >= 1 << 31:
            for (lang, i, j), cells in self.arrays.items():
                at = np.flatnonzero(cells)
                yield lang, i * TILE + at // TILE, j * TILE + at % TILE, cells[at]
            self.arrays.clear()
            self.hits = 0


def phrase_counts(texts: DataFrame, words: Level, shorter: Level, length: int, seed: int) -> DataFrame:
    """(w0, ..., n): occurrences of phrases of `length` words inside pieces, of which every word, the phrase without its last word and that without its
    first are frequent (or pass for it in the filters). The row of a tile is the rank of the phrase without its last word, the column that of the last word."""
    shared = texts.sparkSession.sparkContext.broadcast((words, shorter))
    names = [f"w{k}" for k in range(length)]

    def run(batches):
        single, stem = shared.value
        tiles = _Tiles()

        def out(columns, n):
            for k in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([*[_signed(np.ascontiguousarray(c[k:k + 100_000])) for c in columns], pa.array(n[k:k + 100_000].astype(np.int64))],
                                                 [*names, "n"])

        def named(lang, rows, columns, n):
            return out([*stem.ranked[lang][0][rows].T, single.ranked[lang][0][columns, 0]], n)

        for lang, _, _, _, hashes, piece in _spans(batches, seed):
            ok = _held(single, hashes)
            starts = np.arange(max(0, len(hashes) - length + 1))
            fine = piece[starts] == piece[starts + length - 1]
            for k in range(length):
                fine &= ok[starts + k]
            starts = starts[fine]
            if length > 2:
                for k in (0, 1):
                    starts = starts[_held(stem, _key([hashes[starts + k + i] for i in range(length - 1)]))]
            phrase = [hashes[starts + k] for k in range(length)]
            rows, columns = _ranks(stem, phrase[:-1], lang), _ranks(single, phrase[-1:], lang)
            both = (rows >= 0) & (columns >= 0)
            if both.any():
                yield from named(lang, *tiles.add(lang, rows[both], columns[both]))
            if not both.all():
                yield from out(*_runs([w[~both] for w in phrase]))
            for cells in tiles.flush(ARRAYS):
                yield from named(*cells)
        for cells in tiles.flush(1):
            yield from named(*cells)

    schema = ", ".join(f"{w} bigint" for w in names) + ", n bigint"
    return texts.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly. As a is at most l and r, the doubles' estimate is one off at most; decimals of 38 digits settle it while
    counts are below 3e15."""
    def wide(c):
        return c.cast("decimal(38,0)")

    guess = F.floor(F.lit(1e6) * (a / left) * (a / right))
    top, base = wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right)
    return F.when(wide(guess) * base > top, guess - 1).when(wide(guess + 1) * base <= top, guess + 1).otherwise(guess).cast("bigint")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, absorb: int = 50, first: int = 2000,
                 seed: int = 9) -> DataFrame:
    """The `first` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and pieces into words at blanks and tabs. n counts the words of a language, a the
    occurrences of a phrase of 2 to `longest` words inside pieces, `least` at least. Of its cuts into two parts with l and r occurrences the one with the
    lowest score floor(1000000 a a / (l r)) counts, ties to the shortest first part. A phrase whose words lie inside a longer phrase with `absorb` percent of its
    occurrences or more is left out. Order: score, then a, falling, then the phrase as UTF-8 bytes.

    Null texts are empty, a null language is `und`; repeated rows count each time; languages without a frequent phrase give no row, nor does an empty
    table. Other columns are not read. All counts cover all texts: a phrase is frequent only if its parts are, so each length counts only phrases
    of frequent parts. Words are told apart by 64-bit hashes of word and language; if two share one, all is done again with other
    hashes. What is broadcast: RANKED ranked phrases a length and a filter of 16 MB at most.
    """
    texts = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit(NONE)).alias("lang"), quoted(text_col).cast("string").alias("text"))
    every = materialize(word_counts(texts, seed))
    if every.groupBy("hash").count().where("count > 1").limit(1).collect():
        return collocations(docs, text_col, lang_col, longest, least, absorb, first, seed + 100)
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    vocabulary = materialize(every.where(F.col("n") >= least).select("lang", F.col("hash").alias("w0"), "word", "n"))
    words = shorter = level_of(vocabulary, 1)
    counted = [vocabulary.select("lang", F.array("w0").alias("key"), "n")]
    for length in range(2, longest + 1):
        found = phrase_counts(texts, words, shorter, length, seed).where(F.col("n") >= least)
        found = materialize(found.join(vocabulary.select("w0", "lang"), "w0"))
        counted.append(found.select("lang", F.array(*[f"w{k}" for k in range(length)]).alias("key"), "n"))
        if length < longest:
            shorter = level_of(found, length)
    phrases = reduce(DataFrame.unionByName, counted)
    candidates = phrases.where(F.size("key") > 1)

    cuts = candidates.select("lang", "key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    size = F.size("key")
    cuts = cuts.withColumns({"left": F.slice("key", F.lit(1), F.col("k")), "right": F.slice("key", F.col("k") + 1, size - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select(F.col("key").alias(side), F.col("n").alias(name)), [side])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    lowest = cuts.groupBy("lang", "key").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))

    longer = candidates.where(F.size("key") > 2)
    inside = longer.select("n", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda s: F.slice("key", s, m))))).alias("key"))
    over = inside.groupBy("key").agg(F.max("n").alias("over"))
    kept = lowest.join(over, ["key"], "left").where(F.coalesce(F.col("over") * 100 < F.col("cut.a") * absorb, F.lit(True))).select("lang", "key", "cut.*")

    for k in range(longest):
        name = vocabulary.select(F.col("w0").alias(f"_w{k}"), F.col("word").alias(f"_t{k}"))
        kept = kept.withColumn(f"_w{k}", F.get("key", F.lit(k))).join(name, [f"_w{k}"], "left")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *[f"_t{k}" for k in range(longest)]))
    # the first of each of 64 parts of a language, then the first of those
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = kept.select("lang", "phrase", "a", "l", "r", "score").withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= first)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
