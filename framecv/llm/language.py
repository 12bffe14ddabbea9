"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: a slot holds a bitmask with one bit per language, so the masks of an n-gram's
slots, taken together with AND, are the set of all languages that contain it. A document counts its n-grams per
language; the counts are corrected for each filter's false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framecv.llm.common import quoted, without
from framecv.llm.shingles import CHUNK, chunks, mix, text_bytes, text_parts

SIZES = (3, 4)
SLOTS = 1 << 21
HASHES = 3
#: At most so many languages: the bits of a mask.
LANGUAGES = 63
RESULT = ("lang_pred", "score")
NONE = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    fallback: int


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: hashes of the byte n-grams of the words (and the blanks next to them), and their number per text.

    data is lower-cased UTF-8. Bytes that cannot belong to a letter are blanks; n-grams with a blank inside are left out.
    """
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    value = np.where(letter, data, 32).astype(np.uint32)
    fill = np.concatenate([value, np.full(8, 32, np.uint32)])
    held = np.concatenate([letter, np.zeros(8, bool)])
    n = len(value)
    for size in SIZES:
        code = np.zeros(n, np.uint32)
        inside = np.ones(n, bool)
        for k in range(size):
            code = code * np.uint32(0x01000193) ^ fill[k:k + n]
            if 0 < k < size - 1:
                inside &= held[k:k + n]
        for k in range(1, size):
            at = offsets[1:] - k
            inside[at[at >= 0]] = False  # an n-gram does not reach beyond its text
        where = np.flatnonzero(inside)
        yield (code[where] ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)), np.diff(np.searchsorted(where, offsets))


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _places(codes, hashes: int = HASHES, slots: int = SLOTS) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        wide = mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return [((wide >> np.uint64(21 * k)) % np.uint64(slots)).astype(np.int64) for k in range(hashes)]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, text) to (lang, gram, n). Every task adds up its own counts before they are shuffled."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[heads], np.add.reduceat(np.concatenate([c for _, c in parts])[order], heads)

        for part in (x for batch in batches for x in text_parts(batch, 1, 4 * CHUNK)):
            langs = part.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = _lower(part.column(1).filter(pc.equal(langs.indices, k)))
                data, offsets = text_bytes(texts)
                for at, to in chunks(offsets):
                    own = offsets[at:to + 1]
                    for codes, _ in _grams(data[own[0]:own[-1]], own - own[0]):
                        if len(codes):
                            held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                    if len(held.get(lang, ())) >= 8:
                        held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            keys, counts = merged(parts)
            for i in range(0, len(keys), 100_000):
                part = keys[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int64)),
                                                  pa.array(counts[i:i + 100_000].astype(np.int64))], ["lang", "gram", "n"])

    return (labelled.mapInArrow(run, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def train_languages(labelled: DataFrame, lang: str = "lang", text: str = "text", rate: float = 1e-5, ratio: float = 0.1) -> LanguageModel:
    """Learn the filters from all rows with a language.

    An n-gram belongs to a language if it makes up `rate` of the language's n-grams or more (so at most 1 / rate
    belong to one, and the filters have a fixed size) and its share is at least `ratio` of its largest share in any
    language (so that quoted foreign text does not count). Counting covers all rows; the driver gets the filled slots,
    at most SLOTS of them, and one row per language. More than 63 languages are refused. Null or empty texts add nothing.
    """
    rows = labelled.select(quoted(lang).cast("string").alias("lang"), quoted(text).cast("string").alias("text")).where("lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = [r.lang for r in sizes]
    if not languages:
        return LanguageModel([], np.zeros(SLOTS, np.uint8), np.zeros(0), 0)
    counts = gram_counts(rows)
    bit = F.element_at(F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(1 << i).cast("bigint"))]), F.col("lang"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))  # one row per language
    per_gram = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("held"))
    chosen = per_gram.where(F.col("top") >= rate).select("gram", "top", F.explode("held").alias("h")).where(
        (F.col("h.share") >= rate) & (F.col("h.share") >= F.col("top") * ratio)).select("gram", F.col("h.lang").alias("lang"))
    masks = chosen.select("gram", bit.alias("bit")).groupBy("gram").agg(F.bit_or("bit").alias("mask"))

    def place(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy().astype(np.uint32)
            places = _places(codes)
            mask = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), pa.array(np.tile(mask, HASHES))], ["slot", "mask"])

    slots = masks.mapInArrow(place, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= bits)
    table = np.zeros(SLOTS, kind)
    table[slots.column("slot").to_numpy()] = slots.column("mask").to_numpy().astype(kind)
    filled = np.array([np.count_nonzero(table & kind(1 << i)) / SLOTS for i in range(len(languages))])
    fallback = max(range(len(languages)), key=lambda i: sizes[i].n)
    return LanguageModel(languages, table, filled ** HASHES, fallback)


def _scores(column: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Corrected counts per text and language, and the number of n-grams."""
    data, offsets = text_bytes(_lower(column))
    found = np.zeros((len(column), len(model.languages)))
    total = np.zeros(len(column))
    for at, to in chunks(offsets, CHUNK // 4):
        own = offsets[at:to + 1]
        for codes, sizes in _grams(data[own[0]:own[-1]], own - own[0]):
            if not len(codes):
                continue
            places = _places(codes)
            mask = model.masks[places[0]]
            for more in places[1:]:
                mask = mask & model.masks[more]
            ends = np.append(0, np.cumsum(sizes))
            for i in range(len(model.languages)):
                hits = np.append(0, np.cumsum((mask >> mask.dtype.type(i)) & mask.dtype.type(1), dtype=np.int64))
                found[at:to, i] += hits[ends[1:]] - hits[ends[:-1]]
            total[at:to] += sizes
    rate = np.minimum(model.false_rate, 0.999)
    return np.maximum(0.0, (found - total[:, None] * rate) / (1 - rate)), total


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred and score, the corrected share of the text's n-grams that the language contains (0 to 1).

    Null texts and texts without a letter get `und` and 0, as does every text if no language was learned. Equal
    counts go to the first language by name; a text with letters but without any known n-gram gets the language with
    the most training rows and 0. Columns of df with a result's name are left out. A batch is scored and returned in
    slices of about CHUNK bytes of text, so a task needs little beyond the batch it is given.
    """
    base = without(df, RESULT)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = base.columns
    at = names.index(text)

    def run(batches):
        known = shared.value
        for part in (x for batch in batches for x in text_parts(batch, at)):
            column = part.column(at)
            letters = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if known.languages:
                found, total = _scores(column, known)
                best = found.argmax(axis=1)
                high = found[np.arange(len(best)), best]
                best = np.where(high > 0, best, known.fallback)
                score = np.where(letters & (total > 0), np.clip(high / np.maximum(total, 1), 0.0, 1.0), 0.0)
                pred = [known.languages[b] if ok else NONE for b, ok in zip(best.tolist(), letters.tolist())]
            else:
                pred, score = [NONE] * part.num_rows, np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*names, *RESULT])

    schema = T.StructType(base.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids that is never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def keep_known_languages(docs: DataFrame, least: float = 0.2, id_col: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows in a language that the filters know: not `und`, and at least the share `least` of the n-grams known.

    Every column goes through the filters once, under a name that no result has, and gets its own name back."""
    train = docs.where(F.coalesce(~held_out(quoted(id_col)), F.lit(False)))
    model = train_languages(train, lang, text)
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    marked = identify(docs.select(*[quoted(c).alias(n) for c, n in names.items()]), model, next(n for c, n in names.items() if c.lower() == text.lower()))
    return marked.where((F.col("lang_pred") != NONE) & (F.col("score") >= least)).select(*[quoted(n).alias(c) for c, n in names.items()])
