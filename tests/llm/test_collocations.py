import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framecv.llm import collocations as C
from framecv.llm.collocations import _score, collocations
from framecv.llm.queries import QUERIES
from framecv.llm.words import hash_words, separators, word_bounds


def brute(rows, longest=3, least=10, absorb=50, first=2000):
    found, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                found[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in found.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        over = Counter()
        for p in candidates:
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    over[p[s:s + m]] = max(over[p[s:s + m]], f[p])
        kept = []
        for p in candidates:
            if over[p] and 100 * over[p] >= absorb * f[p]:
                continue
            score, k = min((10**6 * f[p]**2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def same(df, want):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(tuple(r) for r in df.collect()) == want


def test_query_against_counting(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([(r.text, r.lang) for r in docs])
    assert len(want) > 500
    same(QUERIES["op13_collocations"](spark, sf), want)


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(4)
    common = ["of", "the", "Of", "ÉTÉ", "new", "york", "a\xa0b", "\x1c", "#", "日本"]
    rows = []
    for i in range(120):
        words = [r.choice(common) if r.random() < 0.8 else f"w{r.randrange(40)}" for _ in range(r.randrange(60))]
        text = "".join(w + r.choice([" ", "  ", "\t", ". ", ",", "\n", " ! ", " "]) for w in words)
        rows.append((i, text, r.choice(["en", "fr", None, "und", ""]), "x", 1))
    rows += [(200, None, "en", "x", 1), (201, "", "en", "x", 1), (202, "....,,\n ", "de", "x", 1), (203, "solo " * 9, "xx", "x", 1),
             (204, "go " * 50_000, "en", "x", 1), (204, "go " * 50_000, "en", "x", 1), (205, "q" * 2_500_000 + " of the", "fr", "x", 1), (None, "new york " * 12, "fr", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, phrase string, n int")


def test_odd_texts(odd):
    rows = [(r.text, r.lang) for r in odd.collect()]
    same(collocations(odd), brute(rows))
    same(collocations(odd, least=3, absorb=80, first=7), brute(rows, least=3, absorb=80, first=7))


def test_longer_phrases(odd):
    rows = [(r.text, r.lang) for r in odd.where("doc_id < 200").collect()]
    same(collocations(odd.where("doc_id < 200"), longest=4, least=4), brute(rows, longest=4, least=4))


def test_few_ranks_and_small_tiles(odd, monkeypatch):
    """Most words without a rank, and arrays that are flushed again and again, give the same rows."""
    r = np.random.default_rng(1)
    rows, columns = r.integers(0, 60, 4000), r.integers(0, 60, 4000)
    monkeypatch.setattr(C, "TILE", 16)
    tiles = C._Tiles()
    cells = Counter()
    for part in (slice(0, 1500), slice(1500, 4000)):
        for i, j, n in zip(*tiles.add("en", rows[part], columns[part])):
            cells[i, j] += n
    assert tiles.arrays
    for _, i, j, n in tiles.flush(1):
        cells.update({(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), n.tolist())})
    assert cells == Counter(zip(rows.tolist(), columns.tolist())) and not tiles.arrays
    monkeypatch.undo()
    monkeypatch.setattr(C, "RANKED", 12)  # decides on the driver which phrases have ranks
    same(collocations(odd), brute([(x.text, x.lang) for x in odd.collect()]))


def test_shared_hashes_are_found(spark, monkeypatch):
    """Two words with one hash: the count is done again with another seed."""
    docs = spark.createDataFrame([("en", " ".join(f"w{i % 700}" for i in range(9000)))], "lang string, text string")
    real, seeds = C.word_counts, []

    def clash(texts, seed):
        seeds.append(seed)
        return real(texts, seed).withColumn("hash", F.pmod("hash", F.lit(300))) if len(seeds) == 1 else real(texts, seed)

    monkeypatch.setattr(C, "word_counts", clash)
    same(collocations(docs), brute([(r.text, r.lang) for r in docs.collect()]))
    assert len(seeds) == 2 and seeds[0] != seeds[1]


def test_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    same(collocations(docs), [])
    same(collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")), [])


def test_scores_are_exact(spark):
    r = random.Random(8)
    rows = []
    for top in (20, 10**4, 10**9, 10**12, 2 * 10**15):
        for _ in range(300):
            left, right = r.randint(1, top), r.randint(1, top)
            a = r.choice([min(left, right), r.randint(1, min(left, right))])
            rows.append((a, left, right))
    rows += [(n, n, n) for n in (1, 7, 10**15)] + [(10**7, 10**10, 10**10), (10**7 - 1, 10**10, 10**10)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").withColumn("s", _score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert all(x.s == 10**6 * x.a * x.a // (x.l * x.r) for x in got)


def test_words_and_hashes():
    apart = separators(b" ,")
    texts = ["a b", "b", "", " ,", "long" * 700_000, "x" * 1_048_576, "b a", "ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    starts, ends = word_bounds(data, offsets, apart)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["a", "b", "b", texts[4], texts[5], "b", "a", "ab"]
    hashes = hash_words(data, starts, ends)
    assert {(h == g) for w, h in zip(words, hashes) for v, g in zip(words, hashes) if w == v} == {True}
    assert len(set(hashes.tolist())) == len(set(words))
    alone = np.frombuffer(texts[4].encode(), np.uint8)
    assert hash_words(alone, *word_bounds(alone, np.array([0, len(alone)]), apart))[0] == hashes[3]
