import random
import re
from collections import Counter

import numpy as np
import pytest

from framecv.llm import quality
from framecv.llm.queries import QUERIES
from framecv.llm.quality import apply_quality, calibrate, minimise, train_quality

CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def counts(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_query_against_counting_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op12_quality"](spark, sf)
    assert out.columns[:8] == CONTRACT
    rows = {r.doc_id: r for r in out.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert counts(rows[d.doc_id]) == by_hand(d.text)
        assert not (rows[d.doc_id].kept and rows[d.doc_id].base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[i] == 1, rows[i].kept) for i in labels if not rows[i].base_failed]
    assert np.mean([a == b for a, b in judged]) > 0.97


def test_labels_that_were_not_seen(spark):
    """Trained on half of the labels, the verdicts agree with the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train_quality(docs, labels.where("doc_id % 2 = 0"), rounds=16)
    rows = apply_quality(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model).where("not base_failed").collect()
    right = {q: np.mean([r.kept == (q == 1) for r in rows if r.quality == q]) for q in (0, 1)}
    assert len(rows) > 500 and right[1] > 0.99 and right[0] > 0.9
    # calibrated: the mean probability is the share of good rows
    assert np.mean([r.probability for r in rows]) == pytest.approx(np.mean([r.quality for r in rows]), abs=0.05)


def test_edges(spark):
    r = random.Random(5)
    words = ["ab", "x#y", "É|", "*", "日本", "a" * 300]
    texts = [None, "", " \n\t ", "a", "a a a a", "same line\nsame line\n same line\n\n\nsame line", "\x1cx\x85y\xa0z", "a b c d a b c",
             "w " * 60, "".join(r.choice(words) + r.choice([" ", "\n", "\x0b", "  ", "\r\n"]) for _ in range(20_000)), "z" * 3_000_000,
             ("lorem " * 30 + "\n") * 20_000, " " * 2_500_000 + "end"]
    rows = [(i, t, "kept column", 7) for i, t in enumerate(texts)] + [(3, "a", "again", 8), (None, "null id", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, N_words int")
    out = apply_quality(df, None)
    assert out.columns == ["doc_id", "text", *quality.RESULT]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _, _ in rows)
    for row in got:
        assert counts(row) == by_hand(row.text) and row.probability is None and row.kept is not row.base_failed
    assert apply_quality(df.limit(0), None).count() == 0
    # nothing to learn from: no labels, one class, null and odd labels
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    assert train_quality(df, empty) is None and train_quality(df.limit(0), empty) is None
    assert train_quality(df, spark.createDataFrame([(3, 1), (4, None), (5, 2), (None, 0)], "doc_id bigint, quality int")) is None


def test_score_is_the_sum_over_features(spark):
    """The score in batches equals weights times features of each text alone, also over slices and next to other texts."""
    import pyarrow as pa
    texts = ["one two two", "", "ü", "ab", "X" * 5 + " " + "yz " * 400_000, None, "tail of it"]
    weights = np.random.default_rng(1).normal(size=quality.WIDTH + 1)
    for column in (pa.array(texts), pa.array(texts[:4])):
        got, want = [], []
        for at, to, data, offsets in quality._text_chunks(column):
            hashes, bounds = quality._words(data, offsets)
            got += quality._scores(data, offsets, hashes, bounds, weights).tolist()
        for t in column.to_pylist():
            data = np.frombuffer((t or "").encode(), np.uint8)
            offsets = np.array([0, len(data)])
            slots, values = next(quality._features(data, offsets, *quality._words(data, offsets)))
            want.append(float(weights[slots] @ values))
        assert got == pytest.approx(want, abs=1e-7)


def test_minimise_and_calibrate():
    target = np.arange(6.0)
    found = minimise(lambda w: (float(((w - target) ** 2 * (1 + target)).sum()), 2 * (w - target) * (1 + target)), np.zeros(6), 60, tolerance=1e-9)
    assert found == pytest.approx(target, abs=1e-6)
    r = np.random.default_rng(3)
    scores = r.normal(size=20_000) * 3
    a, b = calibrate(scores, r.random(20_000) < 1 / (1 + np.exp(-(0.5 * scores - 1))))
    assert (a, b) == (pytest.approx(0.5, abs=0.05), pytest.approx(-1, abs=0.1))
    assert calibrate(scores, scores < 0) == (1.0, 0.0) and calibrate(scores[:3], np.ones(3, bool)) == (1.0, 0.0)
