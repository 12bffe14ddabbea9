import math
from collections import Counter

import numpy as np
import pyarrow as pa

from framecv.llm import scoring
from framecv.llm.scoring import bucket_of, forward, hashed_words, initial, score_texts, views, windows, word_counts


def word_hash(word):
    (_, _, hashes), = hashed_words(pa.array([word]))
    return hashes


def test_words_of_a_bucket_are_told_apart(spark):
    by_bucket: dict = {}
    for i in range(100_000):
        pair = by_bucket.setdefault(int(bucket_of(word_hash(f"w{i}"))[0]), [])
        pair.append(f"w{i}")
        if len(pair) == 3:
            break
    often, seldom, never = pair
    docs = spark.createDataFrame([(i, f"x {often} y") for i in range(50)] + [(50, f"x {seldom} y"), (51, None)], "doc_id bigint, text string")
    counts = word_counts(docs)
    test = spark.createDataFrame([(0, f"x {often} y"), (1, f"x {seldom} y"), (2, f"x {never} y"), (3, None), (4, f"x {often} y")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in score_texts(test, initial(), counts=counts).collect()}
    assert abs(got[0].log_prob - got[1].log_prob - math.log(50)) < 1e-6 and abs(got[1].log_prob - got[2].log_prob) < 1e-6
    assert got[3].n_tokens == 0 and got[3].log_prob == 0 and got[3].mean_log_prob is None and got[4].log_prob == got[0].log_prob


def test_word_scores_by_hand(spark, monkeypatch):
    texts = [" ".join(f"w{(i * j * j) % 97}" for j in range(1, 60)) for i in range(40)] + [f"one{i} w1 w2" for i in range(9)] + [None, "", "  "]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int").repartition(3)
    counts = word_counts(docs)
    seen = Counter(w for t in texts for w in (t or "").split())
    assert {(r.word, r.n) for r in counts.collect()} == {(int(word_hash(w).view(np.int64)[0]), n) for w, n in seen.items()}
    in_bucket: Counter = Counter()
    for w, n in seen.items():
        in_bucket[int(bucket_of(word_hash(w))[0])] += n
    model, want = views(initial()), []
    for t in texts:
        (_, _, word, around), = windows(pa.array([t]))
        logs = forward(model, word, around)[2] if len(word) else np.zeros(0)
        want.append(sum(float(x) + math.log(seen[w]) - math.log(in_bucket[b] + 1) for w, b, x in zip((t or "").split(), word.tolist(), logs)))
    for common in (4, 30, 1 << 16):  # all joined, some joined, all looked up
        monkeypatch.setattr(scoring, "COMMON", common)
        out = score_texts(docs, initial(), counts=counts, keep_text=False)
        assert out.columns == ["doc_id", "n_tokens", "log_prob", "mean_log_prob"]
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i].n_tokens == len((t or "").split()) and abs(got[i].log_prob - want[i]) < 1e-3
    assert score_texts(docs.limit(0), initial(), counts=word_counts(docs.limit(0))).count() == 0


def test_counts_grow_with_the_words(spark):
    docs = spark.createDataFrame([(i, f"a b new{i}") for i in range(9_000)], "doc_id bigint, text string")
    assert word_counts(docs).count() == 9_002 > scoring.BUCKETS
