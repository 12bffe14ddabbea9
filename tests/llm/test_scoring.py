import math
import random

import numpy as np
import pyarrow as pa

from framecv.llm.scoring import BUCKETS, PLACES, forward, initial, score_texts, text_scores, train_window_model, views, windows


def test_probabilities_add_up():
    model = views(np.random.default_rng(1).normal(0, 0.5, initial().shape).astype(np.float32))
    around = np.repeat(np.array([[3], [77], [BUCKETS], [4000]]), BUCKETS, axis=1)
    _, _, log_p = forward(model, np.arange(BUCKETS), around)
    assert abs(np.exp(log_p.astype(float)).sum() - 1) < 1e-3


def test_windows_and_scores_by_hand():
    texts = ["a b c", None, "", "A b", " one ", "c b a b c"]
    (_, counts, word, around), = windows(pa.array(texts))
    assert counts.tolist() == [3, 0, 0, 2, 1, 5]
    a, b, c = word[:3].tolist()
    assert word.tolist()[3:5] == [a, b]
    assert around[:, 1].tolist() == [BUCKETS, a, c, BUCKETS] and around[:, 3].tolist() == [BUCKETS, BUCKETS, b, BUCKETS]
    assert around[:, 8].tolist() == [c, b, b, c]
    model = views(initial())
    n, total = text_scores(pa.array(texts), model)
    at = 0
    for k, count in enumerate(counts.tolist()):
        by_hand = 0.0
        for i in range(count):
            own = np.array([word[at + i + s] if 0 <= i + s < count else BUCKETS for s in PLACES])[:, None]
            by_hand += float(forward(model, word[at + i:at + i + 1], own)[2][0])
        at += count
        assert n[k] == count and abs(by_hand - total[k]) < 1e-3


def test_training_helps_and_covers_all_rows(spark):
    r = random.Random(2)
    follow = {f"w{i}": [f"w{(i * 7 + j) % 60}" for j in range(3)] for i in range(60)}

    def chain(n):
        out = ["w0"]
        while len(out) < n:
            out.append(r.choice(follow[out[-1]]))
        return out
    rows = [(i, " ".join(chain(120)), 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, log_prob int").repartition(4)
    model = train_window_model(docs)
    good = [" ".join(chain(200)) for _ in range(20)]
    bad = [" ".join(r.sample(t.split(), 200)) for t in good]
    test = spark.createDataFrame([(i, t, 0) for i, t in enumerate(good + bad)] + [(90, None, 0), (91, " \n", 0)], "doc_id bigint, text string, log_prob int")
    out = score_texts(test, model)
    assert out.columns == ["doc_id", "text", "n_tokens", "log_prob", "mean_log_prob"]
    got = {x.doc_id: x for x in out.collect()}
    assert min(got[i].mean_log_prob for i in range(20)) > max(got[i].mean_log_prob for i in range(20, 40))
    assert np.mean([got[i].mean_log_prob for i in range(20)]) > -math.log(30)
    assert got[90].n_tokens == 0 and got[90].log_prob == 0 and got[90].mean_log_prob is None and got[91].n_tokens == 0
    assert np.array_equal(train_window_model(docs.limit(0)), initial())
