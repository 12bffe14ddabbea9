from collections import Counter

import corpus_pipeline
from framecv.llm.mixing import mix_all, tempered_weights, whole_shares


def test_a_small_source_does_not_end_the_mix(spark):
    sizes = {"a": 3000, "b": 1500, "c": 60, None: 20}
    rows = [(i, s, f"t{i}", 1) for s, n in sizes.items() for i in range(n)] + [(None, "a", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, slot int")
    out = mix_all(docs, block=4, period=100, cell_rows=200)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(tuple(r) for r in got) == Counter(rows)
    # while both go on, the two large sources are a block or two from their shares of the slots they have together
    shares = whole_shares(tempered_weights(docs), 100)
    done: Counter = Counter()
    for r in got:
        if done["b"] == sizes["b"]:
            break
        done[r.source] += 1
        both = done["a"] + done["b"]
        assert abs(done["a"] - both * shares["a"] / (shares["a"] + shares["b"])) <= 8
    assert done["b"] == sizes["b"] and done["c"] == sizes["c"] and done[None] == sizes[None]
    assert mix_all(docs.limit(0)).count() == 0


def test_the_stage_keeps_every_document(spark):
    docs = spark.createDataFrame([(i, "large" if i % 50 else "small", "t") for i in range(5000)], "doc_id bigint, source string, text string")
    assert Counter(r.source for r in corpus_pipeline.mixing(spark, docs, "").collect()) == {"large": 4900, "small": 100}
