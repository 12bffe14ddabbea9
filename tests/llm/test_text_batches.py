import random
import tracemalloc

import pyarrow as pa
import pytest

import corpus_pipeline
from framecv.llm.language import identify, keep_known_languages, train_languages
from framecv.llm.shingles import CHUNK, text_parts
from framecv.llm.tokens import _pieces, encoded
from tests.llm.test_language import documents, text_of

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_parts_are_whole_and_bounded():
    texts = [None, "", "é" * 30, "x" * 250, "y" * 40, None, *["z" * 9] * 50, ""]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind)], ["id", "text"])
        for own in (batch, batch.slice(2), batch.slice(0, 0)):
            parts = list(text_parts(own, 1, 100))
            assert [r for p in parts for r in p.to_pylist()] == own.to_pylist()
            assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100 for p in parts)
            assert len(parts) > 5 or not own.num_rows


def test_a_large_batch_is_identified_in_slices(spark, monkeypatch):
    docs = documents(spark, 300).select("doc_id", "text", "lang")
    model, runs = train_languages(docs), []
    kind = type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, real=kind.mapInArrow, **b: runs.append(f) or real(self, f, *a, **b))
    identify(docs, model)
    text = text_of(random.Random(3), "bb", 400)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array([text] * 8000), pa.array(["bb"] * 8000)], ["doc_id", "text", "lang"])
    assert batch.nbytes > 12 * CHUNK
    tracemalloc.start()
    rows, largest = 0, 0
    for out in runs[0](iter([batch])):
        rows += out.num_rows
        largest = max(largest, out.nbytes)
        assert set(out.column(3).to_pylist()) == {"bb"}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 8000 and largest < 2 * CHUNK and peak < 24 * CHUNK


def test_columns_named_like_results_stay(spark):
    docs = documents(spark, 300)
    assert {r.score for r in keep_known_languages(docs).collect()} == {1.5}
    renamed = docs.withColumnRenamed("text", "Text")
    assert keep_known_languages(renamed).columns == renamed.columns
    assert keep_known_languages(renamed).count() == keep_known_languages(docs).count() > 200


def test_stages_give_python_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    def seen():
        got = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('abcd ', 1000) text").mapInArrow(sizes, "n bigint, size bigint").collect()
        assert sum(r.n for r in got) == 4000
        return max(r.size for r in got)

    spark.conf.unset(KEY)
    try:
        corpus_pipeline.prepare(spark)
        assert seen() < 5 << 20
        spark.conf.set(KEY, "1m")
        corpus_pipeline.prepare(spark)
        assert seen() < 2 << 20
    finally:
        spark.conf.unset(KEY)


def test_the_second_vocabulary_is_made_for_long_runs_only():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    _pieces.clear()
    assert len(next(iter(encoded(["some words  here"], path)))) and not _pieces
    assert len(next(iter(encoded(["a" + " " * 100_001 + "b"], path)))) and _pieces
