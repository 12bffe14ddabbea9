import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from tests.llm.test_near_dedup import brute

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{root}/{i}")
        out.append(spark.read.parquet(f"{root}/{i}"))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:5])


def test_language_keeps_what_has_letters(stages):
    before, after = stages[0].collect(), {r.doc_id for r in stages[1].collect()}
    assert {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")} == after


def test_exact_copies_go(stages):
    first: dict = {}
    for r in stages[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert Counter(first.values()) == Counter(r.doc_id for r in stages[2].collect())


def test_near_copies_go(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert {i for i, _, _, kept in brute(rows, 5, 80) if kept} == {r.doc_id for r in stages[3].collect()}


def test_mix_keeps_every_document(stages):
    assert Counter(tuple(r) for r in stages[4].collect()) == Counter(tuple(r) for r in stages[3].collect())


def test_mix_has_the_target_weights(spark, tmp_path):
    """Up to the point where the first source runs out, no source is two blocks of 16 rows from its target weight."""
    sizes = {"a": 4000, "b": 1500, "c": 700, "d": 80}
    docs = spark.createDataFrame([(i, f"t{i}", "en", s, 2) for s, n in sizes.items() for i in range(n)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.mixing(spark, docs, "").coalesce(1).write.parquet(f"{tmp_path}/mixed")
    total = sum(n ** 0.7 for n in sizes.values())
    done: Counter = Counter()
    for r in spark.read.parquet(f"{tmp_path}/mixed").coalesce(1).toLocalIterator():
        done[r.source] += 1
        if done[r.source] == sizes[r.source]:
            break
        for s, n in sizes.items():
            assert abs(done[s] - sum(done.values()) * n ** 0.7 / total) <= 32
    assert sum(done.values()) > 500


def test_packing_holds_every_document(stages):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    lengths = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    got, filled = Counter(), defaultdict(list)
    for r in stages[5].collect():
        got[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert got == lengths
    for parts in filled.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_sequences_follow_the_mix(spark, tmp_path):
    """The first sequences hold the first documents of the mix, so its weights reach the packed result."""
    sizes = {"a": 6000, "b": 2500, "c": 1500}
    docs = spark.createDataFrame([(i, f"text {i}", "en", s, 6) for i, (s, n) in enumerate((s, k) for s, n in sizes.items() for k in range(n))],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.mixing(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    place = {r.doc_id: (r.file_name, r.row_index) for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()}
    packed = corpus_pipeline.packing(spark, mixed, "").collect()
    assert len(packed) == len(place)
    runs = defaultdict(list)
    for r in packed:
        runs[r.sequence_id >> 24].append(place[r.doc_id])
    ordered = [runs[k] for k in sorted(runs)]
    assert len(ordered) >= 3 and all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))
    source = {r.doc_id: r.source for r in docs.collect()}
    total, done = sum(n ** 0.7 for n in sizes.values()), Counter(source[i] for i, at in place.items() if at in set(ordered[0]))
    assert all(abs(done[s] - len(ordered[0]) * n ** 0.7 / total) <= 32 for s, n in sizes.items())
    # rows that are in no file are dealt by hash
    assert corpus_pipeline.mix_runs(docs) is None and corpus_pipeline.packing(spark, docs.limit(20), "").count() == 20


def test_run_gives_the_last_stage(spark, stages):
    assert entry_point.queries()["pipeline"](spark, SF).count() == stages[5].count()
