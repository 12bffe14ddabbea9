import random

import numpy as np
import pyarrow as pa

from framecv.llm.language import HASHES, SLOTS, _grams, _lower, _places, gram_counts, held_out, identify, keep_known_languages, train_languages
from framecv.llm.shingles import text_bytes

PARTS = {"aa": ["ba", "lo", "mi", "tu", "é"], "bb": ["sch", "kr", "el", "öd", "ung"], "cc": ["que", "ión", "ado", "ñe", "sta"]}


def text_of(r, lang, words):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(2, 4))) for _ in range(words)).capitalize() + "."


def documents(spark, n=900):
    r = random.Random(1)
    rows = []
    for i in range(n):
        lang = r.choice(["aa", "aa", "bb", "cc"])
        text = text_of(r, lang, r.choice([2, 20, 60]))
        if r.random() < 0.3:
            text += " Released under the MIT License 12 &&&"
        rows.append((i, text, lang))
    odd = [(2000, None, "aa"), (2001, "", "bb"), (2002, "123 &&& !", "cc"), (2003, "日本語", None), (2004, text_of(r, "bb", 30), None), (2004, text_of(r, "bb", 30), None),
           (None, text_of(r, "cc", 30), "cc"), (2005, text_of(r, "aa", 30_000), "aa")]
    return spark.createDataFrame([(*x, "s", 1.5) for x in rows + odd], "doc_id bigint, text string, lang string, source string, score double")


def test_held_out_accuracy_and_odd_rows(spark):
    docs = documents(spark)
    model = train_languages(docs.where(~held_out(docs.doc_id)))
    assert model.languages == ["aa", "bb", "cc"]
    out = identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == docs.count()
    tested = [r for r in got if r.doc_id is not None and r.doc_id < 900 and len(r.text) > 60]
    assert np.mean([r.lang_pred == r.lang for r in tested]) > 0.99
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (2000, 2001, 2002))
    assert by_id[2003].lang_pred == "aa" and by_id[2003].score == 0
    assert by_id[2004].lang_pred == "bb" and by_id[None].lang_pred == "cc" and by_id[2005].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    kept = keep_known_languages(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {2000, 2001, 2002, 2003} and {r.doc_id for r in tested} <= ids
    none = train_languages(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"} and identify(docs.limit(0), model).count() == 0


def test_counts_and_filters_by_brute_force(spark):
    docs = documents(spark, 200).where("lang is not null").select("lang", "text")
    got = {(r.lang, r.gram): r.n for r in gram_counts(docs).collect()}
    want: dict = {}
    for r in docs.collect():
        data, offsets = text_bytes(_lower(pa.array([r.text])))
        for codes, _ in _grams(data, offsets):
            for c in codes.tolist():
                want[r.lang, c] = want.get((r.lang, c), 0) + 1
    assert got == want
    model = train_languages(docs)
    totals = {lang: sum(n for (k, _), n in want.items() if k == lang) for lang in model.languages}
    for (lang, gram), n in want.items():  # no false negatives
        share = n / totals[lang]
        top = max(want.get((k, gram), 0) / totals[k] for k in model.languages)
        if share >= 1e-5 and share >= top * 0.1:
            assert all(model.masks[p[0]] >> model.languages.index(lang) & 1 for p in _places(np.array([gram], np.uint32)))
    assert len(_places(np.array([1], np.uint32))) == HASHES and len(model.masks) == SLOTS
    assert ((0 < model.false_rate) & (model.false_rate < 0.2)).all()


def test_a_text_is_scored_alike_in_any_batch(spark):
    docs = documents(spark, 300)
    model = train_languages(docs)
    one = {(r.text, r.lang_pred, r.score) for r in identify(docs.repartition(1), model).collect()}
    many = {(r.text, r.lang_pred, r.score) for r in identify(docs.repartition(40), model).collect()}
    assert one == many
