import random

import pytest

from framecv.llm.secrets import chains, find_secrets, train_secrets


@pytest.mark.parametrize("text, value", [('credential = "correct-horse-battery-staple"', "correct-horse-battery-staple"), ("pwd: QwErTyUiOpAsDfGhJkLz", "QwErTyUiOpAsDfGhJkLz")])
def test_tokens_without_a_digit_are_in_the_chain(text, value):
    whole = "then other " + text + " house"
    assert value in {whole[a:b] for run in chains(whole) for a, b in run}


def test_a_letter_only_secret_is_added(spark):
    r = random.Random(6)
    plain = ["then", "other", "the", "house", "number", "tomorrow", "meanwhile", "2024", "possibility"]

    def value():
        if r.random() < 0.5:
            return "-".join(r.choice(["correct", "horse", "battery", "staple", "window", "green"]) for _ in range(4))
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(20))
    rows = []
    for i in range(500):
        words = [r.choice(plain) for _ in range(30)]
        name, form = r.choice(["password", "secret", "token", "api_key"]), r.choice(['{} = "{}"', "{}: {}"])
        words.insert(r.randrange(30), form.format(name, value()))
        words.insert(r.randrange(30), r.choice(["note: ", 'he said "', "title = "]) + r.choice(plain) + r.choice([" ", '" ']))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = train_secrets(docs)
    texts = ['the house credential = "correct-horse-battery-staple" then other', "other pwd: QwErTyUiOpAsDfGhJkLz then", "the note: tomorrow then other house number",
             "the possibility of another house " * 50]
    got = {x.doc_id: x for x in find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    assert [[texts[i][s.start:s.end] for s in got[i].spans] for i in range(4)] == [["correct-horse-battery-staple"], ["QwErTyUiOpAsDfGhJkLz"], [], []]
    assert all(not got[i].base for i in range(4))
    found = find_secrets(docs, model).collect()
    assert all(len(x.base) == len(x.spans) for x in found)
