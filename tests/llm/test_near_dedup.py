import random
import re

import pytest

from framecv.llm.components import connected_components
from framecv.llm.near_dedup import confirmed_links, drop_near_copies, near_components


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(a), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets)}


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            text = r.choice(rows)[1] if r.random() < 0.7 else rows[0][1]
            w = (text or "").split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        else:
            text = " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 30, 60, 120])))
            text = passage + " " + text if r.random() < 0.3 else text
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Ab cD"), (n + 4, "aB\tCd"), (n + 5, "É é"), (n + 6, "é É")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,percent,small", [(1, 3, 85, False), (2, 5, 80, False), (3, 3, 85, True)])
def test_against_brute_force(spark, seed, n, percent, small):
    rows = corpus(seed, 100 if small else 160)
    more = {"most_rows": 40, "most_bytes": 12000} if small else {}
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, component_id string")
    got = {tuple(r) for r in near_components(df, words=n, percent=percent, **more).collect()}
    assert got == brute(rows, n, percent)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(40_000))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e f"), (None, "a b c d e f"), (7, long), (6, long + " x"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, near_components(df, words=3, percent=85).collect()), key=str)
    assert got == sorted([(5, 4, 4, False), (5, 4, 4, False), (4, 4, 4, True), (None, 4, None, True), (7, 39998, 6, False),
                          (6, 39999, 6, True), (9, 0, 9, True)], key=str)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "6", "9", "None"]
    assert near_components(df.limit(0)).count() == 0


def test_large_group_in_slices(spark):
    """All texts in one loose group that is far above what a task may hold."""
    rows = corpus(4, 90)
    df = spark.createDataFrame([(0, i, t or "") for i, t in rows if shingles(t, 3)], "group bigint, id bigint, text string")
    links = confirmed_links(df, 3, 85, 3000)
    found = {r.id: r.component for r in connected_components(links).collect()}
    want = {i: c for i, _, c, _ in brute(rows, 3, 85)}
    assert all(found.get(i, i) == c for i, c in want.items())


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(None, 3)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs[:-1]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in pairs[:-1] if a != b for x in (a, b)}
