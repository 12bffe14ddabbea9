from collections import Counter, defaultdict
from fractions import Fraction

from framecv.llm.mixing import horizon, keep_mix, mix_sources, pfair_period, pfair_slots, tempered_weights, whole_shares, whole_weights


def test_period_is_pfair():
    for weights in ({"a": 5, "b": 3, "c": 2}, {"a": 1}, {"a": 0.9, "b": 0.05, "c": 0.05}, {str(i): i + 1 for i in range(17)}):
        shares = whole_shares(weights, 97)
        assert sum(shares.values()) == 97 and all(v >= 1 for v in shares.values())
        period = pfair_period(shares)
        assert [x[2] for x in period] == list(range(97))
        done = Counter()
        for s, block, slot, release, due in period:
            assert block == done[s] and release <= slot < due
            done[s] += 1
            for other, n in shares.items():
                assert abs(Fraction(n * (slot + 1), 97) - done[other]) < 1


def test_horizon_against_counting():
    for counts, shares, block in (({"a": 100, "b": 10}, {"a": 5, "b": 5}, 1), ({"a": 64, "b": 64, "c": 1}, {"a": 50, "b": 49, "c": 1}, 4),
                                  ({"a": 7}, {"a": 10}, 2)):
        period = sum(shares.values())
        for slack in (0.0, 0.01, 0.2):
            got = horizon(counts, shares, block, slack)

            def empty(t):
                return sum(max(0, t - -(-counts[s] // block) * period / n) * n / period for s, n in shares.items())
            assert empty(got) <= slack * got + 1e-6
            ends = max(-(-counts[s] // block) * period / n for s, n in shares.items())
            assert got + 1 > ends or empty(got + 1) > slack * (got + 1)


def test_rows_and_slots(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", f"t{i}", 9) for i in range(3000)] + [(None, None, None, 1), (5, "s1", "t", 1), (5, "s1", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, slot int")
    weights = {"hot": 2.0, **{f"s{i}": 1.0 for i in range(7)}, None: 0.01, "absent": 3.0}
    out = mix_sources(docs, weights, block=4, period=50, cell_rows=100)
    assert out.columns == ["doc_id", "source", "text", "slot", "position", "release", "deadline", "in_mix"]
    got = out.collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter((a, b, c) for a, b, c, _ in rows)
    assert len({(r.slot, r.position) for r in got}) == len(got)
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append((r.slot, r.position))
        assert r.release <= r.slot < r.deadline and 0 <= r.position < 4
    # one period after the other, done by hand
    shares = whole_shares({s: w for s, w in weights.items() if s != "absent"}, 50)
    slots = {s: [x[2] for x in pfair_period(shares) if x[0] == s] for s in shares}
    for s, found in by_source.items():
        want = [(slots[s][b % shares[s]] + b // shares[s] * 50, p) for b in range(len(found) // 4 + 1) for p in range(4)]
        assert sorted(found) == sorted(want[:len(found)])
    end = horizon({s: len(v) for s, v in by_source.items()}, shares, 4)
    assert all(r.in_mix == (r.slot < end) for r in got)
    kept = Counter(r.source for r in got if r.in_mix)
    for s, n in shares.items():  # within a block of the share, unless the source ran out
        assert kept[s] == len(by_source[s]) or abs(kept[s] - end * n * 4 / 50) < 4


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, source string")
    assert {r.in_mix for r in mix_sources(docs, {}).collect()} == {False}
    assert {(r.source, r.slot is None) for r in mix_sources(docs, {"a": 1}).collect()} == {("a", False), ("b", True)}
    assert keep_mix(docs.limit(0)).count() == 0
    assert keep_mix(docs).columns == docs.columns


def test_kept_rows_are_those_in_the_mix(spark):
    rows = [(i, "hot" if i % 2 else f"s{i % 6}", "text") for i in range(2000)] + [(None, None, "x"), (3000, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    inside = mix_sources(docs, tempered_weights(docs), cell_rows=100).where("in_mix").collect()
    kept = keep_mix(docs, cell_rows=100).collect()
    assert Counter((r.doc_id, r.source) for r in kept) == Counter((r.doc_id, r.source) for r in inside)
    assert 0 < len(kept) < len(rows)


def test_slots_under_exact_weights():
    """After any number of slots no source is a block away from the weight that was given."""
    for weights in ({"a": 5.0, "b": 3.0, "c": 2.0}, {"a": 1e6, "b": 1.0}, {"half": 600.0, **{f"s{i}": 1.0 for i in range(600)}}, {"a": 0.1, "b": 0.2, None: 0.7},
                    {str(i): (i + 1) ** 0.7 for i in range(23)}, {"only": 2.0}):
        exact = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
        done = Counter()
        out = pfair_slots(weights, 3000)
        assert [x[2] for x in out] == list(range(3000))
        for s, block, slot, release, due in out:
            assert block == done[s] and release <= slot < due
            assert release == int(block / exact[s]) and due == -int(-(block + 1) / exact[s] // 1)
            done[s] += 1
            if slot % 7 == 0:
                assert all(abs(w * (slot + 1) - done[o]) < 1 for o, w in exact.items())
    assert pfair_slots({}, 5) == [] and whole_weights({"a": 0.5, "b": 0, "c": None, "d": 0.75}) == {"a": 2, "d": 3}


def test_mix_holds_the_given_weights(spark):
    """600 equal sources next to one of half the weight, and one of a millionth."""
    weights = {"half": 600.0, **{f"s{i}": 1.0 for i in range(600)}, "rare": 1200e-6}
    rows = [(i, s) for s in weights for i in range(3000 if s == "half" else 6)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string"), weights, block=1).collect()
    total, length = sum(weights.values()), max(r.slot for r in got if r.in_mix) + 1
    taken = Counter(r.source for r in got if r.in_mix)
    assert len(got) == len(rows) and length > 5900
    for s, w in weights.items():
        assert abs(taken[s] - length * w / total) < 1.5 or taken[s] == (3000 if s == "half" else 6)
    assert len({r.slot for r in got if r.in_mix}) == sum(taken.values())
    assert all(r.release <= r.slot < r.deadline for r in got if r.in_mix)
