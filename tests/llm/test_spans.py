import hashlib
import random
import re

from framecv.llm import private, secrets

P = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
     ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
S = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]


def plain_private(text):
    out = []
    for kind, pattern in P:
        for m in re.finditer(pattern, text, re.A):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def plain_secrets(text):
    out = []
    for k, (kind, pattern) in enumerate(S):
        for m in re.finditer(pattern, text, re.A):
            if kind == "assign" and len(m[1]) < 8 or kind == "access" and len(m[0]) < 16 or kind == "hex" and len(m[0]) < 32:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def text_of(r):
    bits = ["a.b@c.de", "x@y", "@@a@b.c.d@e.f", "é@a.b", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (555) 123-4567", "+49 30 1234567.", "+1 2", "0" * 20, "tel 5551234567", "token = \"abcd1234efgh\"", "PassWord:'short'", "api_key=ABCDEF.123=", "apikey: x",
            "AKIA" + "Q7" * 8, "AKIA12", "f" * 32, "0123456789abcdef" * 3, "deadbeef", "ſecret=abcdefgh1", "toKen = K1K2K3K4K5K6", "me (at) site dot org", "word", "\n", " ", ",", "=", "日本"]
    return "".join(r.choice(bits) + r.choice(["", " ", " ", "\n", "."]) for _ in range(r.choice([0, 1, 5, 30])))


def test_base_spans_are_the_patterns():
    r = random.Random(1)
    for _ in range(1500):
        text = text_of(r)
        assert private.base_spans(text) == plain_private(text), text
        assert secrets.base_spans(text) == plain_secrets(text), text


def test_best_segmentation_by_brute_force():
    import numpy as np
    rng = np.random.default_rng(2)
    model = rng.normal(size=(private.WIDTH, 4))
    text = "12 345 678 9012"
    atoms = next(private.regions(text))
    found = private.segments(text, atoms)
    score = {(i, j): model[f].sum(axis=0) for i, j, f in found}

    def best(n):
        if n == 0:
            return 0.0
        return max([best(n - 1)] + [best(i) + score[i, n].max() for i in range(n)])
    got = sum(score[i, j][k] for i, j, k in private.best_segments(model, len(atoms), found))
    assert abs(got - best(len(atoms))) < 1e-9


def test_viterbi_by_brute_force():
    from itertools import product

    import numpy as np
    rng = np.random.default_rng(3)
    model = secrets.Chain(rng.normal(size=(secrets.WIDTH, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    for length in (1, 2, 5):
        run = rng.integers(0, secrets.WIDTH, (length, 7)).tolist()
        emit = model.emit[np.array(run)].sum(axis=1)

        def value(tags):
            if tags[0] == 1 or any(a == 2 and b == 1 for a, b in zip(tags, tags[1:])):
                return -1e9
            return model.first[tags[0]] + sum(emit[i][t] for i, t in enumerate(tags)) + sum(model.move[a][b] for a, b in zip(tags, tags[1:]))
        assert secrets.decode(model, [run])[0] == list(max(product(range(3), repeat=length), key=value))


def documents(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        words = [r.choice(["then", "other", "the", "house", "number", "2024", "12345"]) for _ in range(30)]
        if i % 2:
            words.insert(r.randrange(30), f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"')
            words.insert(r.randrange(30), f"+1 ({r.randrange(100, 999)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}")
        rows.append((i, " ".join(words), "x"))
    rows += [(None, None, None), (601, "", None), (602, "a " * 100_000 + "token = abcd1234abcd", None), (602, "call +1 (555) 123-4567", None)]
    rows += [(603, 'credential = "' + hashlib.sha1(b"x").hexdigest()[:31] + '"', None), (604, "call (212) 555-0199 now", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans string")


def test_secrets_over_documents(spark):
    docs = documents(spark)
    out = secrets.find_secrets(docs, secrets.train_secrets(docs.where("doc_id < 600"), sample_rows=300))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "base", "spans"] and len(got) == docs.count()
    for r in got:
        assert [tuple(x) for x in r.base] == plain_secrets(r.text or "")
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}
    by_id = {r.doc_id: r for r in got}
    assert any(x.kind == "other" for x in by_id[603].spans)
    assert not any(x.kind == "other" for i, r in by_id.items() if i is not None and i < 600 for x in r.spans)
    assert secrets.find_secrets(docs.limit(0), secrets.train_secrets(docs.limit(0))).count() == 0


def test_private_over_documents(spark):
    docs = documents(spark)
    out = private.find_private(docs, private.train_private(docs.where("doc_id < 600"), sample_rows=300))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "base", "spans"] and len(got) == docs.count()
    for r in got:
        assert [tuple(x) for x in r.base] == plain_private(r.text or "")
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}
    by_id = {r.doc_id: r for r in got}
    assert not any(len(r.spans) > len(r.base) for i, r in by_id.items() if i is not None and i < 600)
    assert private.find_private(docs.limit(0), private.train_private(docs.limit(0))).count() == 0


def test_long_zero_padded_numbers():
    zeros = "0" * 5_000
    assert private.base_spans(f"1.2.3.{zeros}7") == [("ip", 0, 6 + 5_001)]
    assert private.base_spans(f"1.2.3.{zeros}777") == [] and private.base_spans(f"1.2.3.{zeros}") == [("ip", 0, 6 + 5_000)]
