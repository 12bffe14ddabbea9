import random
import zlib
from collections import defaultdict

import pytest

from framecv.llm.packing import best_fit, local_search, pack_documents, pack_group

public = pytest.importorskip("public_tokenizers")


def test_group_packing():
    r = random.Random(3)
    for n, high in ((0, 9), (1, 9), (300, 60), (400, 100), (200, 40)):
        lengths = [r.randint(1, high) for _ in range(n)]
        first = best_fit(lengths, 100)
        bins, offsets = pack_group(lengths, 100)
        held = defaultdict(list)
        for length, b, o in zip(lengths, bins, offsets):
            held[b].append((o, length))
        for parts in held.values():
            at = 0
            for o, length in parts:
                assert o == at
                at += length
            assert at <= 100
        assert sorted(held) == list(range(len(held))) and len(held) <= len(set(first))
        assert len(held) >= -(-sum(lengths) // 100)


def test_local_search_empties_bins():
    lengths = [51, 27, 26, 23, 51, 27, 26, 23, 51, 27, 26, 23, 21, 25]
    bad = [0, 0, 3, 0 + 4, 1, 1, 3, 4, 2, 2, 3, 4, 5, 6]
    after = local_search(lengths, bad, 100)
    fill = defaultdict(int)
    for length, b in zip(lengths, after):
        fill[b] += length
    assert max(fill.values()) <= 100 and len(fill) < len(set(bad))


def test_documents(spark):
    from tokenizers import Tokenizer
    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    r = random.Random(4)
    texts = [None, "", " ", "  a b", "a  b", "x\n y", "tail ", "<|endoftext|> it's", "é à ß\t\n  z"] + [
        " ".join(r.choice(["alpha", "beta", "gamma,", "Δelta", "12", "x\ny", ""]) for _ in range(r.choice([3, 40, 400, 5000]))) for _ in range(40)]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(None, "a b", 1), (3, "  a b", 1)], "doc_id bigint, text string, piece int")
    got = pack_documents(docs, path, group_rows=16, with_ids=True).collect()
    assert set(pack_documents(docs, path).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in got:
        assert x.length == len(x.ids) <= 2048
        assert x.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x.ids))
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append((x.offset, x.length))
    for i, text in enumerate(texts):
        if i == 3:
            assert len(by_doc[3]) == 2
            continue
        parts = sorted(by_doc[i], key=lambda x: x.piece)
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert [y for x in parts for y in x.ids] == ids
        assert [x.piece for x in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // 2048)
        assert [x.start for x in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert all(x.length == 2048 for x in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(docs.limit(0), path).count() == 0
