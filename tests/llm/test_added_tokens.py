import zlib
from array import array

import pytest

import corpus_pipeline
from framecv.llm.queries import QUERIES
from framecv.llm.tokens import encoded

public = pytest.importorskip("public_tokenizers")


def test_queries_give_the_ids_of_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y  ", "<|endoftext |> <|endoftext", "plain", "", None, " <|endoftext|>\n\n z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = {}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want[i] = (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
    for out in (QUERIES["op9_packing"](spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, "")):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in out.collect()} == want


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + " " * 150_000 + "y" + "\n" * 120_001 + "'s",
                                  "\t" * 100_000 + "<|endoftext|>" + " " * 100_001 + "<|endoftext|> b", "　" * 130_000 + " \t" * 90_000 + "1"])
def test_long_runs_give_the_ids_of_the_library(text):
    from tokenizers import Tokenizer
    path = public.path("byte_bpe_50k.json")
    for added in (True, False):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = not added
        want = t.encode(text, add_special_tokens=False).ids
        assert next(encoded([text], path, added)) == array("I", want).tobytes()
