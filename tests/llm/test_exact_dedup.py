import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from framecv.llm.bloom import filter_bits, held_bits, possibly_held, repeated_bits
from framecv.llm.exact_dedup import drop_copies, exact_dedup


def brute(rows):
    groups = {}
    for i, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(plain, []).append(i)
    out = []
    for i, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        ids = [x for x in groups[plain] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a b", "É", "x " * 30_000, "hot"]
    rows = [(i, r.choice(texts) if r.random() < 0.5 else f"own {i}") for i in range(800)]
    rows += [(5, "again"), (5, "again"), (None, "a b"), (None, "nobody"), (None, "nobody")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "old", 7) for i, t in rows], "doc_id bigint, text string, KEPT string, n int")
    out = exact_dedup(df)
    assert out.columns == ["doc_id", "text", "n", "keep_id", "group_size", "kept", "text_sha256"]
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in out.collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    kept = drop_copies(df)
    assert kept.columns == df.columns and kept.count() == sum(x[3] for x in brute(rows))
    assert exact_dedup(df.limit(0)).count() == 0


def test_filters_have_no_false_negatives(spark):
    keys = spark.range(4000).select(F.expr("concat('k', case when id % 4 = 0 then id div 8 else id end)").alias("key"))
    bits = filter_bits(4000)
    assert bits >= 64_000 and filter_bits(10 ** 12) == 2 ** 30
    twice = {r.key for r in keys.groupBy("key").count().where("count > 1").collect()}
    flagged = {r.key for r in possibly_held(keys, "key", repeated_bits(keys, "key", bits), bits, "hit").where("hit").collect()}
    assert twice <= flagged and len(flagged - twice) < 200
    some = keys.where("key like 'k1%'")
    found = {r.key for r in possibly_held(keys, "key", held_bits(some, "key", bits), bits, "hit").where("hit").collect()}
    own = {r.key for r in some.collect()}
    assert own <= found and len(found - own) < 60


def test_only_possible_copies_are_shuffled(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") - (F.col("id") % 100 == 99).cast("int")).cast("string")).alias("text"))
    out = exact_dedup(df)
    assert out.where("group_size = 2").count() == 60
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
