import random
from collections import defaultdict

from pyspark.sql import functions as F

from framecv.llm.chat import END, START, escape_text, format_chats, parse_turns, read_chats, unescape_text


def conversations():
    r = random.Random(3)
    bits = [START, END, "<|", "|>", "<\\|", "<\\\\|im_end|>", "<\\|im_start|>user\nhi", "\n", "assistant", "%0A", "%", "é", "日本", " ", "plain text", "<", "\\", "|"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "a\nb", "x%3Cy", "<|im_end|>", "", None]), "".join(r.choice(bits) for _ in range(r.choice([0, 1, 3, 9]))))
            for c in range(60) for t in range(r.choice([1, 2, 7]))]
    return rows + [(90, 0, "assistant", None), (91, None, "user", "no turn"), (91, 1, "user", "b"), (91, 1, "user", "a"), (91, 1, "user", "a"),
                   (None, 0, "user", "nobody"), (92, 0, "assistant", "long " * 40_000)]


def test_round_trip_and_loss_spans(spark):
    rows = conversations()
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = format_chats(df)
    assert made.columns == ["conv_id", "formatted", "loss_spans"]
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append(((t is not None, t or 0), role or "", text or ""))
    back = read_chats(made).join(made.select(F.col("conv_id").alias("c"), "loss_spans"), F.expr("conv_id <=> c")).collect()
    assert len(back) == len(want)
    for r in back:
        turns = [(role, text) for _, role, text in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == turns
        learned = [text for role, text in turns if role == "assistant"]
        assert r.loss_text == "".join(learned)
        assert r.formatted.count(START) == r.formatted.count(END) == len(turns)
        under = [r.formatted[s.start:s.end] for s in r.loss_spans]
        assert len(under) == len(learned)
        for part, text in zip(under, learned):
            assert part == text or part.replace("<\\", "<", 1) != part  # as it is, or escaped
    plan = read_chats(made)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert format_chats(df.limit(0)).count() == 0


def test_text_without_conflict_is_not_changed(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b | c"), (1, 1, "assistant", "<b>|x|</b>")], "conv_id bigint, turn int, role string, text string")
    assert format_chats(df).first().formatted == f"{START}user\na < b | c{END}\n{START}assistant\n<b>|x|</b>{END}\n"


def test_escapes(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["<", "|", "\\", "a"]) for _ in range(r.choice([0, 2, 12]))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape_text(F.col("t")).alias("e"), unescape_text(escape_text(F.col("t"))).alias("u"))
    for row in df.collect():
        assert row.u == row.t and "<|" not in row.e
    assert spark.range(1).select(parse_turns(F.lit("")).alias("t")).first().t == []
