"""Chat formatting by grammar round trip (DataFrame functions only).

A formatted conversation is a sequence of turns
    <|im_start|>ROLE newline TEXT <|im_end|> newline
in which neither ROLE nor TEXT holds a control string. The parser is deterministic: it splits at the start
marks, takes the role up to the first newline and the text up to the first end mark, and undoes the escapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framecv.llm.common import quoted

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    """One backslash more between < and |: no control string is left, and unescape_text gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), text, F.lit(END + "\n"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_start\|>")

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.char_length(role) + 2, F.char_length(piece))
        return F.struct(unescape_role(role).alias("role"), unescape_text(F.substring_index(body, END, 1)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans (start and end in code points of the formatted
    string, end exclusive: the texts of the learned role).

    Each turn is rendered as it is, parsed again and compared with its source; a turn that does not come back is
    rendered with its text escaped. This takes place row by row, before the turns of a conversation meet.
    Turns are ordered by turn, then role and text, so that equal turn numbers and repeated rows have a fixed order;
    null turns come first. Null roles and texts are empty. Rows without a conversation form one with a null id.
    Other columns are left out. An empty table gives an empty result.
    """
    said = df.select(quoted(conv).alias("conv"), quoted(turn).alias("turn"),
                     F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    plain = parse_turns(render_turn(F.col("role"), F.col("text")))
    same = (F.size(plain) == 1) & (plain[0]["role"] == F.col("role")) & (plain[0]["text"] == F.col("text"))
    said = said.withColumn("body", F.when(same, F.col("text")).otherwise(escape_text(F.col("text"))))
    said = said.withColumn("piece", render_turn(F.col("role"), F.col("body")))
    head = F.lit(len(START) + 1) + F.char_length(escape_role(F.col("role")))
    said = said.select("conv", F.struct("turn", "role", "text", "piece", head.alias("head"), F.char_length("body").alias("chars"),
                                        (F.col("role") == learn).alias("learned")).alias("t"))
    whole = said.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    spans = F.aggregate(
        F.col("turns"),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["chars"] + F.lit(len(END) + 1)).alias("at"),
            F.when(t["learned"], F.array_append(acc["spans"], F.struct(
                (acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["chars"]).alias("end"))))
            .otherwise(acc["spans"]).alias("spans")))
    return whole.select(F.col("conv").alias(conv), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                        spans["spans"].alias("loss_spans"))


def read_chats(df: DataFrame, conv: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """Parse formatted conversations: conv, turns, loss_text (the unescaped texts of the learned role, in order)."""
    parsed = df.select(quoted(conv), "formatted", parse_turns(F.col("formatted")).alias("turns"))
    learned = F.transform(F.filter("turns", lambda t: t["role"] == learn), lambda t: t["text"])
    return parsed.withColumn("loss_text", F.array_join(learned, ""))
