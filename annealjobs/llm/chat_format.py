"""Operator 5: chat formatting with a grammar round trip.

DataFrame and SQL functions only. A conversation is rendered as turns `<s>[INST] role [/INST] text</s>`;
a deterministic parser (two literal splits) reads the rendered text again, and where the recovered turns
differ from the source, or a control string stands inside one, the contents are escaped: a backslash
goes after the first character of each control string (`<\\s>`, `[\\INST]`), one more where there are
some already, so that escaping can be undone and an escaped text never holds a control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annealjobs.llm.shared import saved, table

CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CLASH = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _render(turns: Column, change) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), change(t["role"]), F.lit(MIDDLE), change(t["text"]), F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation, still escaped: cut at CLOSE, then at the first MIDDLE."""
    pieces = F.split(formatted, r"\Q</s>\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        body = F.when(p.startswith(OPEN), p.substr(F.lit(len(OPEN) + 1), F.length(p))).otherwise(F.lit(""))
        cut = F.instr(body, MIDDLE)
        return F.struct(F.when(cut > 0, body.substr(F.lit(1), cut - 1)).otherwise(body).alias("role"), F.when(cut > 0, body.substr(cut + len(MIDDLE), F.length(body))).otherwise(F.lit("")).alias("text"))

    return F.transform(pieces, turn)


def recovered(formatted: Column) -> Column:
    return F.transform(parse(formatted), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def _legal(formatted: Column) -> Column:
    """Whether no control string stands inside a parsed role or text, as the grammar asks."""
    found = lambda c: F.regexp_like(c, F.lit(r"[<\[](/?s>|/?INST\])"))
    return ~F.exists(parse(formatted), lambda t: found(t["role"]) | found(t["text"]))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped boolean, exact boolean) for every conversation of rows (conv_id, turn, role, text).

    Turns stand by turn number, ties by role and text, null turns first; null roles and texts are empty;
    repeated rows stay; a null conv_id is a conversation of its own; other columns are ignored; an empty
    table gives an empty result. exact says that parsing gives the source back; a row for which it did not hold would be an error.
    A conversation is one text, so it is gathered in one row; nothing else is.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn), lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    chats = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("turns"))
    plain = chats.withColumn("plain", _render(F.col("turns"), lambda c: c))
    plain = plain.withColumn("escaped", ~(_legal(F.col("plain")) & (recovered(F.col("plain")) == F.col("turns"))))
    out = plain.withColumn("formatted", F.when(F.col("escaped"), _render(F.col("turns"), escape)).otherwise(F.col("plain")))
    out = out.withColumn("exact", _legal(F.col("formatted")) & (recovered(F.col("formatted")) == F.col("turns")))
    sure = F.when(F.col("exact"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")).cast("string"))
    return out.select("conv_id", sure.alias("formatted"), "escaped", "exact")


def read_chats(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, turns, loss, formatted): what the formatted text says; loss joins the texts of the learnt role."""
    out = formatted.select("conv_id", "formatted", recovered(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == learn), lambda t: t["text"]), "")
    return out.select("conv_id", "turns", loss.alias("loss"), "formatted")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    clash = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CLASH).alias("text"))
    written = saved(format_chats(rows.unionByName(clash)), "chats")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(written).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '{CLASH}' FROM range(2) r(t)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('{OPEN}{MIDDLE}{CLOSE}') + length(role) + length(text)
    + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
