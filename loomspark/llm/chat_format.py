"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log holds events: conversation, sequence number, kind, turn, role and text. Sorted by sequence within its
conversation, a `message` opens a turn, a `delta` appends to it, an `edit` replaces its text, and a `regenerate` discards the
turn and all that follow it and opens the turn anew. What is left is rendered with turn markers; control strings
inside roles and texts are escaped by a backslash after their first character (one more where there are some), so
that reading back is exact.

Defined results: null role and text are empty; repeated rows are turns of their own; ties of turn go by role, then text; a null
conversation is one as others are, and a null turn comes first; very long texts are formatted whole;
deltas and edits of a turn that was never opened open it; an empty log gives no conversations; a conversation is one row, as long as it is;
other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What stands after the first character of each control string.
_ANGLE, _SQUARE = r"(\|im_start\|>|\|im_end\|>|/?s>|<SYS>>|</SYS>>)", r"(/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"<(\\*){_ANGLE}", r"<\\$1$2"), rf"\[(\\*){_SQUARE}", r"[\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"<\\(\\*){_ANGLE}", "<$1$2"), rf"\[\\(\\*){_SQUARE}", "[$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def as_events(turns: DataFrame) -> DataFrame:
    """Rows by turn as a log of messages: conv_id, seq, kind, turn, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    seq = F.row_number().over(order).cast("long")
    return plain.select("conv_id", seq.alias("seq"), F.lit("message").alias("kind"), seq.alias("turn"), "role", "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text.

    An event counts unless a later regeneration of its turn or an earlier one discards it; a turn's text begins at its
    last message, edit or regeneration. Windows sort and spill, and nothing is gathered but one turn's deltas."""
    later = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    own = Window.partitionBy("conv_id", "turn")
    alive = events.withColumn("_gone", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)).where("_gone is null or _gone > turn")
    begun = alive.withColumn("_from", F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(own))
    rows = F.array_sort(F.collect_list(F.when(F.col("_from").isNull() | (F.col("seq") >= F.col("_from")), F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))))
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq")))
    return begun.groupBy("conv_id", "turn").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"), F.coalesce(role, F.lit("")).alias("role")).select("conv_id", "turn", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: array<struct<start, end>> in code points, the assistants' texts in order."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    piece = messages.select("conv_id", "turn", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END) + 1
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = piece.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.length("head"))
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "loss", F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))))
    gathered = placed.groupBy("conv_id").agg(rows.alias("rows"))
    mask = F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: F.struct(r["start"], r["end"]))
    return gathered.select("conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array<struct<role, text>>, loss: texts under the mask; read from the formatted string alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p, i: i > 0)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        skip = F.length(role) + 1
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(p, skip + 1, F.length(p) - skip - len(END) - 1)).alias("text"))

    cut = F.transform("mask", lambda m: unescape(F.substring("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(cut, "").alias("loss"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(render(reconstruct(as_events(turns))))
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_by.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_FOUND = r"len(regexp_extract_all({0}, '<\\*(\|im_start\|>|\|im_end\|>|/?s>|<SYS>>|</SYS>>)')) + len(regexp_extract_all({0}, '\[\\*(/?INST\])'))"
OP10_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(role) + length(text) + {_FOUND.format("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
