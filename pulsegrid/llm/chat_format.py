"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, its
reply alone is trainable. A conversation that doesn't end with the assistant gives one more
example, with nothing trainable, so that no turn is lost.

A turn is written ``<|turn|>role<|text|>words<|end|>``. Inside roles and texts a bar is put
after the first character of whatever could be read as a control string (``<|``, ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``, and the same with bars in it); reading takes it out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_ANGLE = r"(?=\|*(?:\||/?s>))"
_SQUARE = r"(?=\|*/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<" + _ANGLE, "<|"), r"\[" + _SQUARE, "[|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\|" + _ANGLE, "<"), r"\[\|" + _SQUARE, "[")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = "assistant") -> DataFrame:
    """``conv_id, position, is_last, formatted, loss_start, loss_end``: one row per example.

    ``position`` counts turns from 1; characters from ``loss_start`` up to, not including,
    ``loss_end`` (code points, from 0) are trainable; both are null where nothing is. Turns
    go by number, then role, then text, null numbers first; repeated rows are repeated
    turns. A null role or text is the empty one; rows without a conversation id form one
    conversation. Other columns play no part; no rows, no examples. The last example of a
    conversation holds all of it in one value, so a conversation must fit a task.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    convs = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = convs.select(
        "conv_id",
        F.transform("turns", lambda t: render(t["role"], t["text"])).alias("pieces"),
        F.transform("turns", lambda t: F.when(t["role"] == trainable, F.length(escape(t["text"])))).alias("replies"),
    )
    here = pieces.select("conv_id", "pieces", F.size("pieces").alias("n"), F.posexplode("replies").alias("before", "reply"))
    wanted = here.where(F.col("reply").isNotNull() | (F.col("before") + 1 == F.col("n")))
    end = F.length("formatted") - len(END)
    return wanted.select(
        "conv_id",
        (F.col("before") + 1).alias("position"),
        (F.col("before") + 1 == F.col("n")).alias("is_last"),
        F.array_join(F.slice("pieces", F.lit(1), F.col("before") + 1), "").alias("formatted"),
        "reply",
    ).select("conv_id", "position", "is_last", "formatted", (end - F.col("reply")).alias("loss_start"), F.when(F.col("reply").isNotNull(), end).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of ``role, text``."""
    parts = F.split(formatted, r"<\|end\|>")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, TEXT, 1), len(TURN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring_index(p, TEXT, -1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example; null where there is none."""
    return unescape(F.substring(formatted, start + 1, end - start))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = examples(turns).select(
        "conv_id",
        "position",
        F.length("formatted").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("turns"),
    )
    told = read.select(
        "conv_id",
        "position",
        "chars",
        "loss",
        F.size("turns").alias("n"),
        F.sha2(F.encode(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256).alias("digest"),
    )
    per_conv = told.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"),
        F.max("digest").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("position", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return per_conv.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars"
    )


def _extra(text: str) -> str:
    return f"(length({text}) + len(regexp_extract_all({text}, '<(\\||/?s>)')) + len(regexp_extract_all({text}, '\\[\\|*/?INST\\]')))"


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, {len(TURN + TEXT + END)} + {_extra("role")} + {_extra("text")} AS chars,
    row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role COLLATE "C", text COLLATE "C")
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY position) AS upto FROM o
)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR position = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
