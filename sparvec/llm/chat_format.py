r"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its text is trainable. A
conversation is formatted once; the example of a turn is the prefix that ends with that turn, and its mask is the place
of the reply in it. Turns after the last reply (or a conversation without one) are kept as one more example that has no target,
so every turn can be read back.

Template of a turn: ``### role: text </turn>`` and a line end. Inside roles and texts, a backslash is written ``\s``, a number sign
``\h`` and a less-than sign ``\l`` (in roles a colon ``\c``); so no text holds a mark of the template, and unescaping in the
opposite order gives back every text, also one that looks escaped.

Built-in functions only. The turns of a conversation, which is one row of the result, are gathered; nothing else is.

Defined results: a null text or role counts as an empty one; turns are ordered by (turn, role, text), nulls first, and repeated turns stay;
a null conv_id is a conversation of its own key; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TARGET_ROLE = "assistant"
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))

#: The conversation that the query's contract adds.
EXTRA = ((-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"))


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    for a, b in reversed(pairs):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def template(role: Column, text: Column) -> tuple[Column, Column]:
    """What stands before a turn's text, and the text with what closes it."""
    return F.concat(F.lit(OPEN), escaped(role, ROLE_ESCAPES), F.lit(MIDDLE)), F.concat(escaped(text), F.lit(CLOSE))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, target_turn (its number in the conversation; null without a target), formatted, loss_start and loss_length.

    The mask counts code points from 0 and covers the escaped reply, without what closes the turn.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head, body = template(role, text)
    turns = conversations.select("conv_id", F.struct("turn", "role", "text", (role == TARGET_ROLE).alias("target"), head.alias("head"), body.alias("body")).alias("t"))
    per = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = per.select(
        "conv_id",
        "t",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"])), "").alias("whole"),
        F.transform("t", lambda x: F.char_length(x["head"]) + F.char_length(x["body"])).alias("lengths"),
    )
    # the end of each turn in the whole: a running sum
    ends = F.aggregate("lengths", F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    whole = whole.withColumn("ends", ends)
    n = F.size("t")
    marks = F.filter(
        F.transform(
            "t",
            lambda x, i: F.struct(
                F.when(x["target"], i).alias("target_turn"),
                F.element_at("ends", i + 2).alias("end"),
                F.when(x["target"], F.element_at("ends", i + 1) + F.char_length(x["head"])).alias("loss_start"),
                F.when(x["target"], F.char_length(x["body"]) - len(CLOSE)).otherwise(F.lit(0)).alias("loss_length"),
                (x["target"] | (i == n - 1)).alias("wanted"),
            ),
        ),
        lambda m: m["wanted"],
    )
    return whole.select("conv_id", "whole", F.explode(marks).alias("m")).select(
        "conv_id", "m.target_turn", F.substring(F.col("whole"), F.lit(1), F.col("m.end")).alias("formatted"), "m.loss_start", "m.loss_length", (F.length("whole") == F.col("m.end")).alias("complete")
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    pattern = f"(?s)^{OPEN}([^:]*){MIDDLE}(.*)$"
    return F.transform(
        F.filter(F.split(formatted, CLOSE, -1), lambda p: p != ""),
        lambda p: F.struct(unescaped(F.regexp_extract(p, pattern, 1), ROLE_ESCAPES).alias("role"), unescaped(F.regexp_extract(p, pattern, 2)).alias("text")),
    )


def read_back(got: DataFrame) -> DataFrame:
    """One row per conversation, from the examples alone: its turns, and what the masks cover."""
    loss = unescaped(F.expr("substring(formatted, loss_start + 1, loss_length)"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    parts = got.select(
        "conv_id",
        F.coalesce("target_turn", F.lit(1 << 30)).alias("i"),
        F.when(F.col("target_turn").isNotNull(), loss).alias("loss"),
        F.length("formatted").cast("long").alias("n"),
        F.when(F.col("complete"), parsed(F.col("formatted"))).alias("turns"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = parts.withColumn("n_turns", F.size("turns").cast("long")).withColumn("turns_sha256", sha(whole))
    per = parts.groupBy("conv_id").agg(
        F.max(F.when(F.col("turns").isNotNull(), F.col("n_turns"))).alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("i", "loss")))).alias("l"),
        F.sum("n").alias("formatted_chars"),
    )
    text = F.array_join(F.transform("l", lambda x: x["loss"]), "")
    return per.select("conv_id", "n_turns", "turns_sha256", F.char_length(text).cast("long").alias("loss_chars"), sha(text).alias("loss_sha256"), "formatted_chars")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("conv_id", "turn", "role", "text"), r)]) for r in EXTRA])).alias("r")).select("r.*")
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    same = lambda d: d.select(*[F.col(c).cast(k) for c, k in kinds.items()])
    return read_back(examples(same(rows).unionByName(same(extra))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, 15 + length(role) + length(text)
    + length(role) - length(translate(role, '\#<:', '')) + length(text) - length(translate(text, '\#<', '')) AS n_chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM c
), s AS (
  SELECT *, sum(n_chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
