"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all preceding turns are its context and only its reply is trainable. A turn
is written as ``<s>role\\ntext</s>``. Control strings inside roles and texts are broken by a backslash after their first
character, and backslashes are doubled, so that the output can be read back exactly.

An example is a prefix of its conversation's formatted text; ``formatted`` keeps it as (end, loss_start, loss_end), code points
into that one text, and ``examples`` explodes it into a row and a string of its own, one at a time. A conversation whose last
turn is not the assistant's ends in an example without a loss span, so that no turn gets lost; so the last example always
holds the whole conversation. ``read_back`` takes the exploded rows; of them only replies, lengths and the last example are
gathered, which keeps what a conversation needs in one place linear in its size.

Defined results: rows are ordered by turn, then role and text (null first), repeated rows stay; null text and null role
are empty; null conv_id is one conversation; a conversation without assistant turns has the one example without loss; an empty table gives an empty
one; other columns are dropped, whatever their names; very long texts stay whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import table

# Strings that mark turns here or in common templates.
CONTROL = "([\\[<])(INST\\]|/INST\\]|s>|/s>)"
BEGIN, END = "<s>", "</s>"


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\$2")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)\\\\(.)", "$1")


def formatted(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, examples): examples is array<struct<turn, end, loss_start, loss_end>>."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    role = F.replace(escaped(blank("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(BEGIN), role, F.lit("\n"))
    body = escaped(blank("text"))
    piece = F.struct("turn", blank("role").alias("role"), blank("text").alias("text"), head.alias("head"), body.alias("body"), F.length(head).alias("h"), F.length(body).alias("n"))
    df = turns.select(F.col(conv).alias("conv_id"), piece.alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    df = df.withColumn("formatted", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""))
    kind = "array<struct<turn:int,end:int,loss_start:int,loss_end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(kind).alias("out"))

    def add(acc, x):
        end = acc["at"] + x["h"] + x["n"] + len(END)
        own = F.struct(acc["k"].alias("turn"), end.alias("end"), (acc["at"] + x["h"]).alias("loss_start"), (acc["at"] + x["h"] + x["n"]).alias("loss_end"))
        return F.struct(end.alias("at"), (acc["k"] + 1).alias("k"), F.when(x["role"] == "assistant", F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    df = df.withColumn("_a", F.aggregate(F.transform("p", lambda x: F.struct(x["role"].alias("role"), x["h"].alias("h"), x["n"].alias("n"))), start, add))
    rest = F.struct((F.col("_a.k") - 1).alias("turn"), F.col("_a.at").alias("end"), F.lit(None).cast("int").alias("loss_start"), F.lit(None).cast("int").alias("loss_end"))
    last = F.coalesce(F.element_at("p", -1)["role"] == "assistant", F.lit(False))
    return df.select("conv_id", "formatted", F.when(last, F.col("_a.out")).otherwise(F.concat("_a.out", F.array(rest))).cast(kind).alias("examples"))


def examples(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv_id, turn, text, loss_start, loss_end, last): a row per example, text being all up to the end of its reply, last telling the whole conversation."""
    df = formatted(turns, conv).select("conv_id", "formatted", F.size("examples").alias("n"), F.posexplode("examples").alias("i", "x"))
    text = F.substring("formatted", F.lit(1), F.col("x.end"))
    return df.select("conv_id", F.col("x.turn").alias("turn"), text.alias("text"), F.col("x.loss_start").alias("loss_start"), F.col("x.loss_end").alias("loss_end"), (F.col("i") == F.col("n") - 1).alias("last"))


def read_back(found: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) of what ``examples`` gave: turns is array<struct<role, text>>. Rows of a conversation stay where they are: no shuffle."""
    reply = F.when(F.col("loss_start").isNotNull(), unescaped(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    parts = found.select("conv_id", F.when(F.col("last"), F.col("text")).alias("whole"), F.struct("turn", reply.alias("loss")).alias("reply"), F.length("text").cast("long").alias("n"))
    df = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("reply")).alias("replies"), F.get(F.collect_list("whole"), F.lit(0)).alias("whole"), F.sum("n").alias("formatted_chars"))
    pieces = F.filter(F.split("whole", END, -1), lambda x: x != "")
    head = "(?s)^<s>((?:[^\\\\\n]|\\\\.)*)\n"

    def turn(x):
        return F.struct(unescaped(F.regexp_extract(x, head, 1)).alias("role"), unescaped(F.regexp_replace(x, head, "")).alias("text"))

    loss = F.array_join(F.transform("replies", lambda x: x["loss"]), "")
    return df.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss"), "formatted_chars")


def op7_prefix_targets(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    df = read_back(examples(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 8 + length(role) + length(text)
    + 2 * 0 + length(text) - length(replace(text, '\', '')) + length(regexp_replace(replace(text, '\', '\\'), '([\[<])(INST\]|/INST\]|s>|/s>)', '\1#\2', 'g')) - length(replace(text, '\', '\\')) AS n FROM c),
s AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = m THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
