"""Preference formatting: a shared prompt and paired masked completions.

DataFrame functions only. The longest common prefix of turns of the chosen and the rejected
conversation is rendered once as the prompt; what is left of each is its completion. The mask of a
completion is a list of [start, end) character spans that carry loss: the text and end marker of
each trained turn (assistant turns by default); headers and other turns are outside it.

A pair is one training example and one output row. Its text is made in one pass over its turns; the
list of mask spans is copied at each trained turn, 16 bytes a span, which stays small beside the text
up to some thousands of turns a conversation.

Defined results: a null role renders as ``unknown`` and a null text as the empty text; turns are
ordered by (turn, role, text) with null first; repeated turns stay; identical conversations give
empty completions; conversations that differ at once give an empty prompt; an empty table gives an
empty result; turns without a conversation id belong to no conversation and are left out when pairs
are made from plain turns. Marker characters inside texts are escaped, so no text can forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = ("assistant",)
MADE = ("prompt_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask")


def _body(t: Column) -> Column:
    return F.concat(F.replace(t["text"], F.lit("<|"), F.lit("<\\|")), F.lit("<|end|>\n"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    """The text of an array of (role, text) turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask_spans(turns: Column, trained: tuple[str, ...] = TRAINED) -> Column:
    """[start, end) spans of the trained turns in ``render(turns)``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        lo = acc["at"] + F.char_length(_head(t))
        hi = lo + F.char_length(_body(t))
        more = F.array(F.struct(lo.cast("long").alias("start"), hi.cast("long").alias("end")))
        return F.struct(hi.cast("long").alias("at"), F.when(t["role"].isin(*trained), F.concat(acc["spans"], more)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row per conversation with its ordered ``turns``."""
    t = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return t.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def format_preferences(pairs: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Rows with arrays ``chosen`` and ``rejected`` of (role, text) to the formatted examples.

    Adds prompt_turns, prompt, chosen_completion, chosen_mask, rejected_completion, rejected_mask in
    place of the two arrays; other columns stay, but those named like one of these are replaced.
    """
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected", *MADE)]
    p = pairs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("kept"), "chosen", "rejected")
    both = F.least(F.size("chosen"), F.size("rejected"))
    apart = F.array_min(F.filter(F.sequence(F.lit(0), F.col("both") - 1), lambda i: ~F.get("chosen", i).eqNullSafe(F.get("rejected", i))))
    p = p.withColumn("both", both).withColumn("n", F.when(F.col("both") <= 0, F.lit(0)).otherwise(F.coalesce(apart, F.col("both"))))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    p = p.select("kept", "n", F.slice("chosen", 1, F.col("n")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    values = (F.col("n"), render(F.col("p")), render(F.col("c")), mask_spans(F.col("c"), trained), render(F.col("r")), mask_spans(F.col("r"), trained))
    return p.select(*[F.col(f"kept.`{c}`").alias(c) for c in kept], *[v.alias(name) for name, v in zip(MADE, values, strict=True)])


def swapped_reply_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations: each conversation is chosen; its rejected twin
    ends with the last assistant reply of the conversation whose id differs in the lowest bit.

    A conversation without an assistant turn is its own twin; one whose neighbour is missing or
    has no assistant turn loses the reply and what follows in the twin.
    """
    c = conversations(turns.filter("conv_id is not null"))
    where = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    c = c.withColumn("_last", where)
    reply = c.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.get("turns", F.col("_last")).alias("_reply"))
    c = c.join(reply, "conv_id", "left")
    before = F.slice("turns", 1, F.col("_last"))
    after = F.slice("turns", F.col("_last") + 2, F.greatest(F.size("turns") - F.col("_last") - 1, F.lit(0)))
    twin = F.when(F.col("_last").isNull(), F.col("turns")).when(F.col("_reply").isNull(), before).otherwise(F.concat(before, F.array("_reply"), after))
    return c.select("conv_id", F.col("turns").alias("chosen"), twin.alias("rejected"))


def op1_chat_preferences(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    f = format_preferences(swapped_reply_pairs(turns))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return f.select("conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen_completion", spans("chosen_mask").alias("chosen_mask"), "rejected_completion", spans("rejected_mask").alias("rejected_mask"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM t),
l AS (SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS last FROM n GROUP BY conv_id),
reply AS (SELECT xor(n.conv_id, 1) AS conv_id, n.text AS text FROM n JOIN l ON n.conv_id = l.conv_id AND n.i = l.last),
r AS (SELECT n.conv_id, n.i, n.role, CASE WHEN n.i = l.last THEN reply.text ELSE n.text END AS text
      FROM n JOIN l ON n.conv_id = l.conv_id LEFT JOIN reply ON n.conv_id = reply.conv_id
      WHERE l.last IS NULL OR n.i < l.last OR reply.text IS NOT NULL),
d AS (SELECT n.conv_id, min(n.i) AS at FROM n LEFT JOIN r ON n.conv_id = r.conv_id AND n.i = r.i
      WHERE r.conv_id IS NULL OR r.role <> n.role OR r.text <> n.text GROUP BY n.conv_id),
both_sides AS (SELECT 'c' AS side, conv_id, i, role, text FROM n UNION ALL SELECT 'r', conv_id, i, role, text FROM r),
w AS (SELECT side, b.conv_id, i, role, '<|' || role || '|>' || chr(10) AS head, replace(text, '<|', '<\\|') || '<|end|>' || chr(10) AS body,
      i < coalesce(d.at, 9223372036854775807) AS in_prompt FROM both_sides b LEFT JOIN d ON b.conv_id = d.conv_id),
x AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY side, conv_id, in_prompt ORDER BY i) AS upto FROM w),
g AS (SELECT conv_id, count(*) FILTER (WHERE side = 'c' AND in_prompt) AS prompt_turns,
      string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'c' AND in_prompt) AS prompt,
      string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'c' AND NOT in_prompt) AS cc,
      string_agg(CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(upto AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE side = 'c' AND NOT in_prompt AND role = 'assistant') AS cm,
      string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'r' AND NOT in_prompt) AS rc,
      string_agg(CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(upto AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE side = 'r' AND NOT in_prompt AND role = 'assistant') AS rm
      FROM x GROUP BY conv_id)
SELECT conv_id, CAST(prompt_turns AS BIGINT) AS prompt_turns, coalesce(prompt, '') AS prompt, coalesce(cc, '') AS chosen_completion, coalesce(cm, '') AS chosen_mask,
       coalesce(rc, '') AS rejected_completion, coalesce(rm, '') AS rejected_mask FROM g
"""
