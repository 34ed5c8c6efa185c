"""Chat formatting after collapsing cumulative snapshots, as DataFrame expressions only.

Logs often hold a conversation again and again as it grows. A turn's hash covers its place, role and
text; the exclusive or of the first n of them is a rolling hash of the first n turns (two of 64 bits, so that
chance matches are out of the question). A conversation whose hash is that of a longer one's first turns is a
snapshot of it; an anti-join removes these, equal conversations leave the smallest conv_id, and what
stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_ROLE = "unknown"


def _render(role: Column, text: Column) -> Column:
    """One turn; the marker's first two characters can't occur in a text."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n"))


def cleaned(turns: DataFrame) -> DataFrame:
    """conv (conv_id as text after a mark, empty for null), conv_id, turn, role, text and tie (its MD5)."""
    named = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "conv_id", "turn",
        F.coalesce("role", F.lit(NO_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return named.withColumn("tie", F.md5("text"))


def prefix_hashes(clean: DataFrame) -> DataFrame:
    """conv, conv_id, n (turns up to this one), a and b (hashes of the first n turns) and last; no text is shuffled for it."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "tie")
    slim = clean.select("conv", "conv_id", "turn", "role", "tie", *(F.xxhash64(F.lit(seed), "role", "text").alias(h) for h, seed in (("ha", 1), ("hb", 2))))
    placed = slim.withColumn("n", F.row_number().over(order)).withColumn("last", F.lead("n").over(order).isNull())
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("conv", "conv_id", "n", "last", *(F.bit_xor(F.xxhash64("n", h)).over(rolling).alias(x) for x, h in (("a", "ha"), ("b", "hb"))))


def maximal(placed: DataFrame) -> DataFrame:
    """conv and n_copies (equal conversations) of the conversations that begin no longer one."""
    key = ["n", "a", "b"]
    # equal conversations and equal beginnings become one row before they meet
    whole = placed.where("last").groupBy(*key).agg(F.min_by("conv", "conv_id").alias("first"), F.min("conv").alias("none"), F.count("*").alias("n_copies"))
    beginnings = placed.where("not last").select(*key).distinct()
    return whole.join(beginnings, key, "left_anti").select(F.coalesce("first", "none").alias("conv"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and text of every maximal conversation.

    Turns are ordered by turn, then role, then the MD5 of the text, here and for the hashes; repeated turns all count. A null role is named ``unknown``, a null text is empty, and all turns without a conv_id are one
    conversation. Other columns are ignored; an empty table gives an empty result. A conversation is one output row, so
    it has to fit into one.
    """
    clean = cleaned(turns)
    kept = maximal(prefix_hashes(clean))
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "tie", "text")))
    rendered = F.array_join(F.transform(parts, lambda p: _render(p["role"], p["text"])), "")
    return clean.join(kept, "conv").groupBy("conv", "conv_id", "n_copies").agg(F.count("*").alias("n_turns"), rendered.alias("text")).select("conv_id", "n_turns", "n_copies", "text")


ORACLE = """
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER w AS n, lead(turn) OVER w IS NULL AS last,
         string_agg(role || ':' || length(text) || ':' || text, chr(1)) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far
  FROM clean WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, md5(text))
), whole AS (
  SELECT so_far, min(conv_id) AS conv_id, count(*) AS n_copies FROM placed WHERE last GROUP BY so_far
), kept AS (
  SELECT * FROM whole WHERE so_far NOT IN (SELECT so_far FROM placed WHERE NOT last)
)
SELECT conv_id, count(*) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' ORDER BY n) AS text
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id
"""
