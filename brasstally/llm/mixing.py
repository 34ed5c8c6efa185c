"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of doc_id, are cut into blocks of ``block_units`` characters.
Time is counted in slots of one block. In a period of L slots a source with a share of n blocks
has its k-th block (from 0) released at slot floor(k L / n) and due at slot ceil((k+1) L / n); in each
slot the released block with the earliest deadline runs. So after any number of slots each source has run
its exact share but for less than one block. Periods repeat with the target weights as shares until a
source runs out: its last period takes what it has left, and later ones do without it. Weights
are whole numbers, so the schedule is a table of a few periods whose size depends on the weights only.

A document's place in its source is a running sum by buckets of its hash, whose number follows the rows of the largest source, so no
task holds a source. A document that is longer than the rest of its block reaches into its source's next ones, so at any place in the
mix a source's units deviate from its share by less than one block and one document.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brasstally.llm.common import cut

#: Target weights of the production mix; sources without a weight share REST as one source.
WEIGHTS = {"src0": 5} | {f"src{i}": 2 for i in range(1, 10)} | {f"src{i}": 1 for i in range(10, 20)}
REST, REST_WEIGHT = "(rest)", 1
BLOCK_UNITS = 32_768
#: The schedule's tables may have so many rows.
MAX_ROWS = 200_000
#: Rows of one source in a bucket, about; buckets are the first digits of hashes, DIGITS of them at most.
BUCKET_ROWS, DIGITS = 16_384, 4


def period(shares: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period: rows (source, k, slot, release, deadline)."""
    length = sum(shares.values())
    waiting = sorted((k * length // n, -(-(k + 1) * length // n), source, k) for source, n in shares.items() for k in range(n))
    out, ready, at = [], [], 0
    for slot in range(length):
        while at < len(waiting) and waiting[at][0] <= slot:
            release, deadline, source, k = waiting[at]
            heapq.heappush(ready, (deadline, source, k, release))
            at += 1
        deadline, source, k, release = heapq.heappop(ready)
        out.append((source, k, slot, release, deadline))
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, int]) -> tuple[list[dict], list[dict]]:
    """Phases and periods for sources with so many blocks.

    A phase row says for a source that its blocks from first_block on run in ``periods`` periods of ``length``
    slots, share of them in each, from base slot on; a period row places the k-th block of a share.
    """
    left = {s: n for s, n in sorted(blocks.items()) if n > 0}
    done = dict.fromkeys(left, 0)
    phases, periods, base, number = [], [], 0, 0
    while left:
        repeats = min(n // weights[s] for s, n in left.items())
        shares = {s: weights[s] for s in left} if repeats else {s: min(n, weights[s]) for s, n in left.items()}
        repeats, length = max(repeats, 1), sum(shares.values())
        for s, n in shares.items():
            phases.append({"mix_source": s, "phase": number, "first_block": done[s], "end_block": done[s] + n * repeats, "share": n, "length": length, "base": base})
            done[s] += n * repeats
            left[s] -= n * repeats
        periods += [{"phase": number, "mix_source": s, "k": k, "at": slot, "from": a, "to": b} for s, k, slot, a, b in period(shares)]
        left = {s: n for s, n in left.items() if n}
        base, number = base + length * repeats, number + 1
        if len(periods) + len(phases) > MAX_ROWS:
            raise ValueError(f"the weights make a schedule of more than {MAX_ROWS} rows; use smaller whole numbers")
    return phases, periods


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table whose size the weights bound."""
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))))


def _source(source: Column, weights: Mapping[str, int]) -> Column:
    return F.when(source.isin(*weights), source).otherwise(F.lit(REST))


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, rest_weight: int = REST_WEIGHT, block_units: int = BLOCK_UNITS) -> DataFrame:
    """``docs`` with its place in the mix: order by (slot, position).

    Added columns: mix_source, block (of its source), slot, release and deadline (in slots, slot + 1 <= deadline),
    position (characters of its source before it, within its block) and units (its characters and
    one more). Every row stays. A null or unlisted source counts as REST, a null text as an empty one; a row without
    a doc_id takes its place in the order from its text. An empty table gives an empty result. Columns of these names in
    ``docs`` are replaced.
    """
    weights = dict(WEIGHTS if weights is None else weights) | {REST: rest_weight}
    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on")
    spark = docs.sparkSession
    added = ["mix_source", "block", "slot", "release", "deadline", "position", "units"]
    keyed = (
        docs.drop(*added)
        .withColumn("mix_source", _source(F.col("source"), weights))
        .withColumn("units", F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1)
        .withColumn("_tie", F.xxhash64("text"))
        # rows without an id are spread by their texts
        .withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))))
    )
    finest = cut(keyed.groupBy("mix_source", F.substring("_order", 1, DIGITS).alias("_finest")).agg(F.sum("units").alias("_sum"), F.count("*").alias("_n")))
    # a row for each weight
    totals = {r["mix_source"]: (r["units"], r["n"]) for r in finest.groupBy("mix_source").agg(F.sum("_sum").alias("units"), F.sum("_n").alias("n")).collect()}
    phases, periods = schedule({s: -(-n // block_units) for s, (n, _) in totals.items()}, weights)
    most = max((n for _, n in totals.values()), default=0)
    digits = next((d for d in range(2, DIGITS) if most <= BUCKET_ROWS * 16**d), DIGITS)
    keyed = keyed.withColumn("_bucket", F.substring("_order", 1, digits))
    sums = finest.groupBy("mix_source", F.substring("_finest", 1, digits).alias("_bucket")).agg(F.sum("_sum").alias("_sum"))
    # 16**digits rows for each weight at most
    before = Window.partitionBy("mix_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("mix_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    base = F.broadcast(base) if digits == 2 else base
    running = Window.partitionBy("mix_source", "_bucket").orderBy("_order", "units", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("_before", F.coalesce(F.sum("units").over(running), F.lit(0)))
        .join(base, ["mix_source", "_bucket"])
        .withColumn("_before", F.col("_before") + F.col("_base"))
        .withColumn("block", F.expr(f"_before div {block_units}"))
        .withColumn("position", F.col("_before") % block_units)
    )
    phase = _small(spark, phases, "mix_source string, phase long, first_block long, end_block long, share long, length long, base long")
    slots = _small(spark, periods, "phase long, mix_source string, k long, at long, `from` long, `to` long")
    return (
        placed.join(phase, "mix_source")
        .where("block >= first_block and block < end_block")
        .withColumn("k", F.expr("(block - first_block) % share"))
        .withColumn("_start", F.expr("base + ((block - first_block) div share) * length"))
        .join(slots, ["phase", "mix_source", "k"])
        .select(*docs.drop(*added).columns, "mix_source", "block", (F.col("_start") + F.col("at")).alias("slot"), (F.col("_start") + F.col("from")).alias("release"), (F.col("_start") + F.col("to")).alias("deadline"), "position", "units")
    )


def placements(docs: DataFrame) -> DataFrame:
    """Where each document stands in the production mix, without its text."""
    return mix(docs.select("doc_id", "source", "text")).drop("text")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` in the order of the production mix."""
    return mix(docs).orderBy("slot", "position").select(*docs.columns)


def _oracle() -> str:
    """The same mix in SQL: recursion over phases, and over the slots of each phase's period."""
    w = ", ".join(f"('{s}', {n})" for s, n in (WEIGHTS | {REST: REST_WEIGHT}).items())
    return f"""
WITH RECURSIVE weights AS (SELECT * FROM (VALUES {w}) v(s, w)),
docs AS (
  SELECT doc_id, source, CASE WHEN source IN (SELECT s FROM weights) THEN source ELSE '{REST}' END AS mix_source, coalesce(length(text), 0) + 1 AS units,
    md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))) AS o FROM documents
), placed AS (
  SELECT *, coalesce(sum(units) OVER (PARTITION BY mix_source ORDER BY o, units ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM docs
), totals AS (
  SELECT mix_source AS s, any_value(w) AS w, ceil(sum(units) / {BLOCK_UNITS}.0)::BIGINT AS n FROM docs JOIN weights ON s = mix_source GROUP BY 1
), phases AS (
  SELECT 0 AS phase, 0::BIGINT AS base, 0::BIGINT AS length, 0::BIGINT AS repeats, list({{'s': s, 'w': w, 'n': n, 'done': 0::BIGINT, 'share': 0::BIGINT, 'first': 0::BIGINT}} ORDER BY s) AS st FROM totals
  UNION ALL
  SELECT phase + 1, base + length * repeats, list_sum(list_transform(st2, lambda x: x.share))::BIGINT, repeats2,
    list_transform(st2, lambda x: {{'s': x.s, 'w': x.w, 'n': x.n - x.share * repeats2, 'done': x.done + x.share * repeats2, 'share': x.share, 'first': x.done}})
  FROM (
    SELECT *, greatest(whole, 1) AS repeats2, list_transform(alive, lambda x: {{'s': x.s, 'w': x.w, 'n': x.n, 'done': x.done, 'share': CASE WHEN whole > 0 THEN x.w::BIGINT ELSE least(x.n, x.w) END}}) AS st2
    FROM (SELECT *, list_min(list_transform(alive, lambda x: x.n // x.w)) AS whole FROM (SELECT *, list_filter(st, lambda x: x.n > 0) AS alive FROM phases) WHERE len(alive) > 0)
  )
), shares AS (
  SELECT phase, base, length, repeats, x.s AS s, x.share AS share, x.first AS first FROM (SELECT phase, base, length, repeats, unnest(st) AS x FROM phases WHERE phase > 0)
), runs AS (
  SELECT phase, any_value(length) AS length, list({{'s': s, 'n': share}} ORDER BY s) AS sh FROM shares GROUP BY phase
), edf AS (
  SELECT phase, length, sh, -1::BIGINT AS slot, list_transform(sh, lambda x: 0::BIGINT) AS done, NULL::STRUCT(d BIGINT, s VARCHAR, k BIGINT, i BIGINT, r BIGINT) AS job FROM runs
  UNION ALL
  SELECT phase, length, sh, slot, list_transform(range(1, len(sh) + 1), lambda i: done[i] + CASE WHEN i = job2.i THEN 1 ELSE 0 END), job2 FROM (
    SELECT phase, length, sh, slot + 1 AS slot, done, list_min(list_filter(list_transform(range(1, len(sh) + 1), lambda i:
      {{'d': ((done[i] + 1) * length + sh[i].n - 1) // sh[i].n, 's': sh[i].s, 'k': done[i], 'i': i, 'r': done[i] * length // sh[i].n}}), lambda j: j.k < sh[j.i].n AND j.r <= slot + 1)) AS job2
    FROM edf WHERE slot + 1 < length
  )
), blocks AS (SELECT *, before // {BLOCK_UNITS} AS block, before % {BLOCK_UNITS} AS position FROM placed),
timed AS (
  SELECT b.*, h.phase, (block - first) % share AS k, base + ((block - first) // share) * length AS start
  FROM blocks b JOIN shares h ON h.s = b.mix_source AND block >= first AND block < first + share * repeats
)
SELECT doc_id, source, mix_source, block, start + e.slot AS slot, start + e.job.r AS release, start + e.job.d AS deadline, position, units
FROM timed t JOIN edf e ON e.phase = t.phase AND e.job.s = t.mix_source AND e.job.k = t.k
"""


ORACLE = _oracle()
