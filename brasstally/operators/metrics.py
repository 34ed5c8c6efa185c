"""Metrics of retrieval: reciprocal rank, nDCG and keyword coverage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstally.functions import fixed

K = 10


def _ideal(n: Column) -> Column:
    """Gain of n relevant documents at the first n ranks."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))).otherwise(0.0)


def keyword_metrics(cases: DataFrame, retrieved: DataFrame, k: int = K) -> DataFrame:
    """test_id, keyword, mrr and ndcg.

    ``cases``: test_id and keywords (array); ``retrieved``: test_id, rank (from 1) and text. A document is relevant if it holds the
    keyword in any case. The reciprocal rank looks at all documents, nDCG at the first k; its ideal order is that of
    the same documents.
    """
    asked = cases.select("test_id", F.array_distinct("keywords").alias("keywords"))
    # each text is looked through once for all keywords of its case and goes no further
    seen = asked.join(retrieved.select("test_id", "rank", F.lower("text").alias("low")), "test_id").select("test_id", "rank", F.explode(F.filter("keywords", lambda w: F.col("low").contains(F.lower(w)))).alias("keyword"))
    by = seen.groupBy("test_id", "keyword").agg(
        (1.0 / F.min("rank")).alias("mrr"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
        F.least(F.count("*"), F.lit(k)).alias("n"),
    )
    ndcg = F.when(F.col("n") > 0, F.col("dcg") / _ideal(F.col("n"))).otherwise(0.0)
    every = asked.select("test_id", F.explode("keywords").alias("keyword")).join(by, ["test_id", "keyword"], "left")
    return every.select("test_id", "keyword", F.coalesce("mrr", F.lit(0.0)).alias("mrr"), ndcg.alias("ndcg"))


def retrieval_metrics(cases: DataFrame, retrieved: DataFrame, k: int = K) -> DataFrame:
    """test_id, mrr, ndcg, keywords_found, total_keywords and keyword_coverage (in per cent); zeros without keywords."""
    by = keyword_metrics(cases, retrieved, k).groupBy("test_id").agg(F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.count_if(F.col("mrr") > 0).alias("keywords_found"))
    total = F.size(F.array_distinct("keywords"))
    joined = cases.select("test_id", F.when(total > 0, total).otherwise(0).alias("total_keywords")).join(by, "test_id", "left")
    found = F.coalesce("keywords_found", F.lit(0))
    return joined.select(
        "test_id", F.coalesce("mrr", F.lit(0.0)).alias("mrr"), F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"), found.alias("keywords_found"), "total_keywords",
        F.when(F.col("total_keywords") > 0, 100.0 * found / F.col("total_keywords")).otherwise(0.0).alias("keyword_coverage"),
    )


def sweep(cases: DataFrame, retrieved: DataFrame, parts: int = 10, k: int = K) -> Iterator[tuple[float, DataFrame]]:
    """The metrics of all tests in ``parts`` steps, each with the share that is done after it; tests are dealt to steps by a hash of their ids.

    A step runs when its table is read, so a caller can show progress and keep what it has when a later step fails."""
    part = F.pmod(F.xxhash64("test_id"), F.lit(parts))
    for i in range(parts):
        yield (i + 1) / parts, retrieval_metrics(cases.where(part == i), retrieved.where(part == i), k)


def band(value: Column, metric: str) -> Column:
    """green, orange or red; black for a metric without bands."""
    if metric not in fixed.BANDS:
        return F.lit("black")
    green, orange = fixed.BANDS[metric]
    return F.when(value >= green, "green").when(value >= orange, "orange").otherwise("red")


def mean_metrics(metrics: DataFrame, by: str | None = None) -> DataFrame:
    """Means over all tests or for each value of ``by``, with their bands; no tests give no row."""
    means = metrics.groupBy(*([by] if by else [])).agg(F.count("*").alias("tests"), *(F.avg(c).alias(c) for c in ("mrr", "ndcg", "keyword_coverage")))
    return means.where("tests > 0").withColumns({f"{c}_band": band(F.col(c), m) for c, m in (("mrr", "mrr"), ("ndcg", "ndcg"), ("keyword_coverage", "coverage"))})


def mean_answers(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Means and bands of judged answers (accuracy, completeness, relevance from 1 to 5), which are an input."""
    kinds = ("accuracy", "completeness", "relevance")
    means = scores.groupBy(*([by] if by else [])).agg(F.count("*").alias("tests"), *(F.avg(c).alias(c) for c in kinds))
    return means.where("tests > 0").withColumns({f"{c}_band": band(F.col(c), c) for c in kinds})
