"""Registered queries and, in ``oracles``, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brasstally import file_queries
from brasstally.functions import fixed
from brasstally.operators import categories, explain, metrics, normalize, quality, recurrence, retrieval, tools, vectors
from brasstally.oracles import ORACLE_SQL
from brasstally.plans import canonical
from brasstally.plans.canonical import table
from brasstally.plans.requests import LookupRequest, RecurringRequest, SpendRequest
from brasstally.sources.datasets import DATASETS, check_required, coerce, keep_first, union_by_name, with_headers

Query = Callable[[SparkSession, str], DataFrame]
NOW = "2024-06-01"
START, END = "2024-01-05", "2024-01-20"


def plain(df: DataFrame) -> DataFrame:
    """Timestamps and decimals as text, the same in every engine."""
    shaped = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t.startswith("timestamp") else F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes]
    return df.select(*shaped)


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table of processed transactions, which the first query over a folder writes."""
    return canonical.served(canonical.processed_store(spark, sf_dir))


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.served(recurrence.label(canonical.weekly_series(spark, sf_dir)))


def norm_transactions(spark, sf_dir):
    return plain(normalize.transactions(canonical.raw_transactions(spark, sf_dir)).drop("_ord"))


def norm_accounts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return normalize.accounts(c.select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_name").alias("account_name"), F.when(F.col("c_custkey") % 2 == 0, " Checking ").otherwise(F.col("c_mktsegment")).alias("account_type"), F.when(F.col("c_custkey") % 3 == 0, "ghana  cedi").otherwise("usd").alias("currency")))


def norm_fees_and_limits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return normalize.fees_and_limits(p.select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_size") > 25, "Charges").otherwise("threshold").alias("item_type"), F.col("p_retailprice").alias("value"), F.lower("p_brand").alias("unit"), F.col("p_name").alias("notes")))


def norm_products(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return normalize.products(p.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_type")))


def norm_metadata(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return normalize.metadata(n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"), F.lit(" nation ").alias("source")))


def norm_drop_incomplete(spark, sf_dir):
    raw = canonical.raw_transactions(spark, sf_dir)
    holes = raw.withColumns({"amount": F.when(F.col("_ord") % 5 != 0, F.col("amount")), "currency": F.when(F.col("_ord") % 7 == 0, F.lit("  ")).otherwise(F.col("currency"))})
    return normalize.transactions(holes, normalize.NormalizeConfig(drop_invalid_rows=True)).select("transaction_id", "amount", "currency")


def ingest_transactions(spark, sf_dir):
    """Raw text columns under odd headers, read by the transactions' contract."""
    e = table(spark, sf_dir, "events")
    when = F.when(F.col("event_id") % 11 == 0, "soon").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "dd/MM/yyyy"))
    price = F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.concat(F.lit("£1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(".50")))
    raw = e.select(
        F.expr("event_id div 2").cast("string").alias("Tx ID"), F.col("user_id").alias("Acct-ID"), price.alias("AMT"), F.lit("GHS").alias("Ccy"), when.alias("Created At"),
        F.col("event_type").alias("Narration"), F.col("event_id").alias("_ord"),
    )
    spec = DATASETS["transactions"]
    read = check_required(coerce(with_headers(raw), spec), spec)
    return plain(keep_first(read, spec.key, ["_ord"]).drop("_ord"))


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def dedupe_keep_first(spark, sf_dir):
    return plain(keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], list(LINE[2:])))


def tables_union_by_name(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c = c.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return union_by_name([c, s.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))])


def map_categories(spark, sf_dir):
    raw = canonical.raw_transactions(spark, sf_dir)
    return categories.map_categories(canonical.unnormalized_for_mapping(raw)).select("transaction_id", "merchant_mapped", "category_mapped", "subcategory_mapped", "category_mapping_source")


def map_normalized_categories(spark, sf_dir):
    df = canonical.for_mapping(normalize.transactions(canonical.raw_transactions(spark, sf_dir)))
    return categories.map_categories(df).select("transaction_id", "merchant_mapped", "category_mapped", "subcategory_mapped", "category_mapping_source")


#: Numbers of rules, and how often each may repeat: more parts than a product with 7919 has room for.
RULES, LAPS = 1_000_003, 1 << 31


def map_by_rule_table(spark, sf_dir):
    """Lines as payments to a shop for each part, mapped by a rule for each part: exact ones, some for one direction, patterns within names and a few regular expressions.

    The numbers that name the rules repeat from part 1,000,003 on, where rules with one number apply in the order of their parts: priorities are made of both, and only the numbers are shown.
    """
    key, lines = F.col("p_partkey"), table(spark, sf_dir, "lineitem")
    shop = lambda c: F.concat(F.lit("shop "), c.cast("string"))
    kind, taxonomy = key % 4, F.array(*(F.lit(c) for c in fixed.CATEGORIES))
    rules = table(spark, sf_dir, "part").select(
        (key * 7919 % RULES * LAPS + F.call_function("div", key, F.lit(RULES))).alias("priority"), F.lit("merchant_normalized").alias("field"), F.when(key % 500 == 3, "regex").when(kind == 1, "contains").otherwise("exact").alias("how"),
        F.when(key % 500 == 3, F.concat(F.lit("^shop [0-9]*"), (key % 97).cast("string"), F.lit("$"))).when(kind == 1, F.concat(F.lit("P "), key.cast("string"))).otherwise(shop(key)).alias("value"),
        F.get(taxonomy, (key % len(fixed.CATEGORIES)).cast("int")).alias("category"), F.lit("general").alias("subcategory"), F.lit(None).cast("string").alias("merchant"), F.when(kind == 2, "credit").alias("direction"),
    )
    payments = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"), F.col("l_shipdate").alias("timestamp"), F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_returnflag") == "R", "credit").otherwise("debit").alias("direction"), shop(F.col("l_partkey")).alias("merchant_normalized"), F.lower("l_linestatus").alias("category_normalized"),
    )
    mapped = categories.map_by_rules(payments, rules).groupBy("category_mapped", "subcategory_mapped", "category_mapping_source", "direction").agg(F.count("*").alias("n"))
    number = F.call_function("div", F.substring_index("category_mapping_source", "rule:", -1).try_cast("long"), F.lit(LAPS))
    source = F.coalesce(F.concat(F.lit("rule:"), number), F.col("category_mapping_source"))
    return mapped.groupBy("category_mapped", "subcategory_mapped", source.alias("category_mapping_source"), "direction").agg(F.sum("n").alias("n"))


def mapping_coverage(spark, sf_dir):
    return categories.mapping_coverage(map_categories(spark, sf_dir))


_LABELS = ("transaction_id", "recurrence_group_key", "is_recurring", "recurrence_cadence", "recurrence_confidence", "recurrence_occurrence_count", "recurrence_interval_days", "recurrence_amount_reference")


def recurrence_labels(spark, sf_dir):
    return recurrence.label(canonical.weekly_series(spark, sf_dir)).select(*_LABELS)


def recurrence_labels_processed(spark, sf_dir):
    return canonical.processed(canonical.raw_transactions(spark, sf_dir)).select(*_LABELS)


def recurrence_summary(spark, sf_dir):
    return recurrence.summary(recurrence.label(canonical.weekly_series(spark, sf_dir)))


def quality_findings(spark, sf_dir):
    found = quality.findings(canonical.processed_store(spark, sf_dir), NOW)
    return found.select("check_name", "severity", "row_count", F.array_join("sample_ids", ",").alias("sample_ids"))


def quality_report(spark, sf_dir):
    found = quality.findings(canonical.processed_store(spark, sf_dir), NOW)
    return quality.report(found).select("passed", "errors", "warnings")


def spend_total(spark, sf_dir):
    out = tools.spend_total(_served(spark, sf_dir), SpendRequest(start=START, end=END))
    return plain(out.withColumn("warnings", F.array_join("warnings", "|")))


def spend_by_currency_map(spark, sf_dir):
    return plain(tools.spend_by_currency(_served(spark, sf_dir), SpendRequest()))


def _grouped(group_by: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(tools.spend_grouped(_served(spark, sf_dir), SpendRequest(group_by=group_by, descending=group_by != "account")))

    return run


def _lookup(**request) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(tools.lookup(_served(spark, sf_dir), LookupRequest(**request)))

    return run


def lookup_by_id_table(spark, sf_dir):
    """Transactions with the keys of all finished orders."""
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return plain(tools.lookup(_served(spark, sf_dir), LookupRequest(sort_by="amount", limit=200), tables={"transaction_id": ids}))


def spend_of_account_table(spark, sf_dir):
    """Spend by merchant of the accounts of one segment."""
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return plain(tools.spend_grouped(_served(spark, sf_dir), SpendRequest(group_by="merchant"), tables={"account_id": ids}))


_STREAMS = RecurringRequest(sort_by="merchant", descending=False, limit=100)


def recurring_streams(spark, sf_dir):
    return plain(tools.recurring_streams(_weekly(spark, sf_dir), _STREAMS))


def recurring_streams_latest(spark, sf_dir):
    request = RecurringRequest(confidences=("HIGH", "medium"), cadences=("Weekly",), include_irregular="no", start=START)
    return plain(tools.recurring_streams(_weekly(spark, sf_dir), request))


def recurring_streams_of_accounts(spark, sf_dir):
    request = RecurringRequest(account_ids=tuple(str(i) for i in range(0, 90, 3)), sort_by="average_amount", limit=40)
    return plain(tools.recurring_streams(_weekly(spark, sf_dir), request))


def recurring_stream_summary(spark, sf_dir):
    return tools.recurring_summary(tools.recurring_streams(_weekly(spark, sf_dir), _STREAMS))


def recurring_stream_warnings(spark, sf_dir):
    return tools.recurring_warnings(tools.recurring_streams(_weekly(spark, sf_dir), _STREAMS)).select(F.array_join("warnings", "|").alias("warnings"))


def _blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", ","))


def explain_spend(spark, sf_dir):
    df, request = _served(spark, sf_dir), SpendRequest(group_by="category")
    return _blocks(explain.spend(tools.spend_total(df, request), tools.spend_grouped(df, request), focus="top_categories"))


def explain_transactions(spark, sf_dir):
    records = tools.lookup(_served(spark, sf_dir), LookupRequest(direction="credit"))
    return _blocks(explain.transactions(records))


def explain_recurring(spark, sf_dir):
    return _blocks(explain.recurring(tools.recurring_streams(_weekly(spark, sf_dir), _STREAMS), "high"))


def _explained(df: DataFrame) -> DataFrame:
    """Blocks as lines, flags as names and values, in order."""
    block = F.transform("blocks", lambda b: F.concat_ws(" / ", b["title"], b["value"], b["context"], F.array_join(b["tags"], ","), b["priority"]))
    shown = {"array<string>": lambda c: F.array_join(c, ","), "map<string,bigint>": lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")}
    flags = [F.concat(F.lit(f"{f.name}="), F.coalesce(shown.get(f.dataType.simpleString(), lambda c: c.cast("string"))(F.col("summary_flags")[f.name]), F.lit("null"))) for f in df.schema["summary_flags"].dataType.fields]
    return df.select("source_type", "confidence", F.array_join("warnings", "|").alias("warnings"), F.array_join(block, "\n").alias("blocks"), F.concat_ws(";", *flags).alias("flags"))


def explanation_of_spend(spark, sf_dir):
    df, request = _served(spark, sf_dir), SpendRequest(group_by="category")
    return _explained(explain.explanation(explain.ExplainRequest("Spend", "top_categories"), tools.spend_total(df, request), tools.spend_grouped(df, request)))


def explanation_of_transactions(spark, sf_dir):
    return _explained(explain.explanation(explain.ExplainRequest("transactions"), tools.lookup(_served(spark, sf_dir), LookupRequest(direction="credit"))))


def explanation_of_recurring(spark, sf_dir):
    return _explained(explain.explanation(explain.ExplainRequest("recurring", include_warnings=False, detail="high"), tools.recurring_streams(_weekly(spark, sf_dir), _STREAMS)))


def transaction_flags(spark, sf_dir):
    out = explain.transaction_flags(tools.lookup(_served(spark, sf_dir), LookupRequest(direction="credit")))
    return out.withColumn("currencies", F.array_join("currencies", ","))


def spend_flags(spark, sf_dir):
    df, request = _served(spark, sf_dir), SpendRequest(group_by="category")
    return explain.spend_flags(tools.spend_total(df, request), tools.spend_grouped(df, request))


def recurring_flags(spark, sf_dir):
    return explain.recurring_flags(tools.recurring_streams(_weekly(spark, sf_dir), _STREAMS))


def vector_topk(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings")
    return vectors.nearest_of(stored, stored.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")).select("vec_id", F.round("score", 6).alias("score"))


def vector_topk_of_many(spark, sf_dir):
    """Every twentieth vector asks all others."""
    stored = table(spark, sf_dir, "embeddings")
    found = vectors.nearest_of(stored, stored.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), own=False)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases from the benchmark's items, each asked with the vector of its id, and the documents of the nearest vectors."""
    stored, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    asked = items.join(stored, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("test_id"), "embedding")
    found = vectors.nearest_of(stored, asked, query_key="test_id")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return items.select(F.col("item_id").alias("test_id"), F.split("text", " ").alias("keywords")), found.join(texts, "vec_id").select("test_id", "rank", "text")


def retrieval_sweep(spark, sf_dir):
    return metrics.retrieval_metrics(*_retrieved(spark, sf_dir)).select("test_id", *(F.round(c, 9).alias(c) for c in ("mrr", "ndcg", "keyword_coverage")), "keywords_found", "total_keywords")


def vector_mean(spark, sf_dir):
    return vectors.mean(table(spark, sf_dir, "embeddings")).withColumn("mean", F.round("mean", 9))


def vector_covariance(spark, sf_dir):
    return vectors.covariance(table(spark, sf_dir, "embeddings")).withColumn("covariance", F.round("covariance", 8))


def store_projection(spark, sf_dir):
    """Two coordinates of each vector, for a plot; axes are compared with another library in tests."""
    found = vectors.project(table(spark, sf_dir, "embeddings"), 2)
    return found.select("vec_id", *(F.round(F.get("coordinates", F.lit(i)), 6).alias(c) for i, c in enumerate("xy")))


def chunk_fixed_stride(spark, sf_dir):
    return retrieval.chunk_by_stride(table(spark, sf_dir, "documents"))


def chunk_recursive(spark, sf_dir):
    return retrieval.chunk_recursively(table(spark, sf_dir, "documents"))


def combined_question(spark, sf_dir):
    return retrieval.combined_question(table(spark, sf_dir, "conversations"))


def context_assembly(spark, sf_dir):
    return retrieval.assemble_context(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def corpus_size(spark, sf_dir):
    return retrieval.corpus_size(table(spark, sf_dir, "documents"))


def corpus_tokens(spark, sf_dir):
    """Documents and tokens by a public tokenizer's file."""
    import public_tokenizers

    return retrieval.token_count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def kind_histogram(spark, sf_dir):
    return retrieval.kind_histogram(table(spark, sf_dir, "documents"), "lang")


def store_profile(spark, sf_dir):
    return retrieval.store_profile(table(spark, sf_dir, "embeddings"))


#: Documents of one case in a window, about.
RANGE = 4_096


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases with all words of each benchmark item as keywords; each document is retrieved by one of the cases, in the order of ids.

    A document's rank is the number of its case's documents in smaller ranges of ids and its own place in its range, so no window holds a case.
    """
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("test_id"), F.split("text", " ").alias("keywords"))
    n = max(1, cases.count())
    docs = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(n)).alias("test_id"), F.expr(f"doc_id div {n * RANGE}").alias("range"), "doc_id", "text")
    before = Window.partitionBy("test_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = docs.groupBy("test_id", "range").agg(F.count("*").alias("n")).select("test_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = docs.withColumn("own", F.row_number().over(Window.partitionBy("test_id", "range").orderBy("doc_id"))).join(base, ["test_id", "range"])
    return cases, placed.select("test_id", "text", (F.col("base") + F.col("own")).alias("rank"))


def retrieval_metrics(spark, sf_dir):
    return metrics.retrieval_metrics(*_cases(spark, sf_dir)).select("test_id", *(F.round(c, 9).alias(c) for c in ("mrr", "ndcg", "keyword_coverage")), "keywords_found", "total_keywords")


def retrieval_bands(spark, sf_dir):
    out = metrics.mean_metrics(metrics.retrieval_metrics(*_cases(spark, sf_dir)))
    return out.select("tests", *(F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "keyword_coverage")), "mrr_band", "ndcg_band", "keyword_coverage_band")


def lookup_records_json(spark, sf_dir):
    return tools.to_json(tools.lookup(_served(spark, sf_dir), LookupRequest(direction="credit")))


def lookup_warnings(spark, sf_dir):
    found = tools.lookup_warnings(tools.lookup(_served(spark, sf_dir), LookupRequest(direction="credit")))
    return found.select(F.array_join("warnings", "|").alias("warnings"))


def spend_of_accounts_checked(spark, sf_dir):
    """Rows without a timestamp, an amount or a currency would be an error here."""
    request = SpendRequest(direction="credit", account_ids=tuple(str(i) for i in range(3, 60, 3)))
    return plain(tools.spend_total(_served(spark, sf_dir), request, strict=True).drop("warnings"))


def answer_bands(spark, sf_dir):
    """Scores from 1 to 5 that ids stand in for: judged answers are an input."""
    d = table(spark, sf_dir, "documents")
    scores = d.select("lang", *((F.lit(low) + F.col("doc_id") % n).alias(k) for k, low, n in (("accuracy", 1, 5), ("completeness", 3, 3), ("relevance", 4, 2))))
    kinds = ("accuracy", "completeness", "relevance")
    return metrics.mean_answers(scores, "lang").withColumns({k: F.round(k, 6) for k in kinds})


def norm_bundle(spark, sf_dir):
    p, n, r = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    tables = {
        "products": p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_type")),
        "metadata": n.select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"), F.lit("nation").alias("source")),
        "regions": r.select("r_name"),
    }
    name = {"products": "product_name", "metadata": "key", "regions": "r_name"}
    return union_by_name([df.select(F.lit(k).alias("dataset"), F.col(name[k]).alias("name")) for k, df in normalize.bundle(tables).items()])


def warnings_merged(spark, sf_dir):
    """Blank and repeated warnings go, others keep their order."""
    second = F.when(F.col("n_nationkey") % 2 == 1, F.lit(" mixed")).otherwise(F.lit("  "))
    merged = explain.merged_warnings(F.array(F.concat(F.lit(" "), "n_name"), F.lit("")), F.array(second, F.col("n_name"), second))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(merged, "|").alias("warnings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        norm_transactions, norm_accounts, norm_fees_and_limits, norm_products, norm_metadata, norm_drop_incomplete, ingest_transactions, dedupe_keep_first, tables_union_by_name,
        map_categories, map_normalized_categories, map_by_rule_table, mapping_coverage, recurrence_labels, recurrence_labels_processed, recurrence_summary,
        quality_findings, quality_report, spend_total, spend_by_currency_map, recurring_streams, recurring_streams_latest, recurring_streams_of_accounts, recurring_stream_summary, recurring_stream_warnings,
        explain_spend, explain_transactions, explain_recurring, transaction_flags, spend_flags, recurring_flags, vector_topk, vector_topk_of_many, retrieval_sweep, vector_mean, vector_covariance, store_projection, chunk_fixed_stride, chunk_recursive,
        lookup_records_json, lookup_warnings, spend_of_accounts_checked, answer_bands, norm_bundle, warnings_merged,
        lookup_by_id_table, spend_of_account_table, explanation_of_spend, explanation_of_transactions, explanation_of_recurring,
        combined_question, context_assembly, corpus_size, corpus_tokens, kind_histogram, store_profile, retrieval_metrics, retrieval_bands,
    )
}
QUERIES |= file_queries.QUERIES
QUERIES |= {f"spend_by_{g}": _grouped(g) for g in ("category", "subcategory", "merchant", "account", "currency", "month")}
QUERIES |= {
    "lookup_by_timestamp": _lookup(),
    "lookup_by_amount": _lookup(sort_by="amount", direction="debit", descending=False),
    "lookup_by_merchant": _lookup(sort_by="merchant", merchants=("melcom", "uber"), start=START, end=END, limit=50),
    "lookup_by_filters": _lookup(categories=("groceries", "transport", "fees"), account_ids=tuple(str(i) for i in range(1, 60)), min_amount="10.005", max_amount=250, sort_by="account_id"),
    "lookup_by_ids": _lookup(transaction_ids=tuple(str(i) for i in range(0, 400, 7)), sort_by="transaction_id", descending=False),
}
