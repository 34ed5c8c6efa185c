"""Explanations of tool results: short blocks of title, value, context, tags and priority.

All functions take the limited results of ``tools``; a result without rows gives no blocks but the total.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstally.errors import ExplainInputError
from brasstally.functions import text
from brasstally.operators import tools
from brasstally.plans.shared import kept

# Levels of detail with their numbers of groups and samples, tags and the columns that tell a source's kind. Titles of blocks below are fixed, too.
LEVELS = {"low": 1, "medium": 2, "high": 3}
GROUPS = {"low": 1, "medium": 3, "high": 5}
SAMPLES = {"low": 1, "medium": 2, "high": 4}
TAGS = ("high_spend", "anomaly", "recurring", "large_transaction", "multi_currency", "empty_result", "top_category", "recent_activity", "high_confidence")
KINDS = {"spend": ("total_amount", "transaction_count"), "transactions": ("transaction_id", "amount"), "recurring": ("average_amount", "cadence")}
BLOCK = "place int, title string, value string, context string, tags array<string>, priority int"


def _level(detail: str) -> int:
    if detail not in LEVELS:
        raise ExplainInputError(f"detail must be one of {tuple(LEVELS)}: {detail!r}")
    return LEVELS[detail]


def check_source(df: DataFrame, kind: str) -> None:
    """The result must be of the kind that is to be explained; balances have no operator."""
    if kind == "balance":
        raise ExplainInputError("balances can't be explained: there is no operator for them")
    if kind not in KINDS:
        raise ExplainInputError(f"kind must be one of {(*KINDS, 'balance')}: {kind!r}")
    if missing := [c for c in KINDS[kind] if c not in df.columns]:
        raise ExplainInputError(f"not a result of kind {kind}: columns {missing} are missing")


def priority(detail: str, primary: bool = False, warning: Column | None = None) -> Column:
    base = F.lit(_level(detail) + 2 * primary)
    return base if warning is None else base + F.when(warning, 1).otherwise(0)


def _block(place: Column | int, title: Column, value: Column, context: Column, tags: list[Column], rank: Column) -> list[Column]:
    place = F.lit(place) if isinstance(place, int) else place
    kept = F.array_compact(F.array(*tags)) if tags else F.array().cast("array<string>")
    return [place.cast("int").alias("place"), title.alias("title"), value.cast("string").alias("value"), context.alias("context"), kept.alias("tags"), rank.cast("int").alias("priority")]


def block(title: str, value: str, context: str, tags: tuple[str, ...], rank: int) -> dict:
    """One block as plain values: title and value must not be blank, tags must be known."""
    if not title.strip() or not value.strip():
        raise ExplainInputError("a block needs a title and a value")
    if unknown := [t for t in tags if t not in TAGS]:
        raise ExplainInputError(f"unknown tags: {unknown}")
    return {"title": title.strip(), "value": value.strip(), "context": context, "tags": tags, "priority": rank}


def merged_warnings(*sources: Column, include: bool = True) -> Column:
    """Stripped warnings without blanks and repeats, in order."""
    if not include:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.transform(F.concat(*sources), text.clean)))


def confidence(by_confidence: dict[str, int] | None, warnings: tuple[str, ...]) -> str:
    """The best confidence that occurs, else medium with warnings and high without."""
    for level in ("high", "medium", "low"):
        if by_confidence and by_confidence.get(level, 0) > 0:
            return level
    return "medium" if warnings else "high"


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


def _count(c: Column | str) -> Column:
    return F.concat(F.col(c) if isinstance(c, str) else c, F.lit(" transaction(s)"))


def spend(total: DataFrame, groups: DataFrame | None, detail: str = "medium", focus: str | None = None, descending: bool = True) -> DataFrame:
    """Blocks of a spend total and its leading groups."""
    check_source(total, "spend")
    several = F.col("currencies") > 1
    context = F.concat(F.lit("Based on "), _count("transaction_count"), F.when(several, F.concat(F.lit(" across "), F.col("currencies"), F.lit(" currencies"))).otherwise(""))
    blocks = total.select(*_block(0, F.lit("Total spend"), F.col("total_amount"), context, [F.when(several, "multi_currency")], priority(detail, True, several)))
    if groups is None:
        return blocks
    label = focus.strip().replace("_", " ").title() if focus and focus.strip() else "Grouped spend"
    top = _numbered(groups, [F.col("total_amount"), F.col("transaction_count"), F.lower("key")], descending, [F.asc("key")], GROUPS[detail])
    single = F.when(F.col("currency").isNotNull(), F.concat(F.lit("currency: "), F.col("currency")))
    return blocks.unionByName(top.select(*_block(F.col("r"), F.concat(F.lit(f"{label}: "), F.col("key")), F.col("total_amount"), _joined(_count("transaction_count"), single), [F.when(F.col("r") == 1, "top_category")], priority(detail, False, F.col("currency").isNull()))))


def _numbered(rows: DataFrame, keys: list[Column], descending: bool, ties: list[Column], n: int) -> DataFrame:
    """The first n rows with their place r; only they reach the one task that numbers them."""
    order = [k.desc() if descending else k.asc() for k in keys]
    first = rows.orderBy(*order, *ties).limit(n)
    everything = F.array_sort(F.collect_list(F.struct(*([F.struct(*keys).alias("k")] + [F.struct(*rows.columns).alias("v")]))), _compare(descending))
    return first.agg(everything.alias("a")).select(F.posexplode("a").alias("r", "x")).select((F.col("r") + 1).alias("r"), "x.v.*")


def _compare(descending: bool):
    def by(a: Column, b: Column) -> Column:
        x, y = (b, a) if descending else (a, b)
        return F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0)

    return by


def transactions(records: DataFrame, detail: str = "medium", sort_by: str = "timestamp", descending: bool = True) -> DataFrame:
    """Blocks of the largest, the latest and the first returned transactions. The lookup behind the records runs once, when this is called: each block reads what is kept."""
    check_source(records, "transactions")
    return _transactions(kept(records), detail, sort_by, descending)


def _transactions(records: DataFrame, detail: str, sort_by: str, descending: bool) -> DataFrame:
    ts = text.iso_utc(F.col("timestamp").cast("timestamp"))
    rec = records.withColumn("ts", ts)
    whole = F.struct(*rec.columns)
    best = rec.agg(F.max_by(whole, F.struct("amount", "ts", "transaction_id")).alias("big"), F.max_by(whole, F.struct("ts", "amount", "transaction_id")).alias("late")).where("big is not null")

    def one(name: str, place: int, title: str, tag: str, primary: bool) -> DataFrame:
        x = best.select(f"{name}.*")
        return x.select(*_block(place, F.lit(title), F.col("amount"), _joined("merchant", "category", "ts", "currency"), [F.lit(tag)], priority(detail, primary)))

    out = one("big", 0, "Largest returned transaction", "large_transaction", True).unionByName(one("late", 1, "Most recent returned transaction", "recent_activity", False))
    first = _numbered(rec, [F.col(sort_by)], descending, [F.asc("transaction_id")], SAMPLES[detail])
    samples = first.join(F.broadcast(best.select(F.col("late.transaction_id").alias("late_id"))), F.col("transaction_id") == F.col("late_id"), "left")
    return out.unionByName(samples.select(*_block(F.col("r") + 1, F.concat(F.lit("Transaction: "), F.col("merchant")), F.col("amount"), _joined("category", "ts", "currency", "direction"), [F.when(F.col("late_id").isNotNull(), "recent_activity")], priority(detail))))


def recurring(records: DataFrame, detail: str = "medium") -> DataFrame:
    """Blocks of the primary stream, the streams of high confidence and the cadences. The records are computed once, when this is called."""
    check_source(records, "recurring")
    return _recurring(kept(records), detail)


def _recurring(records: DataFrame, detail: str) -> DataFrame:
    rec = records.withColumn("ts", text.iso_utc(F.col("last_seen_timestamp").cast("timestamp"))).withColumn("money", F.coalesce("currency", F.lit("mixed currency")))
    keys, ties = [F.col("average_amount"), F.col("ts"), F.lower("merchant"), F.lower("account_id")], [F.asc("category"), F.asc("subcategory")]
    mixed, sure = F.col("currency").isNull(), F.col("confidence") == "high"
    best = _numbered(rec, keys, True, ties, 1)
    out = best.select(*_block(0, F.lit("Primary recurring payment"), F.col("average_amount"), _joined("merchant", "cadence", "ts", "money"), [F.lit("recurring"), F.when(sure, "high_confidence")], priority(detail, True, mixed)))
    top = _numbered(rec.where(sure), keys, True, ties, SAMPLES[detail])
    out = out.unionByName(top.select(*_block(F.col("r"), F.concat(F.lit("High-confidence recurring: "), F.col("merchant")), F.col("average_amount"), _joined(F.col("cadence"), _count("transaction_count"), F.col("ts"), F.col("money")), [F.lit("recurring"), F.lit("high_confidence")], priority(detail, False, mixed))))
    if detail == "low":
        return out
    counts = records.groupBy("cadence").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.concat("cadence", F.lit(": "), "n"))).alias("c")).where(F.size("c") > 0)
    return out.unionByName(counts.select(*_block(99, F.lit("Recurring cadence distribution"), F.array_join("c", " | "), F.lit("Count of recurring streams by cadence"), [F.lit("recurring")], F.lit(1))))


def transaction_flags(records: DataFrame) -> DataFrame:
    """One row of flags of a lookup."""
    key = F.col("transaction_id")
    ts = F.col("timestamp")
    currencies = F.sort_array(F.collect_set("currency"))
    return records.agg(
        (F.count("*") == 0).alias("empty_result"), (F.count_distinct("currency") > 1).alias("multi_currency"), F.count("*").alias("match_count"),
        F.max_by(key, F.struct("amount", ts, key)).alias("largest_transaction_id"), F.max("amount").cast("string").alias("largest_transaction_amount"),
        F.max_by(key, F.struct(ts, "amount", key)).alias("most_recent_transaction_id"), currencies.alias("currencies"),
    )


def spend_flags(total: DataFrame, groups: DataFrame, descending: bool = True) -> DataFrame:
    """One row of flags of a spend summary."""
    rank = F.struct("total_amount", "transaction_count", F.lower("key").alias("k"))
    pick = F.max_by if descending else F.min_by
    top = groups.agg((F.count("*") > 0).alias("has_groups"), pick("key", rank).alias("top_group_key"), pick(F.col("total_amount").cast("string"), rank).alias("top_group_amount"))
    flags = total.select((F.col("transaction_count") == 0).alias("empty_result"), (F.col("currencies") > 1).alias("multi_currency"), F.size("warnings").alias("warning_count"), "transaction_count")
    # one row each, made one by an aggregate
    both = flags.unionByName(top, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def recurring_flags(records: DataFrame) -> DataFrame:
    """One row of flags of recurring payments."""
    rank = F.struct("average_amount", "last_seen_timestamp", F.lower("merchant").alias("m"), F.lower("account_id").alias("a"))
    n = F.count("*")
    return records.agg(
        (n == 0).alias("empty_result"), n.alias("record_count"), F.count_if(F.col("confidence") == "high").alias("high_confidence_count"),
        ((n > 0) & (F.count_if("is_irregular") == n)).alias("irregular_only"), F.max_by("merchant", rank).alias("primary_merchant"),
        F.max_by(F.col("average_amount").cast("string"), rank).alias("primary_average_amount"),
    )


@dataclass(frozen=True)
class ExplainRequest:
    """What is explained and how. ``focus`` names the groups of a spend summary."""

    kind: str
    focus: str | None = None
    include_warnings: bool = True
    detail: str = "medium"

    def __post_init__(self):
        for name in ("kind", "detail"):
            value = getattr(self, name)
            if not isinstance(value, str):
                raise ExplainInputError(f"{name} must be a string: {value!r}")
            object.__setattr__(self, name, value.strip().lower())
        if self.kind not in (*KINDS, "balance"):
            raise ExplainInputError(f"kind must be one of {(*KINDS, 'balance')}: {self.kind!r}")
        _level(self.detail)
        if not isinstance(self.include_warnings, bool):
            raise ExplainInputError(f"include_warnings must be a boolean: {self.include_warnings!r}")
        if not isinstance(self.focus, str | None):
            raise ExplainInputError(f"focus must be a string: {self.focus!r}")
        object.__setattr__(self, "focus", (self.focus or "").strip() or None)


def _of_kind(request: ExplainRequest, result: DataFrame, groups: DataFrame | None, sort_by: str, descending: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, and one row each of flags and of warnings."""
    if request.kind == "spend":
        none = result.select(F.lit(None).cast("string").alias("key"), "total_amount", "transaction_count", F.lit(None).cast("string").alias("currency")).limit(0)
        return spend(result, groups, request.detail, request.focus, descending), spend_flags(result, none if groups is None else groups, descending), result.select("warnings")
    if request.kind == "transactions":
        return _transactions(result, request.detail, sort_by, descending), transaction_flags(result), tools.lookup_warnings(result)
    counts = F.array_sort(F.collect_list(F.struct("cadence", "n")))
    cadences = result.groupBy("cadence").agg(F.count("*").alias("n")).agg(F.map_from_entries(counts).alias("count_by_cadence"))
    return _recurring(result, request.detail), _one_row(recurring_flags(result), cadences), tools.recurring_warnings(result)


def _one_row(*rows: DataFrame) -> DataFrame:
    """Frames of one row each side by side."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return whole.agg(*(F.first(c, ignorenulls=True).alias(c) for c in whole.columns))


def explanation(request: ExplainRequest, result: DataFrame, groups: DataFrame | None = None, sort_by: str = "timestamp", descending: bool = True) -> DataFrame:
    """One row: source_type, confidence, warnings, blocks in order and summary_flags, from a result of ``tools`` and the request.

    ``groups`` are those of a spend summary; ``sort_by`` and ``descending`` are the tool request's. The result is limited by its request; it is computed
    once, when this is called, and all parts read what is kept.
    """
    check_source(result, request.kind)
    result = kept(result)
    groups = None if groups is None else kept(groups)
    blocks, flags, warned = _of_kind(request, result, groups, sort_by, descending)
    listed = F.array_sort(F.collect_list(F.struct("place", "title", "value", "context", "tags", "priority")))
    parts = [blocks.agg(listed.alias("blocks")), flags.select(F.struct("*").alias("flags")), warned.select(F.col("warnings").alias("found"))]
    if request.kind == "recurring":
        level = F.coalesce(*(F.max(F.when(F.col("confidence") == c, c)) for c in ("high", "medium", "low")))
        parts.append(result.agg(level.alias("level")))
    whole = _one_row(*parts)
    level = F.coalesce(*([F.col("level")] if request.kind == "recurring" else []), F.when(F.size("found") > 0, "medium").otherwise("high"))
    named = whole.select("blocks", "flags", "found", level.alias("confidence"))
    known = [c for c in flags.columns if c != "warning_count"]
    extra = (F.size("found").alias("warning_count"), F.lit(request.kind).alias("source_type"), F.col("confidence").alias("explanation_confidence"))
    return named.select(
        F.lit(request.kind).alias("source_type"), "confidence", merged_warnings(F.col("found"), include=request.include_warnings).alias("warnings"),
        F.transform("blocks", lambda b: F.struct(b["title"].alias("title"), b["value"].alias("value"), b["context"].alias("context"), b["tags"].alias("tags"), b["priority"].alias("priority"))).alias("blocks"),
        F.struct(*(F.col("flags")[c].alias(c) for c in known), *extra).alias("summary_flags"),
    )
