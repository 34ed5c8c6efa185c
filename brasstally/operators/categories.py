"""Rules that sort transactions into categories: a few as one conditional expression, many as a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import astuple, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasstally.errors import CategoryConfigError, CategoryInputError
from brasstally.functions import fixed, text
from brasstally.plans.shared import kept

FIELDS = ("merchant_normalized", "category_normalized", "direction")
HOW = ("exact", "contains", "regex")
NEEDED = ("transaction_id", "timestamp", "amount", "direction", "merchant_normalized", "category_normalized")


@dataclass(frozen=True)
class Rule:
    priority: int
    field: str
    how: str
    value: str
    category: str
    subcategory: str
    merchant: str | None = None
    direction: str | None = None


@dataclass(frozen=True)
class CategoryConfig:
    """Rules apply in the order given; by default that of their priorities."""

    categories: tuple[str, ...] = fixed.CATEGORIES
    subcategories: tuple[str, ...] = fixed.SUBCATEGORIES
    merchant_aliases: Mapping[str, str] = field(default_factory=lambda: dict(fixed.MERCHANT_ALIASES))
    category_aliases: Mapping[str, str] = field(default_factory=lambda: dict(fixed.CATEGORY_ALIASES))
    rules: tuple[Rule, ...] = tuple(Rule(*r) for r in fixed.RULES)
    default: tuple[str, str] = ("other", "uncategorized")

    def checked(self) -> CategoryConfig:
        wrong = []
        if not self.categories or not self.subcategories:
            wrong.append("the sets of categories and subcategories must not be empty")
        if self.default[0] not in self.categories or self.default[1] not in self.subcategories:
            wrong.append(f"the default {self.default} isn't allowed")
        if len({r.priority for r in self.rules}) < len(self.rules):
            wrong.append("priorities repeat")
        for r in self.rules:
            if r.field not in FIELDS or r.how not in HOW or not r.value.strip():
                wrong.append(f"rule {r.priority} needs a field of {FIELDS}, a match of {HOW} and a value")
            if r.category not in self.categories or r.subcategory not in self.subcategories:
                wrong.append(f"rule {r.priority} leads to {r.category}/{r.subcategory}, which isn't allowed")
        if wrong:
            raise CategoryConfigError("; ".join(wrong))
        return self


def _alias(c: str, table: Mapping[str, str]) -> Column:
    """The alias of a column that has its compared form, so that this is made once."""
    return text.known(F.col(c), {k.strip().lower(): v.strip().lower() for k, v in table.items()}) if table else F.col(c)


def _condition(rule: Rule, columns: dict[str, Column]) -> Column:
    c, value = columns[rule.field], rule.value.strip()
    met = c == value.lower() if rule.how == "exact" else c.contains(value.lower()) if rule.how == "contains" else c.rlike(value)
    for name, wanted in (("direction", rule.direction), ("merchant_normalized", rule.merchant)):
        if wanted is not None:
            met = met & (columns[name] == wanted.strip().lower())
    return met


def _named(df: DataFrame, config: CategoryConfig) -> DataFrame:
    """``df`` with merchant_mapped, _category and _direction in the form in which rules compare them."""
    missing = [c for c in NEEDED if c not in df.columns]
    if missing:
        raise CategoryInputError(f"columns {missing} are missing; there are {sorted(df.columns)}")
    forms = {"merchant_mapped": "merchant_normalized", "_category": "category_normalized", "_direction": "direction"}
    formed = df.withColumns({c: text.match_form(F.col(source)) for c, source in forms.items()})
    return formed.withColumns({"merchant_mapped": _alias("merchant_mapped", config.merchant_aliases), "_category": _alias("_category", config.category_aliases)})


def _verdict(category: Column, subcategory: Column, source: Column) -> Column:
    return F.struct(category.alias("category_mapped"), subcategory.alias("subcategory_mapped"), source.alias("category_mapping_source"))


def _mapped(df: DataFrame, named: DataFrame, config: CategoryConfig, steps: list[tuple[Column, Column]]) -> DataFrame:
    """The first step whose condition is met; then an allowed category, then the default."""
    steps = [*steps, (F.col("_category").isin(*config.categories), _verdict(F.col("_category"), F.lit("general"), F.lit("category_alias")))]
    chain = F.when(*steps[0])
    for met, found in steps[1:]:
        chain = chain.when(met, found)
    out = named.withColumn("_verdict", chain.otherwise(_verdict(F.lit(config.default[0]), F.lit(config.default[1]), F.lit("default_fallback"))))
    own = [c for c in df.columns if c not in ("merchant_mapped", "category_mapped", "subcategory_mapped", "category_mapping_source")]
    return out.select(*own, "merchant_mapped", "_verdict.*")


def map_categories(df: DataFrame, config: CategoryConfig | None = None) -> DataFrame:
    """``df`` with merchant_mapped, category_mapped, subcategory_mapped and category_mapping_source.

    The first rule that matches decides; else an allowed category stands for itself; else the default. Names are compared in lower
    case without outer white space, after aliases. A regular expression is used as it is written. Many rules belong in a table, see ``map_by_rules``.
    """
    config = (config or CategoryConfig()).checked()
    named = _named(df, config)
    columns = {"merchant_normalized": F.col("merchant_mapped"), "category_normalized": F.col("_category"), "direction": F.col("_direction")}
    return _mapped(df, named, config, [(_condition(r, columns), _verdict(F.lit(r.category), F.lit(r.subcategory), F.lit(f"rule:{r.priority}"))) for r in config.rules])


#: The columns of a table of rules, those of ``Rule``.
RULE = ("priority", "field", "how", "value", "category", "subcategory", "merchant", "direction")
#: Verdicts (each for one merchant, category and direction) that go to every task; with more, rows meet them in a shuffle.
MOST_VERDICTS = 200_000


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([astuple(r) for r in rules], "priority int, field string, how string, value string, category string, subcategory string, merchant string, direction string")


def check_rules(rules: DataFrame, config: CategoryConfig) -> None:
    """An error that counts what is wrong in a table of rules, as ``CategoryConfig.checked`` finds it in a few."""
    if missing := [c for c in RULE if c not in rules.columns]:
        raise CategoryConfigError(f"rules lack the columns {missing}")
    wrong = {
        "without a priority": F.col("priority").isNull(), "of an unknown field": ~F.coalesce(F.col("field").isin(*FIELDS), F.lit(False)), "of an unknown match": ~F.coalesce(F.col("how").isin(*HOW), F.lit(False)),
        "without a value": text.is_blank(F.col("value")), "of a category that isn't allowed": ~F.coalesce(F.col("category").isin(*config.categories), F.lit(False)), "of a subcategory that isn't allowed": ~F.coalesce(F.col("subcategory").isin(*config.subcategories), F.lit(False)),
    }
    counts = rules.agg(*(F.count_if(c).alias(name) for name, c in wrong.items()), (F.count("*") - F.count_distinct("priority")).alias("that repeat a priority")).first().asDict()
    if found := {k: n for k, n in counts.items() if n}:
        raise CategoryConfigError("; ".join(f"{n} rules {k}" for k, n in found.items()))


def _hits(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (field, v, merchant, direction, best): for each value the first rule that it meets under each pair of constraints.

    Equal values meet exact rules by a hash of the value; for ``contains`` all stretches of a value that are as long as some pattern meet the patterns by theirs, so
    the number of patterns doesn't matter; regular expressions are tried on each distinct value.
    """
    how = lambda kind: rules.where(F.col("how") == kind).drop("how")
    columns = ("field", "v", "merchant", "direction", "best")
    exact = values.join(how("exact").withColumnRenamed("value", "v"), ["field", "v"]).select(*columns)
    # a row for each field: its patterns' lengths
    lengths = how("contains").groupBy("field").agg(F.collect_set(F.length("value")).alias("lengths"))
    fit = F.filter("lengths", lambda n: n <= F.length("v"))
    stretches = F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.length("v") - n + 1), lambda i: F.substring("v", i, n))))
    cut = values.join(lengths, "field").select("field", "v", F.explode(F.array_distinct(stretches)).alias("value"))
    contains = cut.join(how("contains"), ["field", "value"]).select(*columns)
    tried = how("regex").groupBy("field").agg(F.collect_list(F.struct("value", "merchant", "direction", "best")).alias("tried"))
    regex = values.join(tried, "field").select("field", "v", F.inline(F.filter("tried", lambda r: F.rlike(F.col("v"), r["value"])))).select(*columns)
    return exact.unionByName(contains).unionByName(regex).groupBy("field", "v", "merchant", "direction").agg(F.min("best").alias("best"))


def map_by_rules(df: DataFrame, rules: DataFrame, config: CategoryConfig | None = None) -> DataFrame:
    """Like ``map_categories``, with a table of rules (columns RULE) of any size, tried in the order of their priorities.

    Rules only look at merchant, category and direction, so they are tried on the distinct ones: each value meets its rules by hash joins, a verdict for each
    combination is the least priority, and rows look up their combination's. Verdicts are computed once, when this is called, and counted before they are sent to every task.
    """
    config = replace(config or CategoryConfig(), rules=()).checked()
    check_rules(rules, config)
    named = _named(df, config)
    by = {"merchant_normalized": "merchant_mapped", "category_normalized": "_category", "direction": "_direction"}
    facts = kept(named.select(*by.values()).distinct())
    low = lambda c: F.lower(text.strip(F.col(c)))
    value = F.when(F.col("how") == "regex", text.strip(F.col("value"))).otherwise(low("value"))
    best = F.min(F.struct("priority", "category", "subcategory")).alias("best")
    plain = rules.select("priority", "field", "how", value.alias("value"), "category", "subcategory", low("merchant").alias("merchant"), low("direction").alias("direction"))
    plain = plain.groupBy("field", "how", "value", "merchant", "direction").agg(best)
    values = facts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("v")) for f, c in by.items()))).alias("x")).select("x.*").distinct()
    hits = kept(_hits(values, plain))
    fits = (F.col("merchant").isNull() | (F.col("merchant") == F.col("merchant_mapped"))) & (F.col("direction").isNull() | (F.col("direction") == F.col("_direction")))
    met = [facts.join(hits.where(F.col("field") == f).withColumnRenamed("v", c), c).where(fits).select(*by.values(), "best") for f, c in by.items()]
    verdicts = kept(reduce(DataFrame.unionByName, met).groupBy(*by.values()).agg(F.min("best").alias("_best")))
    looked = named.join(F.broadcast(verdicts) if verdicts.count() <= MOST_VERDICTS else verdicts, list(by.values()), "left")
    rule = _verdict(F.col("_best.category"), F.col("_best.subcategory"), F.concat(F.lit("rule:"), F.col("_best.priority")))
    return _mapped(df, looked, config, [(F.col("_best").isNotNull(), rule)])


def mapping_coverage(df: DataFrame) -> DataFrame:
    """measure and n: rows in total, by kind (default_fallback, category_alias, by_rule) and by source (``source:...``)."""
    if "category_mapping_source" not in df.columns:
        raise CategoryInputError("the column category_mapping_source is missing")
    source = F.coalesce("category_mapping_source", F.lit("missing"))
    by = df.groupBy(source.alias("source")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("source").startswith("rule:"), "by_rule").when(F.col("source").isin("default_fallback", "category_alias"), F.col("source"))
    measures = F.array_compact(F.array(F.lit("total"), kind, F.concat(F.lit("source:"), F.col("source"))))
    return by.select(F.explode(measures).alias("measure"), "n").groupBy("measure").agg(F.sum("n").alias("n"))
