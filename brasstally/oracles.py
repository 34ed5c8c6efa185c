"""SQL for the registered queries, written for another engine on the same tables."""

from __future__ import annotations

from brasstally.functions import fixed
from brasstally.plans.canonical import CATEGORIES, CURRENCIES, MERCHANTS, OUTGOING

NOW = "2024-06-01"
START, END = "2024-01-05", "2024-01-20"


def _case(x: str, values: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({0}, '%f') = '000000' THEN '' ELSE '.' || strftime({0}, '%f') END || '+00:00'"


def _title(x: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all(lower({x}), '(\\pL+|[^\\pL]+)'), lambda s: upper(s[1]) || s[2:]), 'string_agg', '')"


_MERCHANT = _title(_clean("regexp_replace(" + _clean("merchant") + ", '[^\\w\\s&/\\-]', '', 'g')"))
_BASE = f"lower({_clean('category')})"
RAW = f"""raw AS (
  SELECT event_id::VARCHAR AS transaction_id, user_id::VARCHAR AS account_id, ts AS timestamp,
    CASE WHEN event_type IN {_in(OUTGOING)} THEN -value ELSE value END AS amount,
    {_list(CURRENCIES)}[user_id % {len(CURRENCIES)} + 1] AS currency, {_list(MERCHANTS)}[event_id % {len(MERCHANTS)} + 1] AS merchant,
    {_list(CATEGORIES)}[event_id % {len(CATEGORIES)} + 1] AS category, props AS description, event_id AS _ord FROM events
)"""
NORM = f"""norm AS (
  SELECT transaction_id, account_id, timestamp, amount, {_case("lower(currency)", fixed.CURRENCIES, "upper(currency)")} AS currency, merchant,
    {_case(_BASE, fixed.BASE_CATEGORIES, _BASE)} AS category, {_clean("description")} AS description, {_MERCHANT} AS merchant_clean,
    strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%Y-%m') AS month,
    CASE WHEN amount < 0 THEN 'debit' WHEN amount > 0 THEN 'credit' END AS direction, category AS raw_category, _ord FROM raw
)"""


def _mapped(source: str, merchant: str, category: str) -> str:
    columns = {"direction": "coalesce(direction, '')", "merchant_normalized": "merchant_mapped", "category_normalized": "_category"}
    rules = [(p, f"{columns[f]} = '{v}'" + (f" AND merchant_mapped = '{m}'" if m else ""), c, s) for p, f, _, v, c, s, m in fixed.RULES]
    allowed = f"_category IN {_in(fixed.CATEGORIES)}"

    def chain(pick, alias: str, other: str) -> str:
        return "CASE " + " ".join(f"WHEN {w} THEN {pick(p, c, s)}" for p, w, c, s in rules) + f" WHEN {allowed} THEN {alias} ELSE '{other}' END"

    return f"""aliased AS (
  SELECT *, {_case(f"lower(trim({merchant}))", fixed.MERCHANT_ALIASES, f"lower(trim({merchant}))")} AS merchant_mapped,
    {_case(f"lower(trim({category}))", fixed.CATEGORY_ALIASES, f"lower(trim({category}))")} AS _category FROM {source}
), mapped AS (
  SELECT *, {chain(lambda p, c, s: f"'{c}'", "_category", "other")} AS category_mapped, {chain(lambda p, c, s: f"'{s}'", "'general'", "uncategorized")} AS subcategory_mapped,
    {chain(lambda p, c, s: f"'rule:{p}'", "'category_alias'", "default_fallback")} AS category_mapping_source FROM aliased
)"""


LABELLED = """keyed AS (
  SELECT *, concat_ws('|', lower(trim(merchant_mapped)), lower(trim(category_mapped)), lower(trim(subcategory_mapped)), lower(trim(coalesce(direction, '')))) AS recurrence_group_key FROM {0}
), gapped AS (
  SELECT *, date_sub('day', lag(timestamp) OVER (PARTITION BY recurrence_group_key ORDER BY timestamp, _ord), timestamp) AS gap,
    first_value(amount) OVER (PARTITION BY recurrence_group_key ORDER BY _ord) AS ref FROM keyed
), grouped AS (
  SELECT recurrence_group_key, count(*) AS n, count(gap) AS gaps, min(gap) AS lo, max(gap) AS hi, avg(gap) AS mean, any_value(ref) AS ref,
    NOT bool_or(abs(amount - ref) > 5.0 AND CASE WHEN ref <> 0 THEN abs(amount - ref) / ref ELSE abs(amount - ref) END > 0.05) AS steady FROM gapped GROUP BY 1
), cadenced AS (
  SELECT *, CASE WHEN gaps = 0 THEN 'none' WHEN lo >= 5 AND hi <= 9 THEN 'weekly' WHEN lo >= 11 AND hi <= 17 THEN 'biweekly' WHEN lo >= 25 AND hi <= 35 THEN 'monthly'
    WHEN hi - lo <= 10 THEN 'irregular' ELSE 'none' END AS recurrence_cadence FROM grouped
), judged AS (
  SELECT recurrence_group_key, n >= 3 AND recurrence_cadence <> 'none' AND steady AS is_recurring, recurrence_cadence,
    CASE WHEN recurrence_cadence = 'none' OR n < 3 OR NOT steady OR gaps = 0 THEN 'low'
      WHEN n >= 4 AND recurrence_cadence IN ('weekly', 'biweekly', 'monthly') AND hi - lo <= 2 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS recurrence_confidence,
    n AS recurrence_occurrence_count, coalesce(mean, 0.0) AS recurrence_interval_days, ref AS recurrence_amount_reference FROM cadenced
), labelled AS (SELECT keyed.*, judged.* EXCLUDE (recurrence_group_key) FROM keyed JOIN judged USING (recurrence_group_key))"""
WEEKLY = """series AS (
  SELECT DISTINCT user_id, event_type, date_trunc('week', ts)::TIMESTAMP AS timestamp FROM events
), weekly AS (
  SELECT concat_ws('-', user_id, event_type, strftime(timestamp, '%Y%m%d')) AS transaction_id, user_id::VARCHAR AS account_id, timestamp, 10.0::DOUBLE AS amount, 'GHS' AS currency, 'debit' AS direction,
    'user_' || user_id AS merchant_mapped, event_type AS category_mapped, 'general' AS subcategory_mapped,
    concat_ws('-', user_id, event_type, strftime(timestamp, '%Y%m%d')) AS _ord FROM series
)"""
_SERVED = "served AS (SELECT * EXCLUDE ({0}merchant_mapped, category_mapped, subcategory_mapped), merchant_mapped AS merchant, category_mapped AS category, subcategory_mapped AS subcategory, amount::DECIMAL(18,2) AS money FROM labelled)"
PROCESSED = f"WITH {RAW}, {NORM}, {_mapped('norm', 'merchant_clean', 'category')}, {LABELLED.format('mapped')}"
SERVED = f"{PROCESSED}, {_SERVED.format('merchant, category, ')}"
UNNORMALIZED = f"WITH {RAW}, {NORM}, {_mapped('norm', 'merchant', 'raw_category')}"
LABELLED_WEEKLY = f"WITH {WEEKLY}, {LABELLED.format('weekly')}"
SERVED_WEEKLY = f"{LABELLED_WEEKLY}, {_SERVED.format('')}"
_LABELS = "transaction_id, recurrence_group_key, is_recurring, recurrence_cadence, recurrence_confidence, recurrence_occurrence_count, recurrence_interval_days, recurrence_amount_reference"
_MAPPING = "transaction_id, merchant_mapped, category_mapped, subcategory_mapped, category_mapping_source"
_ONE_CURRENCY = "CASE WHEN min(currency) = max(currency) THEN min(currency) END"


def _spend(group: str, order: str = "DESC", where: str = "TRUE") -> str:
    key = {"account": "account_id", "month": "strftime(timestamp, '%Y-%m')"}.get(group, group)
    return f"""{SERVED}, g AS (SELECT coalesce(nullif(trim({key}), ''), 'unknown') AS key, sum(money)::DECIMAL(28,2) AS total, count(*) AS transaction_count, {_ONE_CURRENCY} AS currency FROM served WHERE direction = 'debit' AND {where} GROUP BY 1)
SELECT key, total::VARCHAR AS total_amount, transaction_count, currency FROM g ORDER BY total {order}, transaction_count {order}, lower(key) {order}, key LIMIT 10"""


def _lookup(where: str, order: str, limit: int = 25) -> str:
    return f"""{SERVED}, hit AS (SELECT * FROM served WHERE {where} ORDER BY {order}, transaction_id LIMIT {limit})
SELECT transaction_id, account_id, {_TS.format("timestamp")} AS timestamp, money::VARCHAR AS amount, currency, direction, merchant, category, subcategory FROM hit"""


_CREDITS = f"{SERVED}, hit AS (SELECT * FROM served WHERE direction = 'credit' ORDER BY timestamp DESC, transaction_id LIMIT 25)"


def _streams(where: str, order: str, limit: int) -> str:
    """Averages in whole cents, rounded half to even."""
    return f"""{SERVED_WEEKLY}, sums AS (
  SELECT merchant, category, subcategory, account_id, direction, recurrence_cadence AS cadence, recurrence_confidence AS confidence, count(*) AS transaction_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
    (sum(money) * 100)::BIGINT AS cents, {_ONE_CURRENCY} AS currency FROM served WHERE is_recurring AND direction = 'debit' AND {where} GROUP BY ALL
), streams AS (
  SELECT *, abs(cents) // transaction_count AS q, abs(cents) % transaction_count AS r FROM sums
), averaged AS (
  SELECT *, (sign(cents) * (q + CASE WHEN 2 * r > transaction_count OR (2 * r = transaction_count AND q % 2 = 1) THEN 1 ELSE 0 END))::DECIMAL(18,0) / 100 AS a FROM streams
), records AS (
  SELECT * EXCLUDE (cents, q, r, a), a::DECIMAL(18,2) AS average, cadence = 'irregular' AS is_irregular FROM averaged ORDER BY {order} LIMIT {limit}
)"""


_BY_MERCHANT = _streams("TRUE", "lower(merchant), lower(account_id), last_seen, merchant, category, subcategory, account_id, direction, cadence, confidence", 100)
_LATEST = _streams(f"recurrence_confidence IN ('high', 'medium') AND recurrence_cadence = 'weekly' AND timestamp >= '{START}'", "last_seen DESC, lower(merchant) DESC, lower(account_id) DESC, merchant, category, subcategory, account_id, direction, cadence, confidence", 25)
_OF_ACCOUNTS = _streams(f"account_id IN {_in(range(0, 90, 3))}", "average DESC, lower(merchant) DESC, lower(account_id) DESC, merchant, category, subcategory, account_id, direction, cadence, confidence", 40)
_RECORD = f"SELECT merchant, category, subcategory, account_id, direction, cadence, confidence, transaction_count, {_TS.format('first_seen')} AS first_seen_timestamp, {_TS.format('last_seen')} AS last_seen_timestamp, average::VARCHAR AS average_amount, currency, is_irregular FROM records"


def _findings() -> str:
    nulls = ("transaction_id", "timestamp", "amount", "direction", "merchant_mapped", "category_mapped", "subcategory_mapped", "category_mapping_source", "is_recurring", "recurrence_cadence", "recurrence_confidence")
    domains = {"direction": fixed.DIRECTIONS, "category_mapped": fixed.CATEGORIES, "subcategory_mapped": fixed.SUBCATEGORIES, "recurrence_cadence": fixed.CADENCES, "recurrence_confidence": fixed.CONFIDENCES}
    checks = [("duplicate_transaction_id", "error", "count(*) OVER (PARTITION BY transaction_id) > 1")]
    checks += [(f"null_{c}", "error", f"{c} IS NULL") for c in nulls] + [(f"enum_{c}", "error", f"NOT coalesce({c} IN {_in(v)}, FALSE)") for c, v in domains.items()]
    checks += [
        ("timestamp_unparseable", "error", "timestamp IS NULL"), ("timestamp_too_early", "error", "timestamp < '2000-01-01'"), ("timestamp_future", "warning", f"timestamp > '{NOW}'"),
        ("amount_not_numeric", "error", "amount IS NULL"), ("amount_not_positive", "warning", "amount <= 0"),
        ("recurring_without_group", "error", "is_recurring AND coalesce(trim(recurrence_group_key), '') = ''"), ("recurring_too_few", "error", "is_recurring AND recurrence_occurrence_count < 5"),
        ("not_recurring_but_labelled", "warning", "NOT coalesce(is_recurring, FALSE) AND (recurrence_cadence IS DISTINCT FROM 'none' OR recurrence_confidence IS DISTINCT FROM 'low')"),
    ]
    hits = " UNION ALL ".join(f"SELECT '{n}' AS check_name, '{s}' AS severity, transaction_id, _ord FROM (SELECT transaction_id, _ord, {w} AS bad FROM labelled) WHERE bad" for n, s, w in checks)
    return f"""{PROCESSED}, hits AS ({hits}),
placed AS (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY _ord, transaction_id) AS r FROM hits),
found AS (SELECT check_name, severity, count(*) AS row_count, string_agg(transaction_id, ',' ORDER BY r) FILTER (WHERE r <= 5) AS sample_ids FROM placed GROUP BY 1, 2)"""


_DEALT = "SELECT doc_id % (SELECT count(*) FROM benchmark) AS test_id, lower(text) AS t, row_number() OVER (PARTITION BY doc_id % (SELECT count(*) FROM benchmark) ORDER BY doc_id) AS rank FROM documents"
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"


def _nearest(asked: str, other: str = "true") -> str:
    """The ten nearest vectors of those that ``asked`` gives; scores count to twelve decimals."""
    return f"""SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.query_id, e.vec_id, round(list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v))), 12) AS score
      FROM ({asked}) q, (SELECT vec_id, {_UNIT} AS v FROM embeddings) e WHERE {other} AND list_inner_product(e.v, e.v) > 0) QUALIFY rank <= 10"""


def _cases(docs: str = _DEALT) -> str:
    return f"""WITH wanted AS (
  SELECT item_id AS test_id, list_distinct(string_split(text, ' ')) AS keywords FROM benchmark
), docs AS (
  {docs}
), seen AS (
  SELECT w.test_id, w.keyword, d.rank, coalesce(contains(d.t, lower(w.keyword)), FALSE) AS hit FROM (SELECT test_id, unnest(keywords) AS keyword FROM wanted) w LEFT JOIN docs d USING (test_id)
), by_word AS (
  SELECT test_id, keyword, coalesce(1.0 / min(rank) FILTER (WHERE hit), 0) AS mrr, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE hit AND rank <= 10), 0) AS dcg, least(count(*) FILTER (WHERE hit), 10) AS n FROM seen GROUP BY 1, 2
), scored AS (
  SELECT test_id, mrr, CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM by_word
), metrics AS (
  SELECT w.test_id, coalesce(avg(s.mrr), 0) AS mrr, coalesce(avg(s.ndcg), 0) AS ndcg, count(*) FILTER (WHERE s.mrr > 0) AS keywords_found, any_value(len(w.keywords)) AS total_keywords,
    CASE WHEN any_value(len(w.keywords)) > 0 THEN 100.0 * count(*) FILTER (WHERE s.mrr > 0) / any_value(len(w.keywords)) ELSE 0 END AS keyword_coverage FROM wanted w LEFT JOIN scored s USING (test_id) GROUP BY 1
)"""


def _recursive_chunks(size: int = 1000, overlap: int = 200) -> str:
    """Texts are cut at paragraphs, lines and words, one level of tables for each; neighbouring short parts form a group, whose chunks follow from sums of lengths, one a step of the recursion."""
    separators = ("chr(10) || chr(10)", "chr(10)", "' '")
    at = "CASE " + " ".join(f"WHEN used <= {k} AND contains(t, {s}) THEN {k}" for k, s in enumerate(separators)) + f" ELSE {len(separators)} END"
    sep = f"[{', '.join(separators)}][lvl + 1]"
    levels, groups, stretches = ["n0 AS (SELECT doc_id, []::INT[] AS path, text AS t, 0 AS used FROM documents WHERE text <> '')"], [], []
    for d in range(len(separators) + 1):
        levels.append(f"x{d} AS (SELECT *, {at} AS lvl FROM n{d})")
        levels.append(f"""p{d} AS (SELECT doc_id, path, lvl, unnest(list_filter(list_transform(string_split(t, {sep}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {sep} || x END), lambda x: x <> '')) AS part,
          generate_subscripts(list_filter(list_transform(string_split(t, {sep}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {sep} || x END), lambda x: x <> ''), 1)::INT AS i FROM x{d} WHERE lvl < {len(separators)})""")
        levels.append(f"q{d} AS (SELECT *, length(part) >= {size} AS long, count(*) FILTER (WHERE length(part) >= {size}) OVER (PARTITION BY doc_id, path ORDER BY i) AS g FROM p{d})")
        levels.append(f"n{d + 1} AS (SELECT doc_id, list_append(path, i) AS path, part AS t, lvl + 1 AS used FROM q{d} WHERE long)")
        groups.append(f"SELECT doc_id, list_append(path, min(i)) AS path, list(part ORDER BY i) AS parts FROM q{d} WHERE NOT long GROUP BY doc_id, path, g, path")
        stretches.append(f"SELECT doc_id, list_append(path, k::INT) AS path, 0 AS n, substring(t, (k * {size - overlap} + 1)::INT, {size}) AS chunk FROM (SELECT doc_id, path, t, unnest(range(0, greatest(ceil((length(t) - {size}) / {size - overlap}.0), 0)::INT + 1)) AS k FROM x{d} WHERE lvl = {len(separators)})")
    return f"""WITH RECURSIVE {", ".join(levels)},
    g AS (SELECT *, row_number() OVER () AS gid, list_transform(parts, lambda x: length(x)) AS lens FROM ({" UNION ALL ".join(groups)})),
    c AS (SELECT gid, list(total ORDER BY i) AS sums FROM (SELECT gid, i, sum(len) OVER (PARTITION BY gid ORDER BY i) AS total FROM (SELECT gid, unnest(lens) AS len, generate_subscripts(lens, 1) AS i FROM g)) GROUP BY gid),
    r AS (
      SELECT gid, 0 AS n, 1 AS s, len(list_filter(sums, lambda x: x <= {size})) AS e FROM c
      UNION ALL
      SELECT gid, n, s, len(list_filter(sums, lambda x: x <= CASE WHEN s = 1 THEN 0 ELSE sums[s - 1] END + {size})) FROM (
        SELECT r.gid, r.n + 1 AS n, sums, greatest(r.s, CASE WHEN greatest(sums[r.e] - {overlap}, sums[r.e + 1] - {size}) <= 0 THEN 1 ELSE len(list_filter(sums, lambda x: x < greatest(sums[r.e] - {overlap}, sums[r.e + 1] - {size}))) + 2 END) AS s
        FROM r JOIN c USING (gid) WHERE r.e < len(sums))
    ),
    k AS (SELECT doc_id, path, n, array_to_string(parts[s:e], '') AS chunk FROM r JOIN g USING (gid) UNION ALL {" UNION ALL ".join(stretches)}),
    z AS (SELECT doc_id, path, n, regexp_replace(chunk, '^\\s+|\\s+$', '', 'g') AS chunk FROM k)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY path, n) - 1)::INT AS chunk_id, chunk FROM z WHERE chunk <> ''"""


def _band(x: str, metric: str) -> str:
    green, orange = fixed.BANDS[metric]
    return f"CASE WHEN {x} >= {green} THEN 'green' WHEN {x} >= {orange} THEN 'orange' ELSE 'red' END"


READ_BY_FORMAT = ("csv", "jsonl", "parquet")
COLUMNS_READ = ("transaction_id", "account_id", "amount", "currency", "timestamp", "description")
#: The row of the first file that holds an id.
_FILES = """SELECT '0' || event_id AS transaction_id, user_id::VARCHAR AS account_id, CASE WHEN event_id % 10 = 0 THEN 1000.25 ELSE 1000.25 + event_id % 3 END::DOUBLE AS amount, 'GHS' AS currency,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS description FROM events"""
_STRIPPED = "length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 50"
_BLOCK_CREDIT = "merchant || ' | ' || category || ' | ' || iso || ' | ' || currency"

ORACLE_SQL = {
    "norm_transactions": f"WITH {RAW}, {NORM} SELECT transaction_id, account_id, {_TS.format('timestamp')} AS timestamp, amount, currency, merchant, category, description, merchant_clean, date, month, direction FROM norm",
    "norm_accounts": f"""SELECT c_custkey::VARCHAR AS account_id, {_clean('c_name')} AS account_name, {_case("CASE WHEN c_custkey % 2 = 0 THEN 'checking' ELSE lower(c_mktsegment) END", fixed.ACCOUNT_TYPES, 'lower(c_mktsegment)')} AS account_type,
      CASE WHEN c_custkey % 3 = 0 THEN 'GHS' ELSE 'USD' END AS currency FROM customer""",
    "norm_fees_and_limits": f"SELECT p_partkey::VARCHAR AS item_id, CASE WHEN p_size > 25 THEN 'fee' ELSE 'limit' END AS item_type, p_retailprice AS value, upper({_clean('p_brand')}) AS unit, {_clean('p_name')} AS notes FROM part",
    "norm_products": f"SELECT p_partkey::VARCHAR AS product_id, {_clean('p_name')} AS product_name, lower({_clean('p_type')}) AS product_type FROM part",
    "norm_metadata": f"SELECT lower({_clean('n_name')}) AS key, n_regionkey::VARCHAR AS value, 'nation' AS source FROM nation",
    "norm_drop_incomplete": f"WITH {RAW}, {NORM} SELECT transaction_id, amount, currency FROM norm WHERE _ord % 5 <> 0 AND _ord % 7 <> 0 AND amount IS NOT NULL AND timestamp IS NOT NULL AND account_id IS NOT NULL",
    "ingest_transactions": f"""SELECT (event_id // 2)::VARCHAR AS transaction_id, user_id::VARCHAR AS account_id, CASE WHEN event_id % 13 <> 0 THEN 1000.5 + event_id % 1000 END::DOUBLE AS amount, 'GHS' AS currency,
      {_TS.format("CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('day', ts)::TIMESTAMP END")} AS timestamp, event_type AS description
      FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 2 ORDER BY event_id) = 1""",
    "spend_flags": f"""{SERVED}, t AS (SELECT count(*) AS n, count(DISTINCT currency) AS c FROM served WHERE direction = 'debit'),
      g AS (SELECT coalesce(nullif(trim(category), ''), 'unknown') AS key, sum(money)::DECIMAL(28,2) AS total, count(*) AS n FROM served WHERE direction = 'debit' GROUP BY 1 ORDER BY total DESC, n DESC, lower(key) DESC, key LIMIT 10)
      SELECT t.n = 0 AS empty_result, c > 1 AS multi_currency, CASE WHEN c > 1 THEN 1 ELSE 0 END AS warning_count, t.n AS transaction_count, (SELECT count(*) > 0 FROM g) AS has_groups,
        (SELECT key FROM g ORDER BY total DESC, n DESC, lower(key) DESC LIMIT 1) AS top_group_key, (SELECT total::VARCHAR FROM g ORDER BY total DESC, n DESC, lower(key) DESC LIMIT 1) AS top_group_amount FROM t""",
    "recurring_flags": f"""{_BY_MERCHANT} SELECT count(*) = 0 AS empty_result, count(*) AS record_count, count(*) FILTER (WHERE confidence = 'high') AS high_confidence_count, count(*) > 0 AND bool_and(is_irregular) AS irregular_only,
      first(merchant ORDER BY average DESC, last_seen DESC, lower(merchant) DESC, lower(account_id) DESC) AS primary_merchant, first(average::VARCHAR ORDER BY average DESC, last_seen DESC, lower(merchant) DESC, lower(account_id) DESC) AS primary_average_amount FROM records""",
    "dedupe_keep_first": f"""SELECT * EXCLUDE (r, l_shipdate), {_TS.format('l_shipdate')} AS l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS r FROM lineitem) WHERE r = 1""",
    "tables_union_by_name": "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_acctbal AS balance, s_name AS name FROM supplier",
    "map_categories": f"{UNNORMALIZED} SELECT {_MAPPING} FROM mapped",
    "map_normalized_categories": f"WITH {RAW}, {NORM}, {_mapped('norm', 'merchant_clean', 'category')} SELECT {_MAPPING} FROM mapped",
    "mapping_coverage": f"""{UNNORMALIZED}, c AS (SELECT category_mapping_source AS s, count(*) AS n FROM mapped GROUP BY 1)
      SELECT 'total' AS measure, sum(n)::BIGINT AS n FROM c UNION ALL SELECT 'source:' || s, n FROM c UNION ALL SELECT s, n FROM c WHERE s NOT LIKE 'rule:%' UNION ALL SELECT 'by_rule', sum(n)::BIGINT FROM c WHERE s LIKE 'rule:%'""",
    "recurrence_labels": f"{LABELLED_WEEKLY} SELECT {_LABELS} FROM labelled",
    "recurrence_labels_processed": f"{PROCESSED} SELECT {_LABELS} FROM labelled",
    "recurrence_summary": f"{LABELLED_WEEKLY} SELECT count(*) AS total_rows, count(*) FILTER (WHERE is_recurring) AS recurring_rows, count(*) FILTER (WHERE NOT is_recurring) AS other_rows, "
    + ", ".join([f"count(*) FILTER (WHERE recurrence_cadence = '{c}') AS cadence_{c}" for c in fixed.CADENCES] + [f"count(*) FILTER (WHERE recurrence_confidence = '{c}') AS confidence_{c}" for c in fixed.CONFIDENCES]) + " FROM labelled",
    "quality_findings": f"{_findings()} SELECT * FROM found",
    "quality_report": f"{_findings()} SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS passed, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM found",
    "spend_total": f"""{SERVED} SELECT coalesce(sum(money), 0)::DECIMAL(28,2)::VARCHAR AS total_amount, count(*) AS transaction_count, count(DISTINCT currency) AS currencies,
      CASE WHEN count(DISTINCT currency) > 1 THEN 'Multiple currencies detected. Totals are separated by currency and should not be combined implicitly.' ELSE '' END AS warnings
      FROM served WHERE direction = 'debit' AND timestamp BETWEEN '{START}' AND '{END}'""",
    "spend_by_currency_map": f"{SERVED} SELECT currency, sum(money)::DECIMAL(28,2)::VARCHAR AS total_amount, count(*) AS transaction_count FROM served WHERE direction = 'debit' GROUP BY 1",
    **{f"spend_by_{g}": _spend(g, "ASC" if g == "account" else "DESC") for g in ("category", "subcategory", "merchant", "account", "currency", "month")},
    "lookup_by_timestamp": _lookup("TRUE", "timestamp DESC"),
    "lookup_by_amount": _lookup("direction = 'debit'", "money ASC"),
    "lookup_by_merchant": _lookup(f"merchant IN ('melcom', 'uber') AND timestamp BETWEEN '{START}' AND '{END}'", "merchant DESC", 50),
    "lookup_by_filters": _lookup(f"category IN ('groceries', 'transport', 'fees') AND account_id IN {_in(range(1, 60))} AND money BETWEEN 10.00 AND 250", "account_id DESC"),
    "map_by_rule_table": f"""WITH r AS (SELECT (p_partkey * 7919 % 1000003)::INT AS priority, p_partkey AS k, {_list(fixed.CATEGORIES)}[p_partkey % {len(fixed.CATEGORIES)} + 1] AS category FROM part),
      f AS (SELECT l_partkey AS k, 'shop ' || l_partkey AS m, CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS direction, count(*) AS n FROM lineitem GROUP BY ALL),
      v AS (SELECT f.k, f.direction, any_value(f.n) AS n, min(r.priority) AS priority, arg_min(r.category, r.priority) AS category FROM f LEFT JOIN r ON
        CASE WHEN r.k % 500 = 3 THEN regexp_matches(f.m, '^shop [0-9]*' || r.k % 97 || '$') WHEN r.k % 4 = 1 THEN contains(f.m, 'p ' || r.k) ELSE f.k = r.k AND (r.k % 4 <> 2 OR f.direction = 'credit') END GROUP BY ALL)
      SELECT coalesce(category, 'other') AS category_mapped, CASE WHEN category IS NULL THEN 'uncategorized' ELSE 'general' END AS subcategory_mapped, coalesce('rule:' || priority, 'default_fallback') AS category_mapping_source, direction, sum(n)::BIGINT AS n FROM v GROUP BY ALL""",
    "lookup_by_id_table": _lookup("transaction_id IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'F')", "money DESC", 200),
    "spend_of_account_table": _spend("merchant", where="account_id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "lookup_by_ids": _lookup(f"transaction_id IN {_in(range(0, 400, 7))}", "transaction_id ASC"),
    "recurring_streams": f"{_BY_MERCHANT} {_RECORD}",
    "recurring_streams_latest": f"{_LATEST} {_RECORD}",
    "recurring_streams_of_accounts": f"{_OF_ACCOUNTS} {_RECORD}",
    "recurring_stream_summary": f"""{_BY_MERCHANT} SELECT 'cadence' AS measure, cadence AS value, count(*) AS n FROM records GROUP BY 1, 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM records GROUP BY 1, 2
      UNION ALL SELECT 'currency', coalesce(currency, 'mixed'), count(*) FROM records GROUP BY 1, 2""",
    "recurring_stream_warnings": f"""{_BY_MERCHANT} SELECT concat_ws('|', CASE WHEN count(*) = 0 THEN 'No recurring payments matched the provided filters.' END,
      CASE WHEN count(DISTINCT currency) > 1 OR count(*) > count(currency) THEN 'Multiple or mixed currencies detected in recurring payment results. Values should not be combined implicitly.' END,
      CASE WHEN count(*) > 0 AND bool_and(is_irregular) THEN 'All returned recurring payment records are marked as irregular.' END) AS warnings FROM records""",
    "explain_spend": f"""{SERVED}, t AS (SELECT sum(money)::DECIMAL(28,2) AS total, count(*) AS n, count(DISTINCT currency) AS c FROM served WHERE direction = 'debit'),
      g AS (SELECT coalesce(nullif(trim(category), ''), 'unknown') AS key, sum(money)::DECIMAL(28,2) AS total, count(*) AS n, {_ONE_CURRENCY} AS currency FROM served WHERE direction = 'debit' GROUP BY 1),
      r AS (SELECT *, row_number() OVER (ORDER BY total DESC, n DESC, lower(key) DESC, key) AS r FROM g)
      SELECT 0 AS place, 'Total spend' AS title, total::VARCHAR AS value, 'Based on ' || n || ' transaction(s)' || CASE WHEN c > 1 THEN ' across ' || c || ' currencies' ELSE '' END AS context,
        CASE WHEN c > 1 THEN 'multi_currency' ELSE '' END AS tags, CASE WHEN c > 1 THEN 5 ELSE 4 END AS priority FROM t
      UNION ALL SELECT r, 'Top Categories: ' || key, total::VARCHAR, concat_ws(' | ', n || ' transaction(s)', 'currency: ' || currency), CASE WHEN r = 1 THEN 'top_category' ELSE '' END, CASE WHEN currency IS NULL THEN 3 ELSE 2 END FROM r WHERE r <= 3""",
    "explain_transactions": f"""{_CREDITS}, rec AS (SELECT *, {_ISO.format('timestamp')} AS iso, row_number() OVER (ORDER BY timestamp DESC, transaction_id) AS r,
        row_number() OVER (ORDER BY money DESC, timestamp DESC, transaction_id DESC) AS big, row_number() OVER (ORDER BY timestamp DESC, money DESC, transaction_id DESC) AS late FROM hit)
      SELECT 0 AS place, 'Largest returned transaction' AS title, money::VARCHAR AS value, {_BLOCK_CREDIT} AS context, 'large_transaction' AS tags, 4 AS priority FROM rec WHERE big = 1
      UNION ALL SELECT 1, 'Most recent returned transaction', money::VARCHAR, {_BLOCK_CREDIT}, 'recent_activity', 2 FROM rec WHERE late = 1
      UNION ALL SELECT r + 1, 'Transaction: ' || merchant, money::VARCHAR, category || ' | ' || iso || ' | ' || currency || ' | ' || direction, CASE WHEN late = 1 THEN 'recent_activity' ELSE '' END, 2 FROM rec WHERE r <= 2""",
    "explain_recurring": f"""{_BY_MERCHANT}, rec AS (SELECT *, {_ISO.format('last_seen')} AS iso, coalesce(currency, 'mixed currency') AS cur, row_number() OVER (ORDER BY average DESC, last_seen DESC, lower(merchant) DESC, lower(account_id) DESC, category, subcategory) AS r FROM records),
      main AS (SELECT * FROM rec QUALIFY row_number() OVER (ORDER BY average DESC, last_seen DESC, lower(merchant) DESC, lower(account_id) DESC, r) = 1),
      high AS (SELECT *, row_number() OVER (ORDER BY r) AS k FROM rec WHERE confidence = 'high')
      SELECT 0 AS place, 'Primary recurring payment' AS title, average::VARCHAR AS value, merchant || ' | ' || cadence || ' | ' || iso || ' | ' || cur AS context, CASE WHEN confidence = 'high' THEN 'recurring,high_confidence' ELSE 'recurring' END AS tags, CASE WHEN currency IS NULL THEN 6 ELSE 5 END AS priority FROM main
      UNION ALL SELECT k, 'High-confidence recurring: ' || merchant, average::VARCHAR, cadence || ' | ' || transaction_count || ' transaction(s) | ' || iso || ' | ' || cur, 'recurring,high_confidence', CASE WHEN currency IS NULL THEN 4 ELSE 3 END FROM high WHERE k <= 4
      UNION ALL SELECT 99, 'Recurring cadence distribution', string_agg(c, ' | ' ORDER BY c), 'Count of recurring streams by cadence', 'recurring', 1 FROM (SELECT cadence || ': ' || count(*) AS c FROM records GROUP BY cadence) HAVING count(*) > 0""",
    "transaction_flags": f"""{_CREDITS} SELECT count(*) = 0 AS empty_result, count(DISTINCT currency) > 1 AS multi_currency, count(*) AS match_count, first(transaction_id ORDER BY money DESC, timestamp DESC, transaction_id DESC) AS largest_transaction_id,
      max(money)::VARCHAR AS largest_transaction_amount, first(transaction_id ORDER BY timestamp DESC, money DESC, transaction_id DESC) AS most_recent_transaction_id, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies FROM hit""",
    "vector_topk": """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
      SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))) AS s FROM e, q
        WHERE list_inner_product(e.v, e.v) > 0 ORDER BY s DESC, vec_id LIMIT 10)""",
    "vector_topk_of_many": f"SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM ({_nearest(f'SELECT vec_id AS query_id, {_UNIT} AS v FROM embeddings WHERE vec_id % 20 = 0', 'q.query_id <> e.vec_id')})",
    "retrieval_sweep": f"""{_cases(f"SELECT n.query_id AS test_id, lower(d.text) AS t, n.rank FROM ({_nearest(f'SELECT vec_id AS query_id, {_UNIT} AS v FROM embeddings JOIN benchmark ON item_id = vec_id')}) n JOIN documents d ON d.doc_id = n.vec_id")}
      SELECT test_id, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg, round(keyword_coverage, 9) AS keyword_coverage, keywords_found, total_keywords FROM metrics""",
    "vector_mean": "WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT i::INT AS i, round(avg(x), 9) AS mean, count(*) AS n FROM x GROUP BY i",
    "vector_covariance": """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS c FROM x)
      SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.c * b.c) / count(*), 8) AS covariance FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""",
    "chunk_fixed_stride": """SELECT doc_id, chunk_id::INT AS chunk_id, substring(text, (chunk_id * 800 + 1)::INT, 1000) AS chunk FROM (
      SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 1000) / 800.0), 0)::INT + 1)) AS chunk_id FROM documents WHERE length(text) > 0)""",
    "chunk_recursive": _recursive_chunks(),
    "combined_question": """WITH u AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, text) AS t FROM conversations WHERE role = 'user' GROUP BY 1)
      SELECT conv_id, array_to_string(t[1:len(t) - 1], chr(10)) || chr(10) || t[len(t)] AS question FROM u""",
    "context_assembly": f"SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (WHERE {_STRIPPED}), 'No relevant context found.') AS context FROM conversations GROUP BY 1",
    "corpus_size": "SELECT count(text) AS documents, (sum(length(text)) + 2 * (count(text) - 1))::BIGINT AS characters, sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')))::BIGINT AS words FROM documents",
    "kind_histogram": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
    "store_profile": "SELECT count(*) AS n, max(len(embedding))::INT AS dimension FROM embeddings",
    "files_of_three_formats": _FILES,
    "dataset_of_files": _FILES,
    "json_of_three_shapes": "SELECT CASE n_regionkey WHEN 0 THEN 'list' WHEN 1 THEN 'keyed' ELSE 'single' END AS shape, n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_regionkey = 1 THEN n_nationkey / 2 END AS half FROM nation",
    "documents_by_folder": "SELECT lower(n_name) || chr(10) AS text, 'region=' || n_regionkey AS doc_type FROM nation WHERE n_nationkey % 5 <> 0",
    "evaluation_cases": "SELECT text AS question, array_to_string(string_split(text, ' '), ',') AS keywords, item_id::VARCHAR AS reference_answer, 'item' AS category FROM benchmark",
    "vector_store": "SELECT vec_id, len(embedding)::INT AS dimension FROM embeddings",
    "lookup_records_json": f"""{_CREDITS} SELECT json_object('transaction_id', transaction_id, 'account_id', account_id, 'timestamp', {_ISO.format('timestamp')}, 'amount', money::VARCHAR, 'currency', currency, 'direction', direction,
      'merchant', merchant, 'category', category, 'subcategory', subcategory)::VARCHAR AS record FROM hit""",
    "lookup_warnings": f"""{_CREDITS} SELECT CASE WHEN count(DISTINCT currency) > 1 THEN '{fixed.MIXED_LOOKUP}' ELSE '' END AS warnings FROM hit""",
    "spend_of_accounts_checked": f"""{SERVED} SELECT coalesce(sum(money), 0)::DECIMAL(28,2)::VARCHAR AS total_amount, count(*) AS transaction_count, count(DISTINCT currency) AS currencies
      FROM served WHERE direction = 'credit' AND account_id IN {_in(range(3, 60, 3))}""",
    "answer_bands": f"""WITH m AS (SELECT lang, count(*) AS tests, avg(1 + doc_id % 5) AS accuracy, avg(3 + doc_id % 3) AS completeness, avg(4 + doc_id % 2) AS relevance FROM documents GROUP BY 1)
      SELECT lang, tests, {", ".join(f"round({k}, 6) AS {k}, {_band(k, k)} AS {k}_band" for k in ("accuracy", "completeness", "relevance"))} FROM m""",
    "norm_bundle": f"""SELECT 'products' AS dataset, {_clean('p_name')} AS name FROM part UNION ALL SELECT 'metadata', lower({_clean('n_name')}) FROM nation UNION ALL SELECT 'regions', r_name FROM region""",
    "warnings_merged": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || '|mixed' END AS warnings FROM nation",
    "retrieval_metrics": f"{_cases()} SELECT test_id, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg, round(keyword_coverage, 9) AS keyword_coverage, keywords_found, total_keywords FROM metrics",
    "retrieval_bands": f"""{_cases()}, m AS (SELECT count(*) AS tests, avg(mrr) AS mrr, avg(ndcg) AS ndcg, avg(keyword_coverage) AS keyword_coverage FROM metrics)
      SELECT tests, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(keyword_coverage, 6) AS keyword_coverage, {_band('mrr', 'mrr')} AS mrr_band, {_band('ndcg', 'ndcg')} AS ndcg_band, {_band('keyword_coverage', 'coverage')} AS keyword_coverage_band FROM m""",
}


def _explanation(kind: str, blocks: str, flags: str, warned: str, shown: str, confidence: str, show_warnings: bool = True) -> str:
    """An explanation from the SQL of its blocks, flags and warnings."""
    return f"""WITH b AS ({ORACLE_SQL[blocks]}), f AS ({ORACLE_SQL[flags]}), w AS ({warned}), o AS (
  SELECT '{kind}' AS source_type, {confidence} AS confidence, w.warnings AS found, f.* FROM f, w
) SELECT source_type, confidence, {"found" if show_warnings else "''"} AS warnings,
  (SELECT string_agg(concat_ws(' / ', title, value, context, tags, priority), chr(10) ORDER BY place) FROM b) AS blocks,
  concat_ws(';', {shown}, 'warning_count=' || CASE WHEN found = '' THEN 0 ELSE 1 END, 'source_type={kind}', 'explanation_confidence=' || confidence) AS flags FROM o"""


def _shown(*names: str) -> str:
    return ", ".join(f"'{n}=' || coalesce({n}::VARCHAR, 'null')" for n in names)


_WARNED = "CASE WHEN w.warnings <> '' THEN 'medium' ELSE 'high' END"
_CADENCES = f"(SELECT string_agg(cadence || ':' || n, ',' ORDER BY cadence) FROM ({_BY_MERCHANT} SELECT cadence, count(*) AS n FROM records GROUP BY 1))"
_SURE = f"(SELECT CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END FROM ({_BY_MERCHANT} SELECT * FROM records))"
ORACLE_SQL |= {
    "explanation_of_spend": _explanation("spend", "explain_spend", "spend_flags", f"SELECT CASE WHEN currencies > 1 THEN '{fixed.MIXED_SPEND}' ELSE '' END AS warnings FROM (SELECT (SELECT multi_currency FROM ({ORACLE_SQL['spend_flags']}))::INT + 1 AS currencies)",
        _shown("empty_result", "multi_currency", "transaction_count", "has_groups", "top_group_key", "top_group_amount"), _WARNED),
    "explanation_of_transactions": _explanation("transactions", "explain_transactions", "transaction_flags", ORACLE_SQL["lookup_warnings"],
        _shown("empty_result", "multi_currency", "match_count", "largest_transaction_id", "largest_transaction_amount", "most_recent_transaction_id", "currencies"), _WARNED),
    "explanation_of_recurring": _explanation("recurring", "explain_recurring", "recurring_flags", ORACLE_SQL["recurring_stream_warnings"],
        _shown("empty_result", "record_count", "high_confidence_count", "irregular_only", "primary_merchant", "primary_average_amount") + f", 'count_by_cadence=' || {_CADENCES}", _SURE, False),
}
