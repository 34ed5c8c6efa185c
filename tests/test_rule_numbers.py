"""Rules of many parts, whose numbers repeat, against SQL."""

import datetime as dt

import duckdb
import pytest

from brasstally import queries

#: Numbers repeat from part to part 1,000,003 later.
PARTS = (0, 2, 5, 8, 503, 1_000_003, 1_000_005, 1_000_008, 1_000_503, 2_000_008)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT unnest(?)::BIGINT AS p_partkey", [list(PARTS)])
    lines = [(i, n, part, float(i), "RN"[n % 2], "OF"[i % 2], dt.datetime(2024, 1, 1)) for i, part in enumerate((*PARTS, 77)) for n in range(3)]
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_extendedprice DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?, ?, ?)", lines)
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return con, str(folder)


def test_numbers_repeat(spark, tables):
    con, folder = tables
    df = queries.QUERIES["map_by_rule_table"](spark, folder)
    result = con.execute(queries.ORACLE_SQL["map_by_rule_table"])
    assert df.columns == [c[0] for c in result.description]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_numbers_of_huge_keys(spark, tables, tmp_path):
    """The largest keys whose product with 7919 is a long."""
    con, folder = tables
    last = (2**63 - 1) // 7919
    con.execute(f"COPY (SELECT unnest([{last}, {last - 1_000_003}]) AS p_partkey) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * REPLACE ({last} - (l_linenumber % 2) * 1000003 AS l_partkey) FROM lineitem) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    found = queries.QUERIES["map_by_rule_table"](spark, str(tmp_path)).collect()
    shown = {r["category_mapping_source"] for r in found} - {"default_fallback"}
    assert sum(r["n"] for r in found) == 33 and shown == {f"rule:{last * 7919 % 1_000_003}"}
