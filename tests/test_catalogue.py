"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from basalt.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def canon(t):
    t = t.select(sorted(t.column_names))
    one = lambda v: ("nan" if math.isnan(v) else f"{v:.11g}") if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r.values())) for r in t.to_pylist()), t.column_names


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = canon(catalogue.QUERIES[name](spark, SF).toArrow())
    want = canon(con.sql(catalogue.ORACLES[name]).to_arrow_table())
    assert got == want


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["where_half_open_range"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp" in plan


def test_top_k_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in catalogue.QUERIES["topk_orders"](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("lines", [[(1.0, 10.0)] * 20, [(k / 1000, 0.1 * k) for k in range(15, 400, 10)]], ids=["equal baskets", "quantities that end in 5"])
def test_basket_histogram_on_odd_lines(spark, tmp_path, lines):
    tables = {
        "lineitem": ([(k, k, 1, q, p, "N") for k, (q, p) in enumerate(lines)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"),
        "orders": ([(k, k % 3, None) for k in range(len(lines))], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "customer": ([(k, k) for k in range(3)], "c_custkey long, c_nationkey int"),
    }
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = canon(catalogue.QUERIES["basket_histogram"](spark, str(tmp_path)).toArrow())
    assert got == canon(c.sql(catalogue.ORACLES["basket_histogram"]).to_arrow_table())
