"""Queries whose SQL leaves ties or nulls to the engine, on small tables that have them."""

import duckdb
import pytest

from tessera.plans import catalog


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query by Spark and by its SQL (one thread, rows in the order of the file), over tables given as SQL."""

    def run(name, **tables):
        con = duckdb.connect(config={"threads": 1})
        for t, text in tables.items():
            con.execute(f"copy ({text}) to '{tmp_path}/{t}.parquet'")
            con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalog.ORACLE_SQL[name])
        return sorted(map(repr, (tuple(r) for r in df.select(*want.columns).collect()))), sorted(map(repr, want.fetchall()))

    return run


def test_the_first_of_equally_poor_customers_is_named(both):
    rows = "select i::bigint as c_custkey, nullif('c' || (100 - i), 'c100') as c_name, 1 as c_nationkey, if(i = 7, null, (i // 2 % 3)::double) as c_acctbal, 's' || (i % 2) as c_mktsegment from range(40) as t(i) order by i"
    got, want = both("aggregate_statistics", customer=rows)
    assert got == want and len(got) == 2


def test_the_two_dearest_orders_have_nulls_last(both):
    customers = "select i::bigint as c_custkey, 'n' as c_name from (values (1), (2), (3), (3), (null)) as t(i)"
    orders = "select k::bigint as o_orderkey, c::bigint as o_custkey, p::double as o_totalprice from (values (null, 1, 5), (7, 1, 5), (6, 1, 5), (1, 2, null), (null, 2, 3), (null, 2, null), (9, 3, 1), (8, 3, 'nan'::double), (4, null, 2)) as t(k, c, p)"
    got, want = both("join_lateral_top", customer=customers, orders=orders)
    assert got == want and len(got) == 8
