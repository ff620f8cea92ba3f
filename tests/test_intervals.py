"""Queries on intervals of order lines against their SQL, on rows that the generated tables don't hold."""

import duckdb
import pytest

from sparkloom.plans import ORACLE, QUERIES

LINES = [(1, 1, 0.5), (1, 2, 1.5), (1, 4, 2.5), (1, 5, None), (1, 5, 30.0), (1, 9, 3.5), (1, None, 2.0), (1, 12, 5.5)]
LINES += [(2, 1, None), (2, 1, 45.0), (2, 6, 4.5), (2, 6, 5.5), (None, 3, 1.5), (None, 7, 4.0), (3, None, None), (4, 2, 14.5), (4, 4, 0.0)]
#: Equal intervals that begin an island, go on with one and stand alone.
EQUAL = [(7, 1, 4.0), (7, 1, 4.0), (7, 1, 4.0), (7, 3, 4.0), (7, 3, 4.0), (7, 4, 2.0), (8, 5, 9.0), (8, 5, 9.0)]


def tables(spark, folder, lines):
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    events = [(e, k, at / 10) for e, (k, at) in enumerate((k, at) for k in (1, 2, 4) for at in range(5, 130))]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{folder}/events.parquet")
    c = duckdb.connect(config={"threads": 1})
    for name in ("lineitem", "events"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return c


def same(spark, folder, name, c, sql):
    want = c.sql(sql)
    got = QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["gap_islands", "interval_overlap_join"])
def test_odd_quantities_and_nulls(spark, tmp_path, name):
    c = tables(spark, tmp_path, LINES)
    same(spark, tmp_path, name, c, ORACLE[name])


def test_equal_intervals_share_an_island(spark, tmp_path):
    """The SQL with ties numbered once for both of its windows, in either order."""
    c = tables(spark, tmp_path, EQUAL)
    for order in ("", "DESC"):
        once = ORACLE["gap_islands"].replace("SELECT l_orderkey AS k,", "SELECT file_row_number AS place, l_orderkey AS k,", 1)
        once = once.replace("FROM lineitem", f"FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet', file_row_number = true)").replace("ORDER BY low, high", f"ORDER BY low, high, place {order}")
        same(spark, tmp_path, "gap_islands", c, once)
