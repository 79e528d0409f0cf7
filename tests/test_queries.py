"""Every query of the keyspace engine against its SQL, on the smallest tables."""

import duckdb
import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    said = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert said is None or said.endswith("no SQL"), said


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def against_sql(spark, tmp_path, name, events):
    """The query's difference from its SQL on events (event_id, user_id, event_type)."""
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    return compare(spark, con, str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name])


def test_human_formats_of_large_numbers(spark, tmp_path):
    edges = [0, 60, 1024, 3600, 86_400, 1_024_000, 1_048_576, 6_000_000, 2**30, 2**40, 2**50]
    ids = {i for e in edges for i in (e - 1, e, e + 1) if i >= 0} | set(range(0, 6_000_000, 7_919))
    assert against_sql(spark, tmp_path, "human_formats", [(i, 0, "view") for i in sorted(ids)]) is None


def test_setnx_first_of_keys_shared_by_users(spark, tmp_path):
    """Users of five digits: 1233 (live), 12331, 12332 and 12333 (live) are all one key of four."""
    few = [(4, 12333, "error"), (5, 12332, "click"), (6, 12331, "view"), (7, 1233, "view"), (8, 1, "view"), (9, 3, "view"), (10, -4, "view"), (11, None, "view")]
    many = [(i, i * 7_919 % 90_000, f"t{i % 5}") for i in range(20, 3_000)]
    assert against_sql(spark, tmp_path, "setnx_first", few + many) is None
