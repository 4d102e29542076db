"""merge_template against its SQL on balances and names that the tables of the tests don't have, in one range and in several."""

import duckdb
import pytest

from fieldloom.operators import merge
from fieldloom.plans import all as catalogue

BALANCES = [None, 0.0, -0.0, -0.001, 0.0025, 0.0075, 1.0025, 4999.995, 5000.0, 1e15 + 0.3, 4.5e15, 1.2345678e17, 3e18, float("nan"), float("inf"), float("-inf"), 12.5]


@pytest.mark.parametrize("per_range", [200_000, 5])
def test_odd_rows(spark, tmp_path, monkeypatch, per_range):
    rows = [(i, [f"C{i}", None, ""][i % 3], 1, b, "X") for i, b in enumerate(BALANCES)] + [(None, "last", 1, 5.0, "X")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(merge.merge, "__defaults__", (*merge.merge.__defaults__[:-1], per_range))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = db.sql(catalogue.ORACLE_SQL["merge_template"])
    got = catalogue.QUERIES["merge_template"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
