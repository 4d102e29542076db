"""Every query of the catalogue against its SQL in DuckDB, on whole tables."""

import datetime

import duckdb
import pytest

from fieldloom.plans import all as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations labels pages".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 4)
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    return round(float(v), 4)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
