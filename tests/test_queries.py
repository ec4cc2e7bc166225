"""Each registered masking query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from cloakframe.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "orders", "customer", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(([plain(r[c]) for c in want.columns] for r in df.collect()), key=repr)
    assert got == sorted(([plain(v) for v in r] for r in want.fetchall()), key=repr)
