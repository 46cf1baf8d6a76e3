"""Operators that SQL expresses, against their SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest
from kassabon.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want)
