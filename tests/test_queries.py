"""Every query against its SQL on the smallest tables."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from kassabon.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        path = Path(SF, f"{t}.parquet")
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{source}')")
    return db


def plain(value):
    if isinstance(value, float | Decimal) and math.isfinite(value):
        return f"{round(float(value), 6):.9g}"
    return str(value)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*columns).collect()]
    if name not in queries.ORACLES:
        assert rows
        return
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    assert Counter(rows) == Counter(want)
