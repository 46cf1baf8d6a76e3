"""Upserts that rewrite only the buckets whose rows change."""

import random
from pathlib import Path

import pytest
from kassabon.sources.keyed_table import KeyedTable, sync_table
from pyspark.sql import functions as F

SCHEMA = "store string, id string, price double, seen int"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "table"), spark.createDataFrame([], SCHEMA).schema, ["store", "id"], 8, kept=("seen",))


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def files(table):
    return {str(p) for w in set(table.state()[2].values()) for p in Path(table.path, "data", w).rglob("*.parquet")}


def test_against_a_dict(spark, table):
    rng, want = random.Random(1), {}
    for step in range(4):
        items = list({(rng.choice(["a", "b", None]), str(rng.randint(0, 60))): None for _ in range([50, 2, 20, 0][step])})
        items = [(s, i, rng.choice([1.0, 2.0, None]), step) for s, i in items]
        table.upsert(rows(spark, items))
        for s, i, price, seen in items:
            want[s, i] = (price, want.get((s, i), (None, seen))[1])
        assert {(r["store"], r["id"]): (r["price"], r["seen"]) for r in table.read().collect()} == want
    assert table.read(0).count() == len({k for k in want if want[k][1] == 0})


def test_untouched_buckets_keep_their_files(spark, table):
    table.upsert(rows(spark, [("a", str(i), 1.0, 0) for i in range(200)]))
    before = files(table)
    assert len(before) == 8
    written = table.upsert(rows(spark, [("a", "7", 2.0, 1), ("a", "8", 1.0, 1)]))  # the second row is as it was
    assert len(written) == 1
    assert len(files(table) & before) >= 7 and table.read().count() == 200
    assert sum(w in table.state()[2].values() for w in {w for w in table._names("data")}) == 2
    assert table.upsert(rows(spark, [("a", "7", 2.0, 5)])) == []
    assert table.commits() == [0, 1]


def test_lost_jobs_leave_the_table(spark, table, monkeypatch):
    table.upsert(rows(spark, [("a", "1", 1.0, 0)]))

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(table, "_commit", lost)
    with pytest.raises(RuntimeError):
        table.upsert(rows(spark, [("a", "1", 9.0, 0)]))
    monkeypatch.undo()
    assert table.read().first()["price"] == 1.0
    with pytest.raises(Exception, match="(?i)exist"):
        table._commit(0, -1, {})
    assert table.clean() == 1
    table.upsert(rows(spark, [("a", "1", 3.0, 0)]))
    assert table.clean(keep=1) == 1
    assert (table.read().first()["price"], table.commits()) == (3.0, [1])


def test_guard_and_order(spark, table):
    table.upsert(rows(spark, [("a", "1", 5.0, 0), ("a", "2", 5.0, 0)]))
    newer = rows(spark, [("a", "1", 4.0, 1), ("a", "2", 6.0, 1), ("a", "3", 1.0, 1), ("a", "3", 2.0, 1)])
    table.upsert(newer, when=lambda old, new: new("price") > old("price"), order=[F.desc("price")])
    assert sorted((r["id"], r["price"]) for r in table.read().collect()) == [("1", 5.0), ("2", 6.0), ("3", 2.0)]


def test_sync(spark, tmp_path):
    schema = "store_id string, external_id string, price double, is_available boolean"
    make = lambda items: spark.createDataFrame(items, schema)
    table = KeyedTable(spark, str(tmp_path / "t"), make([]).schema, ["store_id", "external_id"], 4)
    table.upsert(make([("a", "1", 1.0, True), ("a", "2", 1.0, True), ("b", "1", 1.0, True)]))
    sync_table(make([("a", "1", 2.0, True)]), table, store="a")
    assert sorted(map(tuple, table.read().collect())) == [("a", "1", 2.0, True), ("a", "2", 1.0, False), ("b", "1", 1.0, True)]
    assert sync_table(make([("a", "1", 2.0, True)]), table, store="a") == []
