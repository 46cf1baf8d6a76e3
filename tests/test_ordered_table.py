"""Pages by the last key seen."""

import random

from kassabon.sources.ordered_table import OrderedTable
from pyspark.sql import functions as F

SCHEMA = "store string, id long, name string"


def made(spark, tmp_path, n, rows_per_file=100):
    rng = random.Random(n)
    items = list({(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(n)])): None for _ in range(n)})
    items = [(s, i, f"{s} {i}") for s, i in items]
    table = OrderedTable(spark, str(tmp_path / f"t{n}"), spark.createDataFrame([], SCHEMA).schema, ["store", "id"])
    table.write(spark.createDataFrame(items, SCHEMA).repartition(3), rows_per_file)
    return table, sorted(items, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))


def test_pages_are_the_ordered_table(spark, tmp_path):
    table, want = made(spark, tmp_path, 1000)
    got = list(table.pages(170))
    assert [tuple(r) for page in got for r in page] == want
    assert [len(page) for page in got[:-1]] == [170] * (len(got) - 1)
    assert len(table._files(None)) > 8


def test_a_page_reads_few_files(spark, tmp_path):
    table, want = made(spark, tmp_path, 1000)
    after = spark.createDataFrame([want[500]], SCHEMA).first()
    page = table.page(50, after)
    assert [tuple(r) for r in page.collect()] == want[501:551]
    assert len(page.inputFiles()) <= 2


def test_sizes_that_divide_and_none(spark, tmp_path):
    table, want = made(spark, tmp_path, 60)
    assert sum(len(p) for p in table.pages(len(want))) == len(want)
    empty = OrderedTable(spark, str(tmp_path / "none"), spark.createDataFrame([], SCHEMA).schema, ["store", "id"])
    empty.write(spark.createDataFrame([], SCHEMA))
    assert list(empty.pages(5)) == []
    assert table.page(5).agg(F.count("*")).first()[0] == 5
