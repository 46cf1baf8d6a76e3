"""A table in the order of its keys, read page by page from the last key seen.

Rows are written by ranges of their keys, sorted, beside an index with the first and last key and the
number of rows of each file. A page reads the files that can hold it, and no others: there is no offset
to skip, and nothing is sorted but these files' rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class OrderedTable:
    """The table of ``path``. ``keys`` together must be different in every row, or rows of equal keys at the end of a page are passed over; nulls come first."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])

    def write(self, rows: DataFrame, rows_per_file: int = 1_000_000) -> None:
        rows = rows.select(*self.schema.fieldNames()).repartitionByRange(*self.keys).sortWithinPartitions(*self.keys)
        rows.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.path}/data")
        key = F.struct(*self.keys)
        kept = self.spark.read.schema(self.schema).parquet(f"{self.path}/data").select(*self.keys, F.col("_metadata.file_path").alias("file"))
        kept.groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{self.path}/index")

    def _files(self, after: Row | None) -> list[Row]:
        """(file, rows) of files that go past a key, in order: a row a file."""
        index = self.spark.read.parquet(f"{self.path}/index")
        if after is not None:
            index = index.filter(F.col("last") > self._key(after))
        return index.orderBy("first").select("file", "rows").collect()

    def _key(self, row: Row) -> Column:
        return F.struct(*[F.lit(row[k]).cast(self.schema[k].dataType).alias(k) for k in self.keys])

    def page(self, size: int = 1000, after: Row | None = None) -> DataFrame:
        """The first ``size`` rows, or the first after the keys of a row, in order."""
        chosen, sure = [], 0
        for i, file in enumerate(self._files(after)):
            if sure >= size:
                break
            chosen.append(file["file"])
            sure += file["rows"] if i or after is None else 0  # of the first file some rows may be before
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*chosen)
        rows = rows if after is None else rows.filter(F.struct(*self.keys) > self._key(after))
        return rows.orderBy(*self.keys).limit(size)

    def paged(self, size: int = 1000, page: str = "page") -> DataFrame:
        """All rows with the number of their page from 0, in one pass: a row's place is its place in its file and the rows of the files before, a number for each file."""
        before = F.sum("rows").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
        starts = self.spark.read.parquet(f"{self.path}/index").select(F.col("file").alias("_file"), F.coalesce(before, F.lit(0)).alias("_before"))
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data")
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        return rows.join(F.broadcast(starts), "_file").select(*self.schema.fieldNames(), F.floor((F.col("_before") + F.col("_at")) / size).cast("int").alias(page))

    def pages(self, size: int = 1000) -> Iterator[list[Any]]:
        """The rows of one page after the other, until a short one."""
        after = None
        while True:
            rows = self.page(size, after).collect()
            if rows:
                yield rows
            if len(rows) < size:
                return
            after = rows[-1]
