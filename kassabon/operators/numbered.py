"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassabon.sources.folders import new_path


def numbered(rows: DataFrame, *order: str | Column, place: str = "n") -> DataFrame:
    """``rows`` with their place from 0 in an order.

    Rows are dealt into ranges of the order and written once, sorted, with range and place inside; a
    range's start is the sum of the sizes before it, a number for each range. As the ranges are
    written, a lost executor can't draw them anew for half of the plan. Ties get any of their places.
    """
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = new_path(spark, "numbered")
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    kept = spark.read.schema(dealt.schema).parquet(path)
    part = F.shiftright("_at", 33)
    starts, before = [], 0
    for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a range
        starts.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("_part", part).join(offsets, "_part").withColumn(place, F.col("_before") + inside).drop("_part", "_before", "_at")
