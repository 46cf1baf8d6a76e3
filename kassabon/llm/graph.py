"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a file.
ROWS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(key, comp) for every key in ``links`` (a, b): comp is the smallest key that links reach.

    Each round takes the smallest label among a key's neighbours and then the label of that
    label, so that paths shorten by doubling; it ends when a round changes nothing. Links of a
    key to itself are allowed; an empty table gives no rows. Tables are written in as many files
    as the links need.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    files = 1 + 2 * links.count() // ROWS
    edges = cut(both.coalesce(files))
    labels = cut(edges.select(F.col("a").alias("key")).distinct().withColumn("comp", F.col("key")).coalesce(files))
    while True:
        near = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("near"))
        stepped = cut(labels.join(near, "key").select("key", "comp", F.least("comp", "near").alias("new")).coalesce(files))
        over = stepped.select(F.col("key").alias("new"), F.col("new").alias("far"))
        jumped = cut(stepped.join(over, "new").select("key", "comp", F.least("new", "far").alias("new")).coalesce(files))
        changed = jumped.filter("new <> comp").limit(1).count()
        labels = jumped.select("key", F.col("new").alias("comp"))
        if not changed:
            return labels
