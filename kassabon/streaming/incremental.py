"""Incremental refresh: landed files stream in, and each micro-batch updates the silver table.

The state is a keyed table: a batch rewrites the buckets whose products it changes. Its id is the mark of
the commit, so a batch that runs again after a failure finds itself done; late rows don't overwrite newer
ones. Envelopes that land again within a day of event time are dropped before they reach a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kassabon.functions import jsons
from kassabon.plans.silver import bronze, silver
from kassabon.sources.keyed_table import KeyedTable
from kassabon.workers import sent_whole

sent_whole(__name__)

#: The state store that keyed state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["store", "external_id"]


def read_landing(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select(F.trim("value").alias("value")).filter("value <> ''")


def without_repeats(lines: DataFrame, late: str = "1 day") -> DataFrame:
    """Lines whose envelope didn't land before, as far as the watermark of their ``scraped_at`` reaches; lines without a time pass as they are."""
    at = F.try_to_timestamp(jsons.path(F.col("value"), "scraped_at"))
    rows = lines.withColumn("_hash", jsons.row_hash(jsons.path(F.col("value"), "store"), F.col("value"))).withColumn("_at", at)
    once = rows.filter("_at is not null").withWatermark("_at", late).dropDuplicatesWithinWatermark(["_hash"])
    return once.select("value").union(rows.filter("_at is null").select("value"))


def silver_table(spark: SparkSession, state: str, buckets: int = 64) -> KeyedTable:
    schema = silver(bronze(spark.createDataFrame([], "value string"), F.current_timestamp())).schema
    return KeyedTable(spark, state, schema, KEYS, buckets, kept=("first_seen_at", "id"))


def refresh_batch(table: KeyedTable):
    """A function for foreachBatch that merges a batch of landed lines into the table."""

    def merge(lines: DataFrame, batch: int) -> None:
        if batch <= table.state()[1]:
            return
        fresh = silver(bronze(lines, F.current_timestamp()))
        table.upsert(fresh, when=lambda old, new: old("last_seen_at").isNull() | (new("last_seen_at") >= old("last_seen_at")), mark=batch)

    return merge


def start(spark: SparkSession, landing: str, table: KeyedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = read_landing(spark, landing).writeStream.foreachBatch(refresh_batch(table)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class LatestEnvelope(StatefulProcessor):
    """Keeps of each product when it was first and last seen and its text's hash; gives the newest of a batch's envelopes where it is newer than that, or of that time with another text of a higher hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first long, last long, hash string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, last, mark = self.seen.get() if self.seen.exists() else (None, None, "")
        best = None
        for part in rows:
            for at, text, value in zip(part["at"].tolist(), part["hash"], part["value"], strict=True):
                first = at if first is None else min(first, at)
                if last is None or (at, text) > (last, mark):
                    last, mark, best = at, text, value
        self.seen.update((first, last, mark))
        if best is not None:
            yield pd.DataFrame({"store": [key[0]], "external_id": [key[1]], "first_seen_at": [first], "last_seen_at": [last], "value": [best]})

    def close(self) -> None:
        pass


def latest_envelopes(lines: DataFrame) -> DataFrame:
    """(store, external_id, first_seen_at, last_seen_at, value) of a stream of landed lines: a row for each product that a batch brings news of.

    State is kept by product, not as tables of all of them, so late, repeated and replayed lines change nothing.
    Times are microseconds; lines without store, id or time are left out.
    """
    value = F.col("value")
    spoken = lines.select(jsons.path(value, "store").alias("store"), jsons.path(value, "external_id").alias("external_id"), F.unix_micros(F.try_to_timestamp(jsons.path(value, "scraped_at"))).alias("at"), "value")
    rows = spoken.withColumn("hash", jsons.row_hash(F.col("store"), value)).filter("store is not null and external_id is not null and at is not null")
    shape = "store string, external_id string, first_seen_at long, last_seen_at long, value string"
    return rows.groupBy(*KEYS).transformWithStateInPandas(LatestEnvelope(), shape, "Update", "None")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each store and window, late ones up to a bound."""
    return events.withWatermark("scraped_at", late).groupBy(F.window("scraped_at", every), "store").agg(F.count(F.lit(1)).alias("n"))
