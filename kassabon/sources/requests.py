"""Request files: lines in order, cut greedily by number and bytes, with their manifest and id map.

A chunk takes lines until one more would pass either budget, so where it ends depends on where it
began, back to the first line. To find that side by side, lines are taken in blocks: prefix sums of the
bytes give each line's next break, and following those to the block's end gives, for each line that a
chunk could begin the block with, the line it leaves at and the chunks on the way. These maps compose;
blocks are composed FAN at a time, and the way from line 0 is read back down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassabon.workers import sent_whole

sent_whole(__name__)

#: Lines of a block at least; a block has as many as a chunk may have, too.
BLOCK = 1 << 19
#: Blocks composed at a time.
FAN = 32


def breaks(sizes: np.ndarray, own: int, most_requests: int, most_bytes: int) -> np.ndarray:
    """For each of the first ``own`` lines, where a chunk that begins there ends; ``sizes`` goes on past them as far as a chunk may."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(own)
    fits = np.searchsorted(before, before[:own] + most_bytes, side="right") - 1
    return np.minimum(np.clip(fits, at + 1, at + most_requests), len(sizes))


def ways(nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line of a block: the first break outside of it, and how many chunks begin on the way."""
    own = len(nexts)
    to, n = nexts.copy(), np.ones(own, np.int64)
    while True:
        i = np.flatnonzero(to < own)
        if not len(i):
            return to, n
        n[i] += n[to[i]]
        to[i] = to[to[i]]


def request_chunks(lines: DataFrame, text: str, order: str, most_requests: int = 45_000, most_bytes: int = 180 * 1024 * 1024, block: int = BLOCK) -> DataFrame:
    """``lines`` with ``chunk`` (from 0), as one greedy pass in the order of ``order`` (whole numbers from 0 without gaps) cuts them.

    A line's size is that of ``text`` and a line feed; a line above the budget is a chunk by itself.
    """
    block = max(block, most_requests)
    sized = lines.select(F.col(order).cast("long").alias("n"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"))
    own = F.floor(F.col("n") / block).cast("long")
    # The first lines of a block are seen by the block before as well: chunks that begin there may end here.
    near = F.when((F.col("n") % block < most_requests) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = sized.select(F.explode(near).alias("block"), "n", "size")

    def ahead(rows: pd.DataFrame) -> tuple[int, np.ndarray]:
        rows = rows.sort_values("n")
        lines_here = int((rows["n"].to_numpy() < (int(rows["block"].iloc[0]) + 1) * block).sum())
        return lines_here, breaks(rows["size"].to_numpy(), lines_here, most_requests, most_bytes)

    def mapped(rows: pd.DataFrame) -> pd.DataFrame:
        count, nexts = ahead(rows)
        to, n = ways(nexts)
        first = min(count, most_requests)
        # One entry more: the chunk before may end with the last line of all.
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "to": [np.append(np.maximum(to[:first] - count, 0), 0)], "n": [np.append(n[:first], 0)]})

    maps = dealt.groupBy("block").applyInPandas(mapped, "block long, to array<long>, n array<long>")
    most = sized.agg(F.max("n")).first()[0]
    begun = _entries(maps, 0 if most is None else most // block + 1)

    def cut(key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        count, nexts = ahead(rows)
        at, starts = int(entry["entry"].iloc[0]), []
        while at < count:
            starts.append(at)
            at = int(nexts[at])
        place = np.searchsorted(np.array(starts, np.int64), np.arange(count), side="right")
        return pd.DataFrame({"n": key[0] * block + np.arange(count), "chunk": int(entry["before"].iloc[0]) + place - 1})

    placed = dealt.groupBy("block").cogroup(begun.groupBy("block")).applyInPandas(cut, "n long, chunk long")
    return lines.join(placed.withColumnRenamed("n", order), order)


def _entries(maps: DataFrame, blocks: int) -> DataFrame:
    """(block, entry, before) of every block: where the way from line 0 enters it, and the chunks that begin before."""

    def follow(rows: pd.DataFrame, entry: int, before: int) -> pd.DataFrame:
        out = []
        for block, to, n in rows.sort_values("block")[["block", "to", "n"]].itertuples(index=False):
            out.append((block, entry, before))
            entry, before = int(to[entry]), before + int(n[entry])
        return pd.DataFrame(out, columns=["block", "entry", "before"])

    shape = "block long, entry long, before long"
    if blocks <= FAN:
        return maps.groupBy((F.col("block") * 0).alias("all")).applyInPandas(lambda rows: follow(rows, 0, 0), shape)

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        to, n = np.array(rows["to"].iloc[0]), np.array(rows["n"].iloc[0])
        for then, more in rows[["to", "n"]].iloc[1:].itertuples(index=False):
            n, to = n + np.array(more)[to], np.array(then)[to]
        return pd.DataFrame({"block": [int(rows["block"].iloc[0]) // FAN], "to": [to], "n": [n]})

    above = F.floor(F.col("block") / FAN).cast("long").alias("above")
    composed = maps.groupBy(above).applyInPandas(compose, "block long, to array<long>, n array<long>")
    known = _entries(composed, (blocks + FAN - 1) // FAN)
    return maps.groupBy(above).cogroup(known.groupBy("block")).applyInPandas(lambda rows, e: follow(rows, int(e["entry"].iloc[0]), int(e["before"].iloc[0])), shape)


def part_name(chunk: Column) -> Column:
    """part001, part002, ... of chunks from 0."""
    return F.concat(F.lit("part"), F.when(chunk < 999, F.lpad((chunk + 1).cast("string"), 3, "0")).otherwise((chunk + 1).cast("string")))


def manifest(chunks: DataFrame, text: str, stem: str = "canonical") -> DataFrame:
    """(part, request_file, map_file, output_file, requests, bytes) of each chunk."""
    sizes = chunks.groupBy(part_name(F.col("chunk")).alias("part")).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("bytes"))
    file = lambda kind, end: F.concat(F.lit(f"{stem}_{kind}."), F.col("part"), F.lit(end))
    return sizes.select("part", file("requests", ".jsonl").alias("request_file"), file("requests", ".map.json").alias("map_file"), file("output", ".jsonl").alias("output_file"), "requests", "bytes")


def id_maps(chunks: DataFrame, custom_id: str, value: str, order: str) -> DataFrame:
    """(part, map): what each custom id of a chunk stands for, as a JSON object in the order of its lines. ``value`` is a text, or a map of the names of a request."""
    pair = F.to_json(F.create_map(F.col(custom_id), F.col(value)))
    inner = F.substring(pair, F.lit(2), F.char_length(pair) - 2)
    return chunks.groupBy(part_name(F.col("chunk")).alias("part")).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), inner.alias("p")))), lambda x: x["p"]), ","), F.lit("}")).alias("map"))


def grouped_names(rows: DataFrame, order: str, names_per_request: int) -> DataFrame:
    """Requests of one or several names: (n, custom_id, names as (id, name), stands_for as JSON text). ``rows`` has ``order`` from 0 without gaps, name_search and sample_name."""
    if names_per_request <= 1:
        one = F.array(F.struct(F.lit("i0").alias("id"), F.col("sample_name").alias("name")))
        return rows.select(F.col(order).alias("n"), F.concat(F.lit("n"), F.col(order).cast("string")).alias("custom_id"), one.alias("names"), F.to_json(F.array("name_search")).substr(F.lit(2), F.char_length(F.to_json(F.array("name_search"))) - 2).alias("stands_for"))
    group = F.floor(F.col(order) / names_per_request).cast("long")
    item = F.struct((F.col(order) % names_per_request).cast("int").alias("at"), F.col("sample_name").alias("name"), F.col("name_search").alias("search"))
    got = rows.groupBy(group.alias("n")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # names_per_request at most
    label = lambda x: F.concat(F.lit("i"), x["at"].cast("string"))
    names = F.transform("items", lambda x: F.struct(label(x).alias("id"), x["name"].alias("name")))
    return got.select("n", F.concat(F.lit("g"), F.col("n").cast("string")).alias("custom_id"), names.alias("names"), F.to_json(F.map_from_arrays(F.transform("items", label), F.transform("items", lambda x: x["search"]))).alias("stands_for"))


def write_chunks(chunks: DataFrame, text: str, order: str, path: str) -> None:
    """A folder for each part with one file of its lines in order; a chunk is as large as its budget lets it be."""
    rows = chunks.withColumn("part", part_name(F.col("chunk"))).repartition("part").sortWithinPartitions("part", order)
    rows.select("part", F.col(text).alias("value")).write.partitionBy("part").text(path)
