"""Importance resampling towards a target distribution, over hashed runs of words.

Texts are read as the UTF-8 bytes of Arrow buffers: a table says of each byte whether it belongs to
a word, differences of that give where words begin and end, and the CRC of every run of one to three
words is advanced by a table, one byte for all starts at a time. Corpus and target are counted in
10000 buckets; a document's weight is the sum of its features' gains, and a Gumbel draw from its id
makes the highest scores a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, small_batches, stored

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 3
#: Words that a document needs to be drawn, percent of such documents that are, and the seed of the draw.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Words whose CRCs are advanced together: what stays in a processor's cache.
AT_ONCE = 1 << 17
#: Below so many words left in step, each is finished by itself.
FEW = 16

#: Byte -> its lower case, and whether it belongs to a word.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD = np.zeros(256, bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[0x80:] = True


def crc_table() -> np.ndarray:
    """The state that each byte leads to (the reflected polynomial of CRC-32)."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, np.uint32(0xEDB88320) ^ (state >> np.uint32(1)), state >> np.uint32(1))
    return state.astype(np.uint32)


TABLE = crc_table()
START = np.uint32(0xFFFFFFFF)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts on end, and the offsets of each (nulls are empty)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    got = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return LOWER[got], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each text (one more entry at the end)."""
    step = np.diff(WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    touching = inner[WORD[data[inner - 1]] & WORD[data[inner]]]  # a word ends a text and one begins the next
    if len(touching):
        starts, ends = np.sort(np.concatenate([starts, touching])), np.sort(np.concatenate([ends, touching]))
    return starts, ends, np.searchsorted(starts, offsets)


def advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states carried over ``sizes`` bytes from ``starts``, all of them a byte at a time, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    state, at, ascending = state[order], starts[order], sizes[order][::-1]
    low = state.view(np.uint8)[:: state.itemsize]  # the lowest byte of each state
    longest, t = int(ascending[-1]) if len(sizes) else 0, 0
    left = len(sizes) - np.searchsorted(ascending, np.arange(longest), side="right")
    for n in left.tolist():
        if n <= FEW:
            break
        moved = TABLE.take(low[:n] ^ data.take(at[:n]))
        np.right_shift(state[:n], np.uint32(8), out=state[:n])
        state[:n] ^= moved
        at[:n] += 1
        t += 1
    for i in range(int(left[t]) if t < longest else 0):
        rest = data[at[i] : starts[order[i]] + sizes[order[i]]]
        state[i] = zlib.crc32(rest, int(state[i] ^ START)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from word, to word, buckets) of blocks of words: buckets[n, i] is that of the run of n + 1 words that ends there, -1 where the text has no such run."""
    place = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))  # of a word in its text
    before = [np.full(1, START) for _ in range(RUN)]  # states at the end of the last word of the block before
    space = np.uint8(ord(" "))
    for a in range(0, len(starts), AT_ONCE):
        b = min(a + AT_ONCE, len(starts))
        out = np.full((RUN, b - a), -1, np.int64)
        state = np.full(b - a, START)
        for n in range(RUN):
            if n:
                last = np.concatenate([before[n - 1], state])
                before[n - 1], last = last[-1:], last[:-1]
                state = TABLE[(last & np.uint32(255)).astype(np.uint8) ^ space] ^ (last >> np.uint32(8))
            state = advanced(state, data, starts[a:b], ends[a:b] - starts[a:b])
            there = place[a:b] >= n
            out[n, there] = (state[there] ^ START) % np.uint32(BUCKETS)
        yield a, b, out


def counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. A task gives at most BUCKETS rows, and so does the sum."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for _, _, found in features(data, *words(data, offsets)):
                total += np.bincount(found[found >= 0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    with small_batches(df.sparkSession):
        rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    got = np.zeros(BUCKETS, np.int64)
    for row in rows:
        got[row["bucket"]] = row["n"]
    return got


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    whole, wanted = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A draw that depends on the id alone (a null id counts as empty), in thousandths."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_features, weight and score of each row.

    Null texts, and texts without a word, have no feature and weight 0. Of the columns that ``docs``
    has by these names only the new ones stay.
    """
    ship(docs.sparkSession)
    gain = gains(counts(docs, text), counts(target, text))
    key = free_name(docs, "text_to_weigh")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            starts, ends, first = words(data, offsets)
            sums = np.zeros(len(starts) + 1, np.int64)
            for a, b, found in features(data, starts, ends, first):
                sums[a + 1 : b + 1] = np.where(found >= 0, gain[found], 0).sum(0)
            n, sums = np.diff(first), np.cumsum(sums)
            size = sum(np.maximum(n - i, 0) for i in range(RUN))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(size), pa.array(np.diff(sums[first]))], [*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    own = docs.drop("n_words", "n_features", "weight", "score").withColumn(key, F.col(text).cast("string"))
    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    got = own.mapInArrow(summed, f"{told}, n_words long, n_features long, weight long")
    return got.withColumn("score", F.col("weight") + gumbel(F.col("doc_id")))


def ranked(scores: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scores`` (doc_id, n_words, score and more) with the rank of those drawn, null for the others.

    Of N rows with at least ``least`` words the floor(percent * N / 100) of highest score are drawn;
    ties go to the smaller doc_id, a null one last. Rows are dealt out by ranges of that order and
    written, so that places within a range and the ranges' sizes give the rank without one sorted task.
    """
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = scores.withColumn("may", F.col("n_words") >= least)
    parts = max(2, int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    with small_batches(scores.sparkSession):
        rows = stored(rows)
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("may").alias("may")).orderBy("part").collect()  # a row a range
    take, before, starts = percent * sum(r["may"] for r in sizes) // 100, 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(scores.sparkSession.createDataFrame(starts, "part long, before long"))
    rows = rows.withColumn("part", part).join(offsets, "part", "left")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("rank", F.when(F.col("may") & (rank <= take), rank)).drop("may", "at", "part", "before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that are drawn, with n_words, n_features, weight, score and rank beside their own columns."""
    taken = {"may", "at", "part", "before", "rank"} & {c.lower() for c in docs.columns}
    kept = docs.drop(*taken)
    return ranked(weighed(kept, target), percent, least).filter("rank is not null")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``."""
    got = ranked(stored(weighed(docs.select("doc_id", "text"), target).drop("text")))  # written, for the ranges are drawn from a sample of it
    return got.select("doc_id", "n_features", "weight", "score", "rank")
