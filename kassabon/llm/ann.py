"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled by the largest norm of their norm range and given one more coordinate that
makes them unit vectors, so that the nearest unit vector has the largest inner product. Each
table applies pseudo-rotations (random signs, then a fast Hadamard transform, three times) and
hashes a vector to its nearest signed axis. A query looks into its nearest axes of every table;
what it meets there is ranked by inner product in double precision.

Every length is hashed, whatever its number of vectors. A query that met fewer than REACH classes for
each place of its list is searched in full, block by block: there is too little in reach of it to choose from.

Equal vectors form one class, hashed once. A class brings at most its K + 1 smallest ids: no
other can be among K neighbours. Buckets are split by hash into parts of bounded size, each of
which every query of the bucket visits, so no task holds a whole popular bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, stored

K = 20
TABLES = 16
#: Axes that a query looks into in each table.
PROBES = 16
#: Classes that a query has to meet for each place of its list.
REACH = 8
#: Classes in one part of a bucket, or in one block of a full search, roughly.
PART = 2_000
SEED = 97
#: Groups of table buckets, the unit of work of a task.
GROUPS = 512


def rotations(dim: int, tables: int, seed: int) -> np.ndarray:
    """(tables, 3, dim) random signs."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(unit: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes) nearest signed axes after three pseudo-rotations, nearest first: 2 * axis, plus 1 if negative."""
    y = unit
    for s in signs:
        y = hadamard(y * s)
    size = np.abs(y)
    if probes == 1:
        best = size.argmax(1)[:, None]
    else:
        probes = min(probes, y.shape[1])
        best = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
    return 2 * best + (np.take_along_axis(y, best, 1) < 0)


def padded(vectors: np.ndarray, scale: np.ndarray, dim: int, query: bool) -> np.ndarray:
    """Unit vectors of ``dim`` coordinates: data scaled below 1 and completed, queries normalised."""
    out = np.zeros((len(vectors), dim))
    norms = np.linalg.norm(vectors, axis=1)
    with np.errstate(over="ignore"):
        out[:, : vectors.shape[1]] = vectors / (norms if query else scale)[:, None]
    if not query:
        out[:, vectors.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (out[:, : vectors.shape[1]] ** 2).sum(1)))
    return out


def classes(vectors: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(class, vector, ids, norm range, norm) of distinct usable vectors, and (vec_id, class) of all rows.

    Null, zero and non-finite vectors, vectors with null components and rows without an id are
    out. ids: the k + 1 smallest of the class, gathered in two steps so that no group of copies
    meets in one task before it is cut.
    """
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    v = v.filter(~F.coalesce(bad, F.lit(True))).filter(F.exists("v", lambda x: x != 0))
    v = v.withColumn("class", F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(SEED)).alias("b")))
    few = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    part = v.groupBy("class", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("part")).agg(F.first("v").alias("v"), few(F.collect_set("vec_id")).alias("ids"))
    made = part.groupBy("class").agg(F.first("v").alias("v"), few(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    made = made.withColumn("norm", norm).withColumn("band", F.round(F.log2("norm")).cast("int"))
    return made, v.select("vec_id", "class")


def search(vectors: DataFrame, is_query, k: int = K, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for every row that ``is_query`` (a condition on vec_id) picks.

    A query is no neighbour of itself; equal scores go to the smaller id; a query with fewer
    candidates gets fewer rows. Vectors of another length than a query's never meet it. Repeated
    ids with equal vectors count once.
    """
    ship(vectors.sparkSession)
    made, members = classes(vectors, k)
    made = stored(made)
    asked = cut(members.filter(is_query).distinct())
    # powers of two bound the ranges of norm: a row for each (length, range) in use
    bands = made.groupBy(F.size("v").alias("length"), "band").agg(F.max("norm").alias("scale"), F.count(F.lit(1)).alias("n")).collect()
    scale = {(r["length"], r["band"]): r["scale"] for r in bands}
    count = Counter()
    for r in bands:
        count[r["length"]] += r["n"]
    lengths: dict[int, list[int]] = {}
    for length, band in sorted(scale):
        lengths.setdefault(length, []).append(band)

    def hashed(query: bool):
        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for length, own in batch.groupby(batch["v"].map(len)):
                    x = np.stack(own["v"].to_list()).astype(np.float64)
                    dim = 1 << int(length).bit_length()  # room for one more coordinate
                    s = np.array([scale[(length, b)] for b in own["band"]])
                    unit = padded(x, s, dim, query)
                    for t, signs in enumerate(rotations(dim, tables, seed)):
                        spots = axes(unit, signs, probes if query else 1)
                        for j in range(spots.shape[1]):
                            frame = own[["a", "b", "v", "ids"]].assign(length=np.int32(length), axis=spots[:, j].astype(np.int32), at=np.int32(t))
                            if not query:
                                yield frame.assign(band=own["band"].astype(np.int32))
                            for band in lengths[length] if query else ():
                                yield frame.assign(band=np.int32(band))

        return emit

    flat = made.select("class.a", "class.b", "v", "ids", "band")
    shape = "a long, b long, v array<double>, ids array<long>, length int, axis int, at int, band int"
    bucket = ["length", "band", "at", "axis"]
    base = flat.mapInPandas(hashed(False), shape)
    sizes = cut(base.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    sizes = F.broadcast(sizes)  # at most a row for each axis of each table and norm range
    base = base.join(sizes, bucket).withColumn("part", F.pmod(F.col("a"), F.col("parts")).cast("int"))
    wanted = made.join(asked.select("class").distinct(), "class", "left_semi")
    questions = wanted.select("class.a", "class.b", "v", "ids", "band").mapInPandas(hashed(True), shape)
    questions = questions.join(sizes, bucket).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["group", *bucket, "part", "a", "b", "v", "ids"]

    def ranked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        spots, found = [*bucket, "part"], []
        theirs = dict(tuple(right.groupby(spots)))
        for spot, mine in left.groupby(spots):
            if spot not in theirs:
                continue
            data = theirs[spot]
            q, c = np.stack(mine["v"].to_list()), np.stack(data["v"].to_list())
            firsts = np.array([i[0] for i in data["ids"]])
            for i, row in enumerate(q):
                top = np.arange(len(c))
                if len(c) > k + 1:  # all that tie with the last one stay in
                    rough = c @ row
                    least = np.partition(rough, -(k + 1))[-(k + 1)]
                    top = np.flatnonzero(rough >= least - 1e-9 * (1 + abs(least)))
                exact = (row[None] * c[top]).sum(1)
                best = np.lexsort((firsts[top], -exact))[: k + 1]
                found.append((np.full(len(best), mine["a"].iat[i]), np.full(len(best), mine["b"].iat[i]), data["a"].to_numpy()[top[best]], data["b"].to_numpy()[top[best]], exact[best], data["ids"].to_numpy()[top[best]]))
        none = [np.zeros(0, t) for t in ("i8", "i8", "i8", "i8", "f8", "O")]
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else none
        return pd.DataFrame(dict(zip(("qa", "qb", "a", "b", "score", "ids"), parts, strict=True)))

    def met(questions: DataFrame, base: DataFrame, groups: int) -> DataFrame:
        """The k + 1 best classes that each class of queries meets in the same part of a bucket."""
        group = F.pmod(F.xxhash64(*bucket, "part"), F.lit(groups)).cast("int")
        left = questions.withColumn("group", group).select(*columns).groupBy("group")
        right = base.withColumn("group", group).select(*columns).groupBy("group")
        hits = left.cogroup(right).applyInPandas(ranked, "qa long, qb long, a long, b long, score double, ids array<long>")
        hits = hits.groupBy("qa", "qb", "a", "b").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
        order = Window.partitionBy("qa", "qb").orderBy(F.desc("score"), F.col("ids")[0])
        hits = hits.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("qa", "qb")))
        return hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).drop("r")

    hits = cut(met(questions, base, GROUPS))
    # queries that met too few meet all classes of their length, block by block
    had = hits.groupBy(F.col("qa").alias("a"), F.col("qb").alias("b")).agg(F.first("met").alias("had"))
    short = wanted.select("class.a", "class.b", "v", "ids", F.size("v").alias("length")).join(had, ["a", "b"], "left")
    short = cut(short.filter(F.coalesce("had", F.lit(0)) < REACH * (k + 1)).drop("had"))
    asks = {r["length"]: -(-r["n"] // PART) for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if asks:
        blocks = made.sparkSession.createDataFrame([(x, n, -(-count[x] // PART)) for x, n in asks.items()], "length int, asks int, parts int")
        blocks = F.broadcast(blocks)  # a row for each length
        spot = lambda df: df.join(blocks, "length").withColumns({"band": F.lit(0), "at": F.lit(-1)})
        asking = spot(short).withColumn("axis", F.pmod("a", "asks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        every = spot(flat.drop("band").withColumn("length", F.size("v"))).withColumn("part", F.pmod("a", "parts").cast("int")).withColumn("axis", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        full = met(asking, every, max(GROUPS, sum(n * -(-count[x] // PART) for x, n in asks.items())))
        hits = full.unionByName(hits.join(short.select(F.col("a").alias("qa"), F.col("b").alias("qb")), ["qa", "qb"], "left_anti"))
    hits = hits.select("qa", "qb", "score", F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("qa", "qb").orderBy(F.desc("score"), "vec_id")
    hits = cut(hits.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("class.a").alias("qa"), F.col("class.b").alias("qb"))
    pairs = asked.join(hits, ["qa", "qb"])
    # queries of a class share a list of k + 1 from which each drops itself; what comes after moves up
    own = pairs.filter("query_id = vec_id").select("query_id", F.col("r").alias("own"))
    pairs = pairs.filter("query_id <> vec_id").join(own, "query_id", "left")
    rank = F.col("r") - F.when(F.col("own") < F.col("r"), 1).otherwise(0)
    return pairs.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
