"""Mixing sources to target weights, with DataFrame functions only.

Documents of a source are laid end to end and cut into blocks of a fixed number of words.
Output shards of a fixed number of slots draw a source for each slot, so that the counts of a
shard are a multinomial sample of the targets. The k-th slot of a source takes the block at
position k of that source's pseudorandom permutation; further epochs use further permutations.
What a source's target lacks to a whole block is taken from the front of the block that is next.
Slots and blocks meet in an equi-join on (source, block index), which no hot source can skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, running, small

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 64
SHARD = 4096
MOST = 3.0
ROUNDS = 20
SEED = 20240607


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, sidx, source_size, target): the total shared by weight, no target above ``most`` times its size.

    Sources stand in code-point order, null last, and take the weights in turn. Resharing the
    excess until nobody is above has one fixed point: with sources in order of cap by weight,
    the first one that stays below its cap settles the common level. Empty input gives no rows.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("sidx", (F.row_number().over(order) - 1).cast("long"))
    by = by.withColumn("w", F.element_at(given, (F.col("sidx") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    first = Window.orderBy(F.col("cap") / F.col("w"), "sidx")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    by = by.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = F.col("left") / F.col("left_w")
    by = by.withColumn("level", F.when(F.col("cap") >= F.col("w") * level, level))
    by = by.withColumn("place", F.row_number().over(first))
    by = by.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("place"))).over(everything))
    return by.select("source", "sidx", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def permuted(k: Column, n: Column, *salt: Column) -> Column:
    """Position of k (0 <= k < n) under a pseudorandom permutation of n things: a swap-or-not shuffle.

    Each round pairs x with (key - x) mod n and swaps the two where a hash of the larger says so,
    which is a bijection for every n.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *salt), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), r, *salt), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k, step)


def assignment(sources: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, sidx, block): which block of which source each slot of each output shard takes.

    ``sources`` has sidx, blocks and slots (how many blocks the source has and should give).
    A source that was drawn too often drops its last draws; one drawn too rarely gets the rest
    in a last shard, so that totals are exact.
    """
    spark = sources.sparkSession
    every = Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, -1)
    sources = cut(sources.filter("slots > 0").withColumn("lo", F.coalesce(F.sum("slots").over(every), F.lit(0)).cast("long")))
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).cast("long")).first()[0]
    bin_width = max(1, -(-total // 4096))
    hi = F.col("lo") + F.col("slots")
    bins = sources.select("sidx", "lo", hi.alias("hi"), F.explode(F.sequence(F.floor(F.col("lo") / bin_width), F.floor((hi - 1) / bin_width))).alias("bin"))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("x"))
    slots = slots.withColumn("bin", F.floor(F.col("x") / bin_width))
    drawn = slots.join(bins, "bin").filter("x >= lo and x < hi")
    counts = drawn.groupBy(F.floor(F.col("slot") / shard).alias("shard"), "sidx").agg(F.count(F.lit(1)).alias("n"))
    counts = running(cut(counts), ["sidx"], "shard", "n", "k0")
    drawn_of = counts.groupBy("sidx").agg(F.sum("n").alias("drawn"))
    own = sources.select("sidx", "blocks", "slots")
    short = own.join(drawn_of, "sidx", "left").withColumn("k0", F.coalesce("drawn", F.lit(0)))
    short = short.select(F.lit(-(-total // shard)).cast("long").alias("shard"), "sidx", (F.col("slots") - F.col("k0")).alias("n"), "k0")
    parts = counts.select("shard", "sidx", "n", "k0").unionByName(short.filter("n > 0"))
    parts = parts.join(own, "sidx").withColumn("k1", F.least(F.col("k0") + F.col("n"), "slots")).filter("k1 > k0")
    # a few rows that become many: dealt out first, by a number that adaptive execution doesn't lower
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "sidx")
    parts = parts.withColumn("k", F.explode(F.sequence("k0", F.col("k1") - 1)))
    epoch = F.floor(F.col("k") / F.col("blocks"))
    return parts.select("shard", "sidx", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("sidx"), epoch, F.lit(seed)).alias("block"))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs``.

    ``taken`` is how many of the row's words the mix holds, repeats counted, at most ``most`` times
    its size. A null text has size 0; null sources form a source of their own; repeated rows are
    separate documents; an empty table gives no rows.
    """
    sizes = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    sizes = cut(sizes.withColumn("rid", F.monotonically_increasing_id()))
    shares = targets(sizes, weights, most)
    blocks = F.ceil(F.col("source_size") / F.lit(float(block)))
    shares = shares.withColumn("blocks", blocks)
    wish = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    shares = cut(shares.withColumn("wish", wish).withColumn("slots", F.floor(wish)))
    few = small(shares.select(F.col("source").alias("s"), "sidx", "source_size", "target"), 100_000)
    sizes = sizes.join(few, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    n_docs = sizes.count()
    buckets = max(1, n_docs // 64)
    laid = sizes.filter("size > 0").select("rid", "doc_id", "sidx", "size", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).alias("bucket"))
    order = Window.partitionBy("sidx", "bucket").orderBy("doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("sidx", "bucket").agg(F.sum("size").alias("n"))
    starts = running(totals, ["sidx"], "bucket", "n", "start").drop("n")
    laid = laid.withColumn("own", F.coalesce(F.sum("size").over(order), F.lit(0))).join(starts, ["sidx", "bucket"])
    laid = laid.select("rid", "sidx", "size", (F.col("start") + F.col("own")).alias("a"))
    end = F.col("a") + F.col("size")
    pieces = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((end - 1) / block))))
    overlap = F.least(end, (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)
    pieces = pieces.select("rid", "sidx", "block", overlap.alias("n"), (F.greatest("a", F.col("block") * block) - F.col("block") * block).alias("off"))
    uses = assignment(shares.select("sidx", "blocks", "slots"), shard, seed).select("sidx", "block", F.lit(1).alias("uses"), F.lit(0).cast("long").alias("front"))
    rest = shares.filter("wish > slots").select("sidx", "blocks", "source_size", F.col("slots").alias("k"), (F.col("wish") - F.col("slots")).alias("part"))
    rest = rest.withColumn("block", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("sidx"), F.floor(F.col("k") / F.col("blocks")), F.lit(seed)))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    uses = uses.unionByName(rest.select("sidx", "block", F.lit(0).alias("uses"), F.round(F.col("part") * length).cast("long").alias("front")))
    uses = uses.groupBy("sidx", "block").agg(F.sum("uses").alias("uses"), F.sum("front").alias("front"))
    own = F.col("n") * F.col("uses") + F.greatest(F.lit(0), F.least(F.col("n"), F.col("front") - F.col("off")))
    taken = pieces.join(uses, ["sidx", "block"]).groupBy("rid").agg(F.sum(own).alias("taken"))
    return sizes.join(taken, "rid", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def resample(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: the whole part of taken/size, the rest by a hash.

    Documents without words are left out: the mix has no words of theirs. Rows repeated whole
    share what the mix takes of them.
    """
    row, times = free_name(docs, "row"), free_name(docs, "times")
    docs = docs.withColumn(row, F.xxhash64("doc_id", "text", "source"))
    got = mix(docs.select(F.col(row).alias("doc_id"), "source", "text"), **how)
    share = F.sum("taken") / F.sum("size")
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    shares = got.filter("size > 0").groupBy("doc_id").agg(share.alias("share"))
    shares = shares.select(F.col("doc_id").alias(row), (F.floor("share") + F.when(part < F.col("share") - F.floor("share"), 1).otherwise(0)).cast("int").alias(times)).filter(F.col(times) > 0)
    return docs.join(shares, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(row, times)
