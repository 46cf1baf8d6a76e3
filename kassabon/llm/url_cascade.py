"""URL filters by Bloom filter cascades, with DataFrame functions only.

The first level of a cascade encodes the listed keys, the second those unlisted keys of the
corpus that pass the first, the third the listed keys that pass the second, and so on until a
level lets nothing false through. For every key of the corpus the parity of the levels passed
is then exact membership, and a lookup joins nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BITS_PER_KEY = 6
HASHES = 3
#: A level may have so many bits (16 MB); a larger list falls back to an equi-join.
MOST_BITS = 1 << 27


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ?, # or the end); both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def places(key: Column, level: int, bits: int, hashes: int = HASHES) -> list[Column]:
    a, b = F.pmod(F.xxhash64(F.lit(level), key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits))
    return [F.pmod(a + b * j, F.lit(bits)) for j in range(hashes)]


@dataclass
class Cascade:
    """Levels of (bits, 64-bit words as a one-value column), or the listed keys where they exceed ``MOST_BITS``."""

    levels: list[tuple[int, Column]]
    keys: DataFrame | None = None

    def passed(self, key: Column) -> Column:
        """How many levels the key passes before the first that rejects it."""
        rejected = []
        for i, (bits, words) in enumerate(self.levels):
            hit = F.lit(True)
            for p in places(key, i, bits):
                word = F.coalesce(F.get(words, F.floor(p / 64).cast("int")), F.lit(0))
                hit = hit & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
            rejected.append(F.when(~hit, F.lit(i)))
        return F.coalesce(*rejected, F.lit(len(self.levels)))

    def flag(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """``df`` with a boolean: whether ``key`` is listed."""
        if self.keys is not None:
            keys = self.keys.select(F.col("key").alias("_k")).distinct().withColumn("_in", F.lit(True))
            return df.join(keys, df[key] == F.col("_k"), "left").withColumn(out, F.coalesce("_in", F.lit(False))).drop("_k", "_in")
        return df.withColumn(out, self.passed(F.col(key)) % 2 == 1)


def cascade(keys: DataFrame, bits_per_key: int = BITS_PER_KEY, most_bits: int = MOST_BITS) -> Cascade:
    """Build from (key, listed), the corpus's distinct keys and the list together.

    Null keys are nobody's. Each level's bits are made by an aggregation to 64-bit words; its
    size follows the keys it encodes.
    """
    keys = keys.filter("key is not null")
    levels: list[tuple[int, Column]] = []
    made = Cascade(levels)
    while True:
        mine = keys.filter(F.col("listed") if len(levels) % 2 == 0 else ~F.col("listed")).filter(made.passed(F.col("key")) == len(levels))
        n = mine.count()
        if n == 0:
            return made
        bits = 64 * max(1, -(-n * bits_per_key // 64))
        if bits > most_bits:
            return Cascade([], keys.filter("listed"))
        spots = mine.select(F.explode(F.array(*places(F.col("key"), len(levels), bits))).alias("p"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
        words = spots.groupBy(F.floor(F.col("p") / 64).alias("i")).agg(F.bit_or(one).alias("w"))
        dense = keys.sparkSession.range(bits // 64).select(F.col("id").alias("i")).join(words, "i", "left")
        dense = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0)).alias("w")))), lambda x: x["w"]).alias("ws"))
        levels.append((bits, cut(dense).scalar()))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    A rule fits its host and all subdomains where the path starts with its path; the longest
    wins, then the longer host. Keys are every (host suffix, path prefix) that a rule's path
    length allows; block and allow lists have a cascade each over all keys of the corpus. A url
    that no listed key fits is allowed; so are null urls and urls without ://, whose parts are
    empty. Repeated rows are judged alike.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")).withColumn("rid", F.monotonically_increasing_id())
    rows = cut(rows)
    lengths = sorted({len(p) for _, _, p in rules})
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("p")) for n in lengths]), lambda x: F.char_length(x["p"]) == x["n"])
    options = rows.withColumn("tail", F.explode(tails)).withColumn("head", F.explode_outer(heads))
    options = options.select("rid", "page_id", "host", "path", F.char_length("tail").alias("n_host"), F.concat("tail", F.col("head.p")).alias("key"))
    listed = spark.createDataFrame([(h + p, v) for v, h, p in rules], T.StructType([T.StructField("key", T.StringType()), T.StructField("v", T.StringType())]))
    universe = options.select("key", F.lit(None).cast("string").alias("v")).unionByName(listed)
    universe = cut(universe.filter("key is not null").groupBy("key").agg(F.coalesce(F.bool_or(F.col("v") == "block"), F.lit(False)).alias("block"), F.coalesce(F.bool_or(F.col("v") == "allow"), F.lit(False)).alias("allow")))
    for kind in ("block", "allow"):
        made = cascade(universe.select("key", F.col(kind).alias("listed")))
        options = made.flag(options, "key", kind).withColumn(kind, F.coalesce(kind, F.lit(False)))
    fit = F.struct(F.char_length("key").alias("n"), "n_host", "key", "block")
    best = options.groupBy("rid", "page_id", "host", "path").agg(F.max(F.when(F.col("block") | F.col("allow"), fit)).alias("best"))
    verdict = F.when(F.col("best.block"), "block").otherwise("allow")
    return best.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
