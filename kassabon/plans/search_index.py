"""A kept index of search names by trigram, and candidates found by the rarest trigrams of each word.

A name can only be similar to a word if it holds a share of the word's distinct trigrams. So it holds at
least one of any so many of them that the rest is below that share: the rarest of them are looked up, and
all others of the word aren't. A name in which the word stands whole holds every trigram inside the word:
the rarest of these is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassabon.functions.trigram import LEAST_SIMILAR, best_extent, trigrams
from kassabon.sources.keyed_table import KeyedTable

SCHEMA = T.StructType([T.StructField("t", T.StringType()), T.StructField("name_search", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("used", T.BooleanType())])


def name_index(names: DataFrame) -> DataFrame:
    """(t, name_search, size) of each distinct trigram of (name_search), with how many the name has."""
    own = F.array_distinct(trigrams(F.col("name_search")))
    return names.select("name_search", F.size(own).alias("size"), F.explode(own).alias("t")).select("t", "name_search", "size")


def probes(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, t, need, longest): the trigrams of (word) to look up, from the number of names (t, names) that hold each.

    ``need`` trigrams have to be in a similar name; it is null for the trigram by which a name that holds the whole word is found.
    """
    own = F.array_distinct(trigrams(F.col("word")))
    spread = words.select("word", F.size(own).alias("m"), F.explode(own).alias("t")).join(counts, "t", "left")
    order = F.struct(F.coalesce("names", F.lit(0)).alias("names"), "t")
    rare = spread.groupBy("word", "m").agg(F.array_sort(F.collect_list(order)).alias("all"))  # a word's trigrams
    need = F.ceil(F.lit(LEAST_SIMILAR) * F.col("m")).cast("int")
    some = F.transform(F.slice("all", 1, F.col("m") - need + 1), lambda x: x["t"])
    inner = F.filter(F.transform("all", lambda x: x["t"]), lambda t: ~t.contains(" "))
    # Without a trigram inside, as in single letters with blanks between them, any of the word's may be the one in common.
    whole = F.when(F.char_length("word") < 3, F.array().cast("array<string>")).when(F.size(inner) > 0, F.slice(inner, 1, 1)).otherwise(F.transform("all", lambda x: x["t"]))
    both = rare.select("word", F.explode(F.concat(F.transform(some, lambda t: F.struct(t.alias("t"), need.alias("need"))), F.transform(whole, lambda t: F.struct(t.alias("t"), F.lit(None).cast("int").alias("need"))))).alias("p"))
    return both.select("word", "p.t", "p.need")


def met(looked_up: DataFrame, index: DataFrame) -> DataFrame:
    """(word, name_search) pairs that a probe brings together and that lengths allow, each once."""
    fits = F.coalesce(F.col("size") >= F.col("need"), F.char_length("name_search") >= F.char_length("word"))
    return looked_up.join(index, "t").filter(fits).select("word", "name_search").distinct()


def similar(pairs: DataFrame) -> DataFrame:
    """The pairs that count: the word stands in the name, or a run of the name is similar to it."""
    own, name = F.array_distinct(trigrams(F.col("word"))), trigrams(F.col("name_search"))
    shared = F.size(F.array_intersect(own, name))
    near = F.when(shared >= LEAST_SIMILAR * F.size(own), best_extent(own, name) >= LEAST_SIMILAR).otherwise(False)
    return pairs.filter(((F.char_length("word") >= 3) & F.col("name_search").contains(F.col("word"))) | near)


class NameIndex:
    """The index of a folder: rows of trigram and name in buckets by trigram. A search reads the buckets of its probes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.table = KeyedTable(spark, path, SCHEMA, ["t", "name_search"], buckets, by=["t"])

    def refresh(self, products: DataFrame) -> list[int]:
        """Take in the names that products gained, and mark those that none has any more; gives the buckets that were written."""
        now = name_index(products.select("name_search").filter("name_search is not null").distinct()).withColumn("used", F.lit(True))
        gone = self.table.missing(now).filter("used").withColumn("used", F.lit(False))
        return self.table.upsert(now.unionByName(gone))

    def candidates(self, asked: DataFrame) -> DataFrame:
        """(query_id, name_search) of prepared queries (query_id, qtok), as ``search.candidates`` finds them."""
        spread = asked.select("query_id", F.explode("qtok").alias("word"))
        words = spread.select("word").distinct()
        own = words.select(F.explode(F.array_distinct(trigrams(F.col("word")))).alias("t"))
        wanted = self._rows(own)
        counts = wanted.groupBy("t").agg(F.count(F.lit(1)).alias("names"))
        pairs = similar(met(probes(words, counts), wanted))
        return spread.join(pairs, "word").select("query_id", "name_search").distinct()

    def _rows(self, grams: DataFrame) -> DataFrame:
        place: Column = self.table.bucket_of("t")
        buckets = sorted(r[0] for r in grams.select(place.alias("b")).distinct().collect())  # at most the number of buckets
        return self.table.read(buckets=buckets).filter("used").drop("used")
