"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A text is the multiset of its paragraphs (lines). Each paragraph adds a wide vector: eight
32-bit lanes of four hashes of the paragraph, and for each of its three-word shingles one of
two to 64 one-bit lanes. Lanes are summed modulo powers of two, so the fingerprint does not
depend on the order of paragraphs, and one is inserted or deleted by adding or subtracting its
own vector. Equality rests on the hash lanes; a difference of the one-bit lanes, read as signs,
has as its mean square the number of shingles in which two texts differ, hence the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hexed, stored, unique_ids

SEEDS = (11, 23, 37, 53)
PAIRS = 32
LOW = 0xFFFFFFFF
BOTH = (1 << 32) | 1


def vectors(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, hashes (8 longs), signs (64 longs) and total for each row of ``texts``; keys tell rows apart."""
    lines = texts.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("para"))
    parts = lines.select(*keys, "para", F.split("para", r"[\x20\x09-\x0D]+").alias("ws"))
    parts = parts.select(*keys, "para", "ws", F.posexplode("ws").alias("pos", "w0"))
    h = F.xxhash64("w0", F.get("ws", F.col("pos") + 1), F.get("ws", F.col("pos") + 2))
    parts = parts.select(*keys, "pos", "para", h.alias("h"))
    sums = []
    for i, seed in enumerate(SEEDS):
        own = F.when(F.col("pos") == 0, F.xxhash64(F.lit(seed), "para")).otherwise(F.lit(0))
        sums += [F.sum(own.bitwiseAND(F.lit(LOW))).alias(f"e{2 * i}"), F.sum(F.shiftrightunsigned(own, 32)).alias(f"e{2 * i + 1}")]
    sums += [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(BOTH))).alias(f"l{i}") for i in range(PAIRS)]
    got = parts.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("total"))
    hashes = F.array(*[F.col(f"e{i}").bitwiseAND(F.lit(LOW)) for i in range(2 * len(SEEDS))])
    signs = [F.col(f"l{i}").bitwiseAND(F.lit(LOW)) for i in range(PAIRS)] + [F.shiftrightunsigned(F.col(f"l{i}"), 32) for i in range(PAIRS)]
    return got.select(*keys, hashes.alias("hashes"), F.array(*signs).alias("signs"), "total")


def fingerprint(hashes: Column, signs: Column, total: Column) -> Column:
    """The lanes as hexadecimal text: hash lanes modulo 2^32, sign lanes modulo 2^16, the count modulo 2^32."""
    parts = F.concat(F.transform(hashes, lambda x: hexed(x, 8)), F.transform(signs, lambda x: hexed(x.bitwiseAND(F.lit(0xFFFF)), 4)))
    return F.concat(F.array_join(parts, ""), hexed(total.bitwiseAND(F.lit(LOW)), 8))


def likeness(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """1 for equal hash lanes, else 1 less the estimated share of shingles that are not in both; 0 to 1.

    Taken from the lanes as the fingerprint keeps them: differences of sign lanes modulo 2^16,
    of counts modulo 2^32, each read as the nearest to 0.
    """
    (h1, s1, n1), (h2, s2, n2) = a, b
    near = lambda x, bits: F.pmod(x + F.lit(1 << (bits - 1)), F.lit(1 << bits)) - F.lit(1 << (bits - 1))
    more = near(n1 - n2, 32)
    gap = F.aggregate(F.zip_with(s1, s2, lambda x, y: F.pow(2 * near(x - y, 16) - more, F.lit(2.0))), F.lit(0.0), lambda t, x: t + x)
    apart = gap / F.lit(2.0 * PAIRS) / (n1.bitwiseAND(F.lit(LOW)) + n2.bitwiseAND(F.lit(LOW)))
    return F.when(h1 == h2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; null text counts as empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    got = vectors(rows, ["rid", "doc_id"], "text")
    return got.select("doc_id", fingerprint(F.col("hashes"), F.col("signs"), F.col("total")).alias("fingerprint"))


def starts(ids: DataFrame, ranges: int) -> list:
    """First id of each of at most ``ranges`` ranges of about as many ids: a bounded list, whatever the size of ``ids``."""
    dealt = ids.repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in dealt.collect())


def place(value: Column, firsts: list, kind) -> tuple[Column, Column]:
    """The range of an id, found by halving, and whether it is the first of it."""
    known = F.array(*[F.lit(x).cast(kind) for x in firsts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(firsts).bit_length())))])
    at = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(known, lo + step) <= value, lo + step).otherwise(lo))
    return at, F.get(known, at) == value


def followed(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text) with the text of the next larger id, after the last one the first: next_text.

    Ids are distinct and not null. Texts are dealt by range of id, once; the first of each range
    also goes to the range before, where it closes the row.
    """
    spark = texts.sparkSession
    firsts = starts(texts.select("doc_id"), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not firsts:
        return texts.withColumn("range", F.lit(0)).withColumn("next_text", F.col("text"))
    at, is_first = place(F.col("doc_id"), firsts, texts.schema["doc_id"].dataType)
    spot = lambda at, closes: F.struct(at.cast("int").alias("range"), F.lit(closes).alias("closes"))
    before = F.pmod(F.col("at") - 1, F.lit(len(firsts)))
    own = texts.withColumn("at", at).withColumn("first", is_first)
    own = own.withColumn("spot", F.explode(F.when(F.col("first"), F.array(spot(F.col("at"), False), spot(before, True))).otherwise(F.array(spot(F.col("at"), False)))))
    order = Window.partitionBy("range").orderBy("closes", "doc_id")
    own = own.select("doc_id", "text", "spot.range", "spot.closes").withColumn("next_text", F.lead("text").over(order))
    return own.filter("not closes").drop("closes")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Edited: the last quarter of the code points (rounded down) gives way to the first as many of
    the next document by doc_id, after the last one the first. Null text is empty. Rows that
    repeat an id share their successor; where the successor's id repeats, its smallest text
    counts. Rows without an id have no successor, and likeness 0 to it. No likeness is outside 0 to 1.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if unique_ids(own):
        rows, keys = followed(own), ["range", "doc_id"]
    else:
        nexts = followed(own.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))).select("doc_id", "next_text")
        rows = stored(own.withColumn("rid", F.monotonically_increasing_id()))
        rows, keys = rows.join(nexts, "doc_id", "left"), ["rid", "doc_id"]
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    q = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.col("text").substr(F.lit(1), (F.col("n_chars") - q).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.coalesce(F.col("next_text").substr(F.lit(1), q), F.lit(""))))
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    keys = [*keys, "n_chars", "edited_sha256"]
    side = lambda i, body: F.struct(F.lit(i).alias("side"), F.col(body).alias("body"))
    sides = rows.select(*keys, F.inline(F.array(side(0, "text"), side(1, "edited"), side(2, "next_text")))).filter("body is not null")
    # dealt by range (or id) already, so that neither aggregation moves rows
    got = vectors(sides, [*keys, "side"], "body")
    lanes = F.struct("hashes", "signs", "total")
    got = got.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == i, lanes)).alias(name) for i, name in enumerate("abc")])
    of = lambda s: (F.col(f"{s}.hashes"), F.col(f"{s}.signs"), F.col(f"{s}.total"))
    return got.select("doc_id", "n_chars", "edited_sha256", fingerprint(*of("a")).alias("fingerprint"), fingerprint(*of("b")).alias("edited_fingerprint"), likeness(of("a"), of("b")).alias("near_edited"), F.coalesce(likeness(of("a"), of("c")), F.lit(0.0)).alias("near_next"))
