"""Canonical keys of product names: the rule baseline, tags from elsewhere, and how they reach products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassabon.functions import text
from kassabon.operators.keyed import one_per_key
from kassabon.sources.sinks import changes, upsert

TRAILING = r"_[0-9]+_plus$"


def baseline(products: DataFrame) -> DataFrame:
    """Rule keys of the distinct search names of available products."""
    rows = products.filter("is_available and name_search <> ''").groupBy("name_search").agg(F.min("name").alias("name"))
    key = text.normalize_canonical_key(text.canonical_key(F.col("name_search")), F.col("name"))
    return rows.select("name_search", key.alias("canonical_key"), text.name_is_organic(F.col("name_search")).alias("is_organic"), F.lit("rule").alias("source"))


def refresh_baseline(tags: DataFrame, products: DataFrame) -> DataFrame:
    """Tags with fresh rule keys; tags that a model or a person set stay."""
    fresh = baseline(products)
    for c in tags.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(tags.schema[c].dataType))
    return upsert(tags, fresh.select(*tags.columns), ["name_search"], when=lambda old: old("source") == "rule")


def seed_tags(tags: DataFrame, given: DataFrame) -> DataFrame:
    """Tags from another catalogue: manual ones stay, confidence doesn't sink."""
    given = one_per_key(given, ["name_search"], [F.col("tagged_at").desc_nulls_last(), F.col("canonical_key")])
    known = tags.select("name_search", F.col("confidence").alias("_known"))
    given = given.join(known, "name_search", "left").withColumn("confidence", F.greatest("confidence", "_known")).select(*tags.columns)
    return upsert(tags, given, ["name_search"], when=lambda old: ~old("source").eqNullSafe(F.lit("manual")))


def recovered_tags(hosted: DataFrame, at: Column) -> DataFrame:
    """Tags that hosted products bear: of each search name the one that was updated last, those never updated after all others, ties by a hash of the row."""
    rows = hosted.filter("name_search <> '' and canonical_key <> ''")
    last = one_per_key(rows, ["name_search"], [F.col("updated_at").desc_nulls_last(), F.xxhash64("canonical_key", "canonical_name", "is_organic")])
    return last.select("name_search", "canonical_key", F.col("canonical_name").alias("display_name"), "is_organic", F.lit(0.9).alias("confidence"), F.lit("ai_batch").alias("source"), F.lit("hosted_public_products_seed").alias("model"), at.alias("tagged_at"))


def applied(products: DataFrame, tags: DataFrame) -> DataFrame:
    """Products with the normalised key, display name and organic flag of their tag; untagged ones as they are."""
    t = tags.select("name_search", F.col("canonical_key").alias("_key"), F.col("display_name").alias("_shown") if "display_name" in tags.columns else F.lit(None).cast("string").alias("_shown"), F.col("is_organic").alias("_organic"), F.lit(True).alias("_tagged"))
    joined = products.join(t, "name_search", "left")
    key = text.normalize_canonical_key(F.col("_key"), F.col("name"))
    shown = text.canonical_display_name(key, F.col("_shown"))
    for c, value in (("canonical_key", key), ("canonical_name", shown), ("is_organic", F.col("_organic"))):
        joined = joined.withColumn(f"_new_{c}", F.when(F.col("_tagged"), value).otherwise(F.col(c)))
    for c in ("canonical_key", "canonical_name", "is_organic"):
        joined = joined.withColumn(c, F.col(f"_new_{c}"))
    return joined.select(*products.columns)


def applied_changes(products: DataFrame, tags: DataFrame) -> DataFrame:
    """Only the products that applying tags changes."""
    return changes(products, applied(products, tags), ["id"], ["canonical_key", "canonical_name", "is_organic"])


def prepass(tags: DataFrame) -> DataFrame:
    """Tags whose key loses a trailing fat percentage where the key without it is in use."""
    shorter = F.regexp_replace("canonical_key", TRAILING, "")
    used = tags.select(F.col("canonical_key").alias("_used")).distinct()
    joined = tags.withColumn("_short", F.when(F.col("canonical_key").rlike(TRAILING), shorter)).join(used, F.col("_short") == F.col("_used"), "left")
    return joined.withColumn("canonical_key", F.coalesce("_used", "canonical_key")).select(*tags.columns)


def untagged_names(products: DataFrame, tags: DataFrame, limit: int | None = None, like: str | None = None, only_untagged: bool = True) -> DataFrame:
    """(name_search, sample_name, n) of names to tag, the commonest first."""
    rows = products.filter("is_available and name_search <> ''")
    if like:
        rows = rows.filter(F.col("name_search").contains(like))
    got = rows.groupBy("name_search").agg(F.min("name").alias("sample_name"), F.count(F.lit(1)).alias("n"))
    if only_untagged:
        done = tags.filter("source <> 'rule'").select("name_search")
        got = got.join(done, "name_search", "left_anti")
    got = got.orderBy(F.desc("n"), "name_search")
    return got if limit is None else got.limit(limit)


def keys_to_recheck(products: DataFrame, words: int = 3, limit: int | None = None) -> DataFrame:
    """Long keys of a single store, and keys with a trailing fat percentage, with up to eight names each."""
    rows = products.filter("is_available and canonical_key <> ''")
    got = rows.groupBy("canonical_key").agg(F.count_distinct("store_id").alias("stores"), F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("name")), 1, 8).alias("names"))
    tail = F.col("canonical_key").rlike(TRAILING)
    long = F.size(F.split("canonical_key", "_")) >= words
    got = got.filter(tail | (long & (F.col("stores") == 1))).orderBy(F.desc("n"), "canonical_key")
    return got if limit is None else got.limit(limit)
