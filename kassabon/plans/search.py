"""Fuzzy product search, offer groups and price lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kassabon.functions import text
from kassabon.functions.trigram import LEAST_SIMILAR, best_extent, jaccard, tok_match, trigrams
from kassabon.functions.words import SEARCH_STOP, STAPLES, STORES
from kassabon.operators.keyed import cheapest_relevant, price_matrix

from .registry import dealt_out
from .search_index import NameIndex

CANDIDATES = 160


def _words(x: Column) -> Column:
    """Distinct words of a search name that aren't short or numbers."""
    return F.array_distinct(F.filter(text.tokens(F.regexp_replace(x, text.NOT_ALNUM_SPACE, " ")), lambda w: (F.char_length(w) >= 2) & ~w.rlike("^[0-9]+$")))


def _graded(words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(w.alias("w"), F.array_distinct(trigrams(w)).alias("t")))


def _score(q: Column, p: Column) -> Column:
    return tok_match(q["w"], p["w"], jaccard(q["t"], p["t"]))


def _mean_of_best(outer: Column, inner: Column, flip: bool) -> Column:
    def mean(outer: Column, inner: Column) -> Column:
        best = F.transform(outer, lambda o: F.array_max(F.transform(inner, lambda i: _score(i, o) if flip else _score(o, i))))
        return F.when((F.size(outer) > 0) & (F.size(inner) > 0), F.aggregate(best, F.lit(0.0), lambda t, x: t + x) / F.size(outer)).otherwise(0.0)

    return text.once(mean, outer, inner)


def prepared(queries: DataFrame) -> DataFrame:
    """(query_id, qre, qtok) of (query_id, query_text): folded text and the words that count, else the whole text."""
    q = queries.select("query_id", text.search_form(F.col("query_text")).alias("qre"))
    words = F.filter(F.split("qre", " "), lambda w: (F.char_length(w) >= 2) & ~w.isin(*SEARCH_STOP))
    words = F.when(F.size(words) > 0, words).when(F.col("qre") != "", F.array("qre")).otherwise(F.array().cast("array<string>"))
    return q.withColumn("qtok", F.array_distinct(words))


def candidates(products: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) where a word of the query is similar to part of the search name, or stands in it.

    Both need a trigram in common, so names meet words in an equi-join on trigrams; distinct
    names are compared once. A run of a name that is similar holds at least that share of the
    word's trigrams, so runs are looked at only where the name has so many.
    """
    names = products.select("name_search").distinct()
    index = names.select("name_search", F.explode(F.array_distinct(trigrams(F.col("name_search")))).alias("t"))
    asked = queries.select("query_id", F.explode("qtok").alias("word"))
    words = asked.select("word").distinct()
    spread = words.select("word", F.explode(F.array_distinct(trigrams(F.col("word")))).alias("t"))
    pairs = spread.join(index, "t").groupBy("word", "name_search").agg(F.count(F.lit(1)).alias("shared"))
    own = F.array_distinct(trigrams(F.col("word")))
    near = F.when(F.col("shared") >= LEAST_SIMILAR * F.size(own), best_extent(own, trigrams(F.col("name_search"))) >= LEAST_SIMILAR).otherwise(False)
    inside = (F.char_length("word") >= 3) & F.col("name_search").contains(F.col("word"))
    pairs = pairs.filter(inside | near)
    return asked.join(pairs, "word").select("query_id", "name_search").distinct()


def search_many(products: DataFrame, queries: DataFrame, count: int = 8, store: str | None = None, index: NameIndex | None = None) -> DataFrame:
    """The best ``count`` (1 to 20) available products of each query (query_id, query_text), with match_score and rank.

    Names are looked for in ``index``, if one is kept (names of no available product drop out), else among all names.
    """
    count = min(max(count, 1), 20)
    rows = products.filter("is_available")
    if store is not None:
        rows = rows.filter(F.col("store_id") == store)
    asked = prepared(queries)
    # scores depend on the search name alone: each distinct name is scored once, then products take its score
    named = (candidates(rows, asked) if index is None else index.candidates(asked)).join(asked, "query_id")
    similar = F.round(best_extent(F.array_distinct(trigrams(F.col("qre"))), trigrams(F.col("name_search"))), 6)
    named = named.withColumn("_similar", similar).withColumn("_q", _graded(F.col("qtok"))).withColumn("_p", _graded(_words(F.col("name_search"))))
    named = named.withColumn("_s", F.filter("_p", lambda x: ~x["w"].isin(*SEARCH_STOP)))
    named = named.withColumn("_coverage", _mean_of_best(F.col("_q"), F.col("_p"), False)).withColumn("_specificity", _mean_of_best(F.col("_s"), F.col("_q"), True))
    length = F.char_length("qre") / F.greatest(F.char_length("name_search"), F.lit(1))
    score = F.least(F.lit(1.0), 0.55 * F.col("_coverage") + 0.45 * F.col("_specificity") + 0.05 * length)
    named = named.select("query_id", "name_search", "_similar", "_coverage", F.round(score, 6).alias("match_score"))
    # All products of a name are as similar, so beyond the first of a name by id none can be a candidate: names meet queries with so many of their products.
    # These are found on dealt out rows, as a task sorts all that it has read.
    rows = dealt_out(rows, "id").withColumn("_of_name", F.row_number().over(Window.partitionBy("name_search").orderBy("id"))).filter(F.col("_of_name") <= CANDIDATES).drop("_of_name")
    first = Window.partitionBy("query_id").orderBy(F.desc("_similar"), "id")
    found = rows.join(named, "name_search").withColumn("_r", F.row_number().over(first)).filter((F.col("_r") <= CANDIDATES) & (F.col("_coverage") > 0))
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), F.char_length("name"), F.col("current_price_cents").asc_nulls_last(), "name", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count).select("query_id", *products.columns, "match_score", "rank")


def search(products: DataFrame, query: str, count: int = 8, store: str | None = None) -> DataFrame:
    asked = products.sparkSession.createDataFrame([(0, query)], "query_id int, query_text string")
    return search_many(products, asked, count, store).drop("query_id")


def _query(spark: SparkSession, query: str) -> tuple[str, list[str], str]:
    form = spark.range(1).select(text.search_form(F.lit(query)).alias("q")).first()["q"]
    key = "_".join(form.split())
    return form, form.split(), STAPLES.get(key, key)


def offer_group(products: DataFrame, query: str, count: int = 8) -> DataFrame:
    """(canonical_key, grp_score) of the one group that answers a query: its own key, else the best of the search."""
    _, _, key = _query(products.sparkSession, query)
    rows = products.filter("is_available and canonical_key <> ''")
    stores = F.count_distinct("store_id").alias("stores")
    exact = rows.filter(F.col("canonical_key") == key).groupBy("canonical_key").agg(F.lit(1.0).alias("grp_score"), F.count(F.lit(1)).alias("hits"), stores, F.lit(0).alias("priority"))
    ranked = search(products, query, max(count, 12)).filter("canonical_key <> ''")
    found = ranked.groupBy("canonical_key").agg(F.max("match_score").alias("grp_score"), F.count(F.lit(1)).alias("hits"))
    found = found.withColumn("_top", F.max("grp_score").over(Window.partitionBy())).filter("grp_score >= _top - 0.06").drop("_top")
    found = found.join(rows.groupBy("canonical_key").agg(stores), "canonical_key").withColumn("priority", F.lit(1))
    both = exact.unionByName(found.select(*exact.columns))
    return both.orderBy("priority", F.desc("stores"), F.desc("grp_score"), F.desc("hits"), "canonical_key").limit(1).select("canonical_key", "grp_score")


def search_offers(products: DataFrame, query: str, count: int = 8, one_per_store: bool = False) -> DataFrame:
    """All available offers of the group that answers a query, those that name it best and cost least first."""
    form, words, _ = _query(products.sparkSession, query)
    best = offer_group(products, query, count)
    rows = products.filter("is_available and (current_price_cents is null or current_price_cents > 0)").join(F.broadcast(best), "canonical_key")  # one row
    folded = text.fold_text(F.col("name"))
    has = [folded.contains(w) for w in words]
    every, some = F.lit(bool(has)), F.lit(False)
    for h in has:
        every, some = every & h, some | h
    rank = F.when(F.lit(form != "") & (folded == form), 4).when(F.lit(form != "") & folded.contains(form), 3).when(every, 2).when(some, 1).otherwise(0)
    order = [F.desc("offer_rank"), F.col("current_price_cents").isNull(), F.col("current_price_cents").asc_nulls_last(), F.col("unit_price_cents").asc_nulls_last(), F.col("store_id"), F.col("name"), F.col("id")]
    got = rows.withColumn("offer_rank", rank).withColumnRenamed("grp_score", "match_score")
    if one_per_store:
        got = got.withColumn("_n", F.row_number().over(Window.partitionBy("store_id").orderBy(*order))).filter("_n = 1").drop("_n")
    return got.orderBy(*order)


def price_offers(products: DataFrame, product_id: str) -> DataFrame:
    """Available products of the same article number, and the product itself."""
    own = products.filter(F.col("id") == product_id).select(F.col("ean_norm").alias("_ean"))
    same = products.join(F.broadcast(own), F.col("ean_norm") == F.col("_ean")).drop("_ean")
    got = same.unionByName(products.filter(F.col("id") == product_id)).filter("is_available").dropDuplicates(["id"])
    return got.orderBy(F.col("current_price_cents").asc_nulls_last(), "store_id", "id")


def group_offers(products: DataFrame, product_id: str) -> DataFrame:
    """Available offers of the same canonical key with a price above 0 or none."""
    own = products.filter((F.col("id") == product_id) & (F.col("canonical_key") != "")).select("canonical_key")
    got = products.filter("is_available and (current_price_cents is null or current_price_cents > 0)").join(F.broadcast(own), "canonical_key", "left_semi")
    return got.orderBy(F.col("current_price_cents").isNull(), F.col("current_price_cents").asc_nulls_last(), F.col("unit_price_cents").asc_nulls_last(), "store_id", "name", "id")


def kind_offers(products: DataFrame, product_id: str, kind: str = "exact") -> DataFrame:
    """Available products of the same exact or substitute group, else the product itself."""
    column = "exact_group_key" if kind == "exact" else "ingredient_id"
    own = products.filter(F.col("id") == product_id).select(F.coalesce(F.concat(F.lit("group:"), column), F.concat(F.lit("self:"), "id")).alias("_key"))
    keys = F.array_compact(F.array(F.concat(F.lit("group:"), column), F.concat(F.lit("self:"), "id")))  # at most one of them fits
    hit = products.withColumn("_key", F.explode(keys)).join(F.broadcast(own), "_key", "left_semi")
    return hit.filter("is_available").drop("_key").orderBy(F.col("current_price_cents").asc_nulls_last(), "store_id", "id")


def product_price_matrix(products: DataFrame, stores: tuple[str, ...] = STORES) -> DataFrame:
    rows = products.filter("is_available and ean_norm is not null")
    return price_matrix(rows, "ean_norm", "store_id", "current_price_cents", stores, "max", F.min("name").alias("product")).withColumnRenamed("ean_norm", "ean")


def ingredient_price_matrix(products: DataFrame, stores: tuple[str, ...] = STORES) -> DataFrame:
    rows = products.filter("is_available and canonical_key <> ''")
    more = (F.min("canonical_name").alias("display_name"), F.min("name").alias("sample_name"), F.bool_or("is_organic").alias("has_organic"), F.count(F.lit(1)).alias("member_count"))
    return price_matrix(rows, "canonical_key", "store_id", "current_price_cents", stores, "min", *more)


def evaluate(products: DataFrame, cases: DataFrame, count: int = 8) -> DataFrame:
    """Each case (query_id, query_text, terms) with the cheapest relevant product and whether it is one of the expected."""
    found = search_many(products, cases.select("query_id", "query_text"), count)
    best = cheapest_relevant(found, ["query_id"], "match_score", "current_price_cents", "name", width=0.15, least=0.35)
    joined = cases.join(best.select("query_id", "name", "brand", "category", "current_price_cents", "match_score"), "query_id", "left")
    return joined.withColumn("passed", F.coalesce(text.expected_term_found(F.col("terms"), F.col("name"), F.col("brand"), F.col("category")), F.lit(False)))


def pass_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.coalesce(F.try_divide(F.count_if("passed"), F.count(F.lit(1))), F.lit(0.0)).alias("pass_rate"))
