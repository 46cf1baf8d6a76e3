"""Recipes, shopping lists and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassabon.functions import dates, numbers, text
from kassabon.operators.keyed import cheapest_relevant, list_position
from kassabon.sources.folders import written_once

from .search import search_many

#: Products of at most so many texts, of so many bytes, are broadcast.
BROADCAST_TEXTS = 500_000
BROADCAST_BYTES = 16_000_000


def merge_ingredients(rows: DataFrame, keys: list[str], include_optional: bool = True) -> DataFrame:
    """Ingredients of each key as one row a (name, unit): quantities in the common unit summed where known.

    ``rows`` has sort_order and the parsed fields; shown fields come from the first row.
    """
    if not include_optional:
        rows = rows.filter(~F.coalesce("optional", F.lit(False)))
    pick = lambda c: F.nullif(F.col(c), F.lit(""))
    name = text.ingredient_name(F.coalesce(pick("dutch_ingredient_name"), pick("normalized_ingredient_name"), F.col("ingredient_name")))
    unit = numbers.recipe_unit(F.col("unit"))
    rows = rows.withColumn("_name", name).withColumn("_unit", unit["unit"]).withColumn("_qty", F.col("quantity").cast("double") * F.coalesce(unit["factor"], F.lit(1.0)))
    first = lambda c: F.min(F.struct("sort_order", c))[c]
    got = rows.groupBy(*keys, "_name", "_unit").agg(
        first("ingredient_name").alias("ingredient_name"),
        first("dutch_ingredient_name").alias("dutch_ingredient_name"),
        F.sum("_qty").alias("quantity"),
        F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "raw_text"))), lambda x: x["raw_text"]).alias("raw_texts"),
    )
    return got.withColumnRenamed("_name", "normalized_ingredient_name").withColumnRenamed("_unit", "unit")


def choose_products(products: DataFrame, ingredients: DataFrame, count: int = 8) -> DataFrame:
    """The cheapest relevant product of each ingredient (query_id, query_text), all in one search; none gives nulls.

    Each text is searched once, whoever asks for it. The texts are written once, as a search reads them several times.
    """
    texts = written_once(ingredients.select("query_text").filter("query_text is not null").distinct(), "texts")
    found = search_many(products, texts.withColumn("query_id", F.col("query_text")), count)
    best = cheapest_relevant(found, ["query_id"], "match_score", "current_price_cents", "name")
    best = best.select(F.col("query_id").alias("query_text"), F.col("id").alias("selected_product_id"), "store_id", F.col("current_price_cents").alias("estimated_price_cents"))
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("query_text")), F.lit(0)).alias("b")).first()
    few = size["n"] <= BROADCAST_TEXTS and size["b"] <= BROADCAST_BYTES  # counted: few texts stand on very many lists, which a shuffle by text would put into few tasks
    return ingredients.join(F.broadcast(best) if few else best, "query_text", "left")


def add_to_lists(items: DataFrame, wanted: DataFrame, products: DataFrame) -> DataFrame:
    """List items after ingredients (list_id, recipe_ingredient_id, ingredient_name) were added once each, at the end of their list.

    Lists are sorted once: an ingredient's rows stand together, those on the list already first, so the first row tells
    whether it is new. An item without an ingredient or list holds nothing off. What is new is written once.
    """
    keys = ["list_id", "recipe_ingredient_id"]
    both = items.select(*keys, F.lit(True).alias("_had")).unionByName(wanted.withColumn("_had", F.lit(False)), allowMissingColumns=True)
    rows = Window.partitionBy("list_id").orderBy(F.col("recipe_ingredient_id").asc_nulls_last(), F.desc("_had"), "ingredient_name")
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the same order, so that one pass does for all three
    both = both.withColumns({"_above": F.lag("recipe_ingredient_id").over(rows), "_above_had": F.lag("_had").over(rows), "_n": F.count_if("_had").over(whole)})
    unnamed = F.col("list_id").isNull() | F.col("recipe_ingredient_id").isNull()
    first = F.col("_above_had").isNull() | ~F.col("_above").eqNullSafe(F.col("recipe_ingredient_id")) | (F.col("_above_had") & unnamed)
    fresh = both.filter(~F.col("_had") & first)
    place = F.when(F.col("list_id").isNull(), 0).otherwise(F.col("_n")) + list_position(fresh, ["list_id"], "recipe_ingredient_id")
    fresh = fresh.withColumn("sort_order", place.cast("int")).drop("_had", "_above", "_above_had", "_n")
    fresh = written_once(fresh, "fresh").withColumn("query_text", F.col("ingredient_name"))
    placed = choose_products(products, fresh).withColumn("checked", F.lit(False))
    return items.unionByName(placed.select(*items.columns))


def list_totals(items: DataFrame) -> DataFrame:
    """Total of known prices, items and checked items of each list."""
    return items.groupBy("list_id").agg(F.sum(F.coalesce("estimated_price_cents", F.lit(0))).alias("total_cents"), F.count(F.lit(1)).alias("items"), F.count_if("checked").alias("checked_items"))


def upcoming(lists: DataFrame, today: Column, until: Column | None = None) -> DataFrame:
    rows = lists.filter(F.col("scheduled_for").isNotNull() & (F.col("scheduled_for") >= today))
    return (rows if until is None else rows.filter(F.col("scheduled_for") <= until)).orderBy("scheduled_for", "list_id")


def grouped_by_day(rows: DataFrame, day: str, item: str, *order: str) -> DataFrame:
    """Items of each day as one ordered list."""
    got = rows.groupBy(day).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, item))), lambda x: x[item]).alias("items"))
    return got.orderBy(day)


def week_plan(rows: DataFrame, day: str) -> DataFrame:
    return rows.withColumn("week_start", dates.week_start(F.col(day))).withColumn("weekday", F.weekday(day))


def home_feed(recipes: DataFrame, lists: DataFrame, count: int = 8) -> DataFrame:
    """Newest recipes with the total of their latest list."""
    latest = lists.groupBy("recipe_id").agg(F.max_by("total_cents", F.struct("created_at", "list_id")).alias("total_cents"))
    newest = recipes.orderBy(F.desc("created_at"), "recipe_id").limit(count)
    return newest.join(latest, "recipe_id", "left")


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """Parents with their children as an ordered list of structs, empty where there are none."""
    columns = [c for c in children.columns if c not in (key, *order)]
    items = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias(name))
    return parents.join(items, key, "left").withColumn(name, F.coalesce(name, F.array()))


def distinct_tags(recipes: DataFrame) -> DataFrame:
    return recipes.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def completeness(missing: Column, fields: dict[str, Column]) -> Column:
    """Struct of status and missing fields after fields that are there were taken off the list."""
    left = F.array_distinct(missing)
    for name, present in fields.items():
        left = F.when(present, F.array_remove(left, name)).otherwise(left)
    return F.struct(F.when(F.size(left) > 0, "incomplete").otherwise("complete").alias("status"), left.alias("missing_fields"))


# Words of a recipe, and what a page says that asks for a login.
RECIPE_WORDS = r"(?i)\b(ingredients?|ingredienten|directions?|bereiding|instructions?|stappen|tbsp|tsp|cups?|gram|g\b|ml\b|eieren)\b"
LOGIN = {
    "instagram": ("maak een account of meld je aan bij instagram", "log in to instagram"),
    "facebook": ("recipes shared from facebook", "log into facebook", "facebook helps you connect"),
}


def login_page(platform: Column, title: Column, description: Column, site: Column) -> Column:
    said = F.lower(F.concat_ws(" ", title, description, site))
    asks = {name: text.any_of(*[said.contains(x) for x in texts]) for name, texts in LOGIN.items()}
    bare = F.coalesce(F.lower(F.trim(title)) == "instagram", F.lit(False))
    return F.when(platform == "instagram", bare | asks["instagram"]).when(platform == "facebook", asks["facebook"]).otherwise(False)


def usable_signal(platform: Column, title: Column, description: Column, site: Column, embedded: Column, transcript: Column, structured: Column) -> Column:
    """Whether a linked page says enough: no login page, and structured data, a long transcript, or a long text with a recipe word."""
    words = F.trim(F.concat_ws(" ", *[F.nullif(F.trim(x), F.lit("")) for x in (title, description, embedded)]))
    said = F.coalesce(F.char_length(F.trim(transcript)) >= 60, F.lit(False))
    told = (F.char_length(words) >= 80) & words.rlike(RECIPE_WORDS)
    return ~login_page(platform, title, description, site) & (F.coalesce(structured, F.lit(False)) | said | told)


def valid_recipes(rows: DataFrame, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) recipe documents: a title, ingredients with a name, a confidence from 0 to 1."""
    shape = "title string, servings int, ingredients array<struct<rawText:string,quantity:double,unit:string,ingredientName:string>>, tags array<string>, confidenceScore double"
    parsed = rows.withColumn("doc", F.from_json(text_column, shape))
    d = F.col("doc")
    named = F.forall(d["ingredients"], lambda i: F.coalesce(F.trim(i["ingredientName"]) != "", F.lit(False)))
    fine = (F.trim(d["title"]) != "") & (F.size(d["ingredients"]) > 0) & named & d["confidenceScore"].between(0, 1)
    parsed = parsed.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    return parsed.filter("_fine").drop("_fine"), parsed.filter("not _fine").drop("_fine")


def running_position(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.withColumn("step_number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
