"""Recipes of orders and their lines, one in three with a fault, as JSON texts that are judged rule by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recipe_checks
from .registry import query, table

# What is wrong with a recipe: remainder of its number, what it names, what is replaced, and by what.
FAULTS = [
    (1, "title", '"title":"', '"title":"","was":"'),
    (2, "servings", '"servings":4', '"servings":2.5'),
    (3, "sourcePlatform", '"blog"', '"radio"'),
    (4, "confidenceScore", '"confidenceScore":0.5', '"confidenceScore":"0.5"'),
    (5, "ingredients", '"ingredients":[', '"ingredients":["ui",'),
    (6, "ingredients.quantity", '"quantity":', '"quantity":"x","was":'),
    (7, "instructions.text", '"text":"', '"text":null,"was":"'),
    (8, "completeness.status", '"status":"complete"', '"status":"done"'),
    (9, "tags", '"tags":["', '"tags":[" ","'),
    (10, "sourceUrl", '"https://', '"//'),
    (11, "not_json", "{", ""),
    (12, "not_an_object", None, "[]"),
    (13, "description,prepTimeMinutes", '"description":null,"prepTimeMinutes":0', '"description":1,"prepTimeMinutes":-1'),
]
PERIOD = 3 * len(FAULTS)


def _recipe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a recipe for each order, its lines the ingredients."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("p"), F.col("l_quantity").cast("long").alias("q")))).alias("lines")
    )
    items = F.array_join(F.transform("lines", lambda x: F.concat(F.lit('{"rawText":"'), x["p"], F.lit('","ingredientName":"'), x["p"], F.lit('","quantity":'), x["q"], F.lit("}"))), ",")
    head = F.concat(F.lit('{"title":"'), F.col("id"), F.lit('","description":null,"prepTimeMinutes":0,"servings":4,"sourcePlatform":"blog","sourceUrl":"https://example.org/'), F.col("id"))
    text = F.concat(head, F.lit('","confidenceScore":0.5,"tags":["soep"],"ingredients":['), items, F.lit('],"instructions":[{"text":"Kook."}],"completeness":{"status":"complete"}}'))
    return lines.select("id", _spoilt(text).alias("text"))


def _spoilt(text: Column) -> Column:
    out = text
    for n, _, old, new in FAULTS:
        wrong = F.lit(new) if old is None else F.replace(text, F.lit(old), F.lit(new))
        out = F.when(F.col("id") % PERIOD == n, wrong).otherwise(out)
    return out


_WRONG = " ".join(f"WHEN {n} THEN '{names}'" for n, names, _, _ in FAULTS)


@query(f"SELECT l_orderkey AS id, CASE l_orderkey % {PERIOD} {_WRONG} ELSE '' END AS reasons FROM lineitem GROUP BY l_orderkey")
def jsn12_rejected_recipes(spark, sf_dir):
    return recipe_checks.with_reasons(_recipe_texts(spark, sf_dir), "text").select("id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""
    SELECT l_orderkey AS recipe_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), floor(l_quantity)) AS INT) AS place, CAST(l_partkey AS VARCHAR) AS ingredient_name,
           CAST(floor(l_quantity) AS DOUBLE) AS quantity, 'source' AS quantity_source, false AS optional
    FROM lineitem WHERE l_orderkey % {PERIOD} NOT BETWEEN 1 AND {len(FAULTS)}
""")
def jsn12_ingredients_of_recipes(spark, sf_dir):
    """Ingredients of the recipes that pass, what they leave out filled with the default. Each has one at least; an outer generator is not preceded by a filter that makes the list again."""
    valid = recipe_checks.with_defaults(recipe_checks.judged_recipes(_recipe_texts(spark, sf_dir), "text")[0])
    items = valid.select(F.col("id").alias("recipe_id"), F.posexplode_outer("ingredients").alias("n", "i"))
    return items.select("recipe_id", (F.col("n") + 1).alias("place"), F.col("i.ingredientName").alias("ingredient_name"), "i.quantity", F.col("i.quantitySource").alias("quantity_source"), "i.optional")
