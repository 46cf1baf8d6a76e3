"""What must not grow with the input: what is broadcast, what one task holds, how often a row is read."""

import re

from kassabon.functions import product_pages
from kassabon.plans import answer_queries, queries, recipe_queries, recipes, search, silver, table_queries
from kassabon.sources import sinks
from kassabon.sources.ordered_table import OrderedTable
from pyspark.sql import functions as F


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_errors_are_not_broadcast(spark):
    log = spark.range(40).select(F.col("id").alias("run_id"), F.lit("running").alias("status"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("finished_at"))
    results = spark.range(20).select(F.col("id").alias("run_id"), F.col("id").alias("rows"), F.repeat(F.lit("fault "), 500).alias("error"), F.timestamp_seconds("id").alias("finished_at"))
    got = sinks.run_finished(log, results)
    assert "Broadcast" not in plan_of(got)
    assert {(r["status"], len(r["error"] or "")) for r in got.collect()} == {("failed", 2000), ("running", 0)}
    assert "Broadcast" not in plan_of(got)


def test_first_written_goes_by_place_in_the_files(spark, tmp_path):
    """Spark reads the largest file first; of rows of one number the one in the first file counts all the same."""
    for name, n, part in (("a", 500, 1), ("b", 20000, 2)):
        rows = spark.range(n).select(F.lit(1).alias("l_linenumber"), (F.col("id") % 500).alias("l_orderkey"), (F.lit(part) + F.floor(F.col("id") / 500) * 10).alias("l_partkey"))
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / name).glob("part-*")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = table_queries.snk18_first_written(spark, str(tmp_path)).collect()
    assert {(r["l_orderkey"], r["l_partkey"]) for r in got} == {(k, 1) for k in range(500)}


def test_landed_texts_are_dropped_after_the_shuffle(spark):
    """No task holds the texts that it reads: every aggregate of a landing stands above the exchange by hash."""
    lines = spark.range(50).select(F.to_json(F.struct(F.lit("ah").alias("store"), (F.col("id") % 20).alias("external_id"))).alias("value"))
    rows = silver.bronze(lines, F.timestamp_seconds(F.lit(0)))
    plan = plan_of(rows)
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange hashpartitioning(row_hash") :]
    assert rows.count() == 20


def test_few_row_groups_are_dealt_out(spark):
    assert queries.landed(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_a_recipe_is_judged_once(spark):
    """Neither filter nor generator makes the parse and the rules of a recipe again."""
    plan = recipe_queries.jsn12_ingredients_of_recipes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2  # the text in a list, and in an object


def test_decisions_are_judged_in_one_pass(spark):
    plan = answer_queries.jsn12_decisions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("Relation") == 1


def test_all_pages_in_one_pass(spark, tmp_path):
    """The same pages as from one to the next, by one read of the table instead of a job or more for each page."""
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), F.col("id").cast("string").alias("name"))
    ordered = OrderedTable(spark, str(tmp_path / "t"), rows.schema, ["k"])
    ordered.write(rows.repartition(3), 90)
    want = {r["k"]: i for i, page in enumerate(ordered.pages(70)) for r in page}
    got = ordered.paged(70)
    assert {r["k"]: r["page"] for r in got.collect()} == want and got.count() == 1000
    plan = table_queries.src5_pages_in_order(spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2  # the table and its index, for four pages


def test_names_meet_searches_with_few_products(spark):
    """Of many products of a name only those that can be candidates are joined with searches, and the best are the same."""
    name = F.element_at(F.array(F.lit("red bolt"), F.lit("blue gear")), (F.col("id") % 2 + 1).cast("int"))
    products = spark.range(2000).select(F.format_string("%05d", "id").alias("id"), F.lit("ah").alias("store_id"), name.alias("name"), name.alias("name_search"), (F.col("id") % 7).alias("current_price_cents"), F.lit(True).alias("is_available"))
    asked = spark.createDataFrame([(1, "red bolt")], "query_id int, query_text string")
    found = search.search_many(products, asked, 5)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [f"{i:05d}" for i in range(0, 70, 14)]
    assert re.search(r"WindowGroupLimit \[name_search#\d+\].*160", plan_of(found))


def test_envelopes_take_one_row_of_a_page(spark):
    """Of a page's parts only the record is made: no filter throws the others away."""
    pages = spark.createDataFrame([("<html><h1>Soep</h1></html>", "https://www.spar.nl/soep-5/"), (None, "x")], "html string, url string")
    lines = product_pages.page_envelopes(pages, F.timestamp_seconds(F.lit(0)))
    assert lines.count() == 1 and "page_record" in plan_of(lines) and "kind" not in plan_of(lines).split("page_record")[0]


def test_new_items_are_made_once_and_not_dealt_by_text(spark, monkeypatch):
    """Lists aren't read again for the texts that are searched, and few texts are broadcast; items without a list or an ingredient hold none off."""
    name = F.element_at(F.array(F.lit("red bolt"), F.lit("blue gear")), (F.col("id") % 2 + 1).cast("int"))
    products = spark.range(20).select(F.format_string("%02d", "id").alias("id"), F.lit("ah").alias("store_id"), name.alias("name"), name.alias("name_search"), F.col("id").cast("int").alias("current_price_cents"), F.lit(True).alias("is_available"))
    had = [(1, "a", "red bolt", None, 0, True), (1, None, "eggs", None, 1, False), (1, "c", "eggs", None, 2, False), (2, "b", "red bolt", None, 0, False), (None, "z", "eggs", None, 0, False)]
    items = spark.createDataFrame(had, "list_id long, recipe_ingredient_id string, ingredient_name string, selected_product_id string, sort_order int, checked boolean")
    asked = [(1, "a", "red bolt"), (1, "b", "red bolt"), (1, "b", "red bolt"), (1, None, "blue gear"), (1, None, "blue gear"), (3, "a", "xylophone"), (3, "b", None), (None, "z", "blue gear")]
    wanted = spark.createDataFrame(asked, "list_id long, recipe_ingredient_id string, ingredient_name string")
    new = [(1, "b", "red bolt", "00", 3, False), (1, None, "blue gear", "01", 4, False), (3, "a", "xylophone", None, 0, False), (3, "b", None, None, 1, False), (None, "z", "blue gear", "01", 0, False)]
    got = recipes.add_to_lists(items, wanted, products)
    plan = plan_of(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(had + new, key=str)
    assert "hashpartitioning(query_text" not in plan and plan.count("Scan ExistingRDD[list_id") == 1
    monkeypatch.setattr(recipes, "BROADCAST_TEXTS", 0)
    assert sorted(map(tuple, recipes.add_to_lists(items, wanted, products).collect()), key=str) == sorted(had + new, key=str)
