"""Queries of recorded pages: listings of three stores made of the parts, walked and joined with their details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassabon.sources import landing
from kassabon.sources.folders import new_path

from . import envelopes
from .registry import query, table

def _at() -> Column:
    return F.timestamp_seconds(F.lit(0))


def _paged(rows: DataFrame, leaf: Column, place: Column, size: int) -> DataFrame:
    """Parts with their leaf, place in it, page of a size, and the last place of the leaf."""
    rows = rows.withColumns({"leaf": leaf, "n": place.cast("long"), "page": F.floor(place / size).cast("long")})
    return rows.join(rows.groupBy("leaf").agg(F.max("n").alias("last")), "leaf")


def _nth(name: str, of: int) -> tuple[Column, Column]:
    """Leaf of a part, and its place in it, when parts are dealt over ``of`` leaves."""
    return F.format_string(f"{name}%02d", F.col("p_partkey") % of), F.floor(F.col("p_partkey") / of)


def _answer(rows: DataFrame, card: Column, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", card.alias("card")))).alias("l")).withColumn("l", F.transform("l", lambda x: x["card"]))


def _page(store: str, kind: str, leaf: Column, page: Column, body: Column, key: Column | None = None) -> list[Column]:
    key = F.lit(None) if key is None else key
    return [F.lit(store).alias("store"), F.lit(kind).alias("kind"), leaf.cast("string").alias("leaf"), page.cast("long").alias("page"), key.cast("string").alias("key"), F.to_json(body).alias("body")]


def _ah(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    both = _paged(part, *_nth("brand", 25), 10).unionByName(_paged(part, *_nth("maker", 5), 10))
    card = F.struct(F.col("p_partkey").alias("webshopId"), F.col("p_name").alias("title"), F.col("leaf").alias("seen"))
    listing = _answer(both, card, "leaf", "last", "page").select(*_page("ah", "listing", F.col("leaf"), F.col("page"), F.struct(F.struct((F.floor(F.col("last") / 10) + 1).alias("totalPages")).alias("page"), F.col("l").alias("products"))))
    tops = F.array(*[F.struct(F.lit(x).alias("id"), F.lit(x).alias("name")) for x in ("brands", "none")])
    leaves = lambda name, of: F.array(*[F.struct(F.lit(f"{name}{i:02d}").alias("id"), F.lit(f"{name}{i:02d}").alias("name")) for i in range(of)])
    below = spark.range(1).select(F.explode(F.array(F.struct(F.lit("brands").alias("leaf"), leaves("brand", 25).alias("c")), F.struct(F.lit("makers").alias("leaf"), leaves("maker", 5).alias("c")))).alias("x"))
    children = below.select(*_page("ah", "children", F.col("x.leaf"), F.lit(0), F.struct(F.col("x.c").alias("children"))))
    whole = F.array_append(tops, F.struct(F.lit("makers").alias("id"), F.lit("makers").alias("name")))
    categories = spark.range(1).select(*_page("ah", "categories", F.lit("all"), F.lit(0), whole))
    detail = part.filter("p_partkey % 3 <> 0").select(*_page("ah", "detail", F.col("p_partkey") % 7, F.col("p_partkey"), F.struct(F.struct(F.upper("p_name").alias("title")).alias("productCard")), F.col("p_partkey")))
    return listing.unionByName(children).unionByName(categories).unionByName(detail)


@query("""
    WITH n AS (
        SELECT p_partkey, p_name, format('brand{:02d}', p_partkey % 25) AS leaf, 0 AS turn, p_partkey // 25 // 10 AS page FROM part
        UNION ALL SELECT p_partkey, p_name, format('maker{:02d}', p_partkey % 5), 1, p_partkey // 5 // 10 FROM part
    )
    SELECT CAST(p_partkey AS VARCHAR) AS external_id, arg_min(leaf, turn) AS seen, arg_min(p_name, turn) AS title, CASE WHEN p_partkey % 3 <> 0 THEN upper(arg_min(p_name, turn)) END AS more
    FROM n WHERE page < 30 GROUP BY p_partkey
""")
def src6_walked_categories(spark, sf_dir):
    """Recorded by Spark, read back through the format: two trees of leaves, 30 pages of a leaf at most."""
    path = new_path(spark, "recorded")
    landing.record(_ah(spark, sf_dir), path)
    lines = envelopes.gathered(envelopes.recorded(spark, path, "ah"), "ah", _at())
    at = lambda p: F.get_json_object("value", p)
    return lines.select(at("$.external_id").alias("external_id"), at("$.raw.card.seen").alias("seen"), at("$.raw.card.title").alias("title"), at("$.raw.detail.productCard.title").alias("more"))


@query("""
    WITH n AS (SELECT *, p_partkey // 24 * 24 AS start, max(p_partkey) OVER () AS n FROM part)
    SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN 'again' WHEN p_partkey % 2 = 0 THEN upper(p_name) END AS more FROM n WHERE start < n - 29 OR start = 0
""")
def src7_walked_offsets(spark, sf_dir):
    """One listing by offsets, of which fewer products are said than were recorded; details in chunks, some answered twice."""
    part = table(spark, sf_dir, "part")
    rows = _paged(part, F.lit("all"), F.col("p_partkey"), 24)
    card = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    listing = _answer(rows, card, "leaf", "last", "page").select(*_page("jumbo", "listing", F.col("leaf"), F.col("page") * 24, F.struct(F.struct(F.struct((F.col("last") - 29).alias("count"), F.col("l").alias("products")).alias("searchProducts")).alias("data"))))
    told = part.filter("p_partkey % 2 = 0").select("p_partkey", F.lit(0).alias("turn"), F.upper("p_name").alias("title")).unionByName(part.filter("p_partkey % 7 = 0").select("p_partkey", F.lit(1).alias("turn"), F.lit("again").alias("title")))
    told = told.withColumn("n", F.col("p_partkey")).withColumn("page", F.col("turn") * F.lit(1_000_000_000) + F.floor(F.col("p_partkey") / 50))
    chunks = _answer(told, F.struct(F.col("p_partkey").cast("string").alias("sku"), "title"), "page").select(*_page("jumbo", "detail", F.lit("all"), F.col("page"), F.struct(F.struct(F.col("l").alias("products")).alias("data"))))
    lines = envelopes.gathered(envelopes.kinds_of(listing.unionByName(chunks), "jumbo"), "jumbo", _at())
    at = lambda p: F.get_json_object("value", p)
    return lines.select(at("$.external_id").alias("external_id"), at("$.raw.listing.title").alias("title"), at("$.raw.detail.title").alias("more"))


@query("""
    WITH n AS (SELECT p_partkey, p_name, format('brand{:02d}', p_partkey % 25) AS leaf, p_partkey // 25 // 3 + 1 AS page FROM part),
    k AS (SELECT * FROM n WHERE page < CASE right(leaf, 1) WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 3 ELSE 1000000 END)
    SELECT CAST(p_partkey AS VARCHAR) AS external_id, leaf, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END AS more FROM k WHERE leaf <> 'brand11'
""")
def src9_walked_pages(spark, sf_dir):
    """Leaves that stop at an empty page, at a missing one, or at the number of pages that the last answer says; one leaf isn't in the menu."""
    part = table(spark, sf_dir, "part")
    rows = _paged(part, *_nth("brand", 25), 3).withColumn("page", F.col("page") + 1)
    end = F.right("leaf", F.lit(1))
    slug = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    card = F.struct(F.struct(F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey").cast("string")).alias("SKU"), slug.alias("Slug"), F.col("p_name").alias("Name"), F.col("leaf").alias("Seen")).alias("PLP_Str"))
    pages = _answer(rows, card, "leaf", "last", "page").filter(~((end == "3") & (F.col("page") == 2)))
    said = F.when(end == "4", F.lit(2)).otherwise(F.floor(F.col("last") / 3) + 1)
    listed = F.when((end == "2") & (F.col("page") == 3), F.slice("l", 1, 0)).otherwise(F.col("l"))
    listing = pages.select(*_page("plus", "listing", F.col("leaf"), F.col("page"), F.struct(F.struct(said.alias("TotalPages"), F.struct(listed.alias("List")).alias("ProductList")).alias("data"))))
    item = F.struct(F.struct(F.col("b").alias("Slug"), F.col("b").alias("Name"), F.lit(5).alias("ExternalId"), F.lit(0).alias("ParentExternalId"), (F.col("b") != "brand11").alias("HasChild"), F.lit(1).alias("SortOrder")).alias("Category_str"))
    menu = part.select(_nth("brand", 25)[0].alias("b")).distinct().agg(F.collect_list(item).alias("l")).select(*_page("plus", "menu", F.lit("all"), F.lit(0), F.struct(F.struct(F.struct(F.col("l").alias("List")).alias("Categories")).alias("data"))))
    detail = part.filter("p_partkey % 2 = 0").select(*_page("plus", "detail", F.lit("all"), F.col("p_partkey"), F.struct(F.struct(F.struct(F.upper("p_name").alias("Name")).alias("ProductOut")).alias("data")), slug))
    lines = envelopes.gathered(envelopes.kinds_of(listing.unionByName(menu).unionByName(detail), "plus"), "plus", _at())
    at = lambda p: F.get_json_object("value", p)
    return lines.select(at("$.external_id").alias("external_id"), at("$.raw.plp.Seen").alias("leaf"), at("$.raw.plp.Name").alias("title"), at("$.raw.pdp.ProductOut.Name").alias("more"))
