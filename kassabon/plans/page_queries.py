"""Queries of product pages: sections, nutrients and pictures as rows, and on to silver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassabon.functions import product_pages

from . import silver
from .registry import query, table


def _html() -> Column:
    """A page of a part: a description with a weight, nutrients for two bases, ingredients for some, pictures seen twice."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    block = lambda title, body: said('<details class="c-collapsible js-content" open><summary><h2>', title, '</h2></summary><section class="x product-information-block">', body, "</section></details>")
    about = block("Omschrijving", said("<article><strong>Inhoud &amp; gewicht</strong><p>", F.col("p_size").cast("string"), " gram</p></article><p>Over&nbsp;", name, "</p>"))
    table_ = said("<p><span>Soort</span><span>per 100 g</span></p><p><span>Vet</span> <span>", k, " g</span></p><p><span>Soort</span><span>per portie</span></p><p><span>Zout</span><span><b>", F.col("p_size").cast("string"), "</b> g</span></p>")
    food = block("Voedingswaarden", said('<p>Bereid</p><div class="product-information-table">', table_, "</div>"))
    made = F.when(F.col("p_partkey") % 3 == 0, block("Ingrediënten", said("<article><strong>Ingredi&euml;nten</strong> ", name, "</article>"))).otherwise("")
    ld = said('<script type="application/ld+json">', F.to_json(F.struct(F.lit("Product").alias("@type"), name.alias("name"), F.format_string("%013d", F.col("p_partkey")).alias("gtin13"), F.struct(F.col("p_retailprice").cast("string").alias("price"), F.lit("EUR").alias("priceCurrency")).alias("offers"))), "</script>")
    return said("<html>", ld, '<div class="c-offer__price"><span class="c-price__euro">', k, '.</span><span class="c-price__cent">5</span></div><img src="https://media.spar.nl/', k, '.jpg"><img data-src="https://media.spar.nl/', k, '.jpg"><img src="/logo.svg">', about, food, made, "</html>")


def _pages(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    # The parts lie in one small file; reading pages is dear, so they are dealt out before pages are made of them.
    part = part.repartition(max(part.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    return part.select("p_partkey", _html().alias("html"), F.concat(F.lit("https://www.spar.nl/p-"), F.col("p_partkey").cast("string"), F.lit("/")).alias("url"))


@query("""
    WITH p AS (SELECT p_partkey, p_name, CAST(p_size AS VARCHAR) AS size, CAST(p_partkey AS VARCHAR) AS k FROM part)
    SELECT p_partkey, 'section' AS kind, 'omschrijving' AS section, 0 AS place, 'Omschrijving' AS name, 'Inhoud & gewicht ' || size || ' gram Over ' || p_name AS value, NULL AS basis FROM p
    UNION ALL SELECT p_partkey, 'article', 'omschrijving', 0, 'inhoud_gewicht', size || ' gram', NULL FROM p
    UNION ALL SELECT p_partkey, 'section', 'voedingswaarden', 1, 'Voedingswaarden', 'Bereid Soort per 100 g Vet ' || k || ' g Soort per portie Zout ' || size || ' g', NULL FROM p
    UNION ALL SELECT p_partkey, 'section', 'ingredienten', 2, 'Ingrediënten', 'Ingrediënten ' || p_name, NULL FROM p WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 'article', 'ingredienten', 0, 'ingredienten', p_name, NULL FROM p WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 'nutrient', 'voedingswaarden', 0, 'Vet', k || ' g', 'per 100 g' FROM p
    UNION ALL SELECT p_partkey, 'nutrient', 'voedingswaarden', 1, 'Zout', size || ' g', 'per portie' FROM p
    UNION ALL SELECT p_partkey, 'basis', 'voedingswaarden', 0, NULL, 'per portie', NULL FROM p
    UNION ALL SELECT p_partkey, 'image', NULL, 0, NULL, 'https://media.spar.nl/' || k || '.jpg', NULL FROM p
""")
def txt28_page_sections(spark, sf_dir):
    """The table function over a page of each part, through SQL."""
    product_pages.register(spark)
    _pages(spark, sf_dir).createOrReplaceTempView("product_pages_of_parts")
    return spark.sql("SELECT p.p_partkey, t.* FROM product_pages_of_parts p, LATERAL page_parts(p.html, p.url) t WHERE t.kind NOT IN ('raw', 'field', 'breadcrumb')")


@query("""
    SELECT 'spar' AS store, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS external_id, p_name AS name, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean, p_partkey + 0.05::DOUBLE AS price, 'https://media.spar.nl/' || p_partkey || '.jpg' AS image_url FROM part
""")
def src10_pages_to_silver(spark, sf_dir):
    """Pages to envelopes to silver."""
    lines = product_pages.page_envelopes(_pages(spark, sf_dir), F.timestamp_seconds(F.lit(0)))
    rows = silver.silver(silver.bronze(lines, F.timestamp_seconds(F.lit(0))))
    return rows.select("store", "external_id", "name", "ean", F.col("price").cast("double").alias("price"), "image_url")
