"""Searches, offers, matrices and text functions as a user of SQL writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries as base
from . import silver, sql_functions
from .registry import ORACLES, query


def _said(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a SQL text over the catalogue."""
    sql_functions.register(spark, base.catalogue(spark, sf_dir), base.silver_rows(spark, sf_dir))
    return spark.sql(text)


@query(ORACLES["tf6_misspelt_searches"])
def sql6_search_products(spark, sf_dir):
    base._cases(spark).createOrReplaceTempView("searches")
    return _said(spark, sf_dir, "SELECT s.query_id, p.rank, p.id, p.match_score FROM searches s, LATERAL search_products(s.query_text) p")


@query(f"WITH {base._sql_search('''SELECT 0 AS query_id, 'Smal ANVILL!' AS query_text''', 20)} SELECT id, CAST(rank AS INT) AS rank, name, match_score FROM found")
def sql6_search_for_many(spark, sf_dir):
    """More than the 20 products that a search gives at most."""
    return _said(spark, sf_dir, "SELECT id, rank, name, match_score FROM search_products('Smal ANVILL!', match_count => 50)")


@query(ORACLES["tf7_misspelt_offers"])
def sql7_search_offers(spark, sf_dir):
    return _said(spark, sf_dir, "SELECT id, store_id, match_score FROM search_product_offers('smal anvill')")


@query(f"""
    WITH {base.CATALOGUE}
    SELECT id, store_id, 1.0::DOUBLE AS match_score, CAST(row_number() OVER (ORDER BY name_search = 'red bolt' DESC, current_price_cents, unit_price_cents, store_id, name, id) AS INT) AS place
    FROM catalogue WHERE is_available AND canonical_key = 'red_bolt' AND current_price_cents > 0
""")
def sql7_offers_in_order(spark, sf_dir):
    """The group of that key, in the order of offers: the plain name first (all others hold it, too), then what costs least."""
    return _said(spark, sf_dir, "SELECT id, store_id, match_score, place FROM search_product_offers('Red bolt')")


@query(ORACLES["tf8_price_offers"])
def sql8_price_offers(spark, sf_dir):
    return _said(spark, sf_dir, "SELECT id, store_id, current_price_cents FROM product_price_offers('8')")


@query(ORACLES["tf9_group_offers"])
def sql9_group_offers(spark, sf_dir):
    return _said(spark, sf_dir, "SELECT id, store_id, name, current_price_cents FROM product_group_offers('8')")


@query(ORACLES["tf11_product_price_matrix"])
def sql11_product_price_matrix(spark, sf_dir):
    return _said(spark, sf_dir, "SELECT * FROM product_price_matrix")


@query(ORACLES["tf12_ingredient_price_matrix"])
def sql12_ingredient_price_matrix(spark, sf_dir):
    return _said(spark, sf_dir, "SELECT * FROM ingredient_price_matrix")


@query(ORACLES["tf3_canonical_baseline"])
def sql3_canonical_baseline(spark, sf_dir):
    return _said(spark, sf_dir, "SELECT * FROM canonical_baseline()")


@query(ORACLES["tf13_ean_groups"])
def sql13_exact_ean_groups(spark, sf_dir):
    return _said(spark, sf_dir, "SELECT * FROM exact_ean_groups()")


@query(f"""
    WITH {base.CATALOGUE}
    SELECT id, lower(name) AS folded, {base._sql_key("name")} AS key, {base._sql_normal_key(base._sql_key("name"))} AS normal_key, regexp_matches(lower(name), '\\b(bio|biologisch|biologische|organic)\\b') AS organic,
           {base._sql_norm("name")} AS norm, {base._sql_variant("name")} AS variant, CASE WHEN ean IS NOT NULL THEN lpad(ean, 14, '0') END AS ean_norm
    FROM catalogue
""")
def sql_name_keys(spark, sf_dir):
    return _said(spark, sf_dir, """
        SELECT id, fold_text(name) AS folded, canonical_key(name) AS key, normalize_canonical_key(canonical_key(name), name) AS normal_key, name_is_organic(name) AS organic,
               catalog_norm(name) AS norm, variant_signature(name) AS variant, normalize_ean(ean) AS ean_norm
        FROM catalog_products""")  # fmt: skip


@query(f"WITH {base.LANDED} SELECT external_id, name, price, base_price_unit FROM silver WHERE store = 'jumbo'")
def sql1_silver_of_a_store(spark, sf_dir):
    sql_functions.register(spark, base.catalogue(spark, sf_dir), silver.silver(base._bronze(spark, sf_dir)))
    return spark.sql("SELECT external_id, name, price, base_price_unit FROM silver_products('jumbo')")
