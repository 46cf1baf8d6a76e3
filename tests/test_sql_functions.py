"""SQL functions against the column functions and DataFrame functions that they stand for."""

import pytest
from kassabon.functions import numbers, text, trigram
from kassabon.plans import search, sql_functions
from pyspark.sql import functions as F

ODD = [None, "", "  ", "Éa", "AH Verse Melk 500 ml", "Cola regular", "cola", "Bio  light 0,0", "banaan", "Kaas 48%", "kaas", "Tomaten 2x3", "ï-Ÿ é", "l'eau \\ d", "€ 1.234,5", "-1,25", ".5", "1-2", "12345678", "00000000", " 8712345678906 ", "Liter", "KILO", "bolt", "red bolts", "12", "x", "ß", "日本 茶", "liter 'x'"]
PRODUCTS = [
    ("1", "ah", "Halfvolle melk", 120, 60, True, "00000012345678", "melk", "zuivel"),
    ("2", "jumbo", "Halfvolle melk", 110, 55, True, "00000012345678", "melk", "zuivel"),
    ("3", "dirk", "Melk houdbaar", None, None, True, "00000012345678", "melk", None),
    ("4", "plus", "Melkchocolade", 250, None, True, None, "chocolade", "snoep"),
    ("5", "plus", "Melk", 90, 45, False, "00000012345678", "melk", "zuivel"),
    ("6", "spar", "Karnemelk", 0, 10, True, None, "", None),
    ("7", "aldi", "Halfvolle melk", 110, 55, True, None, "halfvolle_melk", "zuivel"),
    ("8", "aldi", "", 5, 5, True, None, None, None),
    ("9", "ah", None, 5, 5, True, None, None, None),
]


@pytest.fixture(scope="module")
def products(spark):
    rows = spark.createDataFrame(PRODUCTS, "id string, store_id string, name string, current_price_cents int, unit_price_cents int, is_available boolean, ean_norm string, canonical_key string, ingredient_id string")
    rows = rows.withColumn("name_search", text.fold_text(F.col("name"))).withColumn("canonical_name", F.col("name")).withColumn("is_organic", F.lit(False)).withColumn("exact_group_key", F.when(F.col("id") < "3", "g"))
    rows = rows.cache()
    sql_functions.register(spark, rows)
    return rows


def test_scalars(spark):
    sql_functions.register_scalars(spark)
    pairs = [(a, b) for a in ODD for b in ("", "Bio cola banaan yoghurt", "red bolts", None)]
    spark.createDataFrame(pairs, "x string, n string").createOrReplaceTempView("odd")
    x, n = F.col("x"), F.col("n")
    same = {
        "fold_text(x)": text.fold_text(x), "search_form(x)": text.search_form(x), "catalog_norm(x)": text.catalog_norm(x), "canonical_key(x)": text.canonical_key(x),
        "normalize_canonical_key(x, n)": text.normalize_canonical_key(x, n), "name_is_organic(x)": text.name_is_organic(x), "variant_signature(x)": text.variant_signature(x),
        "to_numeric(x)": numbers.to_numeric(x), "norm_unit(x)": numbers.norm_unit(x), "normalize_ean(x)": numbers.normalize_ean(x), "trigrams(x)": trigram.trigrams(x),
        "word_similarity(x, n)": trigram.word_similarity(F.coalesce(x, F.lit("")), F.coalesce(n, F.lit(""))), "to_cents(to_numeric(x))": numbers.to_cents(numbers.to_numeric(x)),
    }
    heads = [h.replace("word_similarity(x, n)", "word_similarity(coalesce(x, ''), coalesce(n, ''))") for h in same]
    rows = spark.sql("SELECT x, n, " + ", ".join(f"{h} AS g{i}" for i, h in enumerate(heads)) + " FROM odd")
    rows = rows.select("x", "n", *[f"g{i}" for i in range(len(heads))], *[c.alias(f"w{i}") for i, c in enumerate(same.values())])
    for r in rows.collect():
        for i, head in enumerate(heads):
            assert r[f"g{i}"] == r[f"w{i}"], (head, r.x, r.n)


SEARCHES = ["melk", "Halfvole mlek", "melkchoc", "", "   ", "de", "xyz", "MELK halfvolle!", "12"]


def test_search(spark, products):
    asked = spark.createDataFrame([(s, s) for s in SEARCHES], "query_id string, query_text string")
    asked.createOrReplaceTempView("asked")
    order = lambda rows: sorted((r.query_id, r["rank"], r.id, r.match_score) for r in rows.collect())
    want = order(search.search_many(products, asked, 8))
    assert order(spark.sql("SELECT a.query_id, p.* FROM asked a, LATERAL search_products(a.query_text) p")) == want and len(want) > 10
    for store, count in (("ah", 8), (None, 1), (None, 0), ("none", 3)):
        want = order(search.search_many(products, asked, count, store))
        given = "NULL" if store is None else f"'{store}'"
        assert order(spark.sql(f"SELECT a.query_id, p.* FROM asked a, LATERAL search_products(a.query_text, {given}, {count}) p")) == want


@pytest.mark.parametrize("said", ["melk", "Halfvolle melk", "xyz", "", "melkchoc"])
def test_offers(spark, products, said):
    got = spark.sql(f"SELECT id, match_score, offer_rank FROM search_product_offers('{said}') ORDER BY place").collect()
    want = search.search_offers(products, said).select("id", "match_score", "offer_rank").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("product", ["1", "4", "5", "6", "8", "none"])
def test_offers_of_a_product(spark, products, product):
    ids = lambda rows: sorted(r.id for r in rows.collect())
    assert ids(spark.sql(f"SELECT * FROM product_price_offers('{product}')")) == ids(search.price_offers(products, product))
    assert ids(spark.sql(f"SELECT * FROM product_group_offers('{product}')")) == ids(search.group_offers(products, product))
    for kind in ("exact", "substitute"):
        assert ids(spark.sql(f"SELECT * FROM get_product_group_offers('{product}', '{kind}')")) == ids(search.kind_offers(products, product, kind))


def test_no_products(spark, products):
    sql_functions.register(spark, products.limit(0))
    assert spark.sql("SELECT * FROM search_products('melk')").count() == 0
    assert spark.sql("SELECT * FROM search_product_offers('melk')").count() == 0
    sql_functions.register(spark, products)
