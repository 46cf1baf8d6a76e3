"""Functions on small values."""

from kassabon.functions import jsons, web
from kassabon.plans import recipes, search
from kassabon.sources import sinks
from pyspark.sql import functions as F


def values(spark, rows, shape, column):
    return [r[0] for r in spark.createDataFrame(rows, shape).select(column).collect()]


def test_hosts(spark):
    urls = ["http://u@10.0.0.1/", "https://user:p@127.0.0.1/x", "http://[::1]/", "http://a.LOCAL", "http://172.32.0.1/", "https://www.pinterest.de/pin/1", "https://x.org:8080/?a=http://10.0.0.1", "mailto:a@b.c", None]
    got = values(spark, [(u,) for u in urls], "url string", web.safe_url(F.col("url")))
    assert got == [None, None, None, None, urls[4], urls[5], urls[6], None, None]
    assert values(spark, [(urls[5],), ("https://vm.tiktok.com/1",), ("https://example.org/",)], "url string", web.platform(F.col("url"))) == ["pinterest", "tiktok", "blog"]


def test_subtitles(spark):
    text = "webvtt\nKind: captions\n\n1\n00:01.000  --> 00:02,000\n<c>salt</c> &amp; pepper\nsalt &amp; pepper\na --> b\r\nNOTEBOOK is here\nnote x\n"
    assert values(spark, [(text,), (None,)], "x string", web.subtitle_text(F.col("x"))) == ["Kind: captions salt & pepper a --> b NOTEBOOK is here", None]


def test_recipe_signal(spark):
    long = "Mix everything well in a large bowl and then bake it until it is golden brown. Directions: 2 tbsp of oil, 1 tsp salt"
    rows = [
        ("blog", "Cake", long, None, None, None, False, True),
        ("blog", None, "minuten " * 20, None, None, None, False, False),
        ("blog", "Cake", "2 tbsp", None, None, None, False, False),
        ("instagram", "Instagram", long, None, None, "x" * 80, True, False),
        ("facebook", "Log into Facebook", long, None, None, None, False, False),
        ("blog", "Log into Facebook", long, None, None, None, False, True),
        ("blog", None, None, None, None, "said " * 20, None, True),
        ("blog", None, None, None, None, None, True, True),
    ]
    signal = recipes.usable_signal(*[F.col(c) for c in ("platform", "title", "about", "site", "embedded", "said", "structured")])
    frame = spark.createDataFrame(rows, "platform string, title string, about string, site string, embedded string, said string, structured boolean, want boolean")
    assert all(r["got"] == r["want"] for r in frame.select(signal.alias("got"), "want").collect())


def test_row_hash_of_equal_objects(spark):
    texts = [('{"b": 1, "a": {"y": [1, 2], "x": null}}',), ('{"a":{"x":null,"y":[1,2]},"b":1}',), ('{"b":1,"a":{"y":[2,1],"x":null}}',), ("no json",)]
    got = values(spark, texts, "x string", jsons.row_hash(F.lit("s"), F.col("x")))
    assert got[0] == got[1] != got[2] and len(set(got)) == 3
    assert values(spark, texts[:1], "x string", jsons.canonical(F.col("x"))) == [texts[1][0]]


def test_upsert_settles_repeats(spark):
    rows = [("a", i) for i in range(50)]
    old = spark.createDataFrame([("b", 1)], "k string, v long")
    new = spark.createDataFrame(rows, "k string, v long")
    got = [sorted(map(tuple, f(old, t, ["k"]).collect())) for f in (sinks.upsert, sinks.insert_new) for t in (new, new.repartition(7), new.orderBy(F.desc("v")))]
    assert got[0] == got[1] == got[2] and got[3] == got[4] == got[5]


def test_offers_of_a_kind(spark):
    rows = [("1", "g", None, True, 300, "a"), ("2", "g", None, True, 200, "b"), ("3", None, None, True, 100, "c"), ("4", "g", None, False, 50, "d"), ("g", None, None, True, 1, "e")]
    products = spark.createDataFrame(rows, "id string, exact_group_key string, ingredient_id string, is_available boolean, current_price_cents int, store_id string")
    assert [r["id"] for r in search.kind_offers(products, "1").collect()] == ["2", "1"]
    assert [r["id"] for r in search.kind_offers(products, "3").collect()] == ["3"]
    assert search.kind_offers(products, "1").columns == products.columns
