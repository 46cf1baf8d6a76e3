"""Queries of single fields. Texts as stores write them are dealt over the products, and what should be read in each stands beside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kassabon.functions import dates, jsons, labels, media, numbers, text, web
from kassabon.operators import keyed

from .registry import query, table


def _dealt(given: list, key: str = "p_partkey") -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in given]), (F.col(key) % len(given) + 1).cast("int"))


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def _sql_dealt(given: list, key: str = "p_partkey") -> str:
    return f"[{', '.join(map(_quoted, given))}][CAST({key} % {len(given)} + 1 AS INT)]"


PACKS = [
    ("500 g", 0.5, "kg"), ("6 x 330 ml", 1.98, "l"), ("2,5 kilo", 2.5, "kg"), ("75 cl", 0.75, "l"), ("250 g of 300 g", None, None), ("per stuk", 1, "stuk"),
    ("7 rollen", 7, "stuk"), ("ca. 400 t/m 500 g", None, None), ("3x2 liter", 6, "l"), ("doos", None, None), ("", None, None), (None, None, None), ("2 × 4 capsules", 8, "stuk"), ("0 g per stuk", 1, "stuk"),
]


@query(f"""
    WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(12, 2)) END AS price, {_sql_dealt([q for _, q, _ in PACKS])} AS q, {_sql_dealt([u for _, _, u in PACKS])} AS u FROM part),
         v AS (SELECT id, u, CAST(round_even(CAST(price AS DOUBLE) / q, 2) AS DECIMAL(12, 2)) AS value FROM p)
    SELECT id, value, CASE WHEN value IS NOT NULL THEN u END AS unit, CASE WHEN value IS NOT NULL THEN CAST(value AS VARCHAR) || '/' || u ELSE '' END AS shown FROM v
""")
def num9_base_unit_price(spark, sf_dir):
    price = F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice").cast("decimal(12,2)"))
    got = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), numbers.base_unit_price(_dealt([p for p, _, _ in PACKS]), price).alias("x"))
    return got.select("id", "x.value", "x.unit", F.col("x.text").alias("shown"))


MONEY = [("€ 1,99", 199), ("1.234,56 euro", 123456), ("1,234.56", 123456), ("1.234", 123400), ("2.5", 250), ("-3,00", None), ("gratis", None), ("", None), (None, None), ("0,005", 1), ("voor 12", 1200)]
AMOUNTS = [("1,50", "1.5"), ("2.000", "2"), ("100", "100"), ("0.125", "0.125"), ("x", None), (None, None)]
SECONDS = [("90", 90.0), ("61000", 61.0), ("1000", 1000.0), ("x", None)]
AVAILABLE = [("", True), ("Nee", False), ("0", False), ("OutOfStock", False), ("op voorraad", True), (None, True), ("niet  beschikbaar", False)]


@query(f"""
    SELECT p_partkey AS id, CAST({_sql_dealt([c for _, c in MONEY])} AS INT) AS cents, {_sql_dealt([n for _, n in AMOUNTS])} AS plain, CAST({_sql_dealt([s for _, s in SECONDS])} AS DOUBLE) AS seconds,
           CAST({_sql_dealt([int(a) for _, a in AVAILABLE])} AS BOOLEAN) AS available, round(p_retailprice / 100, 0) AS first_finite
    FROM part
""")
def num_texts(spark, sf_dir):
    given = [_dealt([t for t, _ in pairs]) for pairs in (MONEY, AMOUNTS, SECONDS, AVAILABLE)]
    finite = numbers.first_finite(F.lit("NaN?"), F.lit(None), F.round(F.col("p_retailprice") / 100, 0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), numbers.money_cents(given[0]).alias("cents"), numbers.plain_number(given[1]).alias("plain"), numbers.seconds(given[2]).alias("seconds"), numbers.is_available(given[3]).alias("available"), finite.alias("first_finite"))


JSON_TEXTS = [('["a", "", "b c"]', "a > b c"), ('{"x": "1", "y": "none", "z": "3"}', "1 > 3"), ("[]", None), ("[broken", "[broken"), ("plain", "plain"), ("", None), (None, None)]
ONIONS = [("2 Green Onions", "bosui", "2 bosui"), ("lente-uitjes, fijn", "bosui", "bosui, fijn"), ("scallion oil", "bosui", "bosui oil"), ("onion", None, "onion"), ("lente  ui", "bosui", "lente  ui"), (None, None, None)]
FIELDS = [("servings,quantities", "porties, hoeveelheden"), ("steps", "steps"), ("ingredients", "ingredienten")]


@query(f"""
    SELECT p_partkey AS id, {_sql_dealt([x for _, x in JSON_TEXTS])} AS said, {_sql_dealt([x for _, x, _ in ONIONS])} AS known, {_sql_dealt([x for _, _, x in ONIONS])} AS renamed, {_sql_dealt([x for _, x in FIELDS])} AS missing,
           concat_ws(' ', CASE WHEN p_size % 3 <> 0 THEN CAST(p_size % 3 AS VARCHAR) END, CASE WHEN p_partkey % 2 = 0 THEN 'g' END, p_name) AS raw
    FROM part
""")
def txt_recipe_fields(spark, sf_dir):
    onion = _dealt([x for x, _, _ in ONIONS])
    name = text.known_ingredient(onion)
    raw = text.raw_text((F.col("p_size") % 3).cast("double"), F.when(F.col("p_partkey") % 2 == 0, "g").otherwise(""), F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), web.json_list_text(_dealt([x for x, _ in JSON_TEXTS])).alias("said"), name.alias("known"), text.with_known_name(onion, name).alias("renamed"),
        text.missing_fields(F.split(_dealt([x for x, _ in FIELDS]), ",")).alias("missing"), raw.alias("raw"),
    )


SCORES = [("Nutri-Score b", "B"), ("https://x/nutriscore_E.png", "E"), ("nutri score: e", None), ("nutriscore-abc", None), ("NUTRISCORE  A", "A"), (None, None)]
STOCK = [("https://schema.org/InStock", "hier te koop", "InStock", True), ("https://schema.org/OutOfStock", "", "OutOfStock", False), ("InStock", "DIT product is niet meer leverbaar", "InStock", False), (None, "", None, None), (" ", None, None, None)]


@query(f"""
    SELECT id, score, label, have, CASE WHEN price IS NULL THEN 'missing_price' WHEN NOT have THEN 'sold_out_price_visible' ELSE 'visible_price' END AS status, logo_score, logos
    FROM (
        SELECT p_partkey AS id, {_sql_dealt([s for _, s in SCORES])} AS score, {_sql_dealt([x for _, _, x, _ in STOCK])} AS label,
               CAST({_sql_dealt([None if x is None else int(x) for _, _, _, x in STOCK])} AS BOOLEAN) AS have, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price,
               coalesce({_sql_dealt([s for _, s in SCORES])}, 'D') AS logo_score, 2::INT AS logos
        FROM part
    )
""")
def txt_scores_and_stock(spark, sf_dir):
    score = _dealt([x for x, _ in SCORES])
    label, page = _dealt([x for x, _, _, _ in STOCK]), _dealt([x for _, x, _, _ in STOCK])
    have = labels.in_stock(label, page)
    logo = lambda d, i: F.struct(d.cast("string").alias("description"), i.cast("string").alias("image"))
    own, rest = F.array(logo(score, F.lit("a.png"))), F.array(logo(score, F.lit("a.png")), logo(F.lit("Bio"), F.lit("nutriscore-d.svg")))
    both = labels.all_logos(own, rest)
    price = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), labels.nutriscore(score).alias("score"), labels.availability_label(label).alias("label"), have.alias("have"), labels.price_status(price, have).alias("status"), labels.logo_nutriscore(both).alias("logo_score"), F.size(both).alias("logos"))


@query("""
    SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'note=per portie' WHEN 1 THEN 'Energie: per 100g=' || p_size || ', value_2=x' ELSE 'Vet: per 100g=' || p_size END AS nutrition,
           CASE WHEN p_size % 2 = 0 THEN 'Bonus | 1+1' ELSE 'Bonus' END AS label,
           CASE p_size % 3 WHEN 0 THEN '1.5/kg | 2.0' WHEN 1 THEN '2.0' END AS base, CASE p_size % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 END::DOUBLE AS base_value, CASE WHEN p_size % 3 = 0 THEN 'kg' END AS base_unit,
           p_brand AS roots, p_type || ',' || p_name AS paths
    FROM part
""")
def jsn_product_labels(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    rows = F.when(k % 3 == 0, F.array(F.array(F.lit("per portie")), F.array().cast("array<string>"))).when(k % 3 == 1, F.array(F.array(F.lit("Energie"), size, F.lit("x")))).otherwise(F.array(F.array(F.lit("Vet"), size)))
    record = F.get(labels.nutrition_records(F.array(F.lit("naam"), F.lit("per 100g")), rows), 0)
    values = F.array_join(F.transform(F.map_entries(record["values"]), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    nutrition = F.coalesce(F.concat(F.lit("note="), record["note"]), F.concat(record["name"], F.lit(": "), values))
    tags = F.create_map(F.lit("a"), F.lit(" Bonus "), F.lit("b"), F.when(F.col("p_size") % 2 == 0, "1+1").otherwise(" "))
    price = lambda v, u: F.struct(F.lit(v).cast("double").alias("value"), F.lit(u).cast("string").alias("unit"))
    base = labels.base_prices(F.when(F.col("p_size") % 3 == 0, F.array(price(1.5, "kg"), price(2.0, None))).when(F.col("p_size") % 3 == 1, F.array(price(None, None), price(2.0, None))).otherwise(F.array(price(None, None))))
    paths = labels.category_paths(F.create_map(F.lit("lvl2"), F.array("p_name"), F.lit("lvl0"), F.array(F.col("p_brand"), F.lit("")), F.lit("lvl1"), F.array("p_type")))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), nutrition.alias("nutrition"), labels.price_label(tags).alias("label"), base["text"].alias("base"), base["value"].alias("base_value"), base["unit"].alias("base_unit"),
        F.array_join(paths["roots"], ",").alias("roots"), F.array_join(paths["paths"], ",").alias("paths"),
    )


LINKS = [
    ("https://www.instagram.com/reel/C1/", True, True, False), ("https://m.facebook.com/x/videos/12/", False, True, False), ("https://fb.watch/abc", False, True, False), ("https://a.org/p?u=1&v=2", False, True, False),
    ("https://a.org/p?video=2#?v=1", False, False, False), ("https://cdn.org/A.MP4?x=.png", False, False, True), ("https://cdn.org/a.mp4.png", False, False, False), ("no address", False, False, False),
]


@query(f"""
    SELECT p_partkey AS id, {", ".join(f"CAST({_sql_dealt([int(x[i]) for x in LINKS])} AS BOOLEAN) AS {n}" for i, n in ((1, "reel"), (2, "video_page"), (3, "file")))} FROM part
""")
def url3_link_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _dealt([x[0] for x in LINKS]).alias("link"))
    return rows.select("id", *[f(F.col("link")).alias(n) for n, f in (("reel", media.is_reel), ("video_page", media.is_video_page), ("file", media.is_media_file))])


@query("""
    SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'b.png' ELSE 'a.png' END AS largest, CASE WHEN p_size % 2 = 0 THEN 'https://x/2.mp4' ELSE 'https://x/1.webm' END AS video,
           CASE WHEN p_size % 2 = 0 THEN 'w400' ELSE 'last' END AS sized, CASE WHEN p_size % 2 = 0 THEN 'main' ELSE 'one' END AS main, CASE p_size % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'o' ELSE 's' END AS asset,
           CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'one two' END AS spoken, CASE WHEN p_size % 2 = 0 THEN 'https://ok.org/c.vtt' END AS captions
    FROM part
""")
def web_media(spark, sf_dir):
    even = F.col("p_size") % 2 == 0

    def rows(names: str, *given) -> Column:
        return F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names.split(), g, strict=True)]) for g in given])

    images = F.when(even, rows("url width height", ("a.png", 10, 10), ("b.png", 21, 5), ("c.png", 2, 50), ("", 900, 900), ("d.png", F.lit(None).cast("int"), 5))).otherwise(rows("url width height", ("a.png", 10, 10), ("b.png", F.lit(None).cast("int"), 5), ("c.png", 2, 50)))
    videos = F.array(F.lit("https://x/page"), F.lit("https://x/1.webm"), F.when(even, "https://x/2.mp4").otherwise("https://x/2.mov"), F.lit("https://x/3.mp4?"))
    videos = F.when(even, videos).otherwise(F.slice(videos, 1, 3))
    sized = rows("url width", ("w200", 200), ("w400", F.when(even, 400)), ("last", 800))
    main = rows("image mainImage", ("", True), ("one", False), ("main", even))
    third = F.col("p_size") % 3
    assets = rows("type url", ("seal", "s"), ("other", F.when(third != 2, "o").otherwise("")), ("primary", F.when(third == 0, "p")))
    found = F.when(even, '{"a": {"b": ["http://localhost/x", "text", "https://ok.org/c.vtt"]}}').otherwise('{"a":[[[[["https://too.deep/"]]]]], "b": 3}')
    given = {"images": images, "videos": videos, "sized": sized, "main": main, "assets": assets, "text": found, "said": F.when(even, F.col("p_name")).otherwise(" "), "segments": rows("text", ("one",), (" ",), ("two ",))}
    got = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[c.alias(n) for n, c in given.items()])
    c = F.col
    return got.select(
        "id", media.largest_image(c("images")).alias("largest"), media.preferred_video(c("videos")).alias("video"), media.image_of_width(c("sized")).alias("sized"), media.main_image(c("main")).alias("main"),
        media.asset_image(c("assets")).alias("asset"), media.transcript([c("said")], c("segments")).alias("spoken"), media.first_safe_url(c("text")).alias("captions"),
    )


@query("SELECT o_orderkey, array_to_string(list_transform(range(0, 7), lambda i: strftime(CAST(o_orderdate AS DATE) + CAST(i AS INT), '%Y-%m-%d')), ',') AS days FROM orders")
def dat5_next_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(dates.next_days(F.col("o_orderdate")), ",").alias("days"))


@query("""
    WITH t AS (SELECT DISTINCT p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS tag FROM part)
    SELECT p_brand, array_to_string(list(tag ORDER BY lower(tag), tag DESC), ',') AS tags FROM t GROUP BY p_brand
""")
def srt8_tags_in_language_order(spark, sf_dir):
    tag = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(tag).alias("tags"))
    return rows.select("p_brand", F.array_join(keyed.in_language_order(F.col("tags")), ",").alias("tags"))


HTML = [
    ("<p>Salt &amp; pepper</p><script>x < 1</script> <b>now</b>", "Salt & pepper now", "Salt & pepper now"), ("caf&eacute; &#233;&#xE9; &#128512;", "caf&eacute; éé 😀", "café éé 😀"), ("a<br/>b\n c", "a b c", "a b c"), ("&amp;lt; &#x; &# &#55296;", "< &#x; &# &#55296;", "&lt; &#x; &# �"), ("", "", None), (None, None, None),
]
MARKS = [("Crème fraîche ﬁn", "Creme fraiche fin"), ("jalapeño-pepers", "jalapeno-pepers"), ("½ ei", "1⁄2 ei"), (None, None)]
PATHS = [("images\\1.png", "https://f.example/images/1.png"), ("/a/b.png", "https://f.example/a/b.png"), ("https://x.org/c.png", "https://x.org/c.png"), (None, None)]
SUFFIXES = [("https://x.org/p/kaas-123", "123"), ("https://x.org/p/45.html?x=9", "45"), ("https://x.org/p/45/", "45"), ("https://x.org/p/a45", None), (None, None)]
PARTS = [("12", "5", 12.50), ("3", None, 3.00), ("€ 1", "99", 1.99), ("", "10", None), ("0", "05", 0.05)]
POSITIVE = [("1,5", 1.5), ("-2", None), ("0", None), ("x", None), ("7", 7.0), (None, None)]


@query(f"""
    SELECT p_partkey AS id, {_sql_dealt([x for _, x, _ in HTML])} AS bare, {_sql_dealt([x for _, _, x in HTML])} AS said, {_sql_dealt([x for _, x in MARKS])} AS unmarked, {_sql_dealt([x for _, x in PATHS])} AS file, {_sql_dealt([x for _, x in SUFFIXES])} AS suffix,
           CAST({_sql_dealt([x for _, _, x in PARTS])} AS DECIMAL(12, 2)) AS price, CAST({_sql_dealt([x for _, x in POSITIVE])} AS DOUBLE) AS positive
    FROM part
""")
def txt_page_fields(spark, sf_dir):
    names = {"html": [x for x, _, _ in HTML], "marked": [x for x, _ in MARKS], "path": [x for x, _ in PATHS], "url": [x for x, _ in SUFFIXES], "euros": [x for x, _, _ in PARTS], "cents": [x for _, x, _ in PARTS], "number": [x for x, _ in POSITIVE]}
    c = F.col
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), *[_dealt(given).alias(n) for n, given in names.items()])
    return rows.select(
        "id", web.strip_html(c("html")).alias("bare"), web.page_text(c("html")).alias("said"), web.without_marks(c("marked")).alias("unmarked"), web.file_url(c("path"), "https://f.example/").alias("file"),
        web.id_suffix(c("url")).alias("suffix"), numbers.price_from_parts(c("euros"), c("cents")).alias("price"), numbers.positive_number(c("number")).alias("positive"),
    )


LD = '[{"@type": "Thing"}, {"@graph": [{"@type": ["Recipe", "Dish"], "name": "N", "recipeInstructions": [{"@type": "HowToSection", "itemListElement": [{"text": "Cut.\\n Mix."}]}, "Bake."]}]}]'


@query("""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS recipes, CASE WHEN page_id % 3 = 0 THEN 'page ' || page_id END AS name, CASE WHEN page_id % 3 = 0 THEN 'Cut.|Mix.|Bake.' END AS steps,
           CASE WHEN page_id % 3 = 0 THEN 'https://x.org/' || page_id || '?a=1&b=2' END AS location
    FROM pages
""")
def jsn_linked_data(spark, sf_dir):
    k = F.col("page_id")
    ld = F.replace(F.lit(LD), F.lit('"N"'), F.concat(F.lit('"page '), k.cast("string"), F.lit('"')))
    block = F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script><loc> https://x.org/"), k.cast("string"), F.lit("?a=1&amp;b=2\n</loc>"))
    rows = table(spark, sf_dir, "pages").select(k, F.when(k % 3 == 0, F.concat("html", block)).otherwise(F.col("html")).alias("html"))
    rows = rows.select(k, F.get(F.filter(web.json_ld(F.col("html")), lambda x: x.contains("recipeInstructions")), 0).alias("ld"), web.sitemap_locations(F.col("html")).alias("locations"))
    rows = rows.select(k, "locations", web.typed_objects(F.coalesce("ld", F.lit("")), F.lit("Recipe")).alias("found"))
    one = F.get("found", 0)
    steps = web.instruction_steps(F.get_json_object(one, "$.recipeInstructions"))
    return rows.select(k, F.size("found").alias("recipes"), web.first_value(one, F.lit("name")).alias("name"), F.nullif(F.array_join(steps, "|"), F.lit("")).alias("steps"), F.get("locations", 0).alias("location"))


@query("""
    SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 3 = 1 THEN 'second' ELSE 'derived-' || left(sha256(p_name || '|' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END), 24) END AS external_id,
           CASE WHEN p_size % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'old' AS b, CASE WHEN p_size % 2 = 0 THEN 'more' END AS c,
           'Name: ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Brand: ' || p_brand ELSE '' END AS lines, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'none' END AS title, p_name || ';' || p_brand AS joined
    FROM part
""")
def jsn_ids_and_lines(spark, sf_dir):
    k, even = F.col("p_partkey"), F.col("p_size") % 2 == 0
    ids = [F.when(k % 3 == 0, k.cast("string")).otherwise(" "), F.when(k % 3 == 1, F.lit(" second "))]
    both = jsons.merged(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old")), F.create_map(F.lit("a"), F.when(even, "new"), F.lit("b"), F.lit(""), F.lit("c"), F.when(even, "more")))
    brand = F.when(even, F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), jsons.external_id(ids, F.col("p_name"), brand).alias("external_id"), both.alias("m"), "p_name", "p_brand", brand.alias("brand"), F.when(even, F.concat(F.lit("\n "), "p_name", F.lit("\nrest"))).otherwise("\n").alias("post"))
    return rows.select(
        "id", "external_id", *[F.try_element_at("m", F.lit(x)).alias(x) for x in "abc"], text.labelled_lines([("Name", F.col("p_name")), ("Brand", F.coalesce("brand", F.lit(" ")))]).alias("lines"),
        text.post_title(F.col("post"), F.lit("none")).alias("title"), text.unique_joined(F.array("p_name", "p_brand", F.concat(F.lit(" "), "p_name"), F.lit(""))).alias("joined"),
    )


@query("""
    WITH w AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ')) AS q, list_distinct(list_concat(string_split(p_name, ' ')[2:], [lower(p_type)])) AS n, p_name, p_size, p_brand FROM part),
         o AS (SELECT *, len(list_intersect(q, n))::DOUBLE / len(q) AS share FROM w)
    SELECT id, share, round(greatest(0, round(share + CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN p_brand = 'Brand#13' THEN 0.1 ELSE 0 END - CASE WHEN p_size % 3 = 0 THEN 0.5 ELSE 0 END, 4)), 4)::DOUBLE AS score,
           CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN p_size || ' g' WHEN p_size % 4 = 2 THEN p_size || '.5' ELSE p_size || '.0' || CASE WHEN false THEN '' ELSE ' l' END END AS shown
    FROM o
""")
def txt_scores_of_names(spark, sf_dir):
    c, size = F.col, F.col("p_size")
    name = F.concat_ws(" ", F.slice(F.split("p_name", " "), 2, 9)[0], F.lower("p_type"))
    category = F.when(size % 2 == 0, c("p_name")).otherwise("other")
    quantity = F.when(size % 4 == 0, None).when(size % 4 == 1, size.cast("double")).when(size % 4 == 2, size + 0.5).otherwise(size + 0.04)
    unit = F.when(size % 4 == 1, "g").when(size % 4 == 3, "l").otherwise("")
    return table(spark, sf_dir, "part").select(
        c("p_partkey").alias("id"), text.token_overlap(c("p_name"), name).alias("share"), text.product_score(c("p_name"), name, category, c("p_brand"), size % 3 != 0, "Brand#13").alias("score"), numbers.format_quantity(quantity, unit).alias("shown"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS read, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS from_seconds FROM events")
def dat_time_stamps(spark, sf_dir):
    shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    given = F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no time")
    seconds = F.when(F.col("event_id") % 2 == 0, F.unix_timestamp("ts").cast("string")).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", shown(dates.iso_timestamp(given, F.col("ts"))).alias("read"), shown(dates.epoch(seconds)).alias("from_seconds"))
