"""The library's queries over whole tables, and the same results in plain SQL.

``part`` stands for a catalogue of products: a part is a product of one of the six stores, its
retail price the shelf price. ``orders`` and ``lineitem`` stand for lists and their items,
``events`` for scraped rows. Every query goes over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kassabon.functions import dates, jsons, numbers, text, web
from kassabon.functions import words as W
from kassabon.operators import keyed
from kassabon.sources import sinks
from kassabon.sources.folders import new_path

from . import answer_queries, canonical, field_queries, grouping, landing_queries, page_queries, recipe_queries, recipes, search, silver, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES, dealt_out, query, table  # noqa: F401

# ---------------------------------------------------------------- the catalogue


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products made of ``part``."""
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (k % len(ENDINGS) + 1).cast("int"))
    base = F.when(k % 4 != 3, F.col("p_retailprice") / (k % 3 + 1))
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"),
        F.element_at(F.array(*[F.lit(s) for s in W.STORES]), (k % 6 + 1).cast("int")).alias("store_id"),
        k.cast("string").alias("external_id"),
        F.concat("p_name", ending).alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.round(F.col("p_retailprice") * 100).cast("int").alias("current_price_cents"),
        (F.col("p_size") * 10).cast("int").alias("unit_price_cents"),
        (k % 11 != 0).alias("is_available"),
        F.when(k % 7 != 0, (10_000_000 + k % 300).cast("string")).alias("ean"),
        F.col("p_retailprice").alias("price"),
        base.alias("base_price"),
        F.when(base.isNotNull(), F.when(k % 2 == 0, "kg").otherwise("l")).alias("base_price_unit"),
        text.fold_text(F.concat("p_name", ending)).alias("name_search"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("canonical_key"),
        F.col("p_name").alias("canonical_name"),
        (k % 5 == 0).alias("is_organic"),
        numbers.normalize_ean(F.when(k % 7 != 0, (10_000_000 + k % 300).cast("string"))).alias("ean_norm"),
    )


ENDINGS = (" Bio", " 6-pack", " 330 ml", " Zero", "")
_in = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
CATALOGUE = f"""
    catalogue AS (
        SELECT *, lower(name) AS name_search, CASE WHEN ean IS NOT NULL THEN lpad(ean, 14, '0') END AS ean_norm,
               CASE WHEN base_price IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN 'kg' ELSE 'l' END END AS base_price_unit
        FROM (
            SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey AS VARCHAR) AS external_id,
                   [{_in(W.STORES)}][CAST(p_partkey % 6 + 1 AS INT)] AS store_id,
                   p_name || [{_in(ENDINGS)}][CAST(p_partkey % {len(ENDINGS)} + 1 AS INT)] AS name, p_brand AS brand, p_type AS category,
                   CAST(round(p_retailprice * 100) AS INT) AS current_price_cents, CAST(p_size * 10 AS INT) AS unit_price_cents,
                   p_partkey % 11 <> 0 AS is_available, CASE WHEN p_partkey % 7 <> 0 THEN CAST(10000000 + p_partkey % 300 AS VARCHAR) END AS ean,
                   p_retailprice AS price, CASE WHEN p_partkey % 4 <> 3 THEN p_retailprice / (p_partkey % 3 + 1) END AS base_price,
                   replace(p_name, ' ', '_') AS canonical_key, p_name AS canonical_name, p_partkey % 5 = 0 AS is_organic
            FROM part
        )
    )
"""


def silver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).withColumnRenamed("store_id", "store")


# ---------------------------------------------------------------- SQL of the text functions


def _sql_norm(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"


def _sql_key(x: str) -> str:
    left_out = _in(W.KEY_STORES + W.KEY_UNITS + W.KEY_NOISE)
    shapes = "^[0-9]+$|^[0-9]+(g|gr|gram|ml|cl|dl|kg|l|ltr|liter|st|stuks?|x|pack)$|^[0-9]+x[0-9]+"
    form = f"trim(regexp_replace(translate(lower({x}), '{W.ACCENTS}', '{W.PLAIN}'), '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g'))"
    return f"array_to_string(list_sort(list_filter(string_split({form}, ' '), lambda w: w <> '' AND w NOT IN ({left_out}) AND NOT regexp_matches(w, '{shapes}'))), ' ')"


def _sql_normal_key(x: str) -> str:
    k = f"regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
    cases = " ".join(f"WHEN {k} IN ({_in(spelt)}) THEN '{target}'" for target, spelt in W.KEY_SYNONYMS.items())
    return f"CASE {cases} ELSE {k} END"


def _sql_variant(x: str) -> str:
    flags = ", ".join(f"CASE WHEN regexp_matches(lower({x}), '\\b({p})\\b') THEN '{flag}' END" for flag, p in W.VARIANTS)
    return f"concat_ws('|', {flags})"


def _sql_pack(name: str) -> str:
    part = lambda label, p: f"'{label}' || nullif(regexp_extract(lower({name}), '{p}', 1), '')"
    sizes = r"[0-9]+([,.][0-9]+)?\s*(ml|cl|l|g|kg)"
    quantity = "'qty:' || CASE WHEN base_price > 0 THEN CAST(CAST(round(price / base_price, 2) AS DECIMAL(38, 2)) AS VARCHAR) END || ':' || coalesce(base_price_unit, 'unit')"
    parts = [quantity, part("pack:", r"\b([0-9]+)\s*[- ]?pack\b"), part("multi:", r"\b([0-9]+\s*x\s*[0-9]+([,.][0-9]+)?\s*(ml|cl|l|g|kg))"), part("size:", rf"\b({sizes})\b")]
    return f"coalesce(nullif(concat_ws('|', {', '.join(parts)}), ''), 'name:' || {_sql_norm(name)})"


# ---------------------------------------------------------------- names, numbers, pages, dates


@query(f"""
    WITH {CATALOGUE}
    SELECT id, lower(name) AS folded, {_sql_key("name")} AS key, {_sql_normal_key(_sql_key("name"))} AS normal_key,
           regexp_matches(lower(name), '\\b(bio|biologisch|biologische|organic)\\b') AS organic, {_sql_norm("name")} AS norm,
           {_sql_variant("name")} AS variant, {_sql_pack("name")} AS pack,
           trim(regexp_replace({_sql_norm("name")}, '\\b({"|".join(W.BRANDS)})\\b', '', 'g')) AS generic
    FROM catalogue
""")
def txt_name_keys(spark, sf_dir):
    n = F.col("name")
    key = text.canonical_key(n)
    return catalogue(spark, sf_dir).select(
        "id", text.fold_text(n).alias("folded"), key.alias("key"), text.normalize_canonical_key(key, n).alias("normal_key"), text.name_is_organic(n).alias("organic"),
        text.catalog_norm(n).alias("norm"), text.variant_signature(n).alias("variant"),
        text.pack_signature(n, F.col("price"), F.col("base_price"), F.col("base_price_unit")).alias("pack"), text.generic_name(n).alias("generic"),
    )


@query("""
    SELECT conv_id, turn, CAST(len(list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda w: trim(w)), lambda w: w <> '')) AS INT) AS lines,
           regexp_replace(regexp_replace(lower(trim(role)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS role_key,
           regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS normal
    FROM conversations
""")
def txt_cleaning(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.size(text.split_lines(F.col("text"))).alias("lines"), text.clean_key(F.col("role")).alias("role_key"), text.normalized_name(F.col("text")).alias("normal"))


@query("""
    WITH p AS (
        SELECT p_partkey AS id, p_size, '€ ' || replace(CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR), '.', ',') AS money,
               CAST(p_size % 6 + 1 AS VARCHAR) || ' x ' || CAST(p_size * 10 AS VARCHAR) || ' ml' AS pack, CAST(p_partkey + 1000000 AS VARCHAR) AS code
        FROM part
    )
    SELECT id, CAST(replace(replace(money, '€ ', ''), ',', '.') AS DECIMAL(12, 2)) AS amount,
           CASE WHEN length(code) BETWEEN 8 AND 14 THEN lpad(code, 14, '0') END AS ean,
           round((p_size % 6 + 1) * (p_size * 10) * 0.001, 6) AS qty, 'l' AS unit, CAST((p_size % 6 + 1) * (p_size * 10) AS DOUBLE) AS package_qty, 'ml' AS package_unit
    FROM p
""")
def num_prices(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("€ "), F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))).alias("money"),
        F.concat((F.col("p_size") % 6 + 1).cast("string"), F.lit(" x "), (F.col("p_size") * 10).cast("string"), F.lit(" ml")).alias("pack"),
        (F.col("p_partkey") + 1_000_000).cast("string").alias("code"),
    )
    base, pack = numbers.quantity_base(F.col("pack")), numbers.package(F.col("pack"))
    return p.select("id", numbers.to_numeric(F.col("money")).cast("decimal(12,2)").alias("amount"), numbers.normalize_ean(F.col("code")).alias("ean"), F.round(base["qty"], 6).alias("qty"), base["unit"].alias("unit"), pack["qty"].alias("package_qty"), pack["unit"].alias("package_unit"))


@query("""
    SELECT page_id, replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')),
               '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' ') AS title,
           lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]*)', 1)) AS host,
           CAST(len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS INT) AS links
    FROM pages
""")
def txt_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", web.page_title(F.col("html")).alias("title"), web.host_of(F.col("url")).alias("host"), F.size(web.links(F.col("html"))).alias("links"))


@query(r"""
    WITH u AS (
        SELECT page_id, CASE page_id % 9
            WHEN 0 THEN 'http://u:p@10.0.0.1/' WHEN 1 THEN 'https://www.pinterest.de/' WHEN 2 THEN 'https://m.youtube.com:443/' WHEN 3 THEN 'https://[::1]/'
            WHEN 4 THEN 'http://a@b@172.20.1.1:80/' WHEN 5 THEN 'ftp://x.org/' WHEN 6 THEN 'HTTPS://FB.Watch/' WHEN 7 THEN 'http://nas.local' ELSE '' END || url AS link
        FROM pages
    ), h AS (
        SELECT page_id, link, lower(regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)', 1)) AS host FROM u
    )
    SELECT page_id, host,
           CASE WHEN contains(host, 'instagram.com') THEN 'instagram' WHEN contains(host, 'tiktok.com') THEN 'tiktok'
                WHEN contains(host, 'facebook.com') OR contains(host, 'fb.watch') THEN 'facebook'
                WHEN contains(host, 'pinterest.') OR contains(host, 'pin.it') THEN 'pinterest'
                WHEN contains(host, 'youtube.com') OR contains(host, 'youtu.be') THEN 'youtube' ELSE 'blog' END AS platform,
           CASE WHEN NOT (starts_with(lower(link), 'http://') OR starts_with(lower(link), 'https://')) OR host IN ('', 'localhost', '[::1]') OR suffix(host, '.local')
                  OR starts_with(host, '127.') OR starts_with(host, '10.') OR starts_with(host, '192.168.') OR regexp_matches(host, '^172\.(1[6-9]|2[0-9]|3[01])\.')
                THEN NULL ELSE link END AS safe
    FROM h
""")
def url_links(spark, sf_dir):
    given = ["http://u:p@10.0.0.1/", "https://www.pinterest.de/", "https://m.youtube.com:443/", "https://[::1]/", "http://a@b@172.20.1.1:80/", "ftp://x.org/", "HTTPS://FB.Watch/", "http://nas.local", ""]
    start = F.element_at(F.array(*map(F.lit, given)), (F.col("page_id") % 9 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(start, "url").alias("link"))
    return rows.select("page_id", web.host_of(F.col("link")).alias("host"), web.platform(F.col("link")).alias("platform"), web.safe_url(F.col("link")).alias("safe"))


@query("""
    WITH l AS (SELECT unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS link, page_id FROM pages)
    SELECT link, count(DISTINCT page_id) AS pages FROM l GROUP BY link
""")
def src_page_inventory(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(web.links(F.col("html"))).alias("link"))
    return rows.groupBy("link").agg(F.count_distinct("page_id").alias("pages"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, sha256(event_type || ':' || json(props)) AS row_hash FROM events")
def jsn_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", jsons.path(F.col("props"), "k").alias("k"), jsons.row_hash(F.col("event_type"), F.col("props")).alias("row_hash"))


@query("""
    SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS sunday,
           CAST(date_trunc('week', date_trunc('month', o_orderdate)) + INTERVAL 41 DAY AS DATE) AS grid_end
    FROM orders
""")
def dat_calendar(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.week_start(d).alias("monday"), F.element_at(dates.week_days(d), 7).alias("sunday"), F.element_at(dates.month_grid(d), 42).alias("grid_end"))


# ---------------------------------------------------------------- landing, silver, products


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of products of the six stores, each scraped twice; the later scrape has the shelf price.

    Every second product holds its name and price where a store puts them second.
    """
    k = F.col("p_partkey")
    rows = dealt_out(table(spark, sf_dir, "part"), "p_partkey").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    name, ean = F.col("p_name"), (10_000_000 + k).cast("string")
    price = (F.col("p_retailprice") + 1 - F.col("turn")).cast("decimal(12,2)")
    cents, first = (price * 100).cast("int"), k % 2 == 0
    image = F.concat(F.lit("https://img.example/"), k.cast("string"), F.lit(".png"))
    here = lambda c, when: F.when(when, c)

    def struct(**fields) -> Column:
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    def prices(when) -> Column:
        return struct(promoPrice=here(cents, when & (k % 4 < 2)), price=here(cents, when & (k % 4 >= 2)), pricePerUnit=here(struct(price=cents * 2, unit=F.lit("Kilo")), when))

    asset = lambda kind, url: struct(type=F.lit(kind), url=url)
    raws = {
        "ah": struct(
            card=struct(title=here(name, first), currentPrice=here(price, first), gtin=here(ean, first), images=F.array(struct(url=image)), unitPriceDescription=here(F.lit("normale prijs per kg 3,49"), first)),
            detail=struct(productCard=struct(title=name, priceBeforeBonus=price, unitPriceDescription=F.lit("per liter 2.50")), tradeItem=struct(gtin=here(ean, ~first))),
        ),
        "jumbo": struct(detail=struct(title=here(name, first), ean=ean, price=prices(first)), listing=struct(title=name, image=image, price=prices(~first))),
        "dirk": struct(
            detail=struct(headerText=here(name, first), barcode=ean, packaging=F.lit("6 x 330 ml"), images=here(F.array(struct(image_url=F.lit("\\artikelen\\1.png"))), first)),
            list=struct(offerPrice=F.when(first, price).otherwise(0), normalPrice=price, productInformation=struct(headerText=name, image=image)),
        ),
        "plus": struct(pdp=struct(Name=name, EAN=here(ean, first), Medicine=struct(EAN=ean), NewPrice=F.when(first, price.cast("string")).otherwise("0.0"), OriginalPrice=price.cast("string"), ImageURL=here(image, first)), plp=struct(Product_Subtitle=F.lit("Per 500 g"), ImageURL=image)),
        "spar": struct(product_name=name, gtin13=ean, package=F.lit("2 x 500 ml"), price_visible=here(F.concat(F.lit("€ "), price.cast("string")), first), price_jsonld=price, images=F.array(image)),
        "aldi": struct(name=name, gtin=here(ean, ~first), detail=struct(ean=here(ean, first)), salesUnit=F.lit("1,5 kg"), currentPrice=struct(priceValue=price), assets=F.array(asset("seal", F.lit("seal.png")), asset("primary", here(image, first)), asset("other", image))),
    }
    envelopes = F.lit(None).cast("string")
    for i, store in enumerate(W.STORES):
        envelope = F.struct(F.lit(store).alias("store"), F.concat(F.lit("2024-01-0"), F.col("turn") + 1, F.lit("T00:00:00Z")).alias("scraped_at"), k.cast("string").alias("external_id"), raws[store].alias("raw"))
        envelopes = F.when(k % 6 == i, F.to_json(envelope)).otherwise(envelopes)
    return rows.select("turn", envelopes.alias("value"))


LANDED = f"""
    landed AS (
        SELECT p_partkey AS k, [{_in(W.STORES)}][CAST(p_partkey % 6 + 1 AS INT)] AS store, CAST(p_partkey AS VARCHAR) AS external_id, p_name AS name,
               CAST(10000000 + p_partkey AS VARCHAR) AS ean, CAST(p_retailprice AS DECIMAL(12, 2)) AS price, p_partkey % 2 = 0 AS first,
               'https://img.example/' || p_partkey || '.png' AS image
        FROM part
    ), silver AS (
        SELECT *, CAST(CASE store WHEN 'ah' THEN CASE WHEN first THEN 3.49 ELSE 2.50 END WHEN 'jumbo' THEN price * 2
                   WHEN 'dirk' THEN round(CAST(price AS DOUBLE) / 1.98, 2) WHEN 'plus' THEN round(CAST(price AS DOUBLE) / 0.5, 2)
                   WHEN 'spar' THEN round(CAST(price AS DOUBLE), 2) ELSE round(CAST(price AS DOUBLE) / 1.5, 2) END AS DECIMAL(12, 2)) AS base_price,
               CASE WHEN store IN ('dirk', 'spar') OR (store = 'ah' AND NOT first) THEN 'l' ELSE 'kg' END AS base_price_unit,
               CASE WHEN store = 'dirk' AND first THEN 'https://web-fileserver.dirk.nl/artikelen/1.png' WHEN store = 'aldi' AND NOT first THEN 'seal.png' ELSE image END AS image_url
        FROM landed
    )
"""


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.bronze(landed(spark, sf_dir), F.lit("2024-01-03").cast("timestamp"))


@query(f"WITH {LANDED} SELECT store, external_id, name, ean, price, base_price, base_price_unit, image_url FROM silver")
def tf1_silver(spark, sf_dir):
    return silver.silver(_bronze(spark, sf_dir)).select("store", "external_id", "name", "ean", "price", "base_price", "base_price_unit", "image_url")


@query(ORACLES["tf1_silver"])
def prj1_silver_of_variants(spark, sf_dir):
    """The same rows from a table that keeps every landed text as a variant: paths are read from it, nothing is parsed again."""
    path = new_path(spark, "bronze")
    silver.parsed(_bronze(spark, sf_dir)).write.parquet(path)
    return silver.silver(spark.read.parquet(path)).select("store", "external_id", "name", "ean", "price", "base_price", "base_price_unit", "image_url")


def _first_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver rows of two thirds of the products' first scrape."""
    return silver.silver(_bronze(spark, sf_dir).filter("scraped_at < '2024-01-02' and cast(get_json_object(raw_data, '$.external_id') as long) % 3 <> 0"))


@query(f"""
    WITH {LANDED} SELECT store, external_id, CASE WHEN store = 'jumbo' OR k % 3 = 0 THEN price ELSE price + 1 END AS price,
        CASE WHEN k % 3 = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS first_seen, CASE WHEN store = 'jumbo' OR k % 3 = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS last_seen
    FROM silver WHERE store = 'jumbo' OR k % 3 <> 0
""")
def tf1_refresh_of_a_store(spark, sf_dir):
    """Silver rows are there already; one store is refreshed, the others stay."""
    after, _ = silver.refresh_silver(_first_scrape(spark, sf_dir), _bronze(spark, sf_dir), "jumbo")
    return after.select("store", "external_id", "price", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


@query(f"WITH {LANDED} SELECT store AS store_id, CAST(count(*) AS INT) AS rows_refreshed FROM silver GROUP BY store")
def tf1_rows_refreshed(spark, sf_dir):
    rows = _bronze(spark, sf_dir)
    return silver.refresh_silver(silver.silver(rows).limit(0), rows)[1]


@query(f"""
    WITH {LANDED} SELECT store AS store_id, external_id, name, CAST(price * 100 AS INT) AS current_price_cents, true AS is_available, lpad(ean, 14, '0') AS ean_norm, lower(name) AS name_search,
           CASE WHEN k % 3 <> 0 THEN replace(name, ' ', '_') END AS canonical_key
    FROM silver
""")
def tf2_publish(spark, sf_dir):
    """Products with a key are there already; their prices change, their keys stay."""
    old = silver.products(_first_scrape(spark, sf_dir)).withColumn("canonical_key", F.replace("name", F.lit(" "), F.lit("_")))
    after, _ = silver.publish(old, silver.silver(_bronze(spark, sf_dir)))
    return after.select("store_id", "external_id", "name", "current_price_cents", "is_available", "ean_norm", "name_search", "canonical_key")


@query(f"WITH {LANDED} SELECT CAST(count(*) AS BIGINT) AS new_rows, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0)::BIGINT AS known_rows FROM (SELECT k FROM landed UNION ALL SELECT k FROM landed WHERE k % 2 = 1)")
def snk2_land(spark, sf_dir):
    """A second run lands all rows, where the first scrape of every second product is there already."""
    lines, when = landed(spark, sf_dir), F.lit("2024-01-03").cast("timestamp")
    before = silver.bronze(lines.filter("turn = 0 and cast(get_json_object(value, '$.external_id') as long) % 2 = 0"), when)
    return silver.land(before, lines, when, "second")[1]


@query("""
    WITH old AS (SELECT c_custkey AS k, c_name AS name, 1 AS seen FROM customer WHERE c_custkey % 3 <> 0),
         new AS (SELECT c_custkey AS k, upper(c_name) AS name, 2 AS seen FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, coalesce(o.seen, n.seen) AS seen FROM old o FULL JOIN new n ON o.k = n.k
""")
def snk3_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(1).alias("seen"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"), F.lit(2).alias("seen"))
    return sinks.upsert(old, new, ["k"], keep=("seen",))


@query("""
    WITH old AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'manual' ELSE 'rule' END AS source FROM customer),
         new AS (SELECT c_custkey AS k, upper(c_name) AS name, 'rule' AS source FROM customer WHERE c_custkey % 2 = 0)
    SELECT o.k, CASE WHEN n.k IS NOT NULL AND o.source = 'rule' THEN n.name ELSE o.name END AS name, o.source FROM old o LEFT JOIN new n ON o.k = n.k
""")
def snk5_guarded_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "manual").otherwise("rule").alias("source"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"), F.lit("rule").alias("source"))
    return sinks.upsert(old, new, ["k"], when=lambda o: o("source") == "rule")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def snk7_insert_new(spark, sf_dir):
    return sinks.insert_new(table(spark, sf_dir, "part").filter("p_size > 25"), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("SELECT c_custkey, round(c_acctbal, 0) AS c_acctbal FROM customer WHERE round(c_acctbal, 0) IS DISTINCT FROM c_acctbal")
def snk9_changes(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return sinks.changes(old, old.withColumn("c_acctbal", F.round("c_acctbal", 0)), ["c_custkey"], ["c_acctbal"])


@query(f"WITH {CATALOGUE} SELECT id, is_available AND k IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) AS is_available FROM catalogue")
def snk12_deactivate_missing(spark, sf_dir):
    present = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").cast("string").alias("id"))
    return sinks.deactivate_missing(catalogue(spark, sf_dir).select("id", "is_available"), present, ["id"])


# ---------------------------------------------------------------- keys, matrices, bands


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def agg16_latest_per_key(spark, sf_dir):
    return keyed.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT l_partkey, min_by(l_suppkey, (l_extendedprice, l_suppkey)) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def agg18_best_of(spark, sf_dir):
    return keyed.best_of(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", F.col("l_extendedprice"))


def _sql_matrix(how: str) -> str:
    return ", ".join(f"{how}(current_price_cents) FILTER (WHERE store_id = '{s}') AS {s}_cents" for s in W.STORES) + ", count(DISTINCT store_id) AS store_count"


@query(f"WITH {CATALOGUE} SELECT ean_norm AS ean, min(name) AS product, {_sql_matrix('max')} FROM catalogue WHERE is_available AND ean_norm IS NOT NULL GROUP BY ean_norm")
def tf11_product_price_matrix(spark, sf_dir):
    return search.product_price_matrix(catalogue(spark, sf_dir))


@query(f"""
    WITH {CATALOGUE} SELECT canonical_key, min(canonical_name) AS display_name, min(name) AS sample_name, bool_or(is_organic) AS has_organic, count(*) AS member_count, {_sql_matrix("min")}
    FROM catalogue WHERE is_available AND canonical_key <> '' GROUP BY canonical_key
""")
def tf12_ingredient_price_matrix(spark, sf_dir):
    return search.ingredient_price_matrix(catalogue(spark, sf_dir))


@query("""
    WITH b AS (SELECT *, max(score) OVER (PARTITION BY l_partkey) AS best FROM (SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, l_extendedprice AS price, l_quantity / 50 AS score FROM lineitem)),
         r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY price, score DESC, name) AS r FROM (SELECT *, l_orderkey * 10 + l_linenumber AS name FROM b WHERE score >= greatest(0.5, best - 0.12)))
    SELECT l_partkey, price, score FROM r WHERE r = 1
""")
def win5_cheapest_in_band(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("price"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("name"))
    return keyed.cheapest_relevant(rows, ["l_partkey"], "score", "price", "name").select("l_partkey", "price", "score")


@query("SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate NULLS LAST, l_partkey) AS position FROM (SELECT DISTINCT l_orderkey, l_partkey, l_shipdate FROM lineitem)")
def win2_member_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").distinct()
    return keyed.members_with_position(rows, ["l_orderkey"], "l_partkey", "l_shipdate")


@query(f"WITH {CATALOGUE} SELECT count(*) AS rows, count(ean) AS ean_count, count(base_price) AS base_price_count FROM catalogue")
def agg24_coverage(spark, sf_dir):
    return keyed.coverage(catalogue(spark, sf_dir), "ean", "base_price")


@query("SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_custkey = 17) o ON l_orderkey = o_orderkey")
def tf29_rows_of_a_user(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id")
    return keyed.children_for_user(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), orders, 17, "l_orderkey", "o_orderkey")


# ---------------------------------------------------------------- canonical keys


@query(f"""
    WITH {CATALOGUE} SELECT name_search, {_sql_normal_key(_sql_key("name_search"))} AS canonical_key,
        regexp_matches(name_search, '\\b(bio|biologisch|biologische|organic)\\b') AS is_organic, 'rule' AS source
    FROM (SELECT DISTINCT name_search FROM catalogue WHERE is_available)
""")
def tf3_canonical_baseline(spark, sf_dir):
    return canonical.baseline(catalogue(spark, sf_dir))


@query(f"""
    WITH {CATALOGUE} SELECT id, CASE WHEN is_available OR name_search IN (SELECT name_search FROM catalogue WHERE is_available) THEN {_sql_normal_key(_sql_key("name_search"))} ELSE canonical_key END AS canonical_key
    FROM catalogue
""")
def tf4_apply_keys(spark, sf_dir):
    products = catalogue(spark, sf_dir)
    return canonical.applied(products, canonical.baseline(products)).select("id", "canonical_key")


@query("""
    WITH tags AS (SELECT DISTINCT p_name AS name_search, replace(p_name, ' ', '_') AS canonical_key FROM part),
         all_tags AS (SELECT * FROM tags UNION ALL SELECT name_search || ' 48+', canonical_key || '_48_plus' FROM tags UNION ALL SELECT 'other ' || name_search, 'other_' || canonical_key || '_30_plus' FROM tags)
    SELECT name_search, CASE WHEN canonical_key LIKE '%\\_48\\_plus' ESCAPE '\\' THEN replace(canonical_key, '_48_plus', '') ELSE canonical_key END AS canonical_key FROM all_tags
""")
def tf5_prepass(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select(F.col("p_name").alias("name_search"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("canonical_key")).distinct()
    fat = tags.select(F.concat("name_search", F.lit(" 48+")), F.concat("canonical_key", F.lit("_48_plus")))
    other = tags.select(F.concat(F.lit("other "), "name_search"), F.concat(F.lit("other_"), "canonical_key", F.lit("_30_plus")))
    return canonical.prepass(tags.union(fat).union(other))


@query(f"WITH {CATALOGUE} SELECT name_search, min(name) AS sample_name, count(*) AS n FROM catalogue WHERE is_available AND name_search NOT LIKE 'small%' GROUP BY name_search")
def tf17_untagged_names(spark, sf_dir):
    products = catalogue(spark, sf_dir)
    done = products.filter(F.col("name_search").startswith("small")).select("name_search", F.lit("ai_batch").alias("source")).distinct()
    return canonical.untagged_names(products, done)


@query(f"""
    WITH {CATALOGUE} SELECT canonical_key, count(DISTINCT store_id) AS stores, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 8), '|') AS names
    FROM (SELECT * REPLACE (canonical_key || CASE WHEN k % 2 = 0 THEN '_48_plus' ELSE '' END AS canonical_key) FROM catalogue WHERE is_available)
    GROUP BY canonical_key HAVING canonical_key LIKE '%plus' OR (len(string_split(canonical_key, '_')) >= 3 AND count(DISTINCT store_id) = 1)
""")
def tf18_keys_to_recheck(spark, sf_dir):
    products = catalogue(spark, sf_dir)
    products = products.withColumn("canonical_key", F.concat("canonical_key", F.when(F.col("id").cast("long") % 2 == 0, "_48_plus").otherwise("")))
    return canonical.keys_to_recheck(products).withColumn("names", F.array_join("names", "|"))


# ---------------------------------------------------------------- groups and reviews

_EAN_KEYS = f"keys AS (SELECT *, 'ean:' || ean || ':pack:' || {_sql_pack('name')} || ':variant:' || {_sql_variant('name')} AS group_key FROM catalogue WHERE ean IS NOT NULL)"


@query(f"WITH {CATALOGUE}, {_EAN_KEYS} SELECT group_key, ean, min(name) AS canonical_name, count(*) AS member_count FROM keys GROUP BY group_key, ean HAVING count(*) >= 2")
def tf13_ean_groups(spark, sf_dir):
    return grouping.ean_groups(silver_rows(spark, sf_dir))


@query(f"""
    WITH {CATALOGUE}, {_EAN_KEYS}, g AS (SELECT group_key FROM keys GROUP BY group_key HAVING count(*) >= 2)
    SELECT group_key, id AS silver_product_id, 'ean' AS source, 1.0::DOUBLE AS confidence FROM keys SEMI JOIN g USING (group_key)
""")
def tf13_ean_members(spark, sf_dir):
    rows = silver_rows(spark, sf_dir)
    return grouping.group_members(rows, grouping.ean_groups(rows))


@query(f"""
    WITH {CATALOGUE}, r AS (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY list_position([{_in(grouping.STORE_RANK)}], store_id), name, id) AS r FROM catalogue WHERE ean IS NOT NULL)
    SELECT 'ean:' || ean AS group_key, ean, name AS canonical_name FROM r WHERE r = 1
""")
def tf14_plain_ean_groups(spark, sf_dir):
    return grouping.plain_ean_groups(silver_rows(spark, sf_dir))


@query(f"""
    WITH {CATALOGUE}, f AS (SELECT *, {_sql_variant("name")} AS v, {_sql_norm("name")} AS norm, trim(regexp_replace({_sql_norm("name")}, '\\b({"|".join(W.BRANDS)})\\b', '', 'g')) AS generic,
              CASE WHEN base_price > 0 THEN round(price / base_price, 3) END AS q3, CASE WHEN base_price > 0 THEN round(price / base_price, 2) END AS q2 FROM catalogue),
    c AS (
        SELECT 'exact' AS kind, 10 AS largest, store_id, name, 'exact:name:' || norm || ':variant:' || v || ':unit:' || coalesce(base_price_unit, '') || ':qty:' || coalesce(CAST(q3 AS VARCHAR), '') AS candidate_key
        FROM f WHERE ean IS NULL AND norm IS NOT NULL
        UNION ALL
        SELECT 'substitute', 16, store_id, name, 'substitute:name:' || generic || ':variant:' || v || ':unit:' || base_price_unit || ':qty:' || CAST(q2 AS VARCHAR)
        FROM f WHERE generic <> '' AND base_price_unit IN ('kg', 'l') AND q2 IS NOT NULL
    )
    SELECT kind AS candidate_kind, candidate_key, min(name) AS canonical_name, count(*) AS member_count, count(DISTINCT store_id) AS store_count
    FROM c GROUP BY kind, candidate_key, largest HAVING count(*) BETWEEN 2 AND largest AND count(DISTINCT store_id) >= 2
""")
def tf15_review_candidates(spark, sf_dir):
    rows = silver_rows(spark, sf_dir)
    none = rows.select(F.col("id").alias("silver_product_id")).limit(0)
    found = grouping.review_candidates(rows, none, most=None)
    return found.select("candidate_kind", "candidate_key", "canonical_name", "member_count", "store_count")


def _grouped_before(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Products, groups, members, ingredients, aliases and mappings before a refresh: some of article numbers, some of a person."""
    rows, k = silver_rows(spark, sf_dir), F.col("id").cast("long")
    pick = lambda n: F.when(k % n == 0, "ean:old").when(k % n == 1, "review:kept")
    products = rows.select("id", F.col("id").alias("silver_product_id"), pick(10).alias("exact_group_key"), pick(9).alias("ingredient_key"))
    groups = spark.createDataFrame([("ean:old", "old", "1", "ean", 1.0), ("review:kept", "kept", None, "manual", 0.9)], "group_key string, canonical_name string, ean string, source string, confidence double")
    owner = lambda c: F.when(F.col(c) == "ean:old", "ean").otherwise("manual")
    members = products.filter("exact_group_key is not null").select(F.col("exact_group_key").alias("group_key"), "silver_product_id", owner("exact_group_key").alias("source"), F.lit(1.0).alias("confidence"))
    of = products.filter("ingredient_key is not null").select("silver_product_id", F.col("ingredient_key").alias("group_key"))
    names = of.select("group_key", F.lit("a name").alias("alias"), F.lit("nl").alias("language"), F.lit(1.0).alias("confidence")).distinct()
    mappings = of.withColumns({"confidence": F.lit(0.9), "mapping_source": F.lit("manual"), "review_status": F.lit("approved")})
    return [products, groups, members, groups.withColumn("group_kind", F.lit("substitute")), names, mappings]


_FOUND = f"{CATALOGUE}, {_EAN_KEYS}, g AS (SELECT group_key FROM keys GROUP BY group_key HAVING count(*) >= 2), found AS (SELECT * FROM keys SEMI JOIN g USING (group_key))"


@query(f"""
    WITH {_FOUND}, c AS (SELECT count(*) FILTER (k % 10 = 0) AS e, count(*) FILTER (k % 9 = 0) AS s FROM catalogue), n AS (SELECT count(*) AS n FROM g),
         f AS (SELECT count(*) AS n, count(*) FILTER (k % 10 <> 1) AS e, count(*) FILTER (k % 9 <> 1) AS s FROM found)
    SELECT unnest(['cleared_exact_products', 'cleared_substitute_products', 'exact_groups', 'exact_members', 'public_exact_products', 'substitute_groups', 'substitute_mappings', 'public_substitute_products']) AS step,
           unnest([c.e, c.s, n.n, f.e, f.e, n.n, f.n, f.s]) AS rows_affected FROM c, n, f
""")
def tf13_refresh_steps(spark, sf_dir):
    return grouping.refresh_exact_groups(silver_rows(spark, sf_dir), *_grouped_before(spark, sf_dir))["report"]


@query(f"""
    WITH {_FOUND} SELECT id AS silver_product_id, group_key, 'rule' AS mapping_source, 'approved' AS review_status, 1.0::DOUBLE AS confidence FROM found
    UNION ALL SELECT id, 'review:kept', 'manual', 'approved', 0.9::DOUBLE FROM catalogue WHERE k % 9 = 1
""")
def tf13_substitute_mappings(spark, sf_dir):
    return grouping.refresh_exact_groups(silver_rows(spark, sf_dir), *_grouped_before(spark, sf_dir))["mappings"]


@query(f"""
    WITH {_FOUND} SELECT group_key, name AS alias, 'nl' AS language, 1.0::DOUBLE AS confidence FROM (SELECT DISTINCT group_key, name FROM found)
    UNION ALL SELECT DISTINCT 'review:kept', 'a name', 'nl', 1.0::DOUBLE FROM catalogue WHERE k % 9 = 1
""")
def tf13_ingredient_aliases(spark, sf_dir):
    return grouping.refresh_exact_groups(silver_rows(spark, sf_dir), *_grouped_before(spark, sf_dir))["aliases"]


@query("""
    WITH c AS (SELECT p_name, CASE WHEN p_size % 2 = 0 THEN 'exact' ELSE 'substitute' END AS kind, p_size, p_partkey, p_name || p_partkey AS key FROM part)
    SELECT kind, 'group:' || key AS group_key, CAST(p_partkey AS VARCHAR) AS silver_product_id, CASE WHEN kind = 'exact' THEN 'ai' ELSE 'ai_batch' END AS source, 0.7::DOUBLE AS confidence FROM c WHERE p_size % 3 = 0
""")
def tf16_reviewed_members(spark, sf_dir):
    """A candidate for each product; a third is approved, by a model."""
    part, rows = table(spark, sf_dir, "part"), silver_rows(spark, sf_dir)
    kind = F.when(F.col("p_size") % 2 == 0, "exact").otherwise("substitute")
    found = part.select(F.concat(F.lit("group:"), "p_name", F.col("p_partkey").cast("string")).alias("candidate_key"), kind.alias("candidate_kind"), F.col("p_name").alias("canonical_name"), F.array(F.col("p_partkey").cast("string")).alias("silver_ids"), F.lit(0.6).alias("confidence"), F.lit("pending").alias("status"), F.lit("rule").alias("source"), "p_size")
    reviews = found.select("candidate_key", F.element_at(F.array(F.lit("approve"), F.lit("reject"), F.lit("needs_later")), (F.col("p_size") % 3 + 1).cast("int")).alias("action"), F.lit("ai").alias("reviewer"), F.lit(0.7).alias("ai_confidence"))
    before = _grouped_before(spark, sf_dir)
    got = grouping.apply_reviews(found.drop("p_size"), reviews, rows, before[0], *[t.limit(0) for t in before[1:]])
    exact = got["members"].select(F.lit("exact").alias("kind"), "group_key", "silver_product_id", "source", "confidence")
    return exact.unionByName(got["mappings"].select(F.lit("substitute").alias("kind"), "group_key", "silver_product_id", F.col("mapping_source").alias("source"), "confidence"))


@query(f"""
    WITH {CATALOGUE}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM catalogue)
    SELECT id, CAST(r % 80 AS INT) AS item_index, 1 AS segment, printf('catalog-segment-01-group-%05d', CAST(r // 80 + 1 AS INT)) AS custom_id FROM o
""")
def win4_request_batches(spark, sf_dir):
    return grouping.batches(catalogue(spark, sf_dir).select("id"), "id")


# ---------------------------------------------------------------- offers and search


@query(f"WITH {CATALOGUE} SELECT id, store_id, current_price_cents FROM catalogue WHERE is_available AND (ean_norm = (SELECT ean_norm FROM catalogue WHERE id = '8') OR id = '8')")
def tf8_price_offers(spark, sf_dir):
    return search.price_offers(catalogue(spark, sf_dir), "8").select("id", "store_id", "current_price_cents")


@query(f"WITH {CATALOGUE} SELECT id, store_id, name, current_price_cents FROM catalogue WHERE is_available AND canonical_key = (SELECT canonical_key FROM catalogue WHERE id = '8') AND current_price_cents > 0")
def tf9_group_offers(spark, sf_dir):
    return search.group_offers(catalogue(spark, sf_dir), "8").select("id", "store_id", "name", "current_price_cents")


@query(f"WITH {CATALOGUE} SELECT id, store_id FROM catalogue WHERE is_available AND canonical_key = 'red_bolt' AND current_price_cents > 0")
def tf7_search_offers(spark, sf_dir):
    return search.search_offers(catalogue(spark, sf_dir), "Red bolt").select("id", "store_id")


def _sql_trigrams(x: str) -> str:
    words = f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda u: u <> '')"
    return f"flatten(list_transform({words}, lambda u: list_transform(range(1, length(u) + 2), lambda c: substr('  ' || u || ' ', c, 3))))"


def _sql_jaccard(a: str, b: str) -> str:
    """Of lists that aren't empty."""
    return f"(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))))"


def _sql_tok(q: str, w: str) -> str:
    return f"""CASE WHEN {q} = {w} THEN 1.0 WHEN starts_with({w}, {q}) AND substr({w}, length({q}) + 1) IN ({_in(W.ENDINGS)}) THEN 0.93
        WHEN length({q}) >= 4 AND suffix({w}, {q}) THEN 0.88 WHEN length({q}) >= 5 AND contains({w}, {q}) THEN 0.42
        WHEN length({q}) >= 3 AND starts_with({w}, {q}) THEN 0.34 WHEN {_sql_jaccard(_sql_trigrams(q), _sql_trigrams(w))} >= 0.6 THEN 0.72 ELSE 0.0 END::DOUBLE"""


def _sql_search(asked: str, count: int) -> str:
    """CTEs up to ``found``, the ranked products of each (query_id, query_text) of ``asked``: every run of every name is compared."""
    words = "list_distinct(list_filter(string_split(n, ' '), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$')))"
    return f"""{CATALOGUE}, asked AS ({asked}),
    form AS (SELECT query_id, trim(regexp_replace(regexp_replace(lower(query_text), '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g'), ' +', ' ', 'g')) AS qre FROM asked),
    q AS (SELECT query_id, qre, list_distinct(list_filter(string_split(qre, ' '), lambda x: length(x) >= 2 AND x NOT IN ({_in(W.SEARCH_STOP)}))) AS qtok FROM form),
    names AS (SELECT DISTINCT name_search, trim(regexp_replace(name_search, '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g')) AS n FROM catalogue WHERE is_available),
    nw AS (SELECT name_search, {words} AS w, {_sql_trigrams("name_search")} AS t FROM names),
    runs AS (SELECT name_search, list_slice(t, i, i + k) AS run FROM (SELECT name_search, t, unnest(range(1, len(t) + 1)) AS i FROM nw), range(0, 80) AS r(k) WHERE i + k <= len(t)),
    texts AS (SELECT DISTINCT unnest(qtok) AS x FROM q UNION SELECT qre FROM q),
    tt AS (SELECT x, {_sql_trigrams("x")} AS t FROM texts),
    near AS (SELECT x, name_search, max({_sql_jaccard("tt.t", "run")}) AS s FROM tt, runs GROUP BY x, name_search),
    qw AS (SELECT query_id, unnest(qtok) AS word FROM q),
    bw AS (SELECT name_search, unnest(w) AS b FROM nw),
    hit AS (SELECT DISTINCT query_id, name_search FROM qw JOIN near ON x = word WHERE s >= 0.6 OR (length(word) >= 3 AND contains(name_search, word))),
    tok AS (SELECT a, b, {_sql_tok("a", "b")} AS m FROM (SELECT DISTINCT unnest(qtok) AS a FROM q), (SELECT DISTINCT unnest(w) AS b FROM nw)),
    cover AS (SELECT query_id, name_search, avg(m) AS coverage FROM (SELECT query_id, name_search, a, max(m) AS m FROM hit JOIN qw USING (query_id) JOIN bw USING (name_search) JOIN tok ON a = word AND tok.b = bw.b GROUP BY ALL) GROUP BY ALL),
    fit AS (SELECT query_id, name_search, avg(m) AS specificity FROM (SELECT query_id, name_search, tok.b, max(m) AS m FROM hit JOIN qw USING (query_id) JOIN bw USING (name_search) JOIN tok ON a = word AND tok.b = bw.b WHERE tok.b NOT IN ({_in(W.SEARCH_STOP)}) GROUP BY ALL) GROUP BY ALL),
    scored AS (
        SELECT query_id, name_search, coverage, round(s, 6) AS alike,
               round(least(1.0, 0.55 * coverage + 0.45 * coalesce(specificity, 0) + 0.05 * (length(qre)::DOUBLE / greatest(length(name_search), 1))), 6) AS match_score
        FROM hit JOIN q USING (query_id) JOIN cover USING (query_id, name_search) LEFT JOIN fit USING (query_id, name_search) JOIN near ON x = qre AND near.name_search = hit.name_search
    ),
    first AS (SELECT c.*, query_id, coverage, match_score, row_number() OVER (PARTITION BY query_id ORDER BY alike DESC, id) AS r FROM catalogue c JOIN scored USING (name_search) WHERE is_available),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, length(name), current_price_cents, name, id) AS rank FROM first WHERE r <= {search.CANDIDATES} AND coverage > 0),
    found AS (SELECT * FROM ranked WHERE rank <= {count})"""


@query(f"WITH {_sql_search('SELECT DISTINCT p_name AS query_id, p_name AS query_text FROM part', 8)} SELECT query_id, CAST(rank AS INT) AS rank, id, match_score FROM found")
def tf6_search_products(spark, sf_dir):
    products = catalogue(spark, sf_dir)
    asked = table(spark, sf_dir, "part").select(F.col("p_name").alias("query_text")).distinct().withColumn("query_id", F.col("query_text"))
    return search.search_many(products, asked, 8).select("query_id", "rank", "id", "match_score")


# words cut short, run together, misspelt and with more words than the names have
CASES = (
    ("q1", "red bolt", "bolt"), ("q2", "blue gears", "gear"), ("q3", "smal anvill", "anvil"), ("q4", "Anvil bio", "anvil"),
    ("q5", "bol", "bolt"), ("q6", "xylophone", "xylophone"), ("q7", "de gear 6-pack", "gear"), ("q8", "greenwidget", "widget"),
)
_CASES = " UNION ALL ".join(f"SELECT '{i}' AS query_id, '{t}' AS query_text, '{e}' AS term" for i, t, e in CASES)


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, [e]) for i, t, e in CASES], "query_id string, query_text string, terms array<string>")


@query(f"WITH {_sql_search(_CASES, 8)} SELECT query_id, CAST(rank AS INT) AS rank, id, match_score FROM found")
def tf6_misspelt_searches(spark, sf_dir):
    return search.search_many(catalogue(spark, sf_dir), _cases(spark).drop("terms"), 8).select("query_id", "rank", "id", "match_score")


@query(f"WITH {_sql_search(_CASES, 8)} SELECT query_id, CAST(rank AS INT) AS rank, id, match_score FROM found")
def tf6_indexed_searches(spark, sf_dir):
    """The same searches through a kept index, made of some products first and then of all."""
    products = catalogue(spark, sf_dir)
    index = search.NameIndex(spark, new_path(spark, "names"), 4)
    index.refresh(products.filter("store_id = 'ah'"))
    index.refresh(products)
    return search.search_many(products, _cases(spark).drop("terms"), 8, index=index).select("query_id", "rank", "id", "match_score")


@query(f"""
    WITH {_sql_search(_CASES, 8)},
    band AS (SELECT *, max(match_score) OVER (PARTITION BY query_id) AS best FROM found WHERE current_price_cents IS NOT NULL),
    pick AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY current_price_cents, match_score DESC, name) AS p FROM band WHERE match_score >= greatest(0.35, best - 0.15)),
    done AS (SELECT a.query_id, coalesce(contains(lower(concat_ws(' ', name, brand, category)), term), false) AS passed FROM asked a LEFT JOIN pick ON pick.query_id = a.query_id AND p = 1)
    SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (passed)::DOUBLE / count(*) AS pass_rate FROM done
""")
def tf23_evaluate_search(spark, sf_dir):
    return search.pass_rate(search.evaluate(catalogue(spark, sf_dir), _cases(spark)))


@query(f"""
    WITH {_sql_search("SELECT 0 AS query_id, 'smal anvill' AS query_text", 12)},
    top AS (SELECT *, max(g) OVER () AS best FROM (SELECT canonical_key, max(match_score) AS g, count(*) AS hits FROM found GROUP BY canonical_key)),
    stores AS (SELECT canonical_key, count(DISTINCT store_id) AS stores FROM catalogue WHERE is_available GROUP BY canonical_key),
    grp AS (SELECT canonical_key, g FROM top JOIN stores USING (canonical_key) WHERE g >= best - 0.06 ORDER BY stores DESC, g DESC, hits DESC, canonical_key LIMIT 1)
    SELECT id, store_id, g AS match_score FROM catalogue JOIN grp USING (canonical_key) WHERE is_available AND current_price_cents > 0
""")
def tf7_misspelt_offers(spark, sf_dir):
    return search.search_offers(catalogue(spark, sf_dir), "smal anvill").select("id", "store_id", "match_score")


# ---------------------------------------------------------------- recipes and lists


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    unit = F.element_at(F.array(F.lit("g"), F.lit("kg"), F.lit("stuks")), (k % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return rows.select(
        F.col("l_orderkey").alias("recipe_id"), (F.col("l_linenumber") * 1000 + k % 1000).alias("sort_order"), F.col("p_name").alias("ingredient_name"), F.lit(None).cast("string").alias("dutch_ingredient_name"),
        F.lit("").alias("normalized_ingredient_name"), F.col("l_quantity").alias("quantity"), unit.alias("unit"), F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), unit, "p_name").alias("raw_text"),
    )


@query("""
    SELECT l_orderkey AS recipe_id, p_name AS normalized_ingredient_name, CASE l_partkey % 3 WHEN 2 THEN 'piece' ELSE 'g' END AS unit,
           sum(l_quantity * CASE l_partkey % 3 WHEN 1 THEN 1000 ELSE 1 END) AS quantity, count(*) AS lines
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
""")
def agg21_merge_ingredients(spark, sf_dir):
    got = recipes.merge_ingredients(ingredients(spark, sf_dir), ["recipe_id"])
    return got.select("recipe_id", "normalized_ingredient_name", "unit", "quantity", F.size("raw_texts").cast("long").alias("lines"))


@query("""
    SELECT l_orderkey AS list_id, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(round(l_extendedprice) AS BIGINT) END)::BIGINT AS total_cents, count(*) AS items,
           count(*) FILTER (WHERE l_linestatus = 'F') AS checked_items FROM lineitem GROUP BY l_orderkey
""")
def agg22_list_totals(spark, sf_dir):
    cents = F.when(F.col("l_returnflag") != "R", F.round("l_extendedprice").cast("long"))
    return recipes.list_totals(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list_id"), cents.alias("estimated_price_cents"), (F.col("l_linestatus") == "F").alias("checked")))


@query("SELECT o_orderkey AS list_id, CAST(o_orderdate AS DATE) AS scheduled_for FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def flt11_upcoming_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("list_id"), F.to_date("o_orderdate").alias("scheduled_for"))
    return recipes.upcoming(rows, F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ',') AS items FROM orders GROUP BY day")
def agg25_items_by_day(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey", F.col("o_orderkey").cast("string").alias("item"))
    return recipes.grouped_by_day(rows, "day", "item", "o_orderkey").withColumn("items", F.array_join("items", ","))


@query("SELECT o_orderkey, count(l_linenumber) AS n, coalesce(array_to_string(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_linenumber IS NOT NULL), ','), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def jn19_nested_children(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    got = recipes.with_children(table(spark, sf_dir, "orders").select("o_orderkey"), items, "o_orderkey", "items", "l_linenumber")
    return got.select("o_orderkey", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT DISTINCT unnest([p_brand, p_type]) AS tag FROM part")
def agg26_distinct_tags(spark, sf_dir):
    return recipes.distinct_tags(table(spark, sf_dir, "part").select(F.array("p_brand", "p_type").alias("tags")))



# ---------------------------------------------------------------- reviews, answers and lists


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each brand, with its products by number."""
    k = F.col("p_partkey")
    got = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(k)).alias("ids"), F.count(F.lit(1)).alias("n"), F.min(k).alias("first"))
    decision = F.when(F.col("n") % 2 == 0, '{"decision":"approve"}').otherwise('{"decision":"reject"}')
    return got.select(
        F.col("p_brand").alias("candidate_key"), F.when(F.col("first") % 2 == 0, "exact").otherwise("substitute").alias("candidate_kind"), F.col("p_brand").alias("canonical_name"), F.transform("ids", lambda x: x.cast("string")).alias("silver_ids"),
        (F.col("n") % 7 / 10).alias("confidence"), F.when(F.col("first") % 5 == 0, "approved").otherwise("pending").alias("status"), decision.alias("ai_decision"), F.when(F.col("n") % 3 != 0, F.col("n") % 3 / 10).alias("ai_confidence"),
    )


_CANDIDATES = """
    candidates AS (
        SELECT p_brand AS candidate_key, CASE WHEN min(p_partkey) % 2 = 0 THEN 'exact' ELSE 'substitute' END AS kind, list(p_partkey ORDER BY p_partkey) AS ids, count(*) % 7 / 10 AS confidence,
               CASE WHEN min(p_partkey) % 5 = 0 THEN 'approved' ELSE 'pending' END AS status, count(*) % 2 = 0 AS wanted, CASE WHEN count(*) % 3 <> 0 THEN count(*) % 3 / 10 END AS sure
        FROM part GROUP BY p_brand
    )
"""


@query(f"""
    WITH {_CANDIDATES}, q AS (SELECT * FROM candidates WHERE status = 'pending' AND kind = 'exact' ORDER BY confidence DESC, candidate_key LIMIT 5)
    SELECT candidate_key, confidence::DOUBLE AS confidence, (SELECT string_agg(p_partkey || ':' || p_name, '|' ORDER BY p_partkey) FROM part WHERE p_brand = candidate_key) AS products FROM q
""")
def tf19_review_queue(spark, sf_dir):
    rows = silver_rows(spark, sf_dir).withColumn("name", F.col("canonical_name"))
    got = grouping.review_queue(_candidates(spark, sf_dir), rows, kind="exact", limit=5)
    listed = F.from_json("products", "array<struct<id:string,name:string>>")
    return got.select("candidate_key", "confidence", F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["id"], x["name"])), "|").alias("products"))


@query(f"WITH {_CANDIDATES} SELECT candidate_key FROM candidates WHERE status = 'pending' AND wanted ORDER BY sure DESC NULLS LAST, confidence DESC, candidate_key LIMIT 6")
def tf20_model_approved(spark, sf_dir):
    return grouping.model_approved(_candidates(spark, sf_dir), limit=6)


@query(f"WITH {_CANDIDATES} SELECT candidate_key, CAST(unnest(ids) AS VARCHAR) AS silver_product_id, unnest(range(1, len(ids) + 1))::INT AS position FROM candidates WHERE status = 'pending'")
def jn16_candidate_members(spark, sf_dir):
    return grouping.candidate_members(_candidates(spark, sf_dir))


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS silver_product_id, p_name AS canonical_name, p_type AS category, (p_size / 50)::DOUBLE AS confidence, CASE WHEN p_size / 50 >= 0.85 THEN 'approved' ELSE 'pending' END AS review_status
    FROM part WHERE p_partkey // 10 % 4 <> 3 AND p_partkey % 9 <> 0
""")
def tf25_answers_to_gold(spark, sf_dir):
    """Groups of ten products are answered; every fourth group's answer names a place twice, so none of it counts."""
    k = F.col("p_partkey")
    group, index = F.concat(F.lit("g"), F.floor(k / 10).cast("string")), (k % 10).cast("int")
    part = table(spark, sf_dir, "part").withColumn("custom_id", group).withColumn("index", index)
    told = F.when((F.floor(k / 10) % 4 == 3) & (index < 2), 0).otherwise(index)
    item = F.struct(told.alias("itemIndex"), F.when(k % 9 != 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(" ").alias("canonicalName"), F.col("p_type").alias("category"), F.array("p_name").alias("aliases"), (F.col("p_size") / 50).alias("confidence"))
    lines = part.groupBy("custom_id").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("body"))
    manifest = part.select("custom_id", F.col("index").alias("item_index"), k.cast("string").alias("silver_product_id"))
    got = grouping.gold(silver_rows(spark, sf_dir), grouping.batch_answers(lines, manifest))
    return got.select("silver_product_id", "canonical_name", "category", "confidence", "review_status")


_BEST = """
    band AS (SELECT *, max(match_score) OVER (PARTITION BY query_id) AS best FROM found WHERE current_price_cents IS NOT NULL),
    pick AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY current_price_cents, match_score DESC, name) AS p FROM band WHERE match_score >= greatest(0.5, best - 0.12))
"""


@query(f"WITH {_sql_search(_CASES, 8)}, {_BEST} SELECT a.query_id, id AS selected_product_id, store_id, current_price_cents AS estimated_price_cents FROM asked a LEFT JOIN pick ON pick.query_id = a.query_id AND p = 1")
def tf27_choose_products(spark, sf_dir):
    return recipes.choose_products(catalogue(spark, sf_dir), _cases(spark)).select("query_id", "selected_product_id", "store_id", "estimated_price_cents")


@query(f"""
    WITH {_sql_search("SELECT query_id, query_text FROM (" + _CASES + ")", 8)}, {_BEST},
    wanted AS (SELECT l_orderkey AS list_id, l_partkey AS item, a.query_text, a.query_id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN asked a ON a.query_id = 'q' || (l_partkey % 8 + 1)),
    had AS (SELECT * FROM wanted WHERE item % 2 = 0), n AS (SELECT list_id, count(*) AS n FROM had GROUP BY list_id)
    SELECT list_id, CAST(item AS VARCHAR) AS item, query_text AS ingredient_name, NULL AS product, (row_number() OVER (PARTITION BY list_id ORDER BY item) - 1)::INT AS sort_order FROM had
    UNION ALL
    SELECT w.list_id, CAST(item AS VARCHAR), w.query_text, pick.id, (coalesce(n, 0) + row_number() OVER (PARTITION BY w.list_id ORDER BY CAST(item AS VARCHAR)) - 1)::INT
    FROM wanted w LEFT JOIN n USING (list_id) LEFT JOIN pick ON pick.query_id = w.query_id AND p = 1 WHERE item % 2 = 1
""")
def tf26_add_to_lists(spark, sf_dir):
    """Half of the wanted ingredients stand on their lists already."""
    asked = _cases(spark).select(F.col("query_id").alias("q"), F.col("query_text").alias("ingredient_name"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list_id"), "l_partkey").repartition("list_id").distinct()  # dealt once, for the distinct rows and for their places
    rows = rows.withColumn("q", F.concat(F.lit("q"), (F.col("l_partkey") % 8 + 1).cast("string"))).join(F.broadcast(asked), "q").drop("q")  # eight rows
    had = rows.filter("l_partkey % 2 = 0").withColumn("sort_order", keyed.list_position(rows, ["list_id"], "l_partkey").cast("int"))
    fields = ["list_id", F.col("l_partkey").cast("string").alias("recipe_ingredient_id"), "ingredient_name"]
    items = had.select(*fields, F.lit(None).cast("string").alias("selected_product_id"), "sort_order", F.lit(False).alias("checked"))
    got = recipes.add_to_lists(items, rows.select(*fields), catalogue(spark, sf_dir))
    return got.select("list_id", F.col("recipe_ingredient_id").alias("item"), "ingredient_name", F.col("selected_product_id").alias("product"), "sort_order")


@query("""
    WITH l AS (SELECT o_custkey AS recipe_id, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS total_cents FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS recipe_id, total_cents FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 8) LEFT JOIN l ON recipe_id = c_custkey
""")
def tf28_home_feed(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recipe_id"), F.col("c_acctbal").alias("created_at"))
    lists = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recipe_id"), F.col("o_orderkey").alias("list_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("total_cents"))
    return recipes.home_feed(made, lists).select("recipe_id", "total_cents")


@query("SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS step_number FROM orders")
def win3_week_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    got = recipes.running_position(recipes.week_plan(rows, "day"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return got.select("o_orderkey", "week_start", "weekday", "step_number")


@query("""
    SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN 'complete' ELSE 'incomplete' END AS status,
           concat_ws(',', CASE WHEN p_size % 2 <> 0 THEN 'servings' END, CASE WHEN p_partkey % 3 = 0 THEN 'quantities' END, CASE WHEN p_partkey % 5 = 0 THEN 'other' END) AS missing, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_size > 5 AND p_partkey % 13 <> 0 AS valid
    FROM part
""")
def jsn12_valid_recipes(spark, sf_dir):
    k, even = F.col("p_partkey"), F.col("p_size") % 2 == 0
    told = F.array_compact(F.array(F.lit("servings"), F.lit("quantities"), F.when(k % 5 == 0, "other"), F.lit("servings")))
    state = recipes.completeness(told, {"servings": even, "quantities": k % 3 != 0})
    item = F.struct(F.when(k % 13 != 0, F.col("p_name")).otherwise(" ").alias("ingredientName"))
    doc = F.struct(F.when(k % 7 != 0, F.col("p_name")).otherwise(" ").alias("title"), F.when(k % 11 != 0, F.array(item)).otherwise(F.array()).alias("ingredients"), F.when(F.col("p_size") > 5, F.col("p_size") / 50).otherwise(1.5).alias("confidenceScore"))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), state["status"].alias("status"), F.array_join(state["missing_fields"], ",").alias("missing"), F.to_json(doc).alias("text"))
    good, bad = recipes.valid_recipes(rows, "text")
    keep = ["id", "status", "missing"]
    return good.select(*keep, F.lit(True).alias("valid")).unionByName(bad.select(*keep, F.lit(False).alias("valid")))


@query(f"""
    WITH {CATALOGUE}, g AS (SELECT *, CASE WHEN k % 3 <> 0 THEN canonical_key END AS key FROM catalogue)
    SELECT id, store_id FROM g WHERE is_available AND (key = (SELECT key FROM g WHERE id = '8') OR id = '8')
""")
def tf10_kind_offers(spark, sf_dir):
    products = catalogue(spark, sf_dir).withColumn("exact_group_key", F.when(F.col("id").cast("long") % 3 != 0, F.col("canonical_key")))
    return search.kind_offers(products, "8").select("id", "store_id")


@query(f"""
    WITH {CATALOGUE}, r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY name_search = 'red bolt' DESC, current_price_cents, unit_price_cents, name, id) AS n
                            FROM catalogue WHERE is_available AND canonical_key = 'red_bolt' AND current_price_cents > 0)
    SELECT id, store_id FROM r WHERE n = 1
""")
def agg19_offer_of_each_store(spark, sf_dir):
    return search.search_offers(catalogue(spark, sf_dir), "Red bolt", one_per_store=True).select("id", "store_id")


from . import sql_queries  # noqa: E402, F401  (takes the catalogue and the SQL from above)
