"""The library's functions for SQL text: scalar functions of names and numbers, and table functions over a catalogue.

After ``register(spark, products)`` one writes ``SELECT * FROM search_products('halfvolle melk')``, or joins a table of
searches laterally: ``SELECT s.who, p.* FROM searches s, LATERAL search_products(s.said) p``. Functions are temporary: they and the
views that they read (``catalog_*``) belong to the session, and a later ``register`` puts another catalogue in their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassabon.functions import words as W
from kassabon.functions.trigram import LEAST_SIMILAR, trigrams

from . import canonical, grouping, search
from .search_index import name_index


def _listed(values) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _table(pairs: dict[str, str]) -> str:
    return f"map({_listed(x for pair in pairs.items() for x in pair)})"


# ---------------------------------------------------------------- scalar functions

# Spark 4.1 doesn't rewrite a SQL function inside the subquery of another one, so bodies spell such calls out.


def _fold(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), '{W.ACCENTS}', '{W.PLAIN}')"


def _form(x: str) -> str:
    return rf"trim(regexp_replace({_fold(x)}, r'[^\p{{L}}\p{{N}} ]+', ' '))"


_SHAPES = r"^[0-9]+$|^[0-9]+(g|gr|gram|ml|cl|dl|kg|l|ltr|liter|st|stuks?|x|pack)$|^[0-9]+x[0-9]+"
_LEFT_OUT = _listed(W.KEY_STORES + W.KEY_UNITS + W.KEY_NOISE)


def _normal_key() -> str:
    cases = [f"WHEN k IN ({_listed(spelt)}) THEN '{target}'" for target, spelt in W.KEY_SYNONYMS.items()]
    cases += [f"WHEN k = '{plain}' AND rlike(n, r'(?U)\\b({'|'.join(spelt)})\\b') THEN '{target}'" for plain, (target, spelt) in W.FLAVOURED.items()]
    cases.append("WHEN k = 'kaas' AND contains(n, 'kaas 48%') THEN 'jonge_kaas'")
    key = rf"regexp_replace(regexp_replace({_fold('key')}, r'[^\p{{L}}\p{{N}}]+', '_'), '^_+|_+$', '')"
    return f"(SELECT CASE {' '.join(cases)} ELSE k END FROM (SELECT {key} AS k, {_fold('name')} AS n))"


#: Head and body of each scalar function.
SCALARS: dict[str, str] = {
    "fold_text(x STRING) RETURNS STRING": _fold("x"),
    "search_form(x STRING) RETURNS STRING": _form("x"),
    "catalog_norm(x STRING) RETURNS STRING": r"nullif(trim(regexp_replace(lower(coalesce(x, '')), r'[^\p{L}\p{N}]+', ' ')), '')",
    "canonical_key(x STRING) RETURNS STRING": f"array_join(array_sort(filter(split({_form('x')}, ' '), w -> w <> '' AND w NOT IN ({_LEFT_OUT}) AND NOT rlike(w, r'{_SHAPES}'))), ' ')",
    "normalize_canonical_key(key STRING, name STRING DEFAULT '') RETURNS STRING": _normal_key(),
    "name_is_organic(x STRING) RETURNS BOOLEAN": rf"rlike({_fold('x')}, r'(?U)\b(bio|biologisch|biologische|organic)\b')",
    "variant_signature(x STRING) RETURNS STRING": "concat_ws('|', " + ", ".join(rf"CASE WHEN rlike(lower(coalesce(x, '')), r'(?U)\b({p})\b') THEN '{flag}' END" for flag, p in W.VARIANTS) + ")",
    "to_numeric(x STRING) RETURNS DECIMAL(38,6)": r"""(SELECT CASE WHEN rlike(k, r'^-?([0-9]+\.?[0-9]*|\.[0-9]+)$') THEN try_cast(k AS DECIMAL(38,6)) END FROM (SELECT translate(regexp_replace(trim(x), '[^0-9,.-]', ''), ',', '.') AS k))""",
    "to_cents(x DECIMAL(38,6)) RETURNS INT": "try_cast(round(x * 100, 0) AS INT)",
    "norm_unit(x STRING) RETURNS STRING": "CASE WHEN lower(trim(x)) IN ('liter', 'litre') THEN 'l' WHEN lower(trim(x)) IN ('kilogram', 'kilo') THEN 'kg' ELSE nullif(lower(trim(x)), '') END",
    "normalize_ean(x STRING) RETURNS STRING": "(SELECT CASE WHEN char_length(d) BETWEEN 8 AND 14 AND NOT rlike(d, '^0+$') THEN lpad(d, 14, '0') END FROM (SELECT regexp_replace(coalesce(x, ''), '[^0-9]', '') AS d))",
    "price_per(price DOUBLE, quantity DOUBLE) RETURNS DOUBLE": "CASE WHEN quantity > 0 THEN round(price / quantity, 2) END",
}


def _grams(x: str, w: str, i: str) -> str:
    """Ordered trigrams of a text; ``w`` and ``i`` name the variables."""
    words = rf"filter(split(regexp_replace(lower({x}), r'[^\p{{L}}\p{{N}}]+', ' '), ' '), {w} -> {w} <> '')"
    return f"flatten(transform({words}, {w} -> transform(sequence(1, char_length({w}) + 1), {i} -> substr(concat('  ', {w}, ' '), {i}, 3))))"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(try_divide(size(array_intersect({a}, {b})), size(array_union({a}, {b}))), 0D)"


def _best_extent(a: str, b: str) -> str:
    """Best likeness of distinct trigrams with any run of a name's: only runs between shared ones are compared."""
    places = f"filter(sequence(1, size({b})), p0 -> array_contains({a}, get({b}, p0 - 1)))"
    runs = f"flatten(transform(ps, p1 -> transform(filter(ps, p2 -> p2 >= p1), p2 -> {_jaccard(a, f'slice({b}, p1, p2 - p1 + 1)')})))"
    return f"CASE WHEN size({a}) > 0 AND size({b}) > 0 THEN get(transform(array({places}), ps -> coalesce(array_max({runs}), 0D)), 0) ELSE 0D END"


def _match(q: str, w: str) -> str:
    """How well a word (w, t) answers a searched one (w, t)."""
    return f"""CASE WHEN {q}.w = '' OR {w}.w = '' THEN 0D WHEN {w}.w = {q}.w THEN 1D
        WHEN startswith({w}.w, {q}.w) AND substr({w}.w, char_length({q}.w) + 1) IN ({_listed(W.ENDINGS)}) THEN 0.93D
        WHEN char_length({q}.w) >= 4 AND endswith({w}.w, {q}.w) THEN 0.88D WHEN char_length({q}.w) >= 5 AND contains({w}.w, {q}.w) THEN 0.42D
        WHEN char_length({q}.w) >= 3 AND startswith({w}.w, {q}.w) THEN 0.34D WHEN {_jaccard(f'{q}.t', f'{w}.t')} >= {LEAST_SIMILAR}D THEN 0.72D ELSE 0D END"""


def _mean_best(outer: str, inner: str, match: str) -> str:
    """Mean over x of ``outer`` of the best ``match`` with a y of ``inner``."""
    best = f"transform({outer}, x -> array_max(transform({inner}, y -> {match})))"
    return f"CASE WHEN size({outer}) > 0 AND size({inner}) > 0 THEN aggregate({best}, 0D, (s, v) -> s + v) / size({outer}) ELSE 0D END"


SCALARS["trigrams(x STRING) RETURNS ARRAY<STRING>"] = _grams("x", "w", "i")
SCALARS["word_similarity(a STRING, b STRING) RETURNS DOUBLE"] = f"(SELECT {_best_extent('ga', 'gb')} FROM (SELECT array_distinct({_grams('a', 'w', 'i')}) AS ga, {_grams('b', 'w', 'i')} AS gb))"

# ---------------------------------------------------------------- table functions


def _search(columns: list[str]) -> str:
    """A search as one chain: words of the query, names that share a trigram, names that count, their scores, products, ranks."""
    words = f"filter(split(qre, ' '), x -> char_length(x) >= 2 AND x NOT IN ({_listed(W.SEARCH_STOP)}))"
    graded = f"transform(array_distinct(qtok), x -> struct(x AS w, array_distinct({_grams('x', 'u', 'i')}) AS t))"
    shared = "size(array_intersect(x.t, grams))"
    counts = f"exists(qtok, x -> (char_length(x.w) >= 3 AND contains(name_search, x.w)) OR CASE WHEN {shared} >= {LEAST_SIMILAR}D * size(x.t) THEN {_best_extent('x.t', 'grams')} >= {LEAST_SIMILAR}D ELSE false END)"
    telling = f"filter(words, x -> x.w NOT IN ({_listed(W.SEARCH_STOP)}))"
    asked = f"""
        SELECT qre, {graded} AS qtok FROM (
            SELECT qre, CASE WHEN size({words}) > 0 THEN {words} WHEN qre <> '' THEN array(qre) ELSE CAST(array() AS ARRAY<STRING>) END AS qtok
            FROM (SELECT {_form('search_products.query_text')} AS qre))"""
    met = f"SELECT DISTINCT qre, qtok, name_search FROM (SELECT qre, qtok, explode(array_distinct(flatten(transform(qtok, x -> x.t)))) AS t FROM ({asked})) JOIN catalog_name_trigrams USING (t)"
    scored = f"""
        SELECT name_search, round({_best_extent('array_distinct(qgrams)', 'grams')}, 6) AS alike, coverage,
               round(least(1D, 0.55D * coverage + 0.45D * {_mean_best('telling', 'qtok', _match('y', 'x'))} + 0.05D * (char_length(qre) / greatest(char_length(name_search), 1))), 6) AS match_score
        FROM (SELECT *, {_grams('qre', 'w', 'i')} AS qgrams, {_mean_best('qtok', 'words', _match('x', 'y'))} AS coverage, {telling} AS telling
              FROM ({met}) JOIN catalog_names USING (name_search) WHERE {counts})"""
    shown = ", ".join(columns)
    return f"""
        SELECT {shown}, match_score, rank FROM (
            SELECT *, CAST(row_number() OVER (ORDER BY match_score DESC, char_length(name), current_price_cents ASC NULLS LAST, name, id) AS INT) AS rank FROM (
                SELECT *, row_number() OVER (ORDER BY alike DESC, id) AS first FROM catalog_available JOIN ({scored}) USING (name_search)
                WHERE search_products.store_filter IS NULL OR store_id = search_products.store_filter)
            WHERE first <= {search.CANDIDATES} AND coverage > 0)
        WHERE rank <= least(greatest(search_products.match_count, 1), 20)"""


def _offers(columns: list[str]) -> str:
    """Offers of the one group that answers a query, the best named and cheapest first by ``place``."""
    asked = f"SELECT {_form('search_product_offers.query_text')} AS form, search_product_offers.query_text AS said, greatest(search_product_offers.match_count, 12) AS most"
    keyed = f"SELECT form, coalesce(try_element_at({_table(W.STAPLES)}, k), k) AS canonical_key FROM (SELECT form, array_join(filter(split(form, ' '), x -> x <> ''), '_') AS k FROM ({asked}))"
    group = f"""
        SELECT canonical_key, grp_score, form FROM (
            SELECT *, row_number() OVER (ORDER BY priority, stores DESC, grp_score DESC, hits DESC, canonical_key) AS n FROM (
                SELECT canonical_key, 1D AS grp_score, members AS hits, stores, 0 AS priority, form FROM catalog_groups JOIN ({keyed}) USING (canonical_key)
                UNION ALL
                SELECT canonical_key, grp_score, hits, stores, 1, form FROM (
                    SELECT *, max(grp_score) OVER () AS top FROM (
                        SELECT form, canonical_key, max(match_score) AS grp_score, count(*) AS hits
                        FROM ({asked}) a, LATERAL search_products(a.said, NULL, a.most) WHERE canonical_key <> '' GROUP BY form, canonical_key))
                JOIN catalog_groups USING (canonical_key) WHERE grp_score >= top - 0.06D))
        WHERE n = 1"""
    words = "filter(split(form, ' '), x -> x <> '')"
    rank = f"""CASE WHEN form <> '' AND folded = form THEN 4 WHEN form <> '' AND contains(folded, form) THEN 3 WHEN size({words}) > 0 AND forall({words}, x -> contains(folded, x)) THEN 2
        WHEN exists({words}, x -> contains(folded, x)) THEN 1 ELSE 0 END"""
    shown = ", ".join(columns)
    return f"""
        SELECT {shown}, grp_score AS match_score, offer_rank,
               CAST(row_number() OVER (ORDER BY offer_rank DESC, current_price_cents ASC NULLS LAST, unit_price_cents ASC NULLS LAST, store_id, name, id) AS INT) AS place
        FROM (SELECT *, {rank} AS offer_rank FROM (SELECT *, {_fold('name')} AS folded FROM catalog_available JOIN ({group}) USING (canonical_key) WHERE current_price_cents IS NULL OR current_price_cents > 0))"""


def _same(columns: list[str], function: str, key: str, more: str = "true", itself: bool = True) -> str:
    """Available products that share a key with the one asked for, which counts even without a key."""
    shown = ", ".join(f"p.{c}" for c in columns)
    alone = f"UNION ALL SELECT {shown} FROM catalog_products p WHERE p.id = {function}.product_id AND p.is_available AND {key.format('p')} IS NULL" if itself else ""
    return f"""
        SELECT {shown} FROM catalog_products p JOIN (SELECT DISTINCT {key.format('o')} AS own FROM catalog_products o WHERE o.id = {function}.product_id) ON {key.format('p')} = own
        WHERE p.is_available AND {more} {alone}"""


def _replace(spark: SparkSession, head: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_scalars(spark: SparkSession) -> None:
    """The scalar functions; each equals the column function of its name."""
    for head, body in SCALARS.items():
        _replace(spark, head, body)


def register(spark: SparkSession, products: DataFrame, silver: DataFrame | None = None) -> None:
    """All functions over a catalogue of products and, where it is given, a silver table. Nothing runs before a function is called.

    A catalogue that is searched often should be a table, and its views ``catalog_name_trigrams`` (t, name_search) and
    ``catalog_names`` may be put in place from a kept table after this, under the same names.
    """
    register_scalars(spark)
    columns = products.columns
    for name, kind in (("exact_group_key", "string"), ("ingredient_id", "string")):
        if name not in columns:
            products = products.withColumn(name, F.lit(None).cast(kind))
    available = products.filter("is_available").select(*columns)
    names = available.select("name_search").filter("name_search is not null").distinct()
    graded = names.select("name_search", trigrams(F.col("name_search")).alias("grams"), search._graded(search._words(F.col("name_search"))).alias("words"))
    groups = available.filter("canonical_key <> ''").groupBy("canonical_key").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("store_id").alias("stores"))
    views = {
        "catalog_products": products, "catalog_available": available, "catalog_names": graded, "catalog_groups": groups,
        "catalog_name_trigrams": name_index(names).select("t", "name_search"),
        "product_price_matrix": search.product_price_matrix(products), "ingredient_price_matrix": search.ingredient_price_matrix(products),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in available.schema)
    _replace(spark, f"search_products(query_text STRING, store_filter STRING DEFAULT NULL, match_count INT DEFAULT 8) RETURNS TABLE ({typed}, match_score DOUBLE, rank INT)", _search(columns))
    _replace(spark, f"search_product_offers(query_text STRING, match_count INT DEFAULT 8) RETURNS TABLE ({typed}, match_score DOUBLE, offer_rank INT, place INT)", _offers(columns))
    priced = "(p.current_price_cents IS NULL OR p.current_price_cents > 0)"
    kind = "CASE WHEN get_product_group_offers.group_kind = 'exact' THEN {0}.exact_group_key ELSE {0}.ingredient_id END"
    _replace(spark, f"product_price_offers(product_id STRING) RETURNS TABLE ({typed})", _same(columns, "product_price_offers", "{0}.ean_norm"))
    _replace(spark, f"product_group_offers(product_id STRING) RETURNS TABLE ({typed})", _same(columns, "product_group_offers", "nullif({0}.canonical_key, '')", priced, itself=False))
    _replace(spark, f"get_product_group_offers(product_id STRING, group_kind STRING DEFAULT 'exact') RETURNS TABLE ({typed})", _same(columns, "get_product_group_offers", kind))
    _over(spark, "canonical_baseline", canonical.baseline(products))
    if silver is not None:
        _over(spark, "exact_ean_groups", grouping.ean_groups(silver))
        _over(spark, "silver_products", silver, "store")


def _over(spark: SparkSession, name: str, rows: DataFrame, store: str | None = None) -> None:
    """A table function that gives the rows of a view, of one store if it takes one."""
    rows.createOrReplaceTempView(f"catalog_{name}")
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    taken, chosen = ("", "") if store is None else ("store_filter STRING DEFAULT NULL", f" WHERE {name}.store_filter IS NULL OR {store} = {name}.store_filter")
    _replace(spark, f"{name}({taken}) RETURNS TABLE ({typed})", f"SELECT * FROM catalog_{name}{chosen}")
