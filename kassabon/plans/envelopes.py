"""Recorded pages to envelopes: the listing card of each product with its detail, as one JSON line.

Which pages of a leaf count follows each store's rule (``landing.RULES``); the first card of a product
counts, in order of leaves, pages and places; details are joined by id or by the card's slug.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassabon.functions import labels
from kassabon.functions.text import none_if_empty
from kassabon.operators.keyed import one_per_key
from kassabon.sources.landing import RULES, read_recorded
from kassabon.sources.sinks import settled
from kassabon.workers import sent_whole

sent_whole(__name__)

# Where a card holds its id, and what card and detail are called in an envelope.
IDS = {"ah": "webshopId", "jumbo": "id", "dirk": "productId", "plus": "SKU", "aldi": "objectID"}
NAMES = {"ah": ("card", "detail"), "jumbo": ("listing", "detail"), "dirk": ("list", "detail"), "plus": ("plp", "pdp")}
FILES = "https://web-fileserver.dirk.nl/"


def _at(text: Column | str, path: str) -> Column:
    return F.get_json_object(text, f"$.{path}")


def _items(text: Column | str, path: str) -> Column:
    """JSON texts of a list's items; what is no list has none."""
    return F.coalesce(F.from_json(_at(text, path), "array<string>"), F.array().cast("array<string>"))


def walked(pages: DataFrame, store: str) -> DataFrame:
    """The pages (leaf, page, body) that a walk of each leaf takes; of a page recorded twice one counts.

    Stores that say how many pages or products there are in their first answer are read up to that,
    and to the store's bound; without a first answer there is nothing. Where a leaf stops at an empty
    page, or at one that is missing, each answer says anew how many pages follow.
    """
    rule = RULES[store]
    pages = one_per_key(pages.select("leaf", "page", "body"), ["leaf", "page"], settled(pages.select("leaf", "page", "body")))
    said = F.coalesce(F.nullif(_at("body", rule.total).try_cast("int"), F.lit(0)), F.lit(rule.none_said)) if rule.total else F.lit(rule.none_said)
    if rule.stops_empty:
        light = pages.select("leaf", "page", said.alias("said"), (F.size(_items("body", rule.products)) > 0).alias("full"))
        order = Window.partitionBy("leaf").orderBy("page")
        reached = F.coalesce(F.col("page") <= F.lag("said").over(order), F.col("page") <= rule.first)
        light = light.withColumn("on", F.col("full") & (F.col("page") == F.row_number().over(order) - 1 + rule.first) & reached)
        ends = light.groupBy("leaf").agg(F.coalesce(F.min(F.when(~F.col("on"), F.col("page"))), F.max("page") + 1).alias("end"))
    else:
        first = pages.filter(F.col("page") == rule.first)
        ends = first.select("leaf", F.greatest(said, F.lit(rule.first + 1)).alias("end"))
        if rule.most is not None:
            ends = ends.withColumn("end", F.least("end", F.lit(rule.most)))
    kept = pages.join(ends, "leaf").filter((F.col("page") < F.col("end")) & ((F.col("page") - rule.first) % rule.step == 0))
    return kept.select("leaf", "page", "body")


def cards(pages: DataFrame, leaves: DataFrame, store: str) -> DataFrame:
    """(external_id, card, slug, leaf, place) of each product: its first card by leaf, page and place. ``leaves`` has (leaf, place)."""
    rule = RULES[store]
    ranks = leaves.groupBy("leaf").agg(F.min("place").alias("leaf_place"))
    rows = walked(pages, store).join(ranks, "leaf").select("leaf", "leaf_place", "page", F.posexplode(_items("body", rule.products)).alias("at", "card"))
    rows = rows.filter("card is not null")
    if store == "plus":
        rows = rows.withColumn("card", F.coalesce(F.when(_at("card", "PLP_Str").startswith("{"), _at("card", "PLP_Str")), F.col("card")))
    rows = rows.filter(F.col("card").startswith("{"))
    own = F.trim(_at("card", IDS[store]))
    slug = _at("card", {"aldi": "productSlug"}.get(store, "Slug"))
    if store == "plus":
        own = F.coalesce(none_if_empty(own), none_if_empty(F.regexp_extract(slug, r"-([0-9]+)$", 1)))
    if store == "dirk":
        rows = rows.withColumn("card", _with_member(F.col("card"), "_webGroupId", F.col("leaf")))
    rows = rows.select(own.alias("external_id"), "card", slug.alias("slug"), "leaf", F.struct("leaf_place", "page", "at").alias("place"))
    rows = rows.filter("external_id is not null and external_id not in ('', 'None')")
    best = rows.groupBy("external_id").agg(F.min_by(F.struct("card", "slug", "leaf", "place"), "place").alias("c"))
    return best.select("external_id", "c.*")


def _with_member(text: Column, name: str, value: Column) -> Column:
    """A JSON object's text with one more member, given as JSON text."""
    head = F.regexp_replace(text, r"\}\s*$", "")
    return F.concat(head, F.when(head.rlike(r"^\s*\{\s*$"), "").otherwise(","), F.lit(f'"{name}":'), value, F.lit("}"))


@F.pandas_udf(T.StringType())
def _with_image_urls(product: pd.Series) -> pd.Series:
    """Images with their address on the file server; the main one at a width. Spark can't replace a member inside a JSON text."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        said = json.loads(text)
        shown = [i for i in said.get("images") or [] if i] if isinstance(said, dict) else []
        for image in shown:
            path = image.get("image")
            url = FILES + quote(str(path).replace("\\", "/").lstrip("/"), safe="/") if path else None
            image["image_url"] = f"{url}?width=500" if url and image.get("mainImage") else url
        return json.dumps(said | {"images": shown}, ensure_ascii=False, separators=(",", ":")) if shown else text

    return product.map(one, na_action="ignore")


def details(pages: DataFrame, store: str) -> DataFrame:
    """(key, detail) of recorded detail answers: by the id that was asked for, for plus and aldi by the slug, for jumbo as they say; the last answer of a key counts."""
    if store == "jumbo":
        rows = pages.select("leaf", "page", F.posexplode(_items("body", "data.products")).alias("at", "detail"))
        rows = rows.select(_at("detail", "sku").alias("key"), "detail", F.struct("page", "leaf", "at").alias("place"))
    else:
        body = F.col("body")
        if store == "dirk":
            body = _with_image_urls(_at(body, "data.product"))
        elif store == "plus":
            data = _at(body, "data")
            body = F.when(_at(data, "ProductOut").startswith("{") | _at(data, "Product").startswith("{"), data)
        elif store == "aldi":
            calls = F.from_json(labels.page_data(body, "$.props.pageProps.apiData", "$"), "array<string>")
            found = F.filter(calls, lambda c: (F.get_json_object(c, "$[0]") == "PRODUCT_DETAIL_GET") & F.get_json_object(c, "$[1].res.products[0]").isNotNull())
            body = F.get_json_object(F.get(found, 0), "$[1].res.products[0]")
        rows = pages.select("key", body.alias("detail"), F.struct("page", "leaf").alias("place"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("detail").startswith("{"))
    return rows.groupBy("key").agg(F.max_by("detail", F.struct("place", "detail")).alias("detail"))


def envelopes(found: DataFrame, more: DataFrame | None, store: str, scraped_at: Column, limit: int | None = None) -> DataFrame:
    """(value): a JSON line for each card, with its detail where there is one. ``limit`` takes the first products of the walk."""
    if limit is not None:
        found = found.orderBy("place").limit(limit)
    by_slug = store in ("plus", "aldi")
    key = none_if_empty(F.trim("slug") if store == "plus" else F.col("slug")) if by_slug else F.col("external_id")
    rows = found.withColumn("key", key)
    rows = rows.join(more, "key", "left") if more is not None else rows.withColumn("detail", F.lit(None).cast("string"))
    if store == "aldi":
        raw = F.when(F.col("detail").isNull(), F.col("card")).otherwise(_with_member(F.col("card"), "detail", F.col("detail")))
    else:
        one, two = NAMES[store]
        none = F.lit("") if store == "plus" else F.lit(f',"{two}":null')
        raw = F.concat(F.lit(f'{{"{one}":'), "card", F.when(F.col("detail").isNull(), none).otherwise(F.concat(F.lit(f',"{two}":'), "detail")), F.lit("}"))
    head = F.to_json(F.struct(F.lit(store).alias("store"), F.date_format(scraped_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("scraped_at"), F.col("external_id")))
    return rows.select(_with_member(head, "raw", raw).alias("value"))


def ah_leaves(tops: DataFrame, children: DataFrame) -> DataFrame:
    """(leaf, name, place) of a category tree: the children of each top category, or itself without any; of a leaf under several the last name stays at the first place.

    ``tops`` has (body), a list of categories; ``children`` has (leaf, body), what each category holds.
    """
    top = tops.select(F.posexplode(F.from_json("body", "array<struct<id:string,name:string>>")).alias("at", "c")).select("at", "c.id", "c.name")
    below = children.select(F.col("leaf").alias("id"), F.from_json(_at("body", "children"), "array<struct<id:string,name:string>>").alias("below"))
    own = F.array(F.struct("id", "name"))
    rows = top.join(below, "id", "left").select("at", "name", F.posexplode(F.when(F.size("below") > 0, F.transform("below", lambda b: F.struct(b["id"].alias("id"), F.concat_ws(" / ", F.col("name"), b["name"]).alias("name")))).otherwise(own)).alias("i", "leaf"))
    place = F.struct("at", "i")
    found = rows.groupBy(F.col("leaf.id").alias("leaf")).agg(F.max_by("leaf.name", place).alias("name"), F.min(place).alias("place"))
    return found.select("leaf", "name", (F.col("place.at") * F.lit(1_000_000) + F.col("place.i")).cast("long").alias("place"))


def plus_leaves(menu: DataFrame) -> DataFrame:
    """(leaf, name, place) of the top categories of a menu that have children, in the menu's order; the first of a slug counts."""
    listed = F.coalesce(F.from_json(_at("body", "data.Categories.List"), "array<string>"), F.from_json(_at("body", "data.CategoriesJson"), "array<string>"))
    rows = menu.select(F.posexplode(listed).alias("at", "item"))
    rows = rows.withColumn("item", F.coalesce(F.when(_at("item", "Category_str").startswith("{"), _at("item", "Category_str")), F.col("item")))
    number = lambda path, kind: F.coalesce(_at("item", path).try_cast(kind), F.lit(0).cast(kind))
    rows = rows.select("at", none_if_empty(_at("item", "Slug")).alias("leaf"), F.trim(F.coalesce(_at("item", "Name"), F.lit(""))).alias("name"), number("ExternalId", "long").alias("id"), number("ParentExternalId", "long").alias("parent"), F.coalesce(_at("item", "HasChild").try_cast("boolean"), F.lit(False)).alias("more"), number("SortOrder", "double").alias("sort"))
    rows = one_per_key(rows.filter("leaf is not null"), ["leaf"], [F.col("at")]).filter("parent = 0 and id <> 0 and more")
    return rows.select("leaf", "name", F.row_number().over(Window.orderBy("sort", F.lower("name"), "at")).cast("long").alias("place"))  # a menu's top level


def dirk_leaves(departments: DataFrame) -> DataFrame:
    """(leaf, name, place) of the groups of all departments in their order. ``departments`` has (body)."""
    shape = "array<struct<webGroups:array<struct<webGroupId:string,description:string>>>>"
    rows = departments.select(F.posexplode(F.from_json(_at("body", "data.listDepartments.departments"), shape)).alias("at", "d")).select("at", F.posexplode("d.webGroups").alias("i", "g"))
    return rows.groupBy(F.col("g.webGroupId").alias("leaf")).agg(F.min(F.struct(F.col("at"), F.col("i"), F.col("g.description").alias("name"))).alias("x")).select("leaf", "x.name", (F.col("x.at") * F.lit(1_000_000) + F.col("x.i")).cast("long").alias("place"))


def one_leaf(pages: DataFrame) -> DataFrame:
    """(leaf, place) for stores of a single listing."""
    return pages.select("leaf").distinct().withColumn("place", F.lit(0).cast("long"))


def gathered(pages: Callable[[str], DataFrame], store: str, scraped_at: Column, limit: int | None = None) -> DataFrame:
    """Envelopes of a store from its recorded pages. ``pages`` gives those (leaf, page, key, body) of a kind: listing and detail, and for the leaves categories and children, menu, or departments."""
    listing = pages("listing")
    if store == "ah":
        leaves = ah_leaves(pages("categories"), pages("children"))
    elif store == "plus":
        leaves = plus_leaves(pages("menu"))
    elif store == "dirk":
        leaves = dirk_leaves(pages("departments"))
    else:
        leaves = one_leaf(listing)
    return envelopes(cards(listing, leaves, store), details(pages("detail"), store), store, scraped_at, limit)


def recorded(spark: SparkSession, path: str, store: str) -> Callable[[str], DataFrame]:
    """For ``gathered``: the kinds of pages of a landing folder, each read by itself."""
    return lambda kind: read_recorded(spark, path, "leaf", "page", "key", "body", store=store, kind=kind)


def kinds_of(pages: DataFrame, store: str) -> Callable[[str], DataFrame]:
    """For ``gathered``: the kinds of pages of a table (store, kind, leaf, page, key, body)."""
    return lambda kind: pages.filter((F.col("store") == store) & (F.col("kind") == kind)).select("leaf", "page", "key", "body")
