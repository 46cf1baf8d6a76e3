"""Landed rows to the latest product of each store, and on to public products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from kassabon.functions import jsons, numbers, text, web
from kassabon.functions.words import STORES
from kassabon.operators.keyed import latest_per_key
from kassabon.sources.sinks import insert_new, upsert

# Where each store's product text holds a field, the first non-null path counts.
PATHS = {
    "name": {
        "ah": ["card.title", "detail.productCard.title"],
        "jumbo": ["detail.title", "listing.title"],
        "dirk": ["detail.headerText", "list.productInformation.headerText"],
        "plus": ["pdp.Name", "plp.Name"],
        "spar": ["product_name"],
        "aldi": ["detail.name", "name"],
    },
    "ean": {
        "ah": ["detail.tradeItem.gtin", "card.gtin"],
        "jumbo": ["detail.ean"],
        "dirk": ["detail.barcode"],
        "plus": ["pdp.EAN", "pdp.Medicine.EAN", "plp.EAN"],
        "spar": ["gtin13"],
        "aldi": ["detail.ean", "ean", "detail.gtin", "gtin"],
    },
    "pack": {"dirk": ["detail.packaging"], "plus": ["plp.Product_Subtitle"], "spar": ["package"], "aldi": ["salesUnit"]},
    "image": {
        "ah": ["card.images.0.url"],
        "jumbo": ["detail.image", "listing.image"],
        "dirk": ["detail.images.0.image_url", "list.productInformation.image"],
        "plus": ["pdp.ImageURL", "plp.ImageURL"],
        "spar": ["images.0"],
        "aldi": ["detail.assets.0.url", "assets.0.url"],
    },
}
# Prices by store in order; "cents" are hundredths, "zero" prices of 0 don't count.
PRICES = {
    "ah": [("", p) for p in ("card.currentPrice", "detail.productCard.currentPrice", "card.priceBeforeBonus", "detail.productCard.priceBeforeBonus")],
    "jumbo": [("cents", p) for p in ("detail.price.promoPrice", "detail.price.price", "listing.price.promoPrice", "listing.price.price")],
    "dirk": [("zero", "list.offerPrice"), ("zero", "detail.productAssortment.offerPrice"), ("", "list.normalPrice"), ("", "detail.productAssortment.normalPrice")],
    "plus": [("zero", "pdp.NewPrice"), ("zero", "plp.NewPrice"), ("", "pdp.OriginalPrice"), ("", "plp.OriginalPrice")],
    "spar": [("", "price_visible"), ("", "price_jsonld"), ("", "price_data_layer")],
    "aldi": [("", "currentPrice.priceValue"), ("", "detail.currentPrice.priceValue")],
}
UNIT_TEXTS = ["card.unitPriceDescription", "detail.productCard.unitPriceDescription"]
UNIT_PRICES = {"price": ["detail.price.pricePerUnit.price", "listing.price.pricePerUnit.price"], "unit": ["detail.price.pricePerUnit.unit", "listing.price.pricePerUnit.unit"]}
IMAGE_HOST = "https://web-fileserver.dirk.nl/"


def _by_store(fields: dict[str, Column]) -> Column:
    out = F.lit(None)
    for store, value in fields.items():
        out = F.when(F.col("store") == store, value).otherwise(out)
    return out


def _raw(*paths: str) -> Column:
    return F.coalesce(*[jsons.parsed_path(F.col("_parsed"), f"raw.{p}") for p in paths])


def _price(kind: str, path: str) -> Column:
    if kind == "cents":
        return numbers.from_cents(_raw(path)).cast(numbers.MONEY)
    value = numbers.to_numeric(_raw(path))
    return F.nullif(value, F.lit(0)) if kind == "zero" else value


def parsed(rows: DataFrame, column: str = "raw_data") -> DataFrame:
    """Landed rows with their text as a variant, as a table keeps them; a text that is no JSON becomes null."""
    return rows.withColumn(column, F.try_parse_json(column))


def _is_parsed(rows: DataFrame) -> bool:
    return isinstance(rows.schema["raw_data"].dataType, VariantType)


def bronze(lines: DataFrame, landed_at: Column, run: str = "run") -> DataFrame:
    """Landed envelopes (value) as rows with a hash; the same text of a store is one row.

    Rows are shuffled by their hash before doubles are dropped: dropped on the way as well, all the texts that one task read would lie in its memory.
    """
    text_of = F.col("value")
    store = jsons.path(text_of, "store")
    rows = lines.select(
        jsons.row_hash(store, text_of).alias("id"),
        F.lit(run).alias("scrape_run_id"),
        store.alias("store"),
        text_of.alias("raw_data"),
        jsons.row_hash(store, text_of).alias("row_hash"),
        F.try_to_timestamp(jsons.path(text_of, "scraped_at")).alias("scraped_at"),
        landed_at.alias("created_at"),
    )
    return rows.filter(F.col("store").isin(*STORES)).repartition("row_hash").dropDuplicates(["row_hash"])


def land(old: DataFrame, lines: DataFrame, landed_at: Column, run: str = "run") -> tuple[DataFrame, DataFrame]:
    """(table after landing, counts of new and known rows). A table of parsed rows takes the new ones parsed."""
    rows = bronze(lines, landed_at, run)
    fresh = insert_new(old, rows, ["row_hash"])
    known = rows.agg(F.count(F.lit(1)).alias("all")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("new_rows"))).select("new_rows", (F.col("all") - F.col("new_rows")).alias("known_rows"))
    return old.unionByName(parsed(fresh) if _is_parsed(old) else fresh), known


def silver(rows: DataFrame, store: str | None = None, image_host: str = IMAGE_HOST) -> DataFrame:
    """The latest row of each (store, external id) with its fields extracted. A row that landed parsed is not parsed again."""
    if store is not None:
        rows = rows.filter(F.col("store") == store)
    at_hand = _is_parsed(rows)
    own_id = jsons.parsed_path(F.col("raw_data"), "external_id") if at_hand else jsons.path(F.col("raw_data"), "external_id")
    rows = rows.withColumn("external_id", F.coalesce(own_id, F.col("id")))
    rows = latest_per_key(rows, ["store", "external_id"], "scraped_at", "created_at", "id")
    rows = rows.withColumn("_parsed", F.col("raw_data") if at_hand else F.try_parse_json("raw_data"))  # once a row, whatever the number of paths
    pack = numbers.quantity_base(_by_store({s: _raw(*p) for s, p in PATHS["pack"].items()}))
    images = {s: _raw(*p) for s, p in PATHS["image"].items()}
    images["dirk"] = web.file_url(images["dirk"], image_host)
    images["aldi"] = F.coalesce(jsons.primary_asset_of(F.col("_parsed"), "raw.assets"), images["aldi"])
    clean = lambda c: text.none_if_empty(F.trim(c))
    rows = rows.select(
        "store", "external_id", F.col("id").alias("bronze_product_id"), "_parsed", "scraped_at",
        clean(_by_store({s: _raw(*p) for s, p in PATHS["name"].items()})).alias("name"),
        clean(_by_store({s: _raw(*p) for s, p in PATHS["ean"].items()})).alias("ean"),
        _by_store({s: F.coalesce(*[_price(*p) for p in ps]) for s, ps in PRICES.items()}).cast("decimal(12,2)").alias("price"),
        clean(_by_store(images)).alias("image_url"),
        pack.alias("pack"),
        _raw(*UNIT_TEXTS).alias("unit_text"),
    )
    ah_price = numbers.to_numeric(text.none_if_empty(F.regexp_extract("unit_text", r"([0-9]+(?:[.,][0-9]+)?)\s*$", 1)))
    ah_unit = text.none_if_empty(F.regexp_extract("unit_text", r"per\s+([0-9]*\s*[a-zA-Z]+)", 1))
    jumbo_price = F.coalesce(*[numbers.from_cents(_raw(p)) for p in UNIT_PRICES["price"]])
    base = F.when(F.col("store") == "ah", ah_price.cast("double")).when(F.col("store") == "jumbo", jumbo_price.cast("double")).otherwise(numbers.price_per(F.col("price"), F.col("pack.qty")))
    unit = F.when(F.col("store") == "ah", ah_unit).when(F.col("store") == "jumbo", _raw(*UNIT_PRICES["unit"])).otherwise(F.col("pack.unit"))
    return rows.select(
        F.sha2(F.concat_ws(":", "store", "external_id"), 256).alias("id"),
        "bronze_product_id", "store", "external_id", "name", "ean", "price",
        base.cast("decimal(12,2)").alias("base_price"), numbers.norm_unit(unit).alias("base_price_unit"),
        "image_url", F.col("scraped_at").alias("first_seen_at"), F.col("scraped_at").alias("last_seen_at"),
    )


def refresh_silver(old: DataFrame, rows: DataFrame, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(silver table after the refresh, rows refreshed by store). When a product was first seen stays."""
    fresh = silver(rows, store)
    return upsert(old, fresh, ["store", "external_id"], keep=("first_seen_at", "id")), fresh.groupBy(F.col("store").alias("store_id")).agg(F.count(F.lit(1)).cast("int").alias("rows_refreshed"))


def products(silver_rows: DataFrame, store: str | None = None) -> DataFrame:
    """Public products of named silver rows: cents, search name and article number."""
    rows = silver_rows.filter("name is not null")
    if store is not None:
        rows = rows.filter(F.col("store") == store)
    return rows.select(
        F.col("id"), F.col("store").alias("store_id"), F.col("id").alias("silver_product_id"), "external_id", "name",
        numbers.to_cents(F.col("price")).alias("current_price_cents"), numbers.to_cents(F.col("base_price")).alias("unit_price_cents"),
        F.col("base_price_unit").alias("unit_price_unit"), F.lit(True).alias("is_available"), "image_url", "ean",
        numbers.normalize_ean(F.col("ean")).alias("ean_norm"), text.fold_text(F.col("name")).alias("name_search"),
        F.lit(None).cast("string").alias("canonical_key"), F.lit(None).cast("string").alias("canonical_name"), F.lit(False).alias("is_organic"),
    )


def publish(old: DataFrame, silver_rows: DataFrame, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(products after promotion, rows by store). Grouping columns of known products stay."""
    fresh = products(silver_rows, store)
    after = upsert(old, fresh, ["store_id", "external_id"], keep=("id", "canonical_key", "canonical_name", "is_organic"))
    return after, fresh.groupBy("store_id").agg(F.count(F.lit(1)).cast("int").alias("rows_upserted"))
