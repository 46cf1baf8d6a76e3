"""What product pages say of a product: scores, stock, nutrition, prices, categories and logos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_text, none_if_empty


def nutriscore(text: Column) -> Column:
    """The letter A to E after the score's name in a text or an address."""
    return F.upper(none_if_empty(F.regexp_extract(text, r"(?i)nutri[-_ ]?score[_\s-]*([a-e])\b", 1)))


def logo_nutriscore(logos: Column) -> Column:
    """The first score that a logo (description, image) shows."""
    seen = F.transform(logos, lambda x: F.coalesce(nutriscore(x["description"]), nutriscore(x["image"])))
    return F.get(F.filter(seen, lambda s: s.isNotNull()), 0)


def all_logos(*lists: Column) -> Column:
    """Logos (description, image) of several lists; the first of each pair stays."""
    given = F.concat(*[F.coalesce(x, F.array()) for x in lists])
    return F.array_distinct(F.transform(given, lambda x: F.struct(F.coalesce(x["description"], F.lit("")).alias("description"), F.coalesce(x["image"], F.lit("")).alias("image"))))


def availability_label(x: Column) -> Column:
    return F.substring_index(clean_text(x), "/", -1)


def in_stock(label: Column, html: Column) -> Column:
    """Whether a product can be had: its label, unless the page says that it is gone; null if neither speaks."""
    gone = F.coalesce(F.lower(html).contains("dit product is niet meer leverbaar"), F.lit(False))
    return F.when(gone, False).otherwise(F.lower(none_if_empty(availability_label(label))) == "instock")


def price_status(price: Column, available: Column) -> Column:
    return F.when(price.isNull(), "missing_price").when(~available, "sold_out_price_visible").otherwise("visible_price")


def nutrition_records(columns: Column, rows: Column) -> Column:
    """Rows of a table as (note, name, values): a row of one cell is a note; columns without a title are counted."""
    title = lambda i: F.coalesce(F.get(columns, i), F.concat(F.lit("value_"), i.cast("string")))

    def record(row: Column) -> Column:
        cells = F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0)))
        values = F.map_from_arrays(F.transform(cells, lambda _, i: title(i + 1)), cells)
        many = F.size(row) > 1
        return F.struct(F.when(~many, F.get(row, 0)).alias("note"), F.when(many, F.coalesce(F.get(row, 0), F.lit(""))).alias("name"), F.when(many, values).alias("values"))

    return F.transform(F.filter(rows, lambda r: F.size(r) > 0), record)


def price_label(labels: Column) -> Column:
    """Values of a map of labels that say something."""
    return none_if_empty(F.array_join(F.filter(F.transform(F.map_values(labels), lambda v: F.trim(v)), lambda v: v != ""), " | "))


def base_prices(prices: Column) -> Column:
    """Struct of all base prices (value, unit) as text and the first one's value and unit."""
    shown = F.transform(F.filter(prices, lambda p: p["value"].isNotNull()), lambda p: F.concat_ws("/", p["value"].cast("string"), none_if_empty(p["unit"])))
    valued = F.filter(prices, lambda p: p["value"].isNotNull())
    first = F.coalesce(F.get(valued, 0), F.try_element_at(prices, F.lit(-1)))
    return F.struct(none_if_empty(F.array_join(shown, " | ")).alias("text"), first["value"].alias("value"), first["unit"].alias("unit"))


def category_paths(levels: Column) -> Column:
    """Struct of the categories of the first level and those of all others, by level."""
    full = lambda v: F.filter(v, lambda x: x != "")
    deeper = F.array_sort(F.map_keys(F.map_filter(levels, lambda k, v: (k != "lvl0") & v.isNotNull())))
    roots = F.coalesce(full(F.try_element_at(levels, F.lit("lvl0"))), F.array().cast("array<string>"))
    return F.struct(roots.alias("roots"), F.flatten(F.transform(deeper, lambda k: full(F.try_element_at(levels, k)))).alias("paths"))


def flat_groups(departments: DataFrame, text: str) -> DataFrame:
    """(department_id, department, webgroup_id, webgroup) of each group in a JSON list of departments."""
    shape = "array<struct<id:long,description:string,webGroups:array<struct<webGroupId:long,description:string>>>>"
    rows = departments.select(F.explode(F.from_json(text, shape)).alias("d")).select("d", F.explode("d.webGroups").alias("g"))
    return rows.select(F.col("d.id").alias("department_id"), F.col("d.description").alias("department"), F.col("g.webGroupId").alias("webgroup_id"), F.col("g.description").alias("webgroup"))


def page_data(html: Column, path: str, inner: str) -> Column:
    """A value of the JSON text that stands as a string at ``path`` of a page's data script."""
    data = F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    return F.get_json_object(F.get_json_object(data, path), inner)
