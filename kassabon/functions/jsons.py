"""JSON texts of stored products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once


def path(x: Column, dotted: str) -> Column:
    """Text at a dotted path; numbers among the parts index lists."""
    parts = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))
    return F.get_json_object(x, "$" + parts)


def first_path(x: Column, *dotted: str) -> Column:
    return F.coalesce(*[path(x, d) for d in dotted])


def parsed_path(x: Column, dotted: str) -> Column:
    """Text at a dotted path of a variant, so that many paths share one parse."""
    parts = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))
    return F.try_variant_get(x, "$" + parts, "string")


def strictly_parsed(x: Column) -> Column:
    """A text that is one JSON value and nothing more, as a variant, else null. Spark's own parser passes over what follows a value;
    inside a list as well as inside an object, nothing but blanks can follow it. An object that names a key twice is null."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))), "$", "array<variant>")
    held = F.try_parse_json(F.concat(F.lit('{"x":'), x, F.lit("}")))
    return once(lambda listed, held: F.when((F.size(listed) == 1) & held.isNotNull(), F.get(listed, 0)), listed, held)


def canonical(x: Column) -> Column:
    """A JSON text without blanks and with the keys of every object in order; other texts stay."""
    return F.coalesce(F.to_json(F.try_parse_json(x)), x)


def row_hash(store: Column, text: Column) -> Column:
    """SHA-256 of the store and the canonical JSON text, so that equal objects have one hash."""
    return F.sha2(F.concat_ws(":", store, canonical(text)), 256)


def external_id(candidates: list[Column], name: Column, url: Column) -> Column:
    """The first id column that says something, else one derived from name and address."""
    given = [F.nullif(F.trim(c), F.lit("")) for c in candidates]
    derived = F.concat(F.lit("derived-"), F.substring(F.sha2(F.concat_ws("|", name, F.coalesce(url, F.lit(""))), 256), 1, 24))
    return F.coalesce(*given, derived)


def primary_asset(x: Column) -> Column:
    """Address of the first asset of type primary in a JSON list."""
    assets = F.from_json(x, "array<struct<type:string,url:string>>")
    return F.get(F.filter(assets, lambda a: a["type"] == "primary"), 0)["url"]


def primary_asset_of(x: Column, dotted: str) -> Column:
    """Address of the first asset of type primary in the list at a dotted path of a variant."""
    parts = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))
    assets = F.try_variant_get(x, "$" + parts, "array<struct<type:string,url:string>>")
    return F.get(F.filter(assets, lambda a: a["type"] == "primary"), 0)["url"]


def merged(*maps: Column) -> Column:
    """Maps put together; a later one wins where it says something."""
    out = maps[0]
    for m in maps[1:]:
        fresh = F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))
        keep = F.map_filter(out, lambda k, _: ~F.coalesce(F.map_contains_key(fresh, k), F.lit(False)))  # noqa: B023
        out = F.map_concat(keep, fresh)
    return out
