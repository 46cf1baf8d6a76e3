"""Prices, quantities, units and article numbers. Casts that may fail give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, none_if_empty, once
from .words import UNITS

MONEY = "decimal(38,6)"


def to_numeric(x: Column) -> Column:
    """Digits, signs and separators of a text as a number, a comma as the point; null if that is none."""
    kept = F.translate(F.regexp_replace(F.trim(x), "[^0-9,.-]", ""), ",", ".")
    return F.when(kept.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), kept.try_cast(MONEY))


def from_cents(x: Column) -> Column:
    return F.round(to_numeric(x) / 100, 2).cast("decimal(12,2)")


def to_cents(x: Column) -> Column:
    return F.round(x * 100, 0).try_cast("int")


def norm_unit(x: Column) -> Column:
    u = F.lower(F.trim(x))
    return F.when(u.isin("liter", "litre"), "l").when(u.isin("kilogram", "kilo"), "kg").otherwise(none_if_empty(u))


def quantity_base(x: Column) -> Column:
    """Struct of quantity and unit (l or kg) of a pack text, multiplied for multipacks; volumes go before weights."""
    s = F.lower(F.coalesce(x, F.lit("")))
    times = F.coalesce(none_if_empty(F.regexp_extract(s, r"([0-9]+)\s*x\s*", 1)).try_cast("double"), F.lit(1.0))

    def read(units: str, factors: dict[str, float]) -> Column:
        pattern = rf"([0-9]+(?:[.,][0-9]+)?)\s*({units})(?:[^a-z]|$)"
        number = F.translate(none_if_empty(F.regexp_extract(s, pattern, 1)), ",", ".").try_cast("double")
        unit = F.regexp_extract(s, pattern, 2)
        factor = F.lit(1.0)
        for spelt, value in factors.items():
            factor = F.when(unit.isin(*spelt.split()), value).otherwise(factor)
        got = F.round(number * times * factor, 9)
        return F.when(got > 0, got)

    volume = read("milliliter|millilitre|centiliter|centilitre|deciliter|decilitre|liter|litre|ml|cl|dl|l", {"ml milliliter millilitre": 0.001, "cl centiliter centilitre": 0.01, "dl deciliter decilitre": 0.1})
    weight = read("kilogram|gram|kg|mg|g", {"g gram": 0.001, "mg": 0.000001})
    unit = F.when(volume.isNotNull(), "l").when(weight.isNotNull(), "kg")
    return F.struct(F.coalesce(volume, weight).alias("qty"), unit.alias("unit"))


def price_per(price: Column, quantity: Column) -> Column:
    return F.when(quantity > 0, F.round(price.cast("double") / quantity, 2))


def normalize_ean(x: Column) -> Column:
    """14 digits from 8 to 14 that aren't all zero."""
    digits = F.regexp_replace(F.coalesce(x, F.lit("")), r"[^0-9]", "")
    return F.when(F.char_length(digits).between(8, 14) & ~digits.rlike("^0+$"), F.lpad(digits, 14, "0"))


def normalize_gtin(x: Column) -> Column:
    return none_if_empty(F.regexp_replace(x, "[^0-9]", ""))


def money_cents(x: Column) -> Column:
    """Cents of the first amount in a text, separators told apart by place; half up; negative gives null."""
    m = none_if_empty(F.regexp_extract(clean_text(x), r"(-?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?)", 1))
    comma, point = m.contains(","), m.contains(".")
    comma_last = F.length(F.substring_index(m, ",", -1)) < F.length(F.substring_index(m, ".", -1))
    plain = (
        F.when(comma & point & comma_last, F.translate(F.translate(m, ".", ""), ",", "."))
        .when(comma & point, F.translate(m, ",", ""))
        .when(comma, F.translate(m, ",", "."))
        .when(point & (F.length(F.substring_index(m, ".", -1)) > 2), F.translate(m, ".", ""))
        .otherwise(m)
    )
    amount = plain.try_cast(MONEY)
    return F.when(amount >= 0, F.round(amount * 100, 0).try_cast("int"))


def first_number(x: Column) -> Column:
    return F.translate(none_if_empty(F.regexp_extract(clean_text(x), r"(\d+(?:[.,]\d+)?)", 1)), ",", ".").try_cast("double")


def package(x: Column) -> Column:
    """Struct of quantity and unit of a pack text; multipacks multiply."""
    s = F.lower(x)
    units = "kg|g|mg|l|ml|cl|stuks?|stuk"
    many, one = rf"(\d+)\s*x\s*(\d+(?:[.,]\d+)?)\s*({units})", rf"(\d+(?:[.,]\d+)?)\s*({units}|pack|pak)"
    number = lambda p, g: F.translate(none_if_empty(F.regexp_extract(s, p, g)), ",", ".").try_cast("double")
    quantity = F.coalesce(number(many, 1) * number(many, 2), number(one, 1))
    unit = F.coalesce(F.when(number(many, 2).isNotNull(), F.regexp_extract(s, many, 3)), none_if_empty(F.regexp_extract(s, one, 2)))
    unit = F.when(unit.isin("stuk", "stuks"), "piece").when(unit.isin("pak", "pack"), "pack").otherwise(unit)
    return F.struct(quantity.alias("qty"), unit.alias("unit"))


def is_available(x: Column) -> Column:
    return ~F.lower(F.coalesce(clean_text(x), F.lit(""))).isin("false", "0", "nee", "no", "outofstock", "unavailable", "niet beschikbaar")


def recipe_unit(x: Column) -> Column:
    """Struct of unit and factor; an unknown unit keeps its name and factor 1, none gives nulls."""
    key = F.regexp_replace(F.trim(F.lower(none_if_empty(x))), r"\.$", "")
    unit = F.create_map(*[F.lit(v) for k, (u, _) in UNITS.items() for v in (k, u)])
    factor = F.create_map(*[F.lit(v) for k, (_, f) in UNITS.items() for v in (k, float(f))])
    return F.struct(F.coalesce(F.try_element_at(unit, key), key).alias("unit"), F.when(key.isNotNull(), F.coalesce(F.try_element_at(factor, key), F.lit(1.0))).alias("factor"))


def format_quantity(quantity: Column, unit: Column) -> Column:
    shown = F.when(quantity == F.floor(quantity), quantity.cast("long").cast("string")).otherwise(F.format_string("%.1f", quantity))
    return F.when(quantity.isNull(), "").otherwise(F.concat_ws(" ", shown, none_if_empty(unit)))


def effective_price(offer: Column, normal: Column) -> Column:
    return F.when(offer > 0, offer).otherwise(normal)


def pack_quantity(price: Column, base_price: Column, places: int = 2) -> Column:
    return F.when(base_price > 0, F.round(price / base_price, places))


def cents_text(x: Column) -> Column:
    return F.format_string("%.2f", x / 100)


def positive_number(x: Column) -> Column:
    n = F.translate(F.trim(x), ",", ".").try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n)


def price_from_parts(euros: Column, cents: Column) -> Column:
    e, c = F.regexp_replace(euros, r"\D", ""), F.regexp_replace(F.coalesce(cents, F.lit("")), r"\D", "")
    return F.concat(none_if_empty(e), F.lit("."), F.substring(F.rpad(c, 2, "0"), 1, 2)).try_cast("decimal(12,2)")


def seconds(x: Column) -> Column:
    """A duration; above 1000 it is in milliseconds."""
    n = x.try_cast("double")
    return F.when(n > 1000, n / 1000).otherwise(n)


# Units of weight and volume with what one of them is in kg or l, and words of pieces.
AMOUNTS = {"kilogram kilo kg": ("kg", "1"), "gram gr g": ("kg", "0.001"), "liter litre ltr l": ("l", "1"), "centiliter centilitre cl": ("l", "0.01"), "milliliter millilitre ml": ("l", "0.001")}
PIECES = r"stuks|stuk|st\.?|tabs|rollen|zakjes|capsules"


def base_unit_price(package: Column, price: Column) -> Column:
    """Struct of text, value and unit: the price of a kg, a l or a piece. Packs of a range have none; ties go to the even cent."""
    times = r"(\d+(?:\.\d+)?)\s*[x×]\s*"
    spelt = "|".join(w for ws in AMOUNTS for w in ws.split())
    amount, pieces = rf"(\d+(?:\.\d+)?)\s*({spelt})\b", rf"(\d+(?:\.\d+)?)\s*({PIECES})(?:\b|$)"
    units = F.create_map(*[F.lit(x) for ws, (unit, _) in AMOUNTS.items() for w in ws.split() for x in (w, unit)])
    sizes = F.create_map(*[x for ws, (_, size) in AMOUNTS.items() for w in ws.split() for x in (F.lit(w), F.lit(size).cast("decimal(4,3)"))])
    number = lambda s, p: none_if_empty(F.regexp_extract(s, p, 1)).try_cast("decimal(12,4)")

    def measured(s: Column, many: Column, price: Column) -> Column:
        rest = F.when(many.isNotNull(), F.regexp_extract(s, rf"(?s){times}(.*)$", 2)).otherwise(s)
        count = F.coalesce(many, F.lit(1).cast("decimal(12,4)"))
        word = F.regexp_extract(rest, amount, 2)
        weighed = (number(rest, amount) * count * F.try_element_at(sizes, word)).cast("decimal(24,9)")
        counted = F.when(rest.contains("per stuk"), F.lit(1).cast("decimal(24,9)")).otherwise((number(rest, pieces) * count).cast("decimal(24,9)"))
        usable = (price > 0) & (s != "") & ~s.rlike(" (of|t/m|tot) ")
        return F.when(usable & (weighed > 0), F.struct(weighed.alias("quantity"), F.try_element_at(units, word).alias("unit"))).when(usable & (counted > 0), F.struct(counted.alias("quantity"), F.lit("stuk").alias("unit")))

    def priced(found: Column, price: Column) -> Column:
        value = F.bround(price / found["quantity"], 2).cast("decimal(12,2)")
        return F.struct(F.concat_ws("/", value.cast("string"), found["unit"]).alias("text"), value.alias("value"), found["unit"].alias("unit"))

    s, price = F.translate(F.lower(package), ",", "."), price.cast("decimal(12,2)")
    return once(priced, once(measured, s, number(s, times), price), price)


def plain_number(x: Column) -> Column:
    """A finite number's text without zeros at its end."""
    n = F.translate(F.trim(x), ",", ".").try_cast("decimal(38,9)")
    return F.regexp_replace(F.regexp_replace(n.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def first_finite(*columns: Column) -> Column:
    """The first of several texts that is a finite number."""
    numbers = [c.cast("string").try_cast("double") for c in columns]
    return F.coalesce(*[F.when(F.abs(n) < float("inf"), n) for n in numbers])
