"""Recipes held against what a recipe must say: a table of those that do, and one of the others with the reasons."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassabon.functions import jsons
from kassabon.functions.text import once

# What fields of a recipe may say, and how long its tags are.
PLATFORMS = ("instagram", "tiktok", "youtube", "facebook", "pinterest", "blog", "manual")
FIELD_SOURCES = ("source", "ai_suggestion")
QUANTITY_SOURCES = ("source", "missing", "ai_suggestion")
STATUSES = ("complete", "incomplete")
MISSING_FIELDS = ("quantities", "ingredients", "instructions", "servings")
TAGS, TAG_LENGTH = 8, 32

NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
ADDRESS = r"(?i)^\s*((https?|wss?|ftp):[/\\]*[^\s/\\?#:@]|(?!https?:|wss?:|ftp:)[a-z][a-z0-9+.-]*:)"

Rule = Callable[[Column], Column]  # of what lies at a place, a variant; null for nothing


def _kind(x: Column) -> Column:
    """Type of a value: VOID for a JSON null, ABSENT for nothing."""
    return F.coalesce(F.schema_of_variant(x), F.lit("ABSENT"))


def _said(x: Column) -> Column:
    return F.try_variant_get(x, "$", "string")


def _items(x: Column) -> Column:
    """The items of a list; null for anything else."""
    return F.try_variant_get(x, "$", "array<variant>")


def _fields(x: Column, names: Iterable[str]) -> Column:
    """The named fields of an object, read in one go; null for anything else."""
    return F.try_variant_get(x, "$", f"struct<{','.join(f'`{name}`:variant' for name in names)}>")


def _reads(names: Iterable[str]) -> Rule:
    return lambda x: _fields(x, names)


def _of(rule: Rule, field: str) -> Rule:
    """A rule of a field, for a struct."""
    return lambda x: rule(x[field])


def _utf16(x: Column) -> Column:
    return F.octet_length(F.encode(x, "UTF-16BE")) / 2


def _text(x: Column) -> Column:
    return _kind(x) == "STRING"


def _some_text(x: Column) -> Column:
    return _text(x) & (_said(x) != "")


def _address(x: Column) -> Column:
    return _text(x) & _said(x).rlike(ADDRESS)


def _number(x: Column) -> Column:
    return _kind(x).rlike(NUMBER)


def _boolean(x: Column) -> Column:
    return _kind(x) == "BOOLEAN"


def _from(least: int) -> Rule:
    """A whole number of at least so much."""

    def rule(x: Column) -> Column:
        value = F.try_variant_get(x, "$", "double")
        return _number(x) & (value >= least) & (value == F.floor(value))

    return rule


def _between(low: float, high: float) -> Rule:
    return lambda x: _number(x) & F.try_variant_get(x, "$", "double").between(low, high)


def _one_of(words: tuple[str, ...]) -> Rule:
    return lambda x: _text(x) & _said(x).isin(*words)


def _or_absent(rule: Rule) -> Rule:
    return lambda x: x.isNull() | rule(x)


def _or_null(rule: Rule) -> Rule:
    """Absent or a JSON null will do as well."""
    return lambda x: x.isNull() | F.is_variant_null(x) | rule(x)


def _passes(rule: Rule) -> Rule:
    return lambda x: F.coalesce(rule(x), F.lit(False))


def _each(rule: Rule, most: int | None = None) -> Rule:
    """A list of at most so many items, each of which passes."""

    def all_pass(x: Column) -> Column:
        few = F.lit(True) if most is None else F.size(_items(x)) <= most
        return few & F.forall(_items(x), _passes(rule))

    return all_pass


def _tag(x: Column) -> Column:
    return _text(x) & _utf16(F.regexp_replace(_said(x), r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+$", "")).between(1, TAG_LENGTH)


INGREDIENT: dict[str, Rule] = {
    "rawText": _some_text,
    "ingredientName": _some_text,
    "quantity": _or_null(_number),
    **{name: _or_null(_text) for name in ("unit", "normalizedIngredientName", "dutchIngredientName", "preparation")},
    "optional": _or_absent(_boolean),
    "ingredientSource": _or_absent(_one_of(FIELD_SOURCES)),
    "quantitySource": _or_absent(_one_of(QUANTITY_SOURCES)),
}
INSTRUCTION: dict[str, Rule] = {"text": _some_text, "source": _or_absent(_one_of(FIELD_SOURCES))}
RECIPE: dict[str, Rule] = {
    "title": _some_text,
    "description": _or_null(_text),
    "servings": _or_null(_from(1)),
    **{name: _or_null(_from(0)) for name in ("prepTimeMinutes", "cookTimeMinutes", "totalTimeMinutes")},
    "tags": _or_absent(_each(_tag, most=TAGS)),
    "imageUrl": _or_null(_address),
    "sourceUrl": _or_null(_address),
    "sourcePlatform": _or_null(_one_of(PLATFORMS)),
    "confidenceScore": _between(0, 1),
    "completeness.status": _one_of(STATUSES),
    "completeness.missingFields": _or_absent(_each(_one_of(MISSING_FIELDS))),
}


def broken_rules(doc: Column) -> Column:
    """Names of the rules that a recipe (a variant) breaks, in the order of its fields; a rule of items breaks if one item breaks it.

    What is no JSON is ``not_json``, JSON of another kind ``not_an_object``; neither is judged further.
    A list that is absent, empty or holds other things than objects goes by its own name alone.
    """
    lists = {"ingredients": INGREDIENT, "instructions": INSTRUCTION}
    plain = [name for name in RECIPE if "." not in name]
    inner = [name.split(".")[1] for name in RECIPE if "." in name]  # all of completeness

    def broken(recipe: Column, completeness: Column) -> Column:
        at = {name: recipe[name] for name in plain} | {f"completeness.{name}": completeness[name] for name in inner}
        own = F.array(*[F.when(~F.coalesce(rule(at[name]), F.lit(False)), name) for name, rule in RECIPE.items()])
        items = [once(_broken_items(name, rules), F.transform(_items(recipe[name]), _reads(rules))) for name, rules in lists.items()]
        return F.when(recipe.isNull(), F.array(F.lit("not_an_object"))).otherwise(F.array_compact(F.concat(own, *items)))

    recipe = _fields(doc, [*plain, *lists])
    judged = once(broken, recipe, _fields(F.try_variant_get(doc, "$.completeness", "variant"), inner))
    return F.when(doc.isNull(), F.array(F.lit("not_json"))).otherwise(judged)


def _broken_items(name: str, rules: dict[str, Rule]) -> Callable[[Column], Column]:
    def broken(items: Column) -> Column:
        fine = F.coalesce((F.size(items) > 0) & F.forall(items, lambda x: x.isNotNull()), F.lit(False))
        parts = [F.when(~F.forall(items, _passes(_of(rule, part))), f"{name}.{part}") for part, rule in rules.items()]
        return F.when(fine, F.array(*parts)).otherwise(F.array(F.lit(name)))

    return broken


def _judged(rows: DataFrame, text: str, doc: str, reasons: str) -> DataFrame:
    """Every row with its parsed recipe and the rules that it breaks. Rows of a generator: a filter over what it gives isn't pushed below it, where both would be made once more."""
    both = once(lambda d: F.struct(d.alias(doc), broken_rules(d).alias(reasons)), jsons.strictly_parsed(F.col(text)))
    return rows.select("*", F.inline(F.array(both)).alias(doc, reasons))


def with_reasons(rows: DataFrame, text: str, reasons: str = "reasons") -> DataFrame:
    """Every row with the rules that its recipe breaks, in one pass; none for a valid one."""
    return rows.withColumn(reasons, once(broken_rules, jsons.strictly_parsed(F.col(text))))


def judged_recipes(rows: DataFrame, text: str, doc: str = "doc", reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(valid with the parsed recipe as ``doc``, rejected with ``reasons``). Every row is in one of both; a rejected one keeps its text as it came.

    Each of both reads and judges every row once: write ``with_reasons`` once and split that where both are wanted of many rows.
    """
    judged = _judged(rows, text, doc, reasons)
    return judged.filter(F.size(reasons) == 0).drop(reasons), judged.filter(F.size(reasons) > 0).drop(doc)


def with_defaults(valid: DataFrame, doc: str = "doc") -> DataFrame:
    """Ingredients and instructions of valid recipes as lists of structs, absent fields with their defaults, and tags trimmed."""
    d = F.col(doc)
    get = lambda x, path, kind="string": F.try_variant_get(x, path, kind)
    texts = ("rawText", "ingredientName", "unit", "normalizedIngredientName", "dutchIngredientName", "preparation")
    ingredient = lambda x: F.struct(
        *[_said(x[name]).alias(name) for name in texts],
        get(x["quantity"], "$", "double").alias("quantity"),
        F.coalesce(get(x["optional"], "$", "boolean"), F.lit(False)).alias("optional"),
        *[F.coalesce(_said(x[name]), F.lit("source")).alias(name) for name in ("ingredientSource", "quantitySource")],
    )
    step = lambda x: F.struct(get(x, "$.text").alias("text"), F.coalesce(get(x, "$.source"), F.lit("source")).alias("source"))
    tags = F.transform(get(d, "$.tags", "array<string>"), lambda t: F.regexp_replace(t, r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+$", ""))
    none = F.array().cast("array<string>")
    return valid.select(
        *[c for c in valid.columns if c != doc],
        get(d, "$.title").alias("title"),
        F.transform(F.transform(get(d, "$.ingredients", "array<variant>"), _reads(INGREDIENT)), ingredient).alias("ingredients"),
        F.transform(get(d, "$.instructions", "array<variant>"), step).alias("instructions"),
        F.coalesce(tags, none).alias("tags"),
        get(d, "$.confidenceScore", "double").alias("confidence"),
        get(d, "$.completeness.status").alias("status"),
        F.coalesce(get(d, "$.completeness.missingFields", "array<string>"), none).alias("missing_fields"),
    )
