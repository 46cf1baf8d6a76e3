"""Names: folding, keys, signatures and token scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

NOT_ALNUM = r"[^\p{L}\p{N}]+"
NOT_ALNUM_SPACE = r"[^\p{L}\p{N} ]+"


def none_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def word_match(x: Column, alternatives: str) -> Column:
    """Whether one of the alternatives stands between word edges; letters with marks are letters."""
    return x.rlike(rf"(?U)\b({alternatives})\b")


def fold_text(x: Column) -> Column:
    """Lower case without marks; null becomes empty."""
    return F.translate(F.lower(F.coalesce(x, F.lit(""))), W.ACCENTS, W.PLAIN)


def search_form(x: Column) -> Column:
    """Folded, with runs of other characters as one blank, trimmed."""
    return F.trim(F.regexp_replace(fold_text(x), NOT_ALNUM_SPACE, " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def canonical_key(x: Column) -> Column:
    """The words that say what a product is, sorted: without stores, packs, noise, numbers and sizes."""
    left_out = W.KEY_STORES + W.KEY_UNITS + W.KEY_NOISE
    shapes = r"^[0-9]+$|^[0-9]+(g|gr|gram|ml|cl|dl|kg|l|ltr|liter|st|stuks?|x|pack)$|^[0-9]+x[0-9]+"
    kept = F.filter(tokens(search_form(x)), lambda w: ~w.isin(*left_out) & ~w.rlike(shapes))
    return F.array_join(F.array_sort(kept), " ")


def normalize_canonical_key(key: Column, name: Column | None = None) -> Column:
    """Folded with underscores; synonyms become one key, and flavoured products leave the plain one."""
    k = F.regexp_replace(F.regexp_replace(fold_text(key), NOT_ALNUM, "_"), "^_+|_+$", "")
    n = fold_text(name if name is not None else F.lit(""))
    out = k
    cases = []
    for target, spelt in W.KEY_SYNONYMS.items():
        cases.append((k.isin(*spelt), target))
    for plain, (target, spelt) in W.FLAVOURED.items():
        cases.append(((k == plain) & word_match(n, "|".join(spelt)), target))
    cases.append(((k == "kaas") & n.contains("kaas 48%"), "jonge_kaas"))
    for condition, target in reversed(cases):
        out = F.when(condition, F.lit(target)).otherwise(out)
    return out


def lookup(x: Column, table: dict[str, str], default: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)
    return found if default is None else F.coalesce(found, default)


def canonical_display_name(key: Column, fallback: Column | None = None) -> Column:
    return lookup(key, W.DISPLAY, none_if_empty(F.trim(fallback if fallback is not None else F.lit(None).cast("string"))))


def name_is_organic(x: Column) -> Column:
    return word_match(fold_text(x), "bio|biologisch|biologische|organic")


def catalog_norm(x: Column) -> Column:
    """Lower case (marks stay), words between single blanks; null if nothing is left."""
    return none_if_empty(F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), NOT_ALNUM, " ")))


def variant_signature(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.concat_ws("|", *[F.when(word_match(low, p), F.lit(flag)) for flag, p in W.VARIANTS])


def pack_signature(name: Column, price: Column, base_price: Column, base_unit: Column) -> Column:
    """Quantity, pack, multipack and size of a product, else its name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    unit = none_if_empty(F.lower(F.trim(F.coalesce(base_unit, F.lit("")))))
    quantity = F.when(base_price > 0, F.round(price / base_price, 2).cast("decimal(38,2)"))
    part = lambda label, pattern: F.concat(F.lit(label), none_if_empty(F.regexp_extract(low, pattern, 1)))
    sizes = r"[0-9]+([,.][0-9]+)?\s*(ml|cl|l|g|kg)"
    parts = [
        F.concat(F.lit("qty:"), quantity.cast("string"), F.lit(":"), F.coalesce(unit, F.lit("unit"))),
        part("pack:", r"(?U)\b([0-9]+)\s*[- ]?pack\b"),
        part("multi:", r"(?U)\b([0-9]+\s*x\s*[0-9]+([,.][0-9]+)?\s*(ml|cl|l|g|kg))"),
        part("size:", rf"(?U)\b({sizes})\b"),
    ]
    return F.coalesce(none_if_empty(F.concat_ws("|", *parts)), F.concat(F.lit("name:"), F.coalesce(catalog_norm(name), F.lit("unknown"))))


def generic_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(catalog_norm(x), rf"(?U)\b({'|'.join(W.BRANDS)})\b", ""))


def clean_text(x: Column) -> Column:
    """Trimmed with single blanks; empty and the words nan, none and null are null."""
    t = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.when((t != "") & ~F.lower(t).isin("nan", "none", "null"), F.regexp_replace(t, r"(?U)\s+", " "))


def clean_key(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalized_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")


def ingredient_name(x: Column) -> Column:
    """Folded words of letters, digits and hyphens with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold_text(x), r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))


def slug(x: Column, mark: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(fold_text(x), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def split_lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\r?\n"), lambda w: F.trim(w)), lambda w: w != "")


def token_overlap(query: Column, name: Column) -> Column:
    """Share of the query's distinct words that the name has; 0 for no words."""
    q, p = F.array_distinct(tokens(ingredient_name(query))), F.array_distinct(tokens(ingredient_name(name)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(0.0)


def product_score(query: Column, name: Column, category: Column, store: Column, available: Column, preferred: str | None = None) -> Column:
    score = token_overlap(query, name)
    score = score + F.when(F.coalesce(token_overlap(query, category) > 0, F.lit(False)), 0.15).otherwise(0.0)
    if preferred:
        score = score + F.when(store == preferred, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.round(score - F.when(available, 0.0).otherwise(0.5), 4))


def expected_term_found(terms: Column, *fields: Column) -> Column:
    whole = F.lower(F.concat_ws(" ", *fields))
    return F.exists(terms, lambda t: whole.contains(F.lower(t)))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def labelled_lines(parts: list[tuple[str, Column]]) -> Column:
    """Non-empty values with their labels, a line each."""
    return F.concat_ws("\n", *[F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), F.trim(c))) for label, c in parts])


def post_title(text: Column, default: Column) -> Column:
    return F.coalesce(F.substring(F.get(split_lines(text), 0), 1, 180), default)


def unique_joined(items: Column, mark: str = ";") -> Column:
    cleaned = F.transform(items, lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))), mark)


def without_repeated_lines(lines: Column) -> Column:
    """A line that equals the one before it goes."""
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))


# Names of one ingredient, as they are found and as they are replaced.
SPRING_ONION = r"(?i)\b(green onions?|spring onions?|scallions?|lente uitjes?|lente ui)\b"
SPRING_ONION_TEXT = r"(?i)\b(green onions?|spring onions?|scallions?|lente[ -]?uitjes?|lente[ -]?ui)\b"


def known_ingredient(x: Column) -> Column:
    """The usual name of an ingredient that goes by several, else null."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[-_]", " "), r"\s+", " "))
    return F.when(spaced.rlike(SPRING_ONION), "bosui")


def with_known_name(x: Column, name: Column) -> Column:
    return F.when(name.isNotNull(), F.regexp_replace(x, F.lit(SPRING_ONION_TEXT), name)).otherwise(x)


def raw_text(quantity: Column, unit: Column, name: Column) -> Column:
    """Quantity, unit and name that say something, with blanks between them; a quantity of 0 says nothing."""
    shown = F.when(quantity == F.floor(quantity), quantity.cast("long").cast("string")).otherwise(quantity.cast("string"))
    return F.concat_ws(" ", F.when(quantity != 0, shown), none_if_empty(unit), none_if_empty(name))


# Labels of the fields of a recipe.
FIELD_LABELS = {"quantities": "hoeveelheden", "ingredients": "ingredienten", "instructions": "bereidingsstappen", "servings": "porties"}


def missing_fields(codes: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in FIELD_LABELS.items() for x in pair])
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.try_element_at(labels, c), c)), ", ")


def once(f: Callable[..., Column], *values: Column) -> Column:
    """f of values that are computed once, however often its lambdas speak of them."""
    names = [f"v{i}" for i in range(len(values))]
    bound = F.array(F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)]))
    return F.get(F.transform(bound, lambda x: f(*[x[n] for n in names])), 0)
