"""Trigram similarity and graded word matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once
from .words import ENDINGS

LEAST_SIMILAR = 0.6


def trigrams(x: Column) -> Column:
    """Ordered trigrams of the words of a text, each word with two blanks before and one after."""
    ws = F.filter(F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return F.flatten(F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def best_extent(a: Column, b: Column) -> Column:
    """Best Jaccard similarity of a's trigrams with any run of b's.

    A run gets no worse when it loses an end that a lacks, so only runs between places of a's trigrams are compared.
    """

    def among(a: Column, b: Column, places: Column) -> Column:
        ends = lambda i: F.filter(places, lambda j: j >= i)
        runs = F.flatten(F.transform(places, lambda i: F.transform(ends(i), lambda j: jaccard(a, F.slice(b, i, j - i + 1)))))
        return F.coalesce(F.array_max(runs), F.lit(0.0))

    def shared(a: Column, b: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(b)), lambda i: F.array_contains(a, F.get(b, i - 1)))
        return F.when((F.size(b) > 0) & (F.size(a) > 0), once(among, a, b, places)).otherwise(0.0)

    return once(shared, a, b)


def word_similarity(a: Column, b: Column) -> Column:
    return best_extent(trigrams(a), trigrams(b))


def tok_match(q: Column, w: Column, similar: Column | None = None) -> Column:
    """How well a word answers a searched one: the first case that holds counts."""
    rest = F.substr(w, F.char_length(q) + 1)
    size = F.char_length(q)
    similar = similarity(q, w) if similar is None else similar
    return (
        F.when((q == "") | (w == ""), 0.0)
        .when(w == q, 1.0)
        .when(w.startswith(q) & rest.isin(*ENDINGS), 0.93)
        .when((size >= 4) & w.endswith(q), 0.88)
        .when((size >= 5) & w.contains(q), 0.42)
        .when((size >= 3) & w.startswith(q), 0.34)
        .when(similar >= LEAST_SIMILAR, 0.72)
        .otherwise(0.0)
    )
