"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding maps look-alike letters and digit substitutions to plain Latin letters. Terms and their
weights are log odds learned from labelled texts; exception phrases are word pairs around a term
that the clean labelled texts use. A text's matches are summed by weight, normalised by length
and put through a logistic curve fitted on the same labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .language import remainder

#: Labelled rows learned from (those of smallest hash).
SAMPLE_ROWS = 8_000
#: Parameters of learning: a term needs so many toxic texts and so large a weight.
SUPPORT = 3
LEAST_WEIGHT = 1.9
PREFIXES = (4, 5, 6, 7, 8)

# Look-alikes of Latin letters, then digits and signs that stand for letters.
LOOKALIKES = {"а": "a", "ɑ": "a", "α": "a", "в": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "є": "e", "ε": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ı": "i", "ι": "i", "ј": "j", "к": "k", "κ": "k", "ⅼ": "l", "ӏ": "l", "м": "m", "ո": "n", "η": "n", "о": "o", "ο": "o", "օ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ѡ": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ᴢ": "z"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
ACCENTED = dict(zip("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy", strict=True))

LETTERS = {**LOOKALIKES, **ACCENTED}
_fold = str.maketrans({**LETTERS, "​": None, "‌": None, "‍": None, "­": None, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}})
_digits = str.maketrans(SUBSTITUTES)
_mixed = re.compile(r"[0-9@$!|€a-z]*(?:[a-z][0-9@$!|€]|[0-9@$!|€][a-z])[0-9@$!|€a-z]*")
_word = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and accents as plain letters, signs inside words as the letters they stand for.

    A sign that ends a word (an exclamation mark) stays; numbers without letters stay.
    """
    text = text.lower()
    if not text.isascii():
        text = text.translate(_fold)
    if not _mixed.search(text):
        return text

    def plain(m: re.Match) -> str:
        word = m[0]
        body = word.rstrip("!|")
        return body.translate(_digits) + word[len(body) :]

    return _mixed.sub(plain, text)


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings of PREFIXES letters with a star."""
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def learn(rows: list[tuple[str, int]], support: int = SUPPORT, least_weight: float = LEAST_WEIGHT) -> dict:
    """Weights, exceptions and the curve, from (text, 0 or 1) pairs; defined, with no terms, for no rows.

    A term is a word or the beginning of words. Its weight is a lower bound of its log odds, so
    that few sightings count for less; a term whose beginning weighs as much is left out.
    """
    seen = {0: Counter(), 1: Counter()}
    split = [(_word.findall(fold(text)), int(label)) for text, label in rows]
    for label in (1, 0):  # clean texts count only terms that toxic ones have often enough
        for words, own in split:
            if own == label:
                found = features(set(words))
                seen[label].update(found if label else found & frequent)
        frequent = {t for t, n in seen[1].items() if n >= support}
    n1 = sum(label for _, label in split)
    n0 = len(split) - n1
    weights = {}
    for term, a in seen[1].items():
        b = seen[0][term]
        sure = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)) - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= support and sure >= least_weight:
            weights[term] = sure
    weights = {t: w for t, w in weights.items() if not any(weights.get(t[:k] + "*", 0) >= w for k in PREFIXES if k + t.endswith("*") < len(t))}
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0])))
    pairs = {0: Counter(), 1: Counter()}
    for words, label in split:
        pairs[label].update({f"{x} {y}" for x, y in zip(words, words[1:], strict=False) if x in weights or y in weights})
    clean = {p: n for p, n in pairs[0].items() if n >= 5 and (n + 0.5) / (n0 + 1) > 2 * (pairs[1][p] + 0.5) / (n1 + 1)}
    exceptions = sorted(clean, key=lambda p: (-clean[p], p))
    model = {"weights": weights, "exceptions": exceptions, "a": 1.0, "b": -1.0}
    if n0 and n1:
        finder = Finder(model)
        x = np.array([finder.strength(text) for text, _ in rows])
        y = np.array([label for _, label in rows], float)
        weight = np.full(len(y), 1.0 / len(y))
        a, b = 1.0, -1.0
        for _ in range(40):  # Newton steps of a weighted, slightly ridged logistic fit
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([np.sum(weight * (y - p) * x) - 1e-3 * a, np.sum(weight * (y - p)) - 1e-3 * b])
            v = weight * p * (1 - p)
            h = np.array([[np.sum(v * x * x) + 1e-3, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 1e-3]])
            da, db = np.linalg.solve(h, g)
            a, b = float(np.clip(a + da, 0.01, 20)), float(np.clip(b + db, -20, 20))
        model |= {"a": a, "b": b}
    return model


class Finder:
    """One automaton for terms (weight) and exceptions (weight 0, longer, so they cover their terms)."""

    def __init__(self, model: dict):
        self.a, self.b = model["a"], model["b"]
        self.machine = ahocorasick.Automaton()
        weights = model["weights"]
        for stem in {term.removesuffix("*") for term in weights}:
            begins = weights.get(stem + "*")  # of longer words, and of the word itself if it is no term
            self.machine.add_word(stem, (len(stem), weights.get(stem, begins), begins))
        for phrase in model["exceptions"]:
            self.machine.add_word(phrase, (len(phrase), 0.0, None))
        self.ready = len(self.machine) > 0
        if self.ready:
            self.machine.make_automaton()

    def strength(self, text: str) -> float:
        """Sum of weights of the matches that start (and, for words, end) at word edges outside exceptions, over a root of the length in words."""
        folded = fold(text)
        if not self.ready:
            return 0.0
        total, covered = 0.0, -1
        hits = []
        for end, (size, weight, begins) in self.machine.iter(folded):
            start = end - size + 1
            if end + 1 < len(folded) and folded[end + 1].isalnum():
                weight = begins
            if weight is not None and (start == 0 or not folded[start - 1].isalnum()):
                hits.append((start, -end, weight))
        hits.sort()
        for start, neg_end, weight in hits:  # leftmost, then longest
            if start > covered:
                total += weight
                covered = -neg_end
        # per 100 words, but a short text isn't magnified and a long one not diluted to nothing
        return total / math.sqrt(max(1.0, (folded.count(" ") + folded.count("\n") + 1) / 100.0)) if total else 0.0

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.a * self.strength(text) + self.b))))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """A model from at most ``rows`` labelled texts, those whose id has the smallest hash. Null labels and texts don't count.

    Of rows that repeat an id the smallest text counts, so that no more rows than that reach the driver.
    """
    ids = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return learn(sorted((r["text"], int(r["toxic"] > 0)) for r in got.collect()))


def rated(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a toxicity from 0 to 1 of every whole text; null text is rated as empty."""
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)  # terms and phrases of SAMPLE_ROWS texts at most

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(given.value)
        for part in parts:
            yield pd.Series([finder.score(t) for t in part.fillna("")], dtype="float64")

    return docs.withColumn(out, rate(F.col(text)))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learned only from labels whose crc32 of the id modulo 5 isn't 0.

    Repeated rows are scored alike; null texts as empty ones; an empty table gives no rows, and
    without labels every text gets the same score below a half.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").filter(remainder(5) != 0))
    got = rated(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
