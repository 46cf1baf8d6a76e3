"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A document is
cut greedily into the longest phrases that occur in that sample; the language that needs the
fewest phrases wins, each weighed by the bits that point into its sample (the logarithm of the
sample's length), so that a shorter sample is no handicap of its own. Parsing runs many documents
in step: one look into a packed transition table advances every document and language by a symbol.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, ship, spans, trim

#: Labelled rows looked at for a language, and characters of them that its automaton holds: whole rows, but for the last.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 80_000
#: Parts of a language's rows that are ranked apart.
PARTS = 8
#: Symbols: what stands between letters, letters of no sample, then each letter of the samples.
BETWEEN, OTHER = 0, 1
LETTER = np.array([chr(i).isalpha() for i in range(0x10000)], bool)
#: Characters of text that are parsed at a time.
AT_ONCE = 1 << 22
#: Below so many documents still being parsed, they are finished one by one.
FEW = 12
UNKNOWN = "und"


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """language -> text of a bounded sample: the rows of smallest hash, one after the other until ``chars`` are reached.

    Ranking first within PARTS parts of each language keeps a frequent language out of one task.
    Of rows that repeat an id and a language the smallest text counts.
    """
    ids = docs.filter("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("h"))
    part = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h", "doc_id")
    ids = ids.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= rows).drop("r").distinct()
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= rows)
    picked = F.broadcast(cut(ids.select("doc_id", "lang", "r")))  # at most ``rows`` for a language
    got = docs.join(picked, ["doc_id", "lang"]).groupBy("lang", "r").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    order = Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("before", F.coalesce(F.sum(F.char_length("text")).over(order), F.lit(0))).filter(F.col("before") < chars)
    texts: dict[str, str] = {}
    for row in sorted(got.select("lang", "r", "text").collect(), key=lambda x: (x["lang"], x["r"])):  # some ``chars`` for a language
        texts[row["lang"]] = (texts.get(row["lang"], "") + "\n" + row["text"].lower())[:chars]
    return texts


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``symbols``; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nexts


def displaced(nexts: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All transitions in one array: that of state s by symbol c is at base[s] + c, if owner says s there.

    States of several transitions look for a place by stepping through pseudorandom ones, the others fill what is free.
    """
    total = sum(map(len, nexts))
    size = 2 * total + 2 * width + 64
    base = np.zeros(len(nexts), np.int32)
    owner, value = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    used = bytearray(size)
    at, span = 12345, size - width
    for s in sorted((s for s, out in enumerate(nexts) if len(out) > 1), key=lambda s: -len(nexts[s])):
        out = nexts[s]
        while True:
            at = (at * 1103515245 + 12345) % 2147483648
            b = at % span
            for c in out:
                if used[b + c]:
                    break
            else:
                break
        base[s] = b
        for c, t in out.items():
            used[b + c] = 1
            owner[b + c], value[b + c] = s, t
    ones = [(s, c, t) for s, out in enumerate(nexts) if len(out) == 1 for c, t in out.items()]
    if ones:
        s, c, t = np.array(ones, np.int64).T
        free = width + np.flatnonzero(np.frombuffer(used, np.uint8)[width:] == 0)[: len(s)]
        base[s], owner[free], value[free] = free - c, s, t
    return base, owner, value


class Model:
    """The automata of all languages, their states numbered together; made by the driver, one language after the other."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        letters = sorted({ch for text in texts.values() for ch in text if ch.isalpha()})
        self.width = len(letters) + 2
        self.symbol = np.where(LETTER, OTHER, BETWEEN).astype(np.uint8 if self.width < 256 else np.int32)
        self.far = {}  # beyond the first plane
        for i, ch in enumerate(letters):
            if ord(ch) < 0x10000:
                self.symbol[ord(ch)] = i + 2
            else:
                self.far[ord(ch)] = i + 2
        self.bits, tables, self.roots = [], [], np.zeros(len(self.langs), np.int32)
        #: Where a new phrase leads that starts with a symbol: the start again for one that the sample lacks.
        self.fresh = np.zeros((len(self.langs), self.width), np.int32)
        states = spots = 0
        for j, lang in enumerate(self.langs):
            sample = self.encode(texts[lang]).tolist()
            nexts = suffix_automaton(sample)
            base, owner, value = displaced(nexts, self.width)
            self.roots[j], self.fresh[j] = states, states
            for c, t in nexts[0].items():
                self.fresh[j, c] = t + states
            tables.append((base + spots, np.where(owner >= 0, owner + states, -1).astype(np.int32), value + states))
            states, spots = states + len(base), spots + len(owner)
            self.bits.append(math.log2(len(sample) + 1))
        self.base, self.owner, self.value = (np.concatenate(x).astype(np.int32) for x in zip(*tables, strict=True)) if tables else [np.zeros(0, np.int32)] * 3

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        got = self.symbol[np.minimum(codes, 0xFFFF)]
        if len(got) and codes.max() > 0xFFFF:
            wide = np.flatnonzero(codes > 0xFFFF)
            got[wide] = [self.far.get(c, OTHER if chr(c).isalpha() else BETWEEN) for c in codes[wide].tolist()]
        between = got == BETWEEN
        between[1:] &= got[:-1] == BETWEEN
        between[:1] = False  # one symbol for a run of other characters
        return got[~between]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(documents, languages): phrases that each text needs in each language.

        A symbol that an automaton can't follow starts a phrase; so does the first one, and the one after a symbol that the sample lacks.
        """
        n, k = len(texts), len(self.langs)
        out = np.zeros((n, k), np.int64)
        coded = [self.encode(t) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        order = np.argsort(-sizes, kind="stable")
        joined = np.concatenate([coded[i] for i in order]) if n else self.symbol[:0]
        del coded
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        ascending = np.sort(sizes)
        state = np.tile(self.roots, (n, 1))
        count = np.zeros((n, k), np.int64)
        longest, t, alive = int(sizes.max(initial=0)), 0, n
        while t < longest:
            alive = n - int(np.searchsorted(ascending, t, side="right"))
            if alive <= FEW:
                break
            until = int(ascending[n - alive])  # no document ends before this
            s, c, at = state[:alive], count[:alive], starts[:alive]
            for t in range(t, until):
                symbols = joined[at + t].astype(np.int32)
                spot = self.base[s] + symbols[:, None]
                known = (self.owner[spot] == s) & (s != self.roots)
                c += ~known
                s = np.where(known, self.value[spot], self.fresh[:, symbols].T)
            state[:alive] = s
            t = until
        base, owner, value = memoryview(self.base), memoryview(self.owner), memoryview(self.value)
        for row in range(alive if t < longest else 0):
            rest = joined[starts[row] + t : ends[row]].tolist()
            for j in range(k):
                s, m, root, fresh = int(state[row, j]), 0, int(self.roots[j]), self.fresh[j].tolist()
                for ch in rest:
                    spot = base[s] + ch
                    if s != root and owner[spot] == s:
                        s = value[spot]
                    else:
                        m += 1
                        s = fresh[ch]
                count[row, j] += m
        out[order] = count
        return out


def judged(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    """Language and score of each text. Score: how far the winner's count is below the next one's, from 0.5 (even) to 1.

    A text without a letter, or a model without languages, gives ``und`` and 0. Ties go to the
    language that sorts first.
    """
    lower = [t.lower() for t in texts]
    lettered = np.array([any(map(str.isalpha, t)) for t in lower], bool)
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return langs, scores
    rows = np.flatnonzero(lettered)
    weighed = model.phrases([lower[i] for i in rows]) * np.array(model.bits)
    for i, c in zip(rows.tolist(), weighed, strict=True):
        best = int(np.argmin(c))
        others = np.delete(c, best)
        langs[i] = model.langs[best]
        second = float(others.min()) if len(others) else 2.0 * c[best]
        scores[i] = max(0.0, min(1.0, 1.0 - 0.5 * float(c[best]) / second if second else 0.0))
    return langs, scores


def identify(docs: DataFrame, training: DataFrame, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of lang and score for each row, learned from ``training`` (doc_id, lang, text).

    Null texts and texts without a letter are ``und`` with score 0; empty training data makes
    every document ``und``. Other columns and repeated rows stay as they are.
    """
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(Model(training_rows(training)))  # some 40 bytes for each of SAMPLE_CHARS characters of a language

    @F.pandas_udf("lang string, score double")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        for part in parts:
            texts, langs, scores = part.fillna("").tolist(), [], []
            for first, last in spans(list(map(len, texts)), AT_ONCE):
                lang, score = judged(texts[first:last], given.value)
                langs += lang
                scores += score
            yield pd.DataFrame({"lang": langs, "score": scores})
        trim()

    return docs.withColumn(out, told(F.col(text)))


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose crc32 of the id modulo 4 isn't 2."""
    own = docs.select("doc_id", "text", "lang")
    learned = own.filter(remainder(4) != 2)
    got = identify(own.select("doc_id", "text"), learned)
    return got.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
