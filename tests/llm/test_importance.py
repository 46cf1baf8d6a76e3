"""Importance resampling against a plain count of features."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from kassabon.llm import importance

rng = random.Random(3)
WORDS = ["the", "Of", "haus", "été", "NIÑO", "über", "x1", "42", "汉字", "😀", "a" * 40, "lorem"]
MARKS = [" ", "  ", ", ", "\n", "-", ".", "_", "\x7f", "/"]
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
COLUMNS = "doc_id long, text string, weight double, score string, rank int, n_words int, part int, may int, before int"


def some(n):
    return "".join(rng.choice(WORDS) + rng.choice(MARKS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    texts = [None, "", " ", "one", "a b", "a b c", "!!!", "x" * 70_000, some(30_000), "é", "Z", "z"] + [some(rng.randint(1, 90)) for _ in range(200)]
    rows = [(i * 3, t, 0.5, "s", 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[-1], (None, some(50), 0.5, "s", 1, 2, 3, 4, 5)], COLUMNS).repartition(3).cache()
    target = spark.createDataFrame([(i, some(30) if i else None) for i in range(12)], "item_id long, text string").cache()
    return docs, target


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) of every row."""
    corpus, wanted, told = [0] * 10000, [0] * 10000, []
    for r in docs:
        told.append((r["doc_id"], *features(r["text"])))
        for f in told[-1][2]:
            corpus[f] += 1
    for r in target:
        for f in features(r["text"])[1]:
            wanted[f] += 1
    s, t = sum(corpus) + 10000, sum(wanted) + 10000
    gain = [math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(corpus, wanted, strict=True)]
    out = []
    for doc, n, found in told:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in found)
        out.append([doc, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for i, r in enumerate(order):
        r.append(i + 1 if i < 5 * len(order) // 100 else None)
    return [(r[0], *r[2:5], r[5] if len(r) > 5 else None) for r in out]


def test_against_a_plain_count(tables):
    docs, target = tables
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in importance.report(docs, target).collect()), key=key)
    assert got == sorted(plain(docs.collect(), target.collect()), key=key)
    assert sum(r[4] is not None for r in got) == 5 * sum(features(r["text"])[0] >= 20 for r in docs.collect()) // 100 > 3


def test_rows_drawn(tables):
    docs, target = tables
    drawn = importance.resampled(docs, target).collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, len(drawn) + 1))
    assert all(r["text"] and r["n_words"] >= 20 for r in drawn)


def test_empty_tables(tables):
    docs, target = tables
    assert importance.report(docs.limit(0), target).collect() == []
    assert importance.report(docs, target.limit(0)).count() == docs.count()


def test_crc_of_runs_across_blocks(monkeypatch):
    monkeypatch.setattr(importance, "AT_ONCE", 7)
    texts = pa.array(["aa b ccc d e ff g", None, "", "h", "I j", "k" * 3000 + " l m n o p", "é", "q r s t u v w x y z " * 5])
    data, offsets = importance.buffers(texts)
    found = np.concatenate([f.ravel() for _, _, f in importance.features(data, *importance.words(data, offsets))])
    assert sorted(found[found >= 0].tolist()) == sorted(f for t in texts.to_pylist() for f in features(t)[1])
