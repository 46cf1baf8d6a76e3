"""Greedy request chunks against one pass over all lines, numbered rows, manifests and id maps."""

import json
import random
from pathlib import Path

import pytest
from kassabon.operators.numbered import numbered
from kassabon.sources import requests
from pyspark.sql import functions as F


def greedy(sizes, most_requests, most_bytes):
    out, lines, size, chunk = [], 0, 0, 0
    for s in sizes:
        if lines and (lines >= most_requests or size + s > most_bytes):
            lines, size, chunk = 0, 0, chunk + 1
        lines, size = lines + 1, size + s
        out.append(chunk)
    return out


@pytest.mark.parametrize(("n", "most_requests", "most_bytes", "block", "seed"), [(1, 7, 50, 8, 1), (700, 7, 60, 8, 2), (900, 9, 40, 10, 3), (640, 8, 10_000, 8, 4), (500, 50, 200, 64, 5), (300, 20, 5, 20, 6), (333, 400, 90, 8, 7)])
def test_one_pass(spark, monkeypatch, n, most_requests, most_bytes, block, seed):
    monkeypatch.setattr(requests, "FAN", 3)  # several levels of composed blocks
    rng = random.Random(seed)
    texts = [None if rng.random() < 0.05 else "é" * rng.randint(0, 12) if rng.random() < 0.97 else "x" * 300 for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(3)
    got = {r["n"]: r["chunk"] for r in requests.request_chunks(rows, "text", "n", most_requests, most_bytes, block).collect()}
    assert [got[i] for i in range(n)] == greedy([len((t or "").encode()) + 1 for t in texts], most_requests, most_bytes)


def test_no_lines(spark):
    rows = spark.createDataFrame([], "n long, text string")
    assert requests.request_chunks(rows, "text", "n", 5, 50).collect() == []
    assert numbered(rows, "text", place="at").collect() == []


def test_numbered(spark):
    rows = spark.createDataFrame([(i % 40, f"t{i}") for i in range(3000)], "k long, text string").repartition(5)
    got = sorted(numbered(rows, "k", F.desc("text"), place="at").collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(3000))
    assert [(r["k"], r["text"]) for r in got] == sorted([(r["k"], r["text"]) for r in got], key=lambda x: (x[0], [-ord(c) for c in x[1]] + [1]))


@pytest.mark.parametrize("names", [1, 4])
def test_files(spark, tmp_path, names):
    rows = spark.createDataFrame([(i, f'zoek "{i}"', f"Naam {i} é") for i in range(23)], "n long, name_search string, sample_name string")
    made = requests.grouped_names(rows, "n", names)
    lines = made.withColumn("line", F.to_json(F.struct("custom_id", F.struct(F.col("names").alias("products")).alias("body"))))
    chunks = requests.request_chunks(lines, "line", "n", 3, 10_000)
    told = {r["part"]: r for r in requests.manifest(chunks, "line").collect()}
    requests.write_chunks(chunks, "line", "n", str(tmp_path / "out"))
    count = 23 if names == 1 else 6
    assert sorted(told) == [f"part{i + 1:03d}" for i in range(-(-count // 3))]
    seen = []
    for part, row in sorted(told.items()):
        (file,) = Path(tmp_path, "out", f"part={part}").glob("part-*.txt")
        text = file.read_text(encoding="utf-8")
        assert (len(text.splitlines()), len(text.encode())) == (row["requests"], row["bytes"])
        assert row["output_file"] == f"canonical_output.{part}.jsonl"
        seen += [json.loads(line)["custom_id"] for line in text.splitlines()]
    assert seen == [f"{'n' if names == 1 else 'g'}{i}" for i in range(count)]
    stands = [json.loads(r["stands_for"]) for r in made.orderBy("n").collect()]
    assert stands == [f'zoek "{i}"' for i in range(23)] if names == 1 else stands[1] == {f"i{i}": f'zoek "{i + 4}"' for i in range(4)}
