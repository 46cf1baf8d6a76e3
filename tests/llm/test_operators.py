"""Each operator against a brute-force version on small tables that hold nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from kassabon.llm import ann, language, mixing, multiset_hash, ngram_join, pieces, pii, suffix_dedup, toxicity, url_cascade
from pyspark.sql import functions as F

rng = random.Random(7)
VOCAB = ["the", "Of", "haus", "été", "niño", "über", "stone", "river", "cloud", "B", "x1", "—", "汉字", "lorem", "ipsum"]


def words(n):
    return " ".join(rng.choice(VOCAB) + str(rng.randint(0, 40)) for _ in range(n))


BASE = words(120)
TEXTS = [
    None, "", " ", "one", "a b c d", "A  b\tc d\n", BASE, BASE, BASE.replace("the", "THE"), BASE + " tail", "head " + BASE, BASE[:300] + "\n" + words(60), words(40) + "\n" + BASE[200:520],
    words(1500), "😀" * 120, "x" * 500, "x" * 450 + "y", words(8), words(5), "line one\nline two\nline three", "line three\nline one\nline two",
] + [words(rng.randint(1, 90)) for _ in range(60)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, key long, size long, h long, score double, hashes string, part int, run int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, None if i == 4 else ["en", "de"][i % 2], None if i % 7 == 0 else f"src{i % 3}" if i % 2 else "src0", None, 1, 2, 3, 0.5, "h", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def repeated(spark, docs):
    """Rows repeated, ids null or used twice."""
    more = [(None, "no id at all", "en", None, None, 1, 2, 3, 0.5, "h", 1, 2), (18, "another text under a used id", "en", "src1", None, 1, 2, 3, 0.5, "h", 1, 2)]
    return docs.unionByName(docs.filter("doc_id between 15 and 30")).unionByName(spark.createDataFrame(more, COLUMNS)).cache()


def empty(docs):
    return docs.limit(0)


# ---------------------------------------------------------------- 1 mixing


def share_out(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, got = float(sum(sizes.values())), {}
    while len(got) < len(names):
        free = [s for s in names if s not in got]
        left = total - sum(got.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        got |= {s: most * sizes[s] for s in over} if over else share
    return got


def test_mix(docs, repeated):
    for table in (docs, repeated):
        got = mixing.mix(table, block=4).collect()
        again = mixing.mix(table, block=4).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
        source = {}
        for r in table.collect():
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            source[r["source"]] = source.get(r["source"], 0) + n
        want, taken = share_out(source), Counter()
        assert len(got) == table.count()
        for r in got:
            assert r["source_size"] == source[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]])
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        for s, t in want.items():
            assert abs(taken[s] - t) <= 0.05 * t + 4
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.resample(docs).columns == docs.columns


def test_mix_of_small_sources(spark):
    """Sources of less than a block come near their targets, too."""
    rows = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate([("a", 64), ("b", 24), ("c", 500), ("c", 3), (None, 1), ("a", 0)])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    want = share_out({"a": 64, "b": 24, "c": 503, None: 1})
    assert all(abs(taken[s] - t) <= 2 + 0.02 * t for s, t in want.items())


def test_resample_of_repeats(spark):
    """Repeated rows share what the mix takes of them; columns with names used inside stay."""
    rows = [(1, "a", "one two three", 5, 6, 7)] * 40 + [(2, "b", "four five six seven", 5, 6, 7)] * 30 + [(3, "b", None, 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, row int, times int, size int")
    got = mixing.resample(docs)
    assert got.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    made = Counter(r["doc_id"] for r in got.collect())
    assert 3 not in made
    for i, n, size in ((1, 40, 3), (2, 30, 4)):
        assert abs(made[i] - taken[i] / size) <= n


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


# ---------------------------------------------------------------- 2 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits or "1"), "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out[kind].append(m.span())
    return out


def test_base_spans():
    chars = "a.@1 2+-()b0.5%é"
    for _ in range(20_000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("a" * 300_000)["email"] == []


def test_personal_data(spark, repeated):
    samples = ["mail joe.doe@mail.example.com now", "4111 1111 1111 1111", "call +1 (651) 555-8500 or (030) 123-4567", "at 10.0.0.255 é 1.2.3.999", None]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(samples)], "doc_id long, text string")
    table = repeated.unionByName(more, allowMissingColumns=True)
    got = pii.reported(table).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in table.collect())
    assert len(got) == sum(texts.values())
    want = Counter()
    for (i, t), n in texts.items():
        base = plain_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in base[k])
        want[i, *(len(base[k]) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()] += n
        for r in got:
            if r["doc_id"] == i and joined:
                assert set(joined.split(",")) <= set(r["spans"].split(","))
    assert want == Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got)
    assert pii.reported(empty(repeated)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(more).collect()}
    assert clean[1000] == "mail <EMAIL> now" and clean[1001] == "<CARD>" and clean[1004] is None


def test_tagger_learns():
    held = random.Random(4242)
    tagger, right, total = pii.default_tagger(), 0, 0
    for _ in range(100):
        text, spans = pii.labelled(held)
        y = np.zeros(len(text), int)
        for a, b, kind in spans:
            y[a:b] = 1 + pii.KINDS.index(kind)
        right += (tagger.best(pii.symbols(text)[None])[0] == y).sum()
        total += len(y)
    assert right / total > 0.95


def test_best_path():
    """Against all paths, for stretches of several lengths at once."""
    g = np.random.default_rng(8)
    tagger = pii.Tagger()
    tagger.w["trans"] = g.normal(size=(5, 5)).astype(np.float32)
    stretches = [g.normal(size=(n, 5)).astype(np.float32) for n in (1, 4, 0, 5, 2, 4)]
    for e, got in zip(stretches, tagger.decode(stretches), strict=True):
        paths = list(itertools.product(range(5), repeat=len(e)))
        worth = [sum(e[t, y] for t, y in enumerate(p)) + sum(tagger.w["trans"][x, y] for x, y in zip(p, p[1:], strict=False)) for p in paths]
        assert tuple(got) == (paths[int(np.argmax(worth))] if len(e) else ())


def test_a_long_stretch_does_not_pad_short_ones():
    tagger, rng = pii.default_tagger(), np.random.default_rng(3)
    stretches = [rng.standard_normal((n, pii.Tagger.LABELS)).astype(np.float32) for n in (60_000, *[5] * 255, *[900] * 300, 0)]
    tracemalloc.start()
    got = tagger.decode(stretches)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for path, e in zip(got, stretches, strict=True):
        assert (path == tagger.decode([e])[0]).all()


def test_freed_memory_goes_back():
    code = """
import numpy as np
from kassabon.llm.common import release
def own():
    return int(open("/proc/self/statm").read().split()[1]) - int(open("/proc/self/statm").read().split()[2])
before, held = own(), [np.ones(8000) for _ in range(2000)]
held = held[-1]
assert own() - before > 20_000
release()
assert own() - before < 5_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])


def test_tagger_adds_spans():
    """On planted forms: spans that the patterns miss are added wherever windows meet, few others are."""
    held, tagger = random.Random(77), pii.default_tagger()
    texts, want = [], []
    for i in range(150):
        text, marked = pii.labelled(held)
        text = "word " * (i % 40) + text
        texts.append(text)
        want.append({(a + 5 * (i % 40), b + 5 * (i % 40), k) for a, b, k in marked})
    missed = found = added = right = 0
    for marked, (base, more) in zip(want, pii.found(texts, tagger), strict=True):
        known = {(a, b, k) for k, spans in base.items() for a, b in spans}
        rest = {m for m in marked if not any(m[0] < b and a < m[1] for a, b, _ in known)}
        missed += len(rest)
        found += sum(any(a < m[1] and m[0] < b and k == m[2] for k, a, b in more) for m in rest)
        added += len(more)
        right += sum(any(a < m[1] and m[0] < b for m in marked) for _, a, b in more)
    assert missed > 50 and found > 0.5 * missed and right > 0.7 * added


# ---------------------------------------------------------------- 3 toxicity


def test_toxicity(spark, repeated):
    insults = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(rng.randint(5, 60)) + (" " + rng.choice(insults) + " " if bad else " ") + words(5)
        rows.append((10_000 + i, text))
        labels.append((10_000 + i, int(bad), None))
    table = repeated.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0)], "doc_id long, toxic int, score int")
    got = toxicity.predictions(table, marks).collect()
    assert len(got) == table.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert toxicity.predictions(empty(table), marks.limit(0)).count() == 0
    assert toxicity.predictions(table, marks.limit(0)).count() == table.count()


def test_word_and_beginning():
    """A word and the beginning of words of the same letters keep a weight each."""
    for weights in ({"scum": 2.0, "scum*": 3.0}, {"scum*": 3.0, "scum": 2.0}):
        finder = toxicity.Finder({"weights": weights, "exceptions": [], "a": 1.0, "b": 0.0})
        assert [finder.strength(t) for t in ("scum", "scum!", "scummy", "a scum, scums", "xscum")] == [2.0, 2.0, 3.0, 5.0, 0.0]


def test_folding_and_exceptions():
    assert toxicity.fold("1d10t ІDІOТ st\u200bupid 2024 no!") == "idiot idiot stupid 2024 no!"
    finder = toxicity.Finder({"weights": {"scum": 2.0, "vile*": 1.0}, "exceptions": ["pond scum"], "a": 1.0, "b": 0.0})
    assert finder.strength("pond scum") == 0 and finder.strength("you scum") == 2.0
    assert finder.strength("viler") == 1.0 and finder.strength("evil") == 0


# ---------------------------------------------------------------- 4 pieces


def viterbi(vocab, text):
    n = len(text)
    best, back = [0] + [-(10**18)] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - vocab.width), end):
            piece = text[start:end]
            if piece in vocab.score and best[start] + vocab.score[piece] > best[end]:
                best[end], back[end] = best[start] + vocab.score[piece], (start, (vocab.ids[piece],))
        ch = text[end - 1]
        if ch not in vocab.score:
            cost, spelt = vocab.literal(ch)
            if best[end - 1] + cost > best[end]:
                best[end], back[end] = best[end - 1] + cost, (end - 1, spelt)
    out = []
    while n:
        n, ids = back[n]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def test_pieces(repeated):
    vocab = pieces.vocabulary(pieces.model_bytes(pieces.MODEL))
    odd = ["a  b   c▁d 😀\x00ж漢 ", "   ", "\n", "é" * 50, "▁▁", "z" * 200, "tab\tend", "\U0010fffd", "z" * 2000, "abc漢" * 300, "".join(rng.choice("abcdefgh") for _ in range(2000))]
    for text in [t for t in TEXTS if t] + odd:
        ids = vocab.encode(text)
        assert vocab.decode(ids) == text
        marked = pieces.MARK + pieces.escape(text).replace(" ", pieces.MARK)
        if len(marked) < 3000:
            assert ids == viterbi(vocab, marked) == [i for run in vocab.stream(marked) for i in run]
    got = pieces.digests(repeated).collect()
    assert len(got) == repeated.count() and all(r["round_trip"] for r in got)
    again = pieces.decoded(pieces.encoded(repeated)).filter("not (text <=> decoded)").count()
    assert again == 0 and pieces.digests(empty(repeated)).count() == 0


# ---------------------------------------------------------------- 5 nearest vectors


def test_nearest(spark):
    g = np.random.default_rng(3)
    x = g.standard_normal((400, 16)) * g.choice([0.2, 1, 5], (400, 1))
    x[50:80] = x[50]
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], 0.0, 1) for i in range(400)]
    odd = [(400, None, 0.0, 1), (420, [0.0] * 16, 0.0, 1), (440, [float("nan")] * 16, 0.0, 1), (460, [1.0, None] * 8, 0.0, 1), (480, [], 0.0, 1), rows[60], (None, rows[3][1], 0.0, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score double, band int")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(np.float32).astype(np.float64)
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        s = x @ x[q]
        assert np.allclose([v for _, _, v in found], [s[i] for _, i, _ in found], atol=1e-12)
        s[q] = -np.inf
        hits += len({i for _, i, _ in found} & set(np.lexsort((np.arange(400), -s))[:20].tolist()))
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
    assert hits / (20 * len(got)) >= 0.9
    few = ann.search(table.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2 and ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def in_full(vectors, queries, k=20):
    """query -> [(id, score)] of the k largest inner products, equal ones by id."""
    out = {}
    for q in queries:
        scores = sorted((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, round(-s, 9)) for s, i in scores[:k]]
    return out


def listed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    return out


def test_nearest_of_few(spark):
    g = np.random.default_rng(11)
    some = g.normal(size=(40, 64))
    for n, copies in ((3, 1), (21, 1), (40, 1), (30, 25)):
        vectors = {i: some[i % n] for i in range(n * copies)}
        table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
        asked = range(min(n, 40))
        got = listed(ann.search(table, F.col("vec_id") < len(asked)).collect())
        assert got == in_full(vectors, asked)


def test_recall_on_embeddings(spark):
    """At least 0.9 of the true neighbours, every list full, on the given vectors."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        assert len(got[ids[q]]) == 20
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("n", [300, 500, 2000, 8000])
def test_recall_through_hashing(spark, monkeypatch, n):
    """At least 0.9 of the true neighbours where no query is searched in full, though Gaussian vectors have no near ones."""
    monkeypatch.setattr(ann, "REACH", 0)
    x = np.random.default_rng(n).normal(size=(n, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    every = n // 60
    got = {}
    for r in ann.search(table, F.col("vec_id") % every == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, n, every):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(n), -s))[:20].tolist()))
        assert len(got[q]) == 20
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_out_of_reach(spark):
    """Most vectors lie in one direction, queries elsewhere meet few of them; another length has few vectors."""
    g = np.random.default_rng(12)
    far = np.concatenate([g.normal(size=(40, 64)), np.eye(64)[:1] * 10 + g.normal(size=(ann.PART + 100, 64)) / 1000])
    vectors = dict(enumerate(far))
    short = {10_000 + i: v for i, v in enumerate(g.normal(size=(25, 48)))}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in (vectors | short).items()], "vec_id long, embedding array<double>")
    got = listed(ann.search(table, (F.col("vec_id") < 40) | (F.col("vec_id") >= 10_000)).collect())
    assert all(len(got[q]) == 20 for q in [*range(40), *short])
    assert {q: got[q] for q in short} == in_full(short, short)


# ---------------------------------------------------------------- 6 language


def plain_phrases(code, train):
    """Greedy parse: the longest match from here, and at least one symbol."""
    n, at = 0, 0
    while at < len(code):
        size = 1
        while at + size < len(code) and any(train[i : i + size + 1] == code[at : at + size + 1] for i in range(len(train))):
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases():
    """Counts of phrases, letters beyond the samples and beyond the first plane included, many texts in step and few."""
    for _ in range(12):
        samples = {x: "".join(rng.choice(letters) for _ in range(rng.randint(5, 60))) for x, letters in (("x", "abc "), ("y", "bcd漢\U00020000 "))}
        model = language.Model(samples)
        texts = ["".join(rng.choice("abcdezé漢\U00020000 .") for _ in range(rng.randint(0, 40))) for _ in range(30)]
        got = model.phrases(texts)
        assert (model.phrases(texts[:3]) == got[:3]).all()
        for text, row in zip(texts, got.tolist(), strict=True):
            assert row == [plain_phrases(model.encode(text).tolist(), model.encode(samples[x]).tolist()) for x in model.langs]


def test_shorter_sample_is_no_handicap():
    long, short = "".join(rng.choice("abcdef") for _ in range(4000)), "".join(rng.choice("defghi") for _ in range(400))
    model = language.Model({"long": long, "short": short})
    texts = ["".join(rng.choice(x) for _ in range(200)) for x in ("abcdef", "defghi") * 20]
    assert language.judged(texts, model)[0] == ["long", "short"] * 20


def test_language(spark, repeated):
    spell = {"aa": "abcde", "bb": "vwxyzé"}
    rows = []
    for i in range(300):
        lang = ["aa", "bb"][i % 2]
        rows.append((20_000 + i, " ".join("".join(rng.choice(spell[lang]) for _ in range(5)) for _ in range(rng.randint(2, 40))), lang))
    table = spark.createDataFrame([*rows, (1, None, "aa"), (2, "", None), (3, "12 + 3!", "bb"), (None, "abcd", "aa"), rows[0]], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = language.predictions(table).collect()
    assert len(got) == table.count()
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]) > 0.97
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language.predictions(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.predictions(table.limit(0)).count() == 0


# ---------------------------------------------------------------- 7 repeated passages


def plain_removal(texts, size=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                cover[i : i + size] = True
        edges = np.flatnonzero(np.diff(cover.astype(int), prepend=0))
        out.append((len(d), int(cover.sum()), len(edges) // 2, hashlib.sha256(bytes(b for b, c in zip(d, cover, strict=False) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize(("many", "run"), [(4096, 40_000), (3, 50)])
def test_suffix_dedup(spark, docs, repeated, many, run, monkeypatch):
    """Heads dealt out or not, in one batch or in many; a passage in surroundings of its own, and one of many copies."""
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    passage = words(70)
    more = [(8000 + i, words(rng.randint(1, 40)) + passage[: rng.choice([190, 215, 260, 330, 600])] + words(rng.randint(0, 40))) for i in range(30)] + [(8100, (passage[:210] + "\n") * 40)]
    for table in (docs, repeated.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)):
        rows = table.select("doc_id", "text").collect()
        want = Counter((r["doc_id"], *x) for r, x in zip(rows, plain_removal([r["text"] for r in rows]), strict=True))
        assert want == Counter(tuple(r) for r in suffix_dedup.removed(table).collect())
    assert suffix_dedup.removed(empty(docs)).count() == 0


def test_merge_of_runs():
    entries = sorted({("".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))).encode() for _ in range(300)})
    for k in (0, 1, 2, 3, 7):
        deal = [[] for _ in range(k)]
        for e in entries:
            for run in deal:
                if rng.random() < 0.5:
                    run.append(e)
        got = list(suffix_dedup.merged([suffix_dedup.front_coded([(e, b"L", b"p") for e in run]) for run in deal]))
        assert [g[0] for g in got] == sorted(e for run in deal for e in run)
        assert all(deal[g[4]].count(g[0]) for g in got)
        for (x, *_), (y, lcp, *_) in zip(got, got[1:], strict=False):
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            assert lcp == n


# ---------------------------------------------------------------- 8 shingle join


def plain_components(rows):
    sets = [ngram_join.shingle_set(ngram_join.words(t or "")) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(text, n):
    ws = text.split()
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"new{rng.randint(0, 99)}"
    return " ".join(ws)


@pytest.mark.parametrize("other", [False, True])
def test_one_of_repeated_rows(spark, other):
    """Repeated rows with words become one, those without stay, whether or not another duplicate goes."""
    rows = [(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, "nine ten eleven twelve"), (3, ""), (3, ""), (4, None), (4, None)]
    more = [(5, "nine ten eleven twelve")] if other else []
    table = spark.createDataFrame(rows + more, "doc_id long, text string")
    kept = Counter(tuple(r) for r in ngram_join.one_of_each(table).collect())
    assert kept == Counter([rows[0], *rows[2:]])


@pytest.mark.parametrize(("frequent", "batch"), [(256, 1 << 20), (2, 300)])
def test_ngram_join(spark, docs, repeated, frequent, batch, monkeypatch):
    """Frequent shingles in pairs or not, documents in one batch or in many."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join.entries, "__defaults__", (frequent,))
    monkeypatch.setattr(ngram_join, "BATCH", batch)
    near = [(5000 + i, edited(BASE, i % 5)) for i in range(50)] + [(6000 + i, edited(words(30), 0)[:150] + " " + BASE[:250]) for i in range(20)]
    far = [(7000 + i, edited(BASE, 8 + i % 9)) for i in range(40)]
    table = repeated.unionByName(spark.createDataFrame(near + far, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(table).collect())
    assert got == plain_components(rows)
    assert ngram_join.joined(empty(docs)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c if n else d for d, n, c in plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])})


def test_ngram_join_of_text_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", None), ("c", "other words")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", 2, "a"), ("a", 2, "a"), ("c", 0, "c"), ("c", 1, "c")}
    clash = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, text string, _key int, key_of_row int")
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(clash).collect()) == ["a", "c", "c"]


def test_entries_meet():
    """Any two similar sets share an entry that both allow, whatever shingles count as frequent."""
    for _ in range(1500):
        n = rng.randint(1, 150)
        a = rng.sample(range(1, 10**6), n)
        b = list(a)
        for _ in range(rng.randint(0, max(1, n // 8))):
            b[rng.randrange(n)] = rng.randrange(10**6, 2 * 10**6)
        if rng.random() < 0.5:
            b = b[: max(1, n - rng.randint(0, n // 8))]
        if rng.random() < 0.3:
            b = (b + rng.sample(range(2 * 10**6, 3 * 10**6), n))[: rng.randint(len(b), max(len(b), n * 5 // 4))]
        a, b = set(a), set(b)
        both = len(a & b)
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        often = rng.random()
        counts = {h: rng.randint(60, 3000) if rng.random() < often else rng.randint(2 if h in a & b else 1, 64) for h in a | b}
        shared = [(w, h, counts[h]) for w, s in enumerate((a, b)) for h in s if counts[h] > 1]
        who, h, c = (np.array(x, t) for x, t in zip(zip(*shared, strict=True), (np.int64, np.uint64, np.int64), strict=True))
        key, at, slack = ngram_join.entries(np.array([len(a), len(b)]), who, ngram_join.mixed(h), c, rng.choice([1, 64, 256]))
        room = [{k: s for k, w, s in zip(key.tolist(), at.tolist(), slack.tolist(), strict=True) if w == i} for i in (0, 1)]
        assert a == b or any(180 * min(room[0][k], room[1][k]) >= 80 * (len(a) + len(b)) for k in room[0].keys() & room[1].keys())


def test_packed_numbers():
    g = np.random.default_rng(5)
    for n in (0, 1, 7, 1000):
        x = np.sort(g.integers(0, 1 << 48, n, np.uint64))
        assert (ngram_join.unpacked(ngram_join.packed(x, 6, True), 6, True) == x).all()
        assert (ngram_join.unpacked(ngram_join.packed(x % 60000, 2), 2) == x % 60000).all()


# ---------------------------------------------------------------- 9 fingerprints


def plain_likeness(x, y):
    """From two fingerprints: 8 hash lanes of 8 digits, 64 sign lanes of 4, the count in 8."""
    a, b = ((f[:64], [int(f[i : i + 4], 16) for i in range(64, 320, 4)], int(f[320:], 16)) for f in (x, y))
    if a[0] == b[0]:
        return 1.0
    near = lambda d, bits: (d + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)
    gap = sum((2 * near(s - t, 16) - near(a[2] - b[2], 32)) ** 2 for s, t in zip(a[1], b[1], strict=True))
    return max(0.0, 1 - gap / 64 / (a[2] + b[2]))


def test_likeness_of_long_texts(spark):
    """Above 65535 shingles the lanes have gone round; likeness is still that of the fingerprints."""
    text = " ".join(f"w{i % 5000}x{i % 77}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text + " tail"), (3, "other words here")], "doc_id long, text string")
    for r in multiset_hash.edits(docs).collect():
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert (r["near_next"] > 0.9) == (r["doc_id"] == 1)


def test_fingerprints(docs, repeated):
    got = {r["doc_id"]: r for r in multiset_hash.edits(docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts)
    prints = {r["doc_id"]: r["fingerprint"] for r in multiset_hash.fingerprints(docs).collect()}
    assert sorted(got) == ids
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, r = texts[i], got[i]
        q = len(t) // 4
        text = t[: len(t) - q] + texts[nxt][:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["fingerprint"] == prints[i] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for j in ids:
            same = sorted(texts[j].split("\n")) == sorted(t.split("\n"))
            assert same == (prints[i] == prints[j])
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):  # likeness from the fingerprints alone
        q = len(texts[i]) // 4
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"]))
        assert got[i]["near_next"] == pytest.approx(plain_likeness(prints[i], prints[nxt]))
    assert got[3 * 13]["near_edited"] > 0.6 > got[3 * 13]["near_next"]
    assert multiset_hash.edits(repeated).count() == repeated.count() and multiset_hash.edits(empty(docs)).count() == 0


# ---------------------------------------------------------------- 10 url filters


def test_urls(spark):
    hosts = ["a.example.org", "EXAMPLE.org", "notexample.org", "x.com", "com", "y.net", "org", ""]
    paths = ["", "/", "/es/1", "/en/1", "/en/199", "/en/2", "/fr/", "/fr", "/de/x", "?q=/de/", "#/fr/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths] + [None, "", "no scheme/de/", "a://b://c/de/", "http://Ä.com/de/\n/x"]
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls + urls[:9])], "page_id long, url string, host string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge(table).collect()}
    for i, u in enumerate(urls + urls[:9]):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"(?s)[^/?#]*", rest)[0]
        path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in url_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")
    assert url_cascade.judge(table.limit(0)).count() == 0


@pytest.mark.parametrize("most_bits", [1 << 27, 64])
def test_cascade_is_exact(spark, most_bits):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    made = url_cascade.cascade(keys, bits_per_key=4, most_bits=most_bits)
    assert made.flag(keys, "key", "hit").filter("hit <> listed").count() == 0
    assert made.keys is not None or len(made.levels) > 2
    none = url_cascade.cascade(keys.filter("not listed"))
    assert none.flag(keys, "key", "hit").filter("hit").count() == 0
