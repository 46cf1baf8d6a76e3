"""Repair of conversations against a plain search over edits that keeps the turns themselves."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from kassabon.llm import conversation_repair as repair

rng = random.Random(5)
ROLES = ["user", "assistant", "system", "tool", "", None, " ", "user", "assistant", "ulf"]
TEXTS = ["Hi.", "ok", "", "  ", None, "\n?", "yes!", "a b c", "Why? ", "é.", "汉字。", "😀!"] + [f"t{i}." for i in range(300)] + [f"u{i}" for i in range(100)]
TURNS = [None, 0, 1, 2, 3, 4, 5, 9, 2**60]
COLUMNS = "conv_id long, turn long, role string, text string, kind string, part int, here int, h long"
TO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def turns(conv, n):
    return [(conv, rng.choice(TURNS), rng.choice(ROLES), rng.choice(TEXTS), "x", 1, 2, 3) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    got = [t for c in [None, *range(200)] for t in turns(c, rng.randint(1, 12))]
    got += [(1000, i, ["user", "assistant"][i % 2] if rng.random() < 0.9 else "tool", f"text {i % 1500}." + ("" if i % 7 else " x"), "x", 1, 2, 3) for i in range(6000)]
    got += [(1001, 5, "user", "same.", "x", 1, 2, 3)] * 3000 + [(1002, None, "user", "same.", "x", 1, 2, 3)] * 2000 + [(1003, 1, "user", "long words " * 500_000, "x", 1, 2, 3)]
    return spark.createDataFrame(got, COLUMNS).repartition(5).cache()


def damage(given):
    for conv, turn, role, text in given:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        row = (turn, "user" if k == 4 else role, text)
        yield from [(conv, None)] if k == 0 else [(conv, row)] * (2 if k == 3 else 1)


def inserted(best):
    """Close a table of states under insertions."""
    todo = list(best)
    while todo:
        state = todo.pop()
        cost, audit, left = best[state]
        for role in ("user", "assistant"):
            to = TO.get((state, role[0]))
            if to is not None and (to not in best or (cost + 3, audit + "I") < best[to][:2]):
                best[to] = cost + 3, audit + "I", (*left, (role, ""))
                todo.append(to)
    return best


def searched(given):
    """What op11 reports for the sorted turns of a conversation."""
    seen, faults = set(), []
    for _, role, text in given:
        body = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    known = [t for t, _, _ in given if t is not None]
    best = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(given, faults, strict=True):
        now, more = {}, 3 * (fault == "truncated")
        for state, (cost, audit, left) in best.items():
            ways = [(state, cost + 4, audit + "D", left)]
            if fault not in ("blank", "duplicate"):
                ways += [(TO.get((state, role[:1])), cost + more, audit + "K", (*left, (role, text)))]
                ways += [(TO.get((state, r[0])), cost + more + 3, audit + "R", (*left, (r, text))) for r in ("user", "assistant")]
            for to, *way in ways:
                if to is not None and (to not in now or tuple(way[:2]) < now[to][:2]):
                    now[to] = tuple(way)
        best = inserted(now)
    cost, audit, left = min((best[s] for s in (0, 3) if s in best), key=lambda e: e[:2])
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(given))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit, sha), left


def expected(spark, df, most=500):
    """By conversation of at most ``most`` turns; turns of one number in the order that the operator states."""
    given = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    hashed = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in {x[2] for _, x in damage(given) if x}] or [("",)], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    groups = {}
    for conv, row in damage(given):
        groups.setdefault(conv, []).extend([row] if row else [])
    order = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashed[x[2]])
    return {c: searched(sorted(g, key=order)) for c, g in groups.items() if len(g) <= most}, set(groups)


def test_against_a_search(spark, rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(rows).collect()}
    want, all_ids = expected(spark, rows, 10_000)
    assert set(got) == all_ids
    assert got == {c: w for c, (w, _) in want.items()}
    assert len(got[1000][6]) > 5000
    assert got[1001][2] > 2000


def test_repaired_turns(spark, rows):
    few = rows.filter("conv_id < 40 or conv_id is null or conv_id = 1000")
    want, _ = expected(spark, few, 10_000)
    got = {}
    for r in repair.repaired(repair.damaged(few), texts=True, here="here").orderBy("place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert r["place"] == len(got[r["conv_id"]])
    assert got == {c: list(left) for c, (_, left) in want.items() if left}


def test_matrices_are_associative():
    for _ in range(200):
        kinds = "".join(rng.choice(list(repair.STEPS)) for _ in range(rng.randint(0, 12)))
        a, b = sorted((rng.randint(0, len(kinds)), rng.randint(0, len(kinds))))
        parts = [repair.matrix_of(k) for k in (kinds[:a], kinds[a:b], kinds[b:])]
        assert repair.tree(parts) == repair.matrix_of(kinds) == repair.product(parts[0], repair.product(parts[1], parts[2]))


def test_empty_and_dropped(spark, rows):
    assert repair.report(rows.limit(0)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.report(spark.createDataFrame([(gone, 0, "user", "Hi.", "x", 1, 2, 3)], COLUMNS)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_columns_that_clash(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "k", "p", "no", 7)], "conv_id long, turn long, role string, text string, kind string, part string, here string, h long")
    assert repair.repaired(rows).first()["audit"] == "KI"
