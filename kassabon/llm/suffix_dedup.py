"""Removal of repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

A 200-byte string (a window) that starts at two places contains, at the same offset, the same
anchor: the smallest of the hashed 16-byte strings that start in its first 121 places. Only
suffixes at anchors are sorted, an 80th or so of all. What follows the distributed duplicate
detection of string sorters: suffixes whose first 80 bytes occur once need not be exchanged.
Each task sorts its other suffixes into runs, front-coded (length of the prefix shared with the
one before, then the rest), one for each receiving partition. A receiver merges its runs with a
loser tree whose entries carry their common prefix with the last winner, so that known prefixes
are never compared again. Neighbours in the merged order tell how far a suffix is repeated to
the right; an exact comparison of the windows around the anchor settles the left side.

Equal text around an anchor is one entry of its batch, however often it occurs: where it occurs
stays with the batch, to which receivers send back the repeated distances of each entry. Heads
of many places are dealt out by the bytes that follow: windows that reach far to the right of
their anchor by those, the others by the bytes to its left.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keyed, ship, small, stored

WINDOW = 200
KMER = 16
#: Places of a window at which its anchor may stand, and what every window shares from its anchor on.
PLACES = 121
HEAD = WINDOW - PLACES + 1
#: Bytes to the left of an anchor that the windows of a dealt head's first kind reach at most.
NEAR = 60
#: Heads of more places than this are dealt out.
MANY = 4_096
#: Bytes of text that are scanned at a time.
SLICE = 1 << 20

_a, _b, _c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_low = np.uint64((1 << 21) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _c
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of runs of windows with one anchor, over texts laid end to end.

    ``ends``: where each text ends. Windows lie within texts. The leftmost of equal hashes counts,
    so the choice depends on nothing but the window.
    """
    out = []
    total = len(data)
    for start in range(0, max(0, total - WINDOW + 1), SLICE):
        piece = data[start : start + SLICE + WINDOW].astype(np.uint64)
        two = piece[:-1] | piece[1:] << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        h = _mix(eight[:-8] * _a + _mix(eight[8:] * _b))
        h = (h & ~_low) | np.arange(len(h), dtype=np.uint64)
        least = h
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: -(PLACES - 64)], least[PLACES - 64 :])
        n = min(SLICE, total - WINDOW + 1 - start)
        at = (least[:n] & _low).astype(np.int64) + start
        p = np.arange(start, start + n)
        inside = p + WINDOW <= ends[np.searchsorted(ends, p, side="right")]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
        first = np.flatnonzero(new)
        stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False))
        out.append((at[first], first + start, stop + start))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the HEAD bytes from each anchor."""
    rows = data[at[:, None] + np.arange(HEAD)[None]] if len(at) else np.zeros((0, HEAD), np.uint8)
    h = np.full(len(at), HEAD, np.uint64)
    for word in np.ascontiguousarray(rows).view(np.uint64).T:
        h = _mix(h * _a + word)
    return h.view(np.int64)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of consecutive texts of about SLICE bytes, a longer text alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def _scan(texts: list[bytes]):
    """(slice start, ends, data, anchors, firsts, lasts, heads) of each slice of texts."""
    for a, b in _groups(texts):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[a:b]])
        at, lo, hi = anchors(data, ends)
        yield a, ends, data, at, lo, hi, heads(data, at)


def _encoded(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's heads and how often it has them."""
    for batch in batches:
        keys = np.array(batch.column("key").to_pylist(), np.int64)
        for a, ends, _, at, _, _, h in _scan(_encoded(batch.column("text"))):
            if len(at):
                row = np.searchsorted(ends, at, side="right")
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])))
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[first]), "key": pa.array(keys[a + row[first]]), "n": pa.array(np.diff(np.append(first, len(h))))})


# ---------------------------------------------------------------- runs


def front_coded(entries: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """A sorted run as bytes: for each (suffix, left side, mark) the shared prefix and the rests."""
    out, before = [], b""
    for right, left, mark in entries:
        n, most = 0, min(len(before), len(right))
        while n < most and before[n] == right[n]:
            n += 1
        out += [n.to_bytes(1, "little"), (len(right) - n).to_bytes(1, "little"), len(left).to_bytes(1, "little"), len(mark).to_bytes(1, "little"), right[n:], left, mark]
        before = right
    return zlib.compress(b"".join(out), 1)


class Run:
    """Reads a front-coded run: the current suffix, its prefix shared with the one before, its left side and mark."""

    __slots__ = ("data", "at", "right", "shared", "left", "mark", "over", "lcp")

    def __init__(self, blob: bytes):
        self.data, self.at, self.right, self.over, self.lcp = zlib.decompress(blob), 0, b"", False, 0
        self.step()

    def step(self) -> None:
        if self.at >= len(self.data):
            self.over = True
            return
        d, at = self.data, self.at
        n, rest, left, mark = d[at : at + 4]
        at += 4
        self.shared, self.right = n, self.right[:n] + d[at : at + rest]
        self.left, self.mark = d[at + rest : at + rest + left], d[at + rest + left : at + rest + left + mark]
        self.at = at + rest + left + mark


def merged(blobs: list[bytes]) -> Iterator[tuple[bytes, int, bytes, bytes, int]]:
    """(suffix, prefix shared with the one before, left side, mark, run) of all runs in order, by a loser tree.

    Every run keeps ``lcp``, its current suffix's common prefix with the last winner. Of two runs
    the one with the larger lcp is smaller, uncompared; only at equal lcp are bytes compared,
    from there on, and the loser's lcp with the winner is what the comparison found.
    """
    runs = [Run(b) for b in blobs]
    size = 1
    while size < len(runs):
        size *= 2
    done = Run(zlib.compress(b""))
    runs += [done] * (size - len(runs))

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser."""
        a, b = runs[x], runs[y]
        if a.over or b.over:
            return (y, x) if a.over else (x, y)
        if a.lcp != b.lcp:
            return (x, y) if a.lcp > b.lcp else (y, x)
        n, s, t = a.lcp, a.right, b.right
        most = min(len(s), len(t))
        if s[n:] == t[n:]:
            n = most
        else:
            while n < most and s[n] == t[n]:
                n += 1
        if n == most:
            first = len(s) <= len(t)
        else:
            first = s[n] < t[n]
        (b if first else a).lcp = n
        return (x, y) if first else (y, x)

    losers = [0] * size
    level = list(range(size))
    width = size
    while width > 1:
        width //= 2
        ahead = []
        for i in range(width):
            w, losers[width + i] = play(level[2 * i], level[2 * i + 1])
            ahead.append(w)
        level = ahead
    top = level[0] if level else 0
    while runs and not runs[top].over:
        run = runs[top]
        yield run.right, run.lcp, run.left, run.mark, top
        run.step()
        run.lcp = 0 if run.over else run.shared
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


# ---------------------------------------------------------------- what the tasks do


_PLACE = np.dtype([("entry", "<i4"), ("at", "<i4"), ("key", "<i8")])
_RANGE = np.dtype([("entry", "<i4"), ("most", "<i4"), ("least", "<i4")])

#: Places that a task gathers before it sorts their suffixes into runs.
RUN = 40_000
#: Rows of a batch. Part -1 and below: its places. Other parts: a run, and as the answer ranges of distances.
_MOVED = "part int, batch long, data binary"
_COLUMNS = ["part", "batch", "data"]


def kinds(right: bytes, left: bytes, least: int, dealt: bool) -> list[tuple[bytes, bytes, int, int]]:
    """(suffix after a byte for its kind, left side, least distance, what it is dealt by besides its head)."""
    if not dealt:
        return [(b"\0" + right, left, least, 0)]
    out = []
    if least <= NEAR:
        out.append((b"\1" + right, left[-NEAR:], least, zlib.crc32(right[: WINDOW - NEAR])))
    if len(left) > NEAR:
        least = max(least, NEAR + 1)
        out.append((b"\2" + right[: WINDOW - least], left, least, zlib.crc32(left[-NEAR - 1 :])))
    return out


def _runs(parts: int):
    """Batches of wanted suffixes: their places, and a sorted run for each receiving partition.

    An entry's mark: its number in the batch, whether the batch has it several times, and its least distance.
    """

    def flushed(found: dict[tuple[int, bytes, bytes, int], int], places: list[tuple[int, int, int]], turn: int) -> pd.DataFrame:
        spots = np.array(places, _PLACE)
        times = np.bincount(spots["entry"], minlength=len(found))
        runs: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for (part, right, left, least), i in found.items():
            runs.setdefault(part, []).append((right, left, i.to_bytes(4, "little") + bytes((min(int(times[i]), 2), least))))
        batch = (TaskContext.get().partitionId() << 32) + turn
        rows = [(-1 - batch % parts, batch, zlib.compress(spots.tobytes(), 1))]
        rows += [(part, batch, front_coded(sorted(entries))) for part, entries in runs.items()]
        return pd.DataFrame(rows, columns=_COLUMNS)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, bytes, bytes, int], int] = {}
        places: list[tuple[int, int, int]] = []
        turn = 0
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            keys = batch["key"].to_numpy()
            lists = [batch["plain"].to_list(), batch["dealt"].to_list()]
            for a, ends, data, at, lo, hi, h in _scan(texts):
                row = np.searchsorted(ends, at, side="right")
                starts = np.concatenate([[0], ends[:-1]])
                whole = data.tobytes()
                for dealt, own in enumerate(lists):
                    wanted = np.concatenate([np.asarray(x, np.int64) for x in own[a : a + len(ends)]] or [h[:0]])
                    for i in np.flatnonzero(np.isin(h, wanted)).tolist():
                        r, p = int(row[i]), int(at[i])
                        right, left = whole[p : min(p + WINDOW, int(ends[r]))], whole[int(lo[i]) : p]
                        for right, left, least, more in kinds(right, left, p - int(hi[i]), bool(dealt)):
                            entry = ((int(h[i]) + more) % parts, right, left, least)
                            places.append((found.setdefault(entry, len(found)), p - int(starts[r]), int(keys[a + r])))
                        if len(places) >= RUN:
                            yield flushed(found, places, turn)
                            found, places, turn = {}, [], turn + 1
        if places:
            yield flushed(found, places, turn)

    return emit


def repeated(group: list[tuple[bytes, bytes, int, int]], reach: list[int]) -> Iterator[tuple[int, int, int]]:
    """(number in the group, largest, least distance from its anchor) of runs of repeated windows around anchors with one head.

    ``group``: (suffix, left side, least distance, times) in order; ``reach``: how far each suffix
    is repeated to the right. A window that starts l bytes before its anchor needs a reach of
    WINDOW - l; whether its left side is repeated with it is settled by counting the windows themselves.
    """
    contexts = []  # text around the anchor, the anchor in it, the windows' distances from it
    for i, ((right, left, least, times), far) in enumerate(zip(group, reach, strict=True)):
        least = max(least, WINDOW - far)
        if len(left) >= least:
            contexts.append((left + right, len(left), len(left), least, times, i))
    same = Counter()
    for whole, n, most, least, times, _ in contexts:
        same[whole[: n - least + WINDOW], most, least] += times
    rest = []
    for c in contexts:
        whole, n, most, least, _, i = c
        if same[whole[: n - least + WINDOW], most, least] > 1:
            yield i, most, least
        else:
            rest.append(c)
    if not rest:
        return
    spots: dict[int, list] = {}
    for d in range(min(c[3] for c in rest), max(c[2] for c in rest) + 1):
        counts = Counter()
        for whole, n, most, least, times, _ in contexts:
            if least <= d <= most:
                counts[whole[n - d : n - d + WINDOW]] += times
        for whole, n, most, least, _, i in rest:
            if least <= d <= most and counts[whole[n - d : n - d + WINDOW]] > 1:
                spots.setdefault(i, []).append(d)
    for i, ds in spots.items():
        first = ds[0]
        for x, y in zip(ds, [*ds[1:], None], strict=True):
            if y != x + 1:
                yield i, x, first
                first = y


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """The ranges of repeated distances of each batch's entries, from the runs of one partition. Places pass unchanged."""
    if frame["part"].iat[0] < 0:
        return frame
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(frame))]
    group, marks, shared = [], [], []

    def settle() -> None:
        if len(group) > 1 or group and group[0][3] > 1:
            reach = []
            for i, (right, _, _, times) in enumerate(group):
                far = max(shared[i] if i else 0, shared[i + 1] if i + 1 < len(group) else 0)
                reach.append(len(right) if times > 1 else far)
            for i, most, least in repeated(group, reach):
                run, entry = marks[i]
                out[run].append((entry, most, least))

    before = False
    for right, lcp, left, mark, run in merged(list(frame["data"])):
        if before and lcp <= HEAD:  # with the byte of its kind
            settle()
            group, marks, shared = [], [], []
        group.append((right[1:], left, mark[5], mark[4]))
        marks.append((run, int.from_bytes(mark[:4], "little")))
        shared.append(lcp - 1)
        before = True
    settle()
    rows = [(part, batch, np.array(got, _RANGE).tobytes()) for part, batch, got in zip(frame["part"], frame["batch"], out, strict=True) if got]
    return pd.DataFrame(rows, columns=_COLUMNS)


def _placed(frame: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of a batch's documents: for each, first and last starts in bytes."""
    own = frame["part"].to_numpy() < 0
    places = np.frombuffer(zlib.decompress(frame["data"][own].iat[0]), _PLACE)
    places = places[np.argsort(places["entry"], kind="stable")]
    ranges = np.frombuffer(b"".join(frame["data"][~own]), _RANGE)
    first, last = (np.searchsorted(places["entry"], ranges["entry"], side=s) for s in ("left", "right"))
    n = last - first
    each = np.repeat(np.arange(len(n)), n)
    spot = places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[each]]
    lo, hi = spot["at"] - ranges["most"][each], spot["at"] - ranges["least"][each]
    order = np.lexsort((lo, spot["key"]))
    key, cuts = np.unique(spot["key"][order], return_index=True)
    split = lambda x: np.split(x[order], cuts[1:]) if len(key) else []
    return pd.DataFrame({"key": key, "lo": split(lo), "hi": split(hi)})


def spans_of(lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the given ranges."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo, hi, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + WINDOW)
        else:
            out.append([a, b + WINDOW])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    last, keep = 0, []
    for a, b in spans:
        keep.append(data[last:a])
        last = b
    return b"".join([*keep, data[last:]])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text, lo, hi in zip(batch["key"], batch["text"], batch["lo"], batch["hi"], strict=True):
            data, spans = text.encode("utf-8", "surrogatepass"), spans_of(list(lo), list(hi))
            rows.append((key, sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest()))
        yield pd.DataFrame(rows, columns=["key", "n_removed", "n_spans", "kept"])


def repeats(docs: DataFrame) -> DataFrame:
    """(key, lo, hi) arrays for each document with repeated windows: first and last starts, in bytes. ``docs`` has key and text."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("key", "text")
    long = docs.filter(F.octet_length("text") >= WINDOW)
    found = stored(long.mapInArrow(_heads, "h long, key long, n long"))
    counts = stored(found.groupBy("h").agg(F.sum("n").alias("c")).filter("c > 1"))
    many = small(counts.filter(F.col("c") > MANY).select("h"))
    plain = found.join(many, "h", "left_anti").join(counts.filter(F.col("c") <= MANY).select("h"), "h")
    wanted = plain.select("key", F.col("h").alias("plain"), F.lit(None).cast("long").alias("dealt"))
    wanted = wanted.unionByName(found.join(many, "h").select("key", F.lit(None).cast("long").alias("plain"), F.col("h").alias("dealt")))
    wanted = stored(wanted.groupBy("key").agg(F.collect_list("plain").alias("plain"), F.collect_list("dealt").alias("dealt")))
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("plain") + F.size("dealt")), F.lit(0)).alias("m")).first()
    few = size["n"] <= BROADCAST_ROWS and size["m"] <= 8 * BROADCAST_ROWS  # 32 MB of hashes; a shuffle join beyond
    own = long.join(F.broadcast(wanted) if few else wanted, "key")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["m"] // RUN))
    answers = own.mapInPandas(_runs(parts), _MOVED).groupBy("part").applyInPandas(_merge, _MOVED)
    spans = answers.groupBy("batch").applyInPandas(_placed, "key long, lo array<int>, hi array<int>")
    return stored(spans.groupBy("key").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi")))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    Every byte covered by a 200-byte string that also starts elsewhere, in the same text or
    another one, goes. Null text is empty; texts under 200 bytes stay whole; of repeated rows
    of 200 bytes or more all bytes go, since each repeats the other.
    """
    docs = keyed(docs)
    found = repeats(docs)
    plain = docs.select("key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    changed = docs.join(found, "key").select("key", "text", "lo", "hi").mapInPandas(_cut, "key long, n_removed long, n_spans long, kept string")
    changed = stored(changed.dropDuplicates(["key"]))
    got = plain.join(changed, "key", "left")
    return got.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
