"""Self-join of documents by Jaccard similarity of word shingles, with token-combination prefixes.

How many distinct sets have a shingle is counted over all documents. Each document's shingles stand
in order of that count, rarest first. Of two documents similar enough, each has at most
n - ceil(t (n + m) / (1 + t)) shingles that the other one lacks, so they share one of as many and
one more from the front (the prefix). Rare shingles of the prefix are indexed singly. Frequent ones
are dealt to classes by their hash and indexed in pairs of a class; the prefix is extended by what
pairs need, so that dropping what the other one lacks still leaves a rare shingle or a pair.

An index entry knows its slack: the largest overlap for which it still belongs to the prefix. Two
entries only make a candidate where both allow the overlap that their sizes demand.

Shingles travel packed: each task sorts those of a batch of documents, counts repeats within it and
sends every part of the hash range one row of coded hashes; counts come back the same way, batch by
batch. So a shingle costs a few bytes, and one that every document holds is one entry of a batch.

The documents under one index key are first compared with the most typical of them (the one with
the smallest share of shingles that nobody else has), which links a group of near copies with as
many comparisons as documents; what is left is compared across components. Candidates are verified
on their texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, keyed, release, ship, small, spans, stored, trim, unique_ids
from .graph import components

SHINGLE = 5
#: Similarity in hundredths.
LEAST = 80
#: A shingle of more distinct sets than this is frequent.
FREQUENT = 256
#: Shingles that a task sorts at a time, and of one part of the hash range: a few dozen MB.
BATCH = 1 << 20
#: Documents of a batch at most, so that two bytes number them.
BATCH_DOCS = 1 << 16
#: Texts that one row of a popular document's text is compared with, roughly.
CHUNK = 1 << 10
#: Bytes of text that are hashed at a time.
AT_ONCE = 1 << 20

_factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % 2**64
    return out[:n]


class Hasher:
    """Shingle hashes of many texts at once.

    A word's hash is a sum of byte codes times powers of an odd number, taken from running sums
    over the bytes and shifted to the word's start by the inverse power.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        self.codes = np.random.default_rng(20240611).integers(1, 2**63, 256, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.grow(AT_ONCE)

    def grow(self, n: int) -> None:
        self.up, self.down = _powers(n + 1, self.BASE), _powers(n + 1, pow(self.BASE, -1, 2**64))

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Sorted hashes of each text's distinct shingles; with fewer than five words the whole sequence is one."""
        for first, last in spans([len(t) for t in texts], AT_ONCE):
            data = [t.encode("utf-8", "surrogatepass") for t in texts[first:last]]
            yield from self.chunk(data)

    def chunk(self, data: list[bytes]) -> Iterator[np.ndarray]:
        joined = np.frombuffer(b" ".join(data).lower() + b" ", np.uint8)
        if len(joined) >= len(self.up):
            self.grow(len(joined))
        gap = self.space[joined]
        first = np.flatnonzero(~gap & np.append(True, gap[:-1]))
        last = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
        total = np.cumsum(self.codes[joined] * self.up[: len(joined)])
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        h = mixed((total[last - 1] - before) * self.down[first])
        ends = np.searchsorted(first, np.cumsum([len(d) + 1 for d in data]))
        start = 0
        rolled = np.full(max(0, len(h) - SHINGLE + 1), SHINGLE, np.uint64)
        for i in range(SHINGLE):
            rolled = mixed(rolled * _factors[i] + h[i : len(h) - SHINGLE + 1 + i]) if len(rolled) else rolled
        for end in ends.tolist():
            n = end - start
            if n >= SHINGLE:
                own = np.sort(rolled[start : end - SHINGLE + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif n:
                one = np.full(1, n, np.uint64)
                for i in range(n):
                    one = mixed(one * _factors[i] + h[start + i : start + i + 1])
                yield one
            else:
                yield h[:0]
            start = end


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(ws: list[bytes]) -> set:
    if len(ws) < SHINGLE:
        return {tuple(ws)} if ws else set()
    return set(zip(*(ws[i:] for i in range(SHINGLE)), strict=False))


def kept(n):
    """ceil(t n): what any similar document shares at least."""
    return -(-LEAST * n // 100)


def classes_of(band):
    """How many classes frequent shingles are dealt to, for documents of 2^band shingles or more."""
    return np.maximum(1, (1 << np.asarray(band)) // 16)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest of each text's set."""
    release()
    hasher = Hasher()
    for batch in batches:
        n, digests = [], []
        for h in hasher.sets(batch.column("text").to_pylist()):
            n.append(len(h))
            digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
        sig = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "sig_a": pa.array(sig[:, 0]), "sig_b": pa.array(sig[:, 1])})
    trim()


# ---------------------------------------------------------------- packed shingles

#: Bits of a hash that travel; those that fall together only add candidates.
BITS = 48


def packed(a: np.ndarray, width: int, rising: bool = False) -> bytes:
    """Whole numbers below 256^width, byte by byte; of rising ones the steps."""
    a = a.astype("<u8")
    if rising and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def unpacked(data: bytes, width: int, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    out = out.view("<u8").ravel()
    return np.cumsum(out, dtype=np.uint64) if rising else out


#: Rows of a batch. Part -1 and below: the batch itself, with its keys, sizes, the hashes that several of its
#: documents have, how many and which. Other parts: hashes of one document and its number, then hashes of several and how many.
_PACKED = "part int, batch long, a binary, b binary, c binary, d binary, e binary"
_COLUMNS = ["part", "batch", "a", "b", "c", "d", "e"]


def _dealt(parts: int):
    """Batches of documents as packed rows for ``parts`` parts of the hash range."""
    edges = np.array([-(-p * 2**BITS // parts) for p in range(parts + 1)], np.uint64)

    def rows(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(h) for h in sets])
        h = np.concatenate(sets) >> np.uint64(64 - BITS)
        order = np.argsort(h, kind="stable")
        h, who = h[order], np.repeat(np.arange(len(n)), n)[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        times = np.diff(np.append(first, len(h)))
        several = np.repeat(times > 1, times)
        one, one_who = h[~several], who[~several]
        many, count = h[first[times > 1]], times[times > 1]
        out = [(-1 - keys[0] % parts, keys[0], np.array(keys, np.int64).tobytes(), packed(n, 4), packed(many, 6, True), packed(count, 4), packed(who[several], 2))]
        x, y = np.searchsorted(one, edges), np.searchsorted(many, edges)
        for p in range(parts):
            if x[p] < x[p + 1] or y[p] < y[p + 1]:
                ones, manys = slice(x[p], x[p + 1]), slice(y[p], y[p + 1])
                out.append((p, keys[0], packed(one[ones], 6, True), packed(one_who[ones], 2), packed(many[manys], 6, True), packed(count[manys], 4), None))
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(_COLUMNS, zip(*out, strict=True), types, strict=True)})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        keys, sets, size = [], [], 0
        for batch in batches:
            for key, h in zip(batch.column("key").to_pylist(), hasher.sets(batch.column("text").to_pylist()), strict=True):
                if not len(h):
                    continue
                if size and (size + len(h) > BATCH or len(keys) == BATCH_DOCS):
                    yield rows(keys, sets)
                    keys, sets, size = [], [], 0
                keys.append(key)
                sets.append(h)
                size += len(h)
        if keys:
            yield rows(keys, sets)
        del keys, sets
        trim()

    return emit


def _counted(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one part of the hash range, the hashes that several documents have, with their counts, for each batch.

    Batches themselves pass unchanged. Columns: hashes of one document of the batch, its number, their counts; hashes of several, their counts.
    """
    if frame["part"].iat[0] < 0:
        return frame
    one = [unpacked(x, 6, True) for x in frame["a"]]
    many = [unpacked(x, 6, True) for x in frame["c"]]
    sizes = [len(x) for pair in zip(one, many, strict=True) for x in pair]
    h = np.concatenate([x for pair in zip(one, many, strict=True) for x in pair])
    times = np.concatenate([x for a, d in zip(one, frame["d"], strict=True) for x in (np.ones(len(a), np.int64), unpacked(d, 4).astype(np.int64))])
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    total = np.add.reduceat(times[order], first)
    count = np.empty(len(h), np.int64)
    count[order] = np.repeat(total, np.diff(np.append(first, len(h))))
    ends, rows = np.cumsum(sizes), []
    for i, (part, batch, who) in enumerate(zip(frame["part"], frame["batch"], frame["b"], strict=True)):
        c, d = count[ends[2 * i] - sizes[2 * i] : ends[2 * i]], count[ends[2 * i] : ends[2 * i + 1]]
        shared = c > 1
        if shared.any() or len(d):
            rows.append((part, batch, packed(one[i][shared], 6, True), packed(unpacked(who, 2)[shared], 2), packed(c[shared], 5), packed(many[i], 6, True), packed(d, 5)))
    return pd.DataFrame(rows, columns=_COLUMNS)


def entries(n: np.ndarray, who: np.ndarray, h: np.ndarray, c: np.ndarray, frequent: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index key, document, slack) for documents of ``n`` shingles, from those that others have too: document, hash and count.

    A shingle's level is how many the other document may lack before it is needed: in order of
    count, rare shingles raise it by one each, frequent ones from the second of their class on.
    """
    frequent = FREQUENT if frequent is None else frequent
    order = np.lexsort((h, c, who))
    who, h, c = who[order], h[order], c[order]
    shared = np.bincount(who, minlength=len(n))
    starts = np.cumsum(shared) - shared
    most = n - kept(n)
    level = np.arange(len(who)) - starts[who] + (n - shared)[who]
    often = c > frequent
    rare = ~often & (level <= most[who])
    out = [(h[rare], who[rare], level[rare])]
    # bands of sizes: a pair of documents meets in the band of the larger one
    band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    wide = np.floor(np.log2(np.maximum(n * 100 // LEAST, 1))).astype(np.int64)
    spot = np.flatnonzero(often)
    below = (n - np.bincount(who[spot], minlength=len(n)))[who[spot]]  # own and rare shingles come first
    for up in (False, True):
        use = spot if not up else spot[(wide > band)[who[spot]]]
        base = below if not up else below[(wide > band)[who[spot]]]
        if not len(use):
            continue
        at = (wide if up else band)[who[use]]
        kind = h[use] % classes_of(at).astype(np.uint64)
        by = np.lexsort((use, kind, who[use]))
        same = np.append(False, (who[use][by][1:] == who[use][by][:-1]) & (kind[by][1:] == kind[by][:-1]))
        later = np.empty(len(use), np.int64)
        later[by] = same  # whether another of its class comes before
        new = np.append(True, who[use][1:] != who[use][:-1])
        before = np.cumsum(later) - later
        own = base + before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(use))))
        keep = (own <= most[who[use]])[by]
        group = np.cumsum(~same)[keep]
        by = by[keep]
        step = 1
        while step < len(by):
            pair = np.flatnonzero(group[step:] == group[:-step])
            if not len(pair):
                break
            x, y = by[pair], by[pair + step]
            key = mixed(h[use[x]] * _factors[0] + mixed(h[use[y]] * _factors[1] + at[y].astype(np.uint64)))
            out.append((key, who[use[y]], own[y]))
            step += 1
    key, who, level = (np.concatenate(x) for x in zip(*out, strict=True))
    return key.astype(np.uint64), who, n[who] - level


def _indexed(frame: pd.DataFrame) -> pd.DataFrame:
    """Index entries of a batch, from its row and the counts of its hashes in all parts."""
    own = frame["part"].to_numpy() < 0
    (batch,), got = frame[own].itertuples(index=False), frame[~own]
    keys, n = np.frombuffer(batch.a, np.int64), unpacked(batch.b, 4).astype(np.int64)
    many, times, which = unpacked(batch.c, 6, True), unpacked(batch.d, 4).astype(np.int64), unpacked(batch.e, 2).astype(np.int64)
    none = np.zeros(0, np.uint64)
    gather = lambda column, width, rising=False: np.concatenate([none, *(unpacked(x, width, rising) for x in got[column])])
    known, total = gather("d", 6, True), gather("e", 5).astype(np.int64)
    total = total[np.argsort(known, kind="stable")]  # of ``many``, in its order
    who = np.concatenate([gather("b", 2).astype(np.int64), which])
    h = np.concatenate([gather("a", 6, True), np.repeat(many, times)])
    c = np.concatenate([gather("c", 5).astype(np.int64), np.repeat(total, times)])
    key, at, slack = entries(n, who, h, c)
    alone = n - np.bincount(who, minlength=len(n))
    return pd.DataFrame({"ik": key.view(np.int64), "key": keys[at], "n": n[at], "slack": slack, "alone": (1000 * alone // np.maximum(n, 1))[at]})


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, mine = None, set()
    for batch in batches:
        yes = []
        for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"], strict=True):
            if a != last:
                last, mine = a, shingle_set(words(ta))
            other = shingle_set(words(tb))
            both = len(mine & other)
            yes.append(100 * both >= LEAST * (len(mine) + len(other) - both))
        yield batch.loc[yes, ["a", "b"]]
    trim()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` whose texts are similar enough; only texts that occur in a pair are moved.

    The text of a document with many partners goes out in several copies, each for about CHUNK of them.
    """
    ids = cut(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
    texts = docs.select("key", "text").join(small(ids), "key", "left_semi")
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("copies")).filter("copies > 1")
    popular = small(cut(degree))
    dealt = pairs.join(popular, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"))
    mine = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")).join(popular, "a", "left")
    mine = mine.select("a", "ta", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    moved = dealt.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(mine, ["a", "copy"])
    return stored(moved.select("a", "b", "ta", "tb").mapInPandas(_similar, "a long, b long"))


def allowed(*slacks):
    """Whether both entries allow the overlap that sizes m and n demand: s (1 + t) >= t (m + n)."""
    return F.least(*slacks) * (100 + LEAST) >= (F.col("m") + F.col("n")) * LEAST


def links(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b): links between distinct sets that give the same components as all links."""
    hub = F.min_by(F.struct(F.col("key").alias("a"), F.col("n").alias("m"), F.col("slack").alias("room")), F.struct("alone", "key")).alias("hub")
    lists = index.groupBy("ik").agg(F.count(F.lit(1)).alias("size"), hub).filter("size > 1")
    pairs = index.select("ik", F.col("key").alias("b"), "n", "slack").join(lists.select("ik", "hub.*"), "ik")
    pairs = pairs.filter(F.col("a") != F.col("b")).filter(allowed("room", "slack")).select("a", "b").distinct()
    hubs = stored(pairs)
    found = verified(hubs, docs)
    comps = components(found)
    rows = index.join(small(comps), "key", "left").select("ik", "key", "n", "slack", F.coalesce("comp", "key").alias("comp"))
    mixed_lists = rows.groupBy("ik").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("ik")
    rows = stored(rows.join(mixed_lists, "ik", "left_semi"))
    left = rows.select("ik", F.col("key").alias("a"), F.col("n").alias("m"), F.col("slack").alias("room"), F.col("comp").alias("ca"))
    right = rows.select("ik", F.col("key").alias("b"), "n", "slack", F.col("comp").alias("cb"))
    rest = left.join(right, "ik").filter("a < b and ca <> cb").filter(allowed("room", "slack")).select("a", "b").distinct()
    known = hubs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(known, ["a", "b"], "left_anti"))
    return found.unionByName(verified(rest, docs))


def joined(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Rows link where 100 * intersection >= 80 * union of their shingle sets; component_id is the
    smallest doc_id that links reach. Null and word-less texts have no shingles and stay alone.
    Equal sets link by definition and are compared once. Repeated rows have the same component.
    Ids may be of any type that has an order.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = keyed(docs)
    sets = stored(docs.select("key", "doc_id", "text").mapInArrow(_described, f"key long, doc_id {kind}, n long, sig_a long, sig_b long"))
    reps = stored(sets.filter("n > 0").groupBy("sig_a", "sig_b").agg(F.min("key").alias("rep"), F.min("n").alias("n"), (F.count(F.lit(1)) > 1).alias("several")))
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copied = small(reps.filter("several").select("sig_a", "sig_b", "rep"))
    of = sets.join(copied, ["sig_a", "sig_b"], "left").select("key", "doc_id", "n", F.coalesce("rep", "key").alias("rep"))
    skip = cut(of.filter("n = 0 or key <> rep").select("key").distinct())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BATCH))
    single = docs.select("key", "text").join(small(skip), "key", "left_anti")
    if not unique_ids(sets):  # rows repeated whole have one key
        single = single.dropDuplicates(["key"])
    dealt = single.mapInArrow(_dealt(parts), _PACKED).groupBy("part").applyInPandas(_counted, _PACKED)
    index = stored(dealt.groupBy("batch").applyInPandas(_indexed, "ik long, key long, n long, slack long, alone long"))
    comps = components(links(docs, index))
    of = of.join(small(comps.withColumnRenamed("key", "rep")), "rep", "left")
    of = stored(of.select("key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("comp")))
    least = small(cut(of.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("comp", "least")))
    own = of.join(least, "comp", "left")
    return own.select("key", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component: the one of smallest id (then key) stays.

    Rows without words belong to no component and stay, repeated ones too. Of rows that repeat
    an id and a text one stays, whatever else the table holds.
    """
    got = stored(joined(docs.select("doc_id", "text")))
    stay = got.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("x"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    stay = small(cut(stay.select("component_id", F.col("x.key").alias("stay"))))
    gone = got.filter("n_shingles > 0").join(stay, got["component_id"].eqNullSafe(stay["component_id"])).filter("key <> stay")
    name = free_name(docs, "key_of_row")
    gone = small(cut(gone.select(F.col("key").alias(name)).distinct()))
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) and not got.filter("doc_id is null or key <> doc_id").limit(1).count():
        return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
    own = docs.withColumn(name, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))  # keys are hashes, so rows may repeat
    blank = small(cut(got.filter("n_shingles = 0").select(F.col("key").alias(name)).distinct()))
    worded = own.join(blank, name, "left_anti").dropDuplicates([name]).join(gone, name, "left_anti")
    return worded.unionByName(own.join(blank, name, "left_semi")).select(*docs.columns)
