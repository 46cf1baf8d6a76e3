"""Repair of the structure of conversations by a scan of min-plus matrices.

A conversation is in order when the initials of its roles match ``(s?(ua)+)?``. The automaton of
that has four states: nothing yet, after s, after u, after a. Each turn is a 4x4 matrix: what leads
from one state to another by keeping, re-roling or deleting the turn, with any insertions before it
(the closure), at which cost and with which edits (cost, audit); the product adds costs, joins
audits and takes the least. Products are associative, so runs of turns are multiplied in the tasks
that hold them and the matrices of a long conversation by a tree over partitions.

Turns are dealt out by ranges of (conversation, turn). A conversation that lies inside one range is
repaired there; one that reaches a border, or is longer than a piece, is written in pieces. Its
matrices meet in the tree; its text passes one task as a stream, as its hash asks for, a piece a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ship, small_batches, stored

#: Turns, and characters of them, that a piece of a long conversation holds.
PIECE_TURNS, PIECE_CHARS = 1024, 1 << 22
#: Matrices multiplied by one call above the ranges.
FAN = 16

NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
ENDS = (NOTHING, AFTER_A)
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3

#: A turn's letter: its initial (o: any other), by its fault.
FINE, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "0123", "4567"
#: Edits as letters whose order is that of D, I, K, R: insert user, assistant; keep s, u, a; re-role to user, assistant. They tell the state they lead to.
PUBLIC = str.maketrans("JLMS", "IKKR")
INSERTED = {"I": "user", "J": "assistant"}
REROLED = {"R": "user", "S": "assistant"}

Element = tuple[int, str]
Row = list[Element | None]
Matrix = list[Row]


def nexts(state: int, role: str) -> int | None:
    """The state that a role leads to."""
    if role == "s":
        return AFTER_S if state == NOTHING else None
    if role == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if state == AFTER_U else None


def least(into: Row, at: int, cost: int, audit: str) -> None:
    if into[at] is None or (cost, audit) < into[at]:
        into[at] = cost, audit


def closure() -> Matrix:
    """Any insertions, from each state: more than a cycle's length never pays."""
    out: Matrix = []
    for start in range(STATES):
        row: Row = [None] * STATES
        at, cost, audit = start, 0, ""
        for _ in range(STATES):
            least(row, at, cost, audit)
            role = "a" if at == AFTER_U else "u"
            at, cost, audit = nexts(at, role), cost + INSERT, audit + ("J" if role == "a" else "I")
        out.append(row)
    return out


def turn_matrix(kind: str) -> Matrix:
    """One turn by itself."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    rank = next((x.index(kind) for x in (FINE, TRUNCATED) if kind in x), None)
    more = UNFINISHED if kind in TRUNCATED else 0
    for state in range(STATES):
        least(out[state], state, DELETE, "D")
        if rank is None:
            continue
        if rank < 3 and (to := nexts(state, FINE[rank])) is not None:
            least(out[state], to, more, "KLM"[rank])
        for role, letter in (("u", "R"), ("a", "S")):
            if (to := nexts(state, role)) is not None:
                least(out[state], to, REROLE + more, letter)
    return out


def times(row: Row, matrix: Matrix) -> Row:
    out: Row = [None] * STATES
    for k, before in enumerate(row):
        if before is not None:
            for j, after in enumerate(matrix[k]):
                if after is not None:
                    least(out, j, before[0] + after[0], before[1] + after[1])
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return [times(row, b) for row in a]


CLOSURE = closure()
#: Insertions, then the turn.
STEPS = {kind: product(CLOSURE, turn_matrix(kind)) for kind in FINE + TRUNCATED + BLANK + DUPLICATE}
UNIT: Matrix = [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]


def folded(row: Row, kinds: str) -> Row:
    for kind in kinds:
        row = times(row, STEPS[kind])
    return row


def matrix_of(kinds: str) -> Matrix:
    """The product of a run of turns."""
    return [folded(row, kinds) for row in UNIT]


def tree(matrices: list[Matrix]) -> Matrix:
    """The product of matrices, neighbours first."""
    while len(matrices) > 1:
        matrices = [reduce(product, matrices[i : i + 2]) for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else UNIT


def cheapest(row: Row) -> Element:
    """The least element of a row that ends in order, after closing insertions."""
    row = times(row, CLOSURE)
    return min(e for i in ENDS if (e := row[i]) is not None)


@lru_cache(maxsize=20_000)
def repair_of(kinds: str) -> Element:
    """Cost and edits of a conversation that one task holds."""
    return cheapest(folded(UNIT[NOTHING], kinds))


def letters_of(audit: str, at: int, turns: int) -> int:
    """Where the edits of the next ``turns`` turns end, insertions before each with it."""
    while turns:
        if audit[at] not in INSERTED:
            turns -= 1
        at += 1
    return at


def edited(letters: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """Role and text of what the edits leave."""
    i = 0
    for x in letters:
        if x in INSERTED:
            yield INSERTED[x], ""
            continue
        if x != "D":
            yield REROLED.get(x, roles[i]), texts[i]
        i += 1


def seen_again(kinds: str, places: Any) -> str:
    """``kinds`` with the turns at ``places`` as duplicates. Blank turns stay blank."""
    out = list(kinds)
    for i in places:
        for known in (FINE, TRUNCATED):
            if out[i] in known:
                out[i] = DUPLICATE[known.index(out[i])]
    return "".join(out)


def initials(kinds: str) -> str:
    return "".join(FINE[next(x.index(k) for x in (FINE, TRUNCATED, BLANK, DUPLICATE) if k in x)] for k in kinds)


def illegal(roles: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(roles, roles[1:], strict=False)))


def among(kinds: str, fault: str) -> int:
    return sum(map(kinds.count, fault))


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(errors="surrogatepass"), digest_size=16).digest()


MEASURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "roles array<string>, texts array<string>"
#: Of a piece: its range and number there, a letter for each turn, places and digests of what is seen for the first time in it, lowest, highest and number of its turns.
PIECE = "part int, piece int, kinds string, firsts array<struct<place:int,digest:binary>>, low long, high long, n_turns long"


def columns(spark_schema: T.StructType, rows: list[dict[str, Any]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(spark_schema))


def gaps_of(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


class Piece:
    """Turns of one conversation on end."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.turns: list[int] = []
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, kind: str) -> None:
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append(text)
        if turn is not None:
            self.turns.append(turn)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.kinds) >= PIECE_TURNS or self.size >= PIECE_CHARS

    def firsts(self) -> tuple[str, list[dict[str, Any]]]:
        """Kinds with duplicates marked, and what is seen for the first time, blank turns left out."""
        seen: set[bytes] = set()
        again, found = [], []
        for i, kind in enumerate(self.kinds):
            if kind in BLANK:
                continue
            d = digest(self.roles[i], self.texts[i])
            if d in seen:
                again.append(i)
            else:
                seen.add(d)
                found.append({"place": i, "digest": d})
        return seen_again("".join(self.kinds), again), found

    def span(self) -> dict[str, int | None]:
        return {"low": min(self.turns, default=None), "high": max(self.turns, default=None), "n_turns": len(set(self.turns))}


def measures(kinds: str, gaps: int, cost: int, audit: str, sha: str) -> dict[str, Any]:
    return {"gaps": gaps, "blank": among(kinds, BLANK), "duplicate": among(kinds, DUPLICATE), "truncated": among(kinds, TRUNCATED), "illegal": illegal(initials(kinds)), "cost": cost, "audit": audit.translate(PUBLIC), "repaired_sha256": sha}


def within_ranges(batches: Iterator[pa.RecordBatch], schema: T.StructType, texts: bool) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted range: repaired, or in pieces where they reach a border of it or fill more than a piece."""
    part = TaskContext.get().partitionId()
    out: list[dict[str, Any]] = []
    held, size, number = Piece(), 0, 0
    conv: Any = None
    began, first, split = False, True, False

    def piece() -> dict[str, Any]:
        nonlocal number
        kinds, firsts = held.firsts()
        number += 1
        return {"conv_id": conv, "part": part, "piece": number, "kinds": kinds, "firsts": firsts, "roles": held.roles, "texts": held.texts} | held.span()

    def whole() -> dict[str, Any]:
        kinds, _ = held.firsts()
        cost, audit = repair_of(kinds)
        left = list(edited(audit, held.roles, held.texts))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        span = held.span()
        row = {"conv_id": conv} | measures(kinds, gaps_of(span["low"], span["high"], span["n_turns"]), cost, audit, sha)
        return row | ({"roles": [r for r, _ in left], "texts": [t for _, t in left]} if texts else {})

    for batch in batches:
        got = batch.to_pydict()
        for own, turn, role, text, here, kind in zip(*(got[c] for c in ("conv_id", "turn", "role", "text", "here", "kind")), strict=True):
            if not began or own != conv:
                if began:
                    out.append(piece() if first or split else whole())
                    size, first = size + held.size, False
                held, conv, began, split = Piece(), own, True, False
            elif held.full():
                out.append(piece())
                size += held.size
                held, split = Piece(), True
            if here:
                held.add(turn, role, text, kind)
            if len(out) >= 2000 or size >= PIECE_CHARS:
                yield columns(schema, out)
                out, size = [], 0
    if began:
        out.append(piece())
    if out:
        yield columns(schema, out)


CELLS = "array<struct<cost:long,audit:string>>"


def packed(matrix: Matrix) -> list[dict[str, Any] | None]:
    return [None if e is None else {"cost": e[0], "audit": e[1]} for row in matrix for e in row]


def unpacked(cells: Any) -> Matrix:
    flat = [None if c is None else (int(c["cost"]), c["audit"]) for c in cells]
    return [flat[i : i + STATES] for i in range(0, STATES * STATES, STATES)]


def settled_piece(kinds: pd.Series, again: pd.Series) -> pd.DataFrame:
    rows = [seen_again(k, [] if a is None else a) for k, a in zip(kinds, again, strict=True)]
    return pd.DataFrame({"kinds": rows, "cells": [packed(matrix_of(k)) for k in rows]})


def multiplied(groups: pd.Series) -> pd.Series:
    return pd.Series([packed(tree([unpacked(x["cells"]) for x in group])) for group in groups])


def finished(cells: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cheapest(unpacked(c)[NOTHING]) for c in cells], columns=["cost", "letters"])


def across_ranges(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, piece, kinds with duplicates of earlier pieces marked) and (conv_id, cost, letters)."""
    settle, multiply, finish = F.pandas_udf(settled_piece, f"kinds string, cells {CELLS}"), F.pandas_udf(multiplied, CELLS), F.pandas_udf(finished, "cost long, letters string")
    place = F.struct("part", "piece")
    seen = pieces.select("conv_id", "part", "piece", F.explode("firsts").alias("f")).select("conv_id", "part", "piece", "f.place", "f.digest")
    # A text that a whole conversation repeats is here once for each piece.
    seen = seen.withColumn("first", F.min(place).over(Window.partitionBy("conv_id", "digest")))
    again = seen.filter(F.col("first") < place).groupBy("part", "piece").agg(F.collect_list("place").alias("again"))  # at most PIECE_TURNS
    told = pieces.select("conv_id", "part", "piece", "kinds").join(again, ["part", "piece"], "left")
    told = stored(told.select("conv_id", "part", "piece", settle("kinds", "again").alias("s")).select("conv_id", "part", "piece", "s.*"))
    level = told.groupBy("conv_id", "part").agg(multiply(F.array_sort(F.collect_list(F.struct("piece", "cells")))).alias("cells")).withColumnRenamed("part", "at")
    most = told.agg(F.max("part")).first()[0] or 0
    while most > 0:
        level = level.withColumn("up", F.floor(F.col("at") / FAN).cast("int")).groupBy("conv_id", "up").agg(multiply(F.array_sort(F.collect_list(F.struct("at", "cells")))).alias("cells")).withColumnRenamed("up", "at")
        most //= FAN
    done = level.select("conv_id", finish("cells").alias("f")).select("conv_id", "f.*")
    return told.select("conv_id", "part", "piece", "kinds"), done


def joined_pieces(batches: Iterator[pa.RecordBatch], schema: T.StructType, texts: bool) -> Iterator[pa.RecordBatch]:
    """Long conversations as streams: first cost and letters, then of each piece its kinds and its turns."""
    out: list[dict[str, Any]] = []
    size = 0
    conv: Any = None
    letters = kinds = ""
    sha, at, began, lines, cost = hashlib.sha256(), 0, False, 0, 0
    last, low, high, distinct, total = "", None, None, 0, {}

    def take(part: list[tuple[str, str]]) -> None:
        nonlocal lines, size
        if part:
            sha.update((("\n" if lines else "") + "\n".join(f"{r}:{t}" for r, t in part)).encode())
            lines += len(part)
            if texts:
                size += sum(len(t) for _, t in part)
                out.append({"conv_id": conv, "n": lines, "roles": [r for r, _ in part], "texts": [t for _, t in part]})

    def close() -> None:
        take(list(edited(letters[at:], [], [])))
        out.append({"conv_id": conv, "n": 0} | total | {"gaps": gaps_of(low, high, distinct), "cost": cost, "audit": letters.translate(PUBLIC), "repaired_sha256": sha.hexdigest()})

    for batch in batches:
        for row in batch.to_pylist():
            if row["what"] == 0:
                if began:
                    close()
                conv, letters, cost = row["conv_id"], row["letters"], row["cost"]
                sha, at, began, lines = hashlib.sha256(), 0, True, 0
                last, low, high, distinct, total = "", None, None, 0, {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            elif row["what"] == 1:
                kinds = row["kinds"]
            else:
                own = measures(kinds, 0, 0, "", "")
                total = {k: v + own[k] for k, v in total.items()}
                roles = initials(kinds)
                if roles:
                    total["illegal"] += illegal(last + roles[0]) if last else 0
                    last = roles[-1]
                if row["low"] is not None:
                    distinct += row["n_turns"] - (row["low"] == high)
                    low, high = row["low"] if low is None else low, row["high"]
                end = letters_of(letters, at, len(kinds))
                take(list(edited(letters[at:end], row["roles"], row["texts"])))
                at = end
            if len(out) >= 2000 or size >= PIECE_CHARS:
                yield columns(schema, out)
                out, size = [], 0
    if began:
        close()
    if out:
        yield columns(schema, out)


WHITE = " \t\n\x0b\x0c\r"


def kind_of(role: Column, text: Column) -> Column:
    """A turn's letter, but for duplicates."""
    said = F.rtrim(text, F.lit(WHITE))
    rank = F.coalesce(F.nullif(F.instr(F.lit(FINE[:3]), F.left(role, F.lit(1))), F.lit(0)), F.lit(4))
    rank = F.when(role == "", 4).otherwise(rank)
    fault = F.when(said == "", F.lit(BLANK)).when(F.right(said, F.lit(1)).isin(".", "!", "?"), F.lit(FINE)).otherwise(F.lit(TRUNCATED))
    return F.substr(fault, rank, F.lit(1))


def repaired(rows: DataFrame, texts: bool = False, here: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role and text; where the boolean column named by ``here`` isn't true, a row
    only names its conversation. Null roles and texts count as one space, a null conv_id is a conversation of
    its own, null turns come first; turns of one number follow each other by role, then by a hash of the
    text, so repeated rows are adjacent. Other columns are ignored. With ``texts`` the repaired turns are
    given instead: conv_id, place (from 1), role, text.
    """
    spark = rows.sparkSession
    ship(spark)
    there = F.lit(True) if here is None else F.coalesce(F.col(here), F.lit(False))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), there.alias("here"))
    own = own.withColumn("kind", kind_of(F.col("role"), F.col("text"))).withColumn("h", F.xxhash64("text"))
    # Rows that are equal in all of this may lie in any order: their own number lets a range border fall between them.
    own = own.withColumn("copy", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "h", "text", "copy"]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = own.repartitionByRange(parts, "conv_id", "turn", "role", "h", "copy").sortWithinPartitions(*order)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {id_type}, {PIECE}, {MEASURES}, {TURNS}")
    with small_batches(spark):
        got = stored(dealt.drop("h", "copy").mapInArrow(lambda b: within_ranges(b, schema, texts), schema))
    pieces = got.filter("part is not null").select("conv_id", *(f.name for f in T.StructType.fromDDL(PIECE)), "roles", "texts")
    kinds, done = across_ranges(pieces)
    stream = done.select("conv_id", F.lit(0).alias("what"), "cost", "letters")
    stream = stream.unionByName(kinds.withColumn("what", F.lit(1)), allowMissingColumns=True)
    stream = stream.unionByName(pieces.drop("kinds", "firsts").withColumn("what", F.lit(2)), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").asc_nulls_first(), "piece", "what")
    wide = T.StructType.fromDDL(f"conv_id {id_type}, n long, {MEASURES}, {TURNS}")
    long = stream.mapInArrow(lambda b: joined_pieces(b, wide, texts), wide)
    short = got.filter("part is null")
    if not texts:
        names = ["conv_id", *(f.name for f in T.StructType.fromDDL(MEASURES))]
        return short.select(*names).unionByName(long.select(*names))
    turns = short.select("conv_id", F.lit(0).cast("long").alias("before"), "roles", "texts")
    turns = turns.unionByName(long.filter("n > 0").select("conv_id", (F.col("n") - F.size("roles")).alias("before"), "roles", "texts"))
    turns = turns.select("conv_id", "before", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "t"))
    return turns.select("conv_id", (F.col("before") + F.col("i") + 1).alias("place"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here: damage by crc32 of ``conv_id:turn`` modulo 20, nulls as one space. A dropped row is kept with ``here`` false."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")))
    k = (F.crc32(key.cast("binary")) % 20).cast("int")
    text = F.coalesce("text", F.lit(" "))
    text = F.when(k == 1, F.lit("")).when(k == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(k == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" ")))
    got = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (k != 0).alias("here"), F.when(k == 3, 2).otherwise(1).alias("times"))
    return got.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def report(rows: DataFrame) -> DataFrame:
    """The damaged conversations' faults, cheapest edits and what they leave."""
    return repaired(damaged(rows), here="here")
