"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text into vocabulary pieces is found from left to right with a
window of the longest piece's length: each boundary extends its best path by every piece that
starts there, and ids are committed as soon as every surviving path runs through one boundary.
Pieces whose inner characters never hold a word mark make every word start such a boundary, so
that the ids committed between two of them can be remembered, in a bounded table.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, ship, spans, trim

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments whose ids a process remembers, twice: a full table becomes the older one. Some 170 bytes each.
REMEMBERED = 160_000
#: Segments longer than this aren't remembered.
LONGEST = 64
#: Characters of text that are segmented at a time.
AT_ONCE = 1 << 18
NEVER = -(1 << 60)
LITERAL = -1
#: Scores are whole numbers, so that sums don't depend on where they start.
SCALE = 1 << 24


class Vocabulary:
    """Pieces with log probabilities, a byte piece for each of 256 bytes, and the bound of the window.

    The model file states merge ranks; piece r of the ranked ones gets -ln(r + 2) as a scaled whole number, and each byte
    of a character outside the vocabulary the worst of those, less 1.
    """

    def __init__(self, pieces: list[str], scores: list[int | None], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.ids = {}
        self.score = {}
        for i, piece in enumerate(pieces):
            if scores[i] is not None:
                self.ids[piece] = i
                self.score[piece] = scores[i]
        self.width = max(map(len, self.ids), default=1)
        self.byte_score = min(self.score.values(), default=0) - SCALE
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # ids as 32-bit words
        self.decoded: list[str] = [p.replace(MARK, " ") for p in pieces]
        #: A trie of the pieces: for each next letter the score and id (None where no piece ends) and what follows, if anything.
        self.trie: dict[str, tuple] = {}
        for piece in sorted(self.ids):
            node = self.trie
            for ch in piece[:-1]:
                score, i, after = node.get(ch, (None, None, None))
                node[ch] = score, i, {} if after is None else after
                node = node[ch][2]
            node[piece[-1]] = self.score[piece], self.ids[piece], None

    @classmethod
    def load(cls, data: bytes) -> Vocabulary:
        """From the bytes of a model file."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        ranked = sorted((-model.get_score(i), i) for i in range(n) if not special[i])
        scores: list[int | None] = [None] * n
        for r, (_, i) in enumerate(ranked):
            scores[i] = -round(math.log(r + 2) * SCALE)
        return cls(pieces, scores, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def literal(self, ch: str) -> tuple[int, tuple[int, ...]]:
        data = (MARK if ch == ESCAPE else ch).encode("utf-8", "surrogatepass")
        return self.byte_score * len(data), tuple(self.byte_ids[b] for b in data)

    def stream(self, text: str) -> Iterator[list[int]]:
        """Runs of ids as they are committed; ``text`` has marks for blanks.

        At equal scores the longest last piece wins. A mark that the text itself holds has been
        escaped by ``escape`` and is spelt in bytes. Only boundaries since the last commit are held.
        """
        trie, width, n = self.trie, self.width, len(text)
        base, room = 0, min(n, 4 * width) + 1  # the last committed boundary; how many boundaries the lists have room for
        best, back, ids = [NEVER] * room, [0] * room, [0] * room  # from base on: score, start and id of the last piece
        best[0] = 0
        due = 2 * width
        for start in range(n):
            if start == due:  # paths that go on end within the window; do they all come through one boundary?
                due += width
                live = {base + j for j in range(start - base, len(best)) if best[j] > NEVER}
                while len(live) > 1:
                    last = max(live)
                    live.remove(last)
                    live.add(back[last - base])
                (head,) = live
                if head > base:
                    yield self.path(text, base, head, back, ids)
                    del best[: head - base], back[: head - base], ids[: head - base]
                    base = head
                room = 3 * width + 1 - (len(best) - (start - base))
                best += [NEVER] * room
                back += [0] * room
                ids += [0] * room
            end = start - base
            own, node, after = best[end], trie, end + 1
            for ch in text[start : start + width]:
                hit = node.get(ch)
                if hit is None:
                    break
                end += 1
                gain, i, node = hit
                if gain is not None:
                    gain += own
                    if gain > best[end]:
                        best[end], back[end], ids[end] = gain, start, i
                if node is None:
                    break
            if text[start] not in self.score:
                cost = own + self.literal(text[start])[0]
                if cost > best[after]:
                    best[after], back[after], ids[after] = cost, start, LITERAL
        yield self.path(text, base, n, back, ids)

    def path(self, text: str, base: int, end: int, back: list[int], ids: list[int]) -> list[int]:
        """Ids between two boundaries."""
        out: list[int] = []
        at = end
        while at > base:
            i, start = ids[at - base], back[at - base]
            if i == LITERAL:
                out += reversed(self.literal(text[start])[1])
            else:
                out.append(i)
            at = start
        out.reverse()
        return out

    def spelt(self, part: str) -> bytes:
        """The ids of a part without its first mark."""
        return array("i", chain.from_iterable(self.stream(MARK + part.replace(" ", MARK)))).tobytes()

    def remember(self, parts: set[str]) -> None:
        """See that the ids of these parts (without their first mark) are in memory."""
        if len(self.memory) + len(parts) > REMEMBERED:  # what wasn't seen since the last time is forgotten
            self.older, self.memory = self.memory, {}
        memory, older = self.memory, self.older
        for part in parts:
            if part not in memory:
                memory[part] = older.get(part) or self.spelt(part)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (32-bit) of whole texts, with one blank set before each; an empty text has none."""
        if not self.splits:
            for text in texts:
                yield np.array([i for run in self.stream(MARK + escape(text).replace(" ", MARK)) for i in run] if text else [], "<i4")
            return
        for first, last in spans(list(map(len, texts)), AT_ONCE):
            parts = [_segments.findall(" " + escape(t)) if t else [] for t in texts[first:last]]
            self.remember({p for p in chain.from_iterable(parts) if len(p) <= LONGEST})
            known = self.memory.get
            for own in parts:
                yield np.frombuffer(b"".join([known(p) or self.spelt(p) for p in own]), "<i4")

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text again, byte for byte: pieces joined, runs of byte pieces as UTF-8, the first blank dropped."""
        shown, byte_of = self.decoded, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            return "".join([shown[i] for i in ids])[1:]
        data = b"".join([bytes((byte_of[i],)) if i in byte_of else shown[i].encode() for i in ids])
        return data.decode("utf-8", "surrogatepass")[1:]


ESCAPE = "\U0010fffe"  # a non-character that stands for a literal mark
#: From a blank up to the next word's: what follows the first blank.
_segments = re.compile(" ( *[^ ]*)")


def escape(text: str) -> str:
    return text.replace(MARK, ESCAPE) if MARK in text else text


def model_bytes(path: str) -> bytes:
    """The model file, read by the driver."""
    return Path(path).read_bytes()


def vocabulary(data: bytes) -> Vocabulary:
    return only("pieces", data, Vocabulary.load)


def encoded(docs: DataFrame, path: str = MODEL, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text; null text gives null, empty text no ids."""
    ship(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(model_bytes(path))  # half a MB

    @F.arrow_udf("array<int>")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(data.value)
        for part in parts:
            made = list(vocab.encode_all(["" if t is None else t for t in part.to_pylist()]))
            ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *made])), mask=part.is_null() if part.null_count else None)
        trim()

    return docs.withColumn(out, ids(F.col(text)))


def decoded(docs: DataFrame, path: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of every id list; null gives null."""
    ship(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    @F.arrow_udf("string")
    def texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(data.value)
        for part in parts:
            yield pa.array([None if x is None else vocab.decode(x) for x in part.to_pylist()], pa.string())

    return docs.withColumn(out, texts(F.col(ids)))


def digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as 32-bit words), decoded_sha256 and round_trip for each row.

    Null text counts as empty. ``round_trip`` tells whether decoding gave the text again.
    """
    ship(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    @F.pandas_udf("n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(data.value)
        for part in parts:
            rows = []
            texts = part.fillna("").tolist()
            for text, ids in zip(texts, vocab.encode_all(texts), strict=True):
                again = vocab.decode(ids.tolist())
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(again.encode("utf-8", "surrogatepass")).hexdigest(), again == text))
            yield pd.DataFrame(rows, columns=["n_ids", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", both(F.col("text")).alias("x")).select("doc_id", "x.*")
