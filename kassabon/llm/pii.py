"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The tagger, trained in numpy from labelled spans, adds spans
that they miss. It reads overlapping windows around every character that personal data can't do
without (a digit or @). What overlapping windows say of a character is averaged, and one best path
through the averages of a whole stretch of windows gives its labels, so that no span is cut where
windows meet. A span counts if it has the digits and the rough shape of its kind (ADDED).
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, spans, trim

KINDS = ("email", "ip", "card", "phone")
#: Windows: a core of so many characters, with a margin on either side.
CORE, MARGIN = 64, 24
WINDOW = CORE + 2 * MARGIN
#: Windows that are read, stretches that are decoded and characters that these are padded to, and characters of text that are looked at, at a time.
BATCH, IN_STEP, PADDED, AT_ONCE = 2048, 256, 1 << 18, 1 << 20
HIDDEN, EMBED = 16, 12
STEPS, LEARNED_AT_ONCE, SEED = 260, 48, 5

# The patterns of the base spans.
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local_end = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_signs = re.compile(r"[0-9@]")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the run before it, not into the last match, then a domain."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        last = at + 1
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", last)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind: leftmost, not overlapping within a kind; matches that fail their test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not _signs.search(text):
        return out
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _phone.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out["phone"].append(m.span())
    return out


# ---------------------------------------------------------------- the tagger


def symbols(text: str) -> np.ndarray:
    """Small integers for characters: ASCII as itself, other letters as 1, the rest as 2."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x2000, 1, 2)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Weights of the network; labels are 0 for nothing and 1 + the kind's place."""

    LABELS = 1 + len(KINDS)

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.w = {"emb": n(128, EMBED), "out": n(2 * HIDDEN, self.LABELS), "out_b": np.zeros(self.LABELS, np.float32), "trans": np.zeros((self.LABELS, self.LABELS), np.float32)}
        for side in "fb":
            self.w |= {f"x{side}": n(EMBED, 4 * HIDDEN), f"h{side}": n(HIDDEN, 4 * HIDDEN), f"c{side}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1.0

    def run(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, rows, HIDDEN) of one direction over x (rows, time)."""
        w = self.w
        table = w["emb"] @ w[f"x{side}"] + w[f"c{side}"]
        rows, length = x.shape
        h = c = np.zeros((rows, HIDDEN), np.float32)
        out, saved = np.empty((length, rows, HIDDEN), np.float32), []
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            z = table[x[:, t]] + h @ w[f"h{side}"]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                saved.append((t, i, f, o, u, before, tc, h_before))
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, rows, labels)"""
        both = np.concatenate([self.run(x, "f", False)[0], self.run(x, "b", False)[0]], axis=2)
        return both @ self.w["out"] + self.w["out_b"]

    def decode(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """Labels of the best path through each stretch of emissions (time, labels), stretches of like length in step."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(stretches)
        trans = self.w["trans"]
        order = sorted((i for i, e in enumerate(stretches) if len(e)), key=lambda i: -len(stretches[i]))
        at = 0
        while at < len(order):
            own = order[at : at + max(1, min(IN_STEP, PADDED // len(stretches[order[at]])))]
            at += len(own)
            sizes = np.array([len(stretches[i]) for i in own])
            length = int(sizes[0])
            live = [int(np.searchsorted(-sizes, -t)) for t in range(length)]  # longer than t
            e = np.zeros((length, len(own), self.LABELS), np.float32)
            for r, i in enumerate(own):
                e[: sizes[r], r] = stretches[i]
            score, back = e[0].copy(), np.zeros((length, len(own), self.LABELS), np.int8)
            for t in range(1, length):
                through = score[: live[t], :, None] + trans[None]
                back[t, : live[t]] = through.argmax(1)
                score[: live[t]] = through.max(1) + e[t, : live[t]]
            label, path = score.argmax(1), np.zeros((len(own), length), np.int8)
            for t in range(length - 1, -1, -1):
                rows = np.arange(live[t])
                path[: live[t], t] = label[: live[t]]
                label[: live[t]] = back[t, rows, label[: live[t]]]
            for r, i in enumerate(own):
                out[i] = path[r, : sizes[r]]
        return out

    def best(self, x: np.ndarray) -> np.ndarray:
        """Labels (rows, time) of the best path of each row."""
        return np.stack(self.decode(list(self.emissions(x).transpose(1, 0, 2))))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of label rows y under the CRF."""
        w, (rows, length) = self.w, x.shape
        states, saved = zip(*(self.run(x, s, True) for s in "fb"), strict=True)
        both = np.concatenate(states, axis=2)
        e, trans = both @ w["out"] + w["out_b"], w["trans"]

        def soft(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))

        ahead = [e[0]]
        for t in range(1, length):
            ahead.append(soft(ahead[-1][:, :, None] + trans, 1) + e[t])
        behind = [np.zeros_like(e[0])]
        for t in range(length - 1, 0, -1):
            behind.append(soft(trans[None] + (e[t] + behind[-1])[:, None, :], 2))
        behind.reverse()
        total = soft(ahead[-1], 1)
        de = np.stack([np.exp(a + b - total[:, None]) for a, b in zip(ahead, behind, strict=True)])
        dtrans = np.zeros_like(trans)
        for t in range(1, length):
            pair = ahead[t - 1][:, :, None] + trans + (e[t] + behind[t])[:, None, :] - total[:, None, None]
            dtrans += np.exp(pair).sum(0)
            np.subtract.at(dtrans, (y[:, t - 1], y[:, t]), 1)
        r = np.arange(rows)
        for t in range(length):
            de[t, r, y[:, t]] -= 1
        de, dtrans = de / (rows * length), dtrans / (rows * length)
        g = {"trans": dtrans, "out": np.einsum("trh,trl->hl", both, de), "out_b": de.sum((0, 1)), "emb": np.zeros_like(w["emb"])}
        dboth = de @ w["out"].T
        for side, kept, part in zip("fb", saved, (dboth[:, :, :HIDDEN], dboth[:, :, HIDDEN:]), strict=True):
            dh = dc = np.zeros((rows, HIDDEN), np.float32)
            dw_h, dtable = np.zeros_like(w[f"h{side}"]), np.zeros((128, 4 * HIDDEN), np.float32)
            for t, i, f, o, u, before, tc, h_before in reversed(kept):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                dw_h += h_before.T @ dz
                np.add.at(dtable, x[:, t], dz)
                dh, dc = dz @ w[f"h{side}"].T, dc * f
            g[f"h{side}"], g[f"c{side}"] = dw_h, dtable.sum(0)
            g[f"x{side}"] = w["emb"].T @ dtable
            g["emb"] += dtable @ w[f"x{side}"].T
        return g


def labelled(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """An invented text with its labelled spans, in forms that the patterns know and forms that they miss."""
    letters = "abcdefghijklmnopqrstuvwxyzäéñßç"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    name = lambda: "".join(rng.choice(letters[:26]) for _ in range(rng.randint(2, 8)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def email() -> str:
        user = rng.choice(["{}", "{}.{}", "{}_{}", "{}.{}"]).format(name(), rng.choice([name(), digits(2)]))
        return user + rng.choice(["@", "@", " @ ", "(@)"]) + rng.choice([name(), "mail" + digits(1) + "." + name()]) + "." + rng.choice(["com", "org", "net", "de", "fr"])

    def ip() -> str:
        return rng.choice([".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        check = next(d for d in "0123456789" if luhn(body + d))
        number = body + check
        return rng.choice(["", " ", "-", "."]).join(number[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {digits(2)} {digits(7)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{digits(2)} {a} {b}{c}", f"tel {a} {b} {c}"[4:]])

    def harmless() -> str:
        return rng.choice([digits(rng.randint(1, 6)), digits(rng.randint(10, 14)), digits(16), f"{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}.{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"CC BY-NC {digits(1)}.0", 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', f"{digits(2)},{digits(2)} EUR", f"@{name()}", word() + "$$$", word() + "###"])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    text, spans = "", []
    for _ in range(rng.randint(10, 18)):
        draw = rng.random()
        if draw < 0.22:
            kind = rng.choice(KINDS)
            made = makers[kind]()
            spans.append((len(text), len(text) + len(made), kind))
            text += made
        else:
            text += harmless() if draw < 0.4 else word()
        text += rng.choice([" ", " ", " ", ", ", ". ", "\n", " | "])
    return text, spans


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], steps: int = STEPS, seed: int = SEED) -> Tagger:
    """Fit by Adam on windows of the examples; the same examples and seed give the same tagger."""
    xs, ys = [], []
    for text, spans in examples:
        x, y = symbols(text), np.zeros(len(text), np.int64)
        for a, b, kind in spans:
            y[a:b] = 1 + KINDS.index(kind)
        for start in range(0, max(1, len(text) - WINDOW + 1), CORE):
            piece = slice(start, start + WINDOW)
            if len(x[piece]) == WINDOW:
                xs.append(x[piece])
                ys.append(y[piece])
    tagger, rng = Tagger(seed), np.random.default_rng(seed)
    if not xs:
        return tagger
    x, y = np.stack(xs), np.stack(ys)
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    v = {k: np.zeros_like(a) for k, a in tagger.w.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), LEARNED_AT_ONCE)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in tagger.gradients(x[pick], y[pick]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            tagger.w[k] = (tagger.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


@functools.cache
def default_tagger() -> Tagger:
    rng = random.Random(SEED)
    return train([labelled(rng) for _ in range(1200)])


#: What an added span must hold to count: digits at least and at most, and a pattern.
ADDED = {"email": (0, 20, re.compile(r"\S+ ?\(?@\)? ?[\w-]+(?:\.[\w-]+)+")), "ip": (4, 12, re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}")), "card": (16, 19, re.compile(r"[0-9]{4}(?:[ .-]?[0-9]{4}){3}(?:[ .-]?[0-9]{1,3})?")), "phone": (9, 15, re.compile(r"\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,7}){1,4}|\+[0-9][ ().0-9-]+[0-9]"))}


def tagged_spans(texts: list[str], tagger: Tagger, within: list[dict[str, list[tuple[int, int]]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger adds to each text, none overlapping a base span or another added one."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    coded, windows = {}, []
    for n, text in enumerate(texts):
        at = [m.start() for m in _signs.finditer(text)]
        if not at:
            continue
        pos = np.array(at)
        cores = np.unique(np.concatenate([np.maximum(pos - MARGIN, 0) // CORE, np.minimum(pos + MARGIN, len(text) - 1) // CORE]))
        x = np.zeros(((len(text) - 1) // CORE + 1) * CORE + 2 * MARGIN, np.uint8)
        x[MARGIN : MARGIN + len(text)] = symbols(text)
        # sums of what windows say of each character, margins included, and how many do
        coded[n] = (x, np.zeros((len(x), tagger.LABELS), np.float32), np.zeros(len(x), np.float32))
        windows += [(n, int(c)) for c in cores]
    for i in range(0, len(windows), BATCH):
        part = windows[i : i + BATCH]
        e = tagger.emissions(np.stack([coded[n][0][c * CORE : c * CORE + WINDOW] for n, c in part]).astype(np.int64))
        for r, (n, c) in enumerate(part):
            coded[n][1][c * CORE : c * CORE + WINDOW] += e[:, r]
            coded[n][2][c * CORE : c * CORE + WINDOW] += 1
    stretches, where = [], []
    for n, (_, said, times) in coded.items():
        said, times = said[MARGIN : MARGIN + len(texts[n])], times[MARGIN : MARGIN + len(texts[n])]
        edges = np.flatnonzero(np.diff(times > 0, prepend=False, append=False))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            stretches.append(said[a:b] / times[a:b, None])
            where.append((n, a))
    labels_of = {n: np.zeros(len(texts[n]), np.int8) for n in coded}
    for (n, a), path in zip(where, tagger.decode(stretches), strict=True):
        labels_of[n][a : a + len(path)] = path
    for n, labels in labels_of.items():
        edges = np.flatnonzero(np.diff(labels, prepend=0, append=0))
        taken = sorted(s for spans in within[n].values() for s in spans)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if not labels[a]:
                continue
            kind = KINDS[labels[a] - 1]
            least, most, shape = ADDED[kind]
            m = shape.search(texts[n], max(0, a - 2), min(len(texts[n]), b + 2))
            if not m or m.end() - m.start() < 0.6 * (b - a) or any(s < m.end() and m.start() < e for s, e in taken):
                continue
            digits = re.sub(r"\D", "", m[0])
            around = texts[n][max(0, m.start() - 1) : m.start()] + texts[n][m.end() : m.end() + 1]
            if least <= len(digits) <= most and not any(ch.isalnum() for ch in around) and (kind != "card" or luhn(digits)) and (kind != "ip" or all(int(p) <= 255 for p in re.findall("[0-9]+", m[0]))):
                out[n].append((kind, m.start(), m.end()))
                taken.append(m.span())
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def found(texts: list[str], tagger: Tagger) -> Iterator[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """Base spans by kind and added spans of each text."""
    for first, last in spans(list(map(len, texts)), AT_ONCE):
        own = texts[first:last]
        base = [base_spans(t) for t in own]
        yield from zip(base, tagged_spans(own, tagger, base), strict=True)


def reported(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, spans, n_added for each row.

    Null text counts as empty: no spans and the hash of an empty string. Spans are in code points.
    """
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())  # a few thousand weights

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def report(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        for part in parts:
            rows = []
            for base, added in found(part.fillna("").tolist(), given.value):
                own = [(k, a, b) for k in KINDS for a, b in base[k]]
                sha = hashlib.sha256(joined(own).encode()).hexdigest()
                rows.append((*(len(base[k]) for k in KINDS), sha, joined(own + added), len(added)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
        trim()

    return docs.select("doc_id", report(F.col("text")).alias("x")).select("doc_id", "x.*")


def redacted(docs: DataFrame, tagger: Tagger | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; where spans overlap, one bracket
    with the kind of the first covers them all. Null text stays null, other columns as they are."""
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())

    @F.pandas_udf("string")
    def redact(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for part in parts:
            texts = part.fillna("").tolist()
            out = []
            for whole, (base, added) in zip(texts, found(texts, given.value), strict=True):
                pieces, last = [], 0
                for a, b, kind in sorted([(a, b, k) for k in KINDS for a, b in base[k]] + [(a, b, k) for k, a, b in added]):
                    if a >= last:
                        pieces += [whole[last:a], f"<{kind.upper()}>"]
                    last = max(last, b)
                out.append("".join(pieces) + whole[last:] if pieces else whole)
            yield pd.Series(out, dtype=object).where(part.notna().to_numpy(), None)
        trim()

    return docs.withColumn(text, redact(F.col(text)))
