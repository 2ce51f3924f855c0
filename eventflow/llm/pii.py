"""Personal data: exact patterns, and a linear-chain conditional random field for what they miss.

Patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers.
The random field labels words as other, email, ip, card or phone from their shapes: digits, letters
and marks with run lengths, those of the words beside them, checks (Luhn, octets) over neighbouring
digit groups. It is trained from a small labelled table, generated below, by
gradient ascent on the conditional likelihood, and decoded by Viterbi in numpy over batches of word
windows. Spans it finds that touch no pattern span are added; pattern spans always stay.

Words without digits, ``@`` or a written-out "at" whose neighbours are such words too are "other" on
every best path: ``plain_is_other`` proves it for the trained weights. So only windows around the
remaining words are decoded, with "other" on both sides, and the result is that of decoding the
whole text. Should the proof fail for some weights, whole texts are decoded.

Spans are kind:start:end in code points, end exclusive. Defined results: null and empty text have no
spans; repeated rows get equal results; an empty table gives an empty table; columns named like an
output are replaced. Matching takes time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
K = len(LABELS)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT = re.compile(r"[(\[{](?:at|dot)[)\]}]", re.I)
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost, longest local part before each ``@``; each character is looked at a fixed number of
    times."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            yield "email", at - local, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """Pattern spans by kind as listed, then by start."""
    found = list(_emails(text))
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# --- word shapes


def shape(word: str) -> str:
    """Digits with their run's length, letters as one sign, marks as they are; long marks are cut."""
    core = word.strip(".,;:!?\"'#*$%&|<>") or word
    if not any(c.isdigit() or c == "@" for c in core):
        m = AT.fullmatch(core)
        return f"written {core[1:-1].lower()}" if m else "plain"
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", core[:80]):
        run = m[0]
        out.append(f"9{len(run)}" if run[0] in "0123456789" else "a" if run[0].isalpha() else run)
    text = "".join(out)
    return text if len(out) <= 12 and len(core) <= 80 else "long"


def coarse(s: str) -> str:
    """Run lengths in classes."""
    return re.sub(r"9(\d+)", lambda m: "9" + next(c for top, c in ((1, "a"), (2, "b"), (3, "c"), (4, "d"), (7, "e"), (12, "f"), (19, "g"), (10**9, "h")) if int(m[1]) <= top), s) if "9" in s else s


NUMERIC = re.compile(r"[+(]*[0-9][0-9().+/-]*[.,;:!?\"'#*$%&|<>]*")


def features(words: list[str]) -> list[list[str]]:
    """Of every word of a window."""
    shapes = [shape(w) for w in words]
    loose = [coarse(s) for s in shapes]
    groups = [""] * len(words)
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and NUMERIC.fullmatch(words[j]):
            j += 1
        if j > i:
            d = _digits("".join(words[i:j]))
            n = len(d)
            kind = "card" if 13 <= n <= 19 and luhn(d) else "phone" if 9 <= n <= 15 else "few" if n < 9 else "many"
            lead = "+" if words[i].startswith("+") else "(" if words[i].startswith("(") else ""
            groups[i:j] = [f"{kind}{lead} {'one' if j == i + 1 else 'more'}"] * (j - i)
        i = max(j, i + 1)
    rows = []
    for i, (s, c) in enumerate(zip(shapes, loose, strict=True)):
        octets = "octets" if IP.fullmatch(words[i].strip(".,;:!?\"'#*$%&|()[]<>")) and all(int(x[-6:]) <= 255 for x in _octets(words[i])) else ""
        row = ["bias", f"s {s}", f"c {c}", f"g {groups[i]}", f"o {octets}"]
        row += [f"p {loose[i - 1]}" if i else "p plain", f"n {loose[i + 1]}" if i + 1 < len(words) else "n plain"]
        rows.append(row)
    return rows


def _octets(word: str) -> list[str]:
    return re.findall(r"[0-9]+", word)


# --- the random field


@dataclass
class Field:
    at: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, K)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((K, K)))

    def emissions(self, words: list[str]) -> np.ndarray:
        e = np.zeros((len(words), K))
        for i, row in enumerate(features(words)):
            e[i] = self.weights[[self.at[f] for f in row if f in self.at]].sum(axis=0)
        return e


def viterbi(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Best label sequences of many windows at once; "other" stands before and after each."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(emissions)
    order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
    for lo in range(0, len(order), 1024):
        part = order[lo : lo + 1024]
        top = max(len(emissions[i]) for i in part)
        e = np.zeros((len(part), top, K))
        lengths = np.array([len(emissions[i]) for i in part])
        for r, i in enumerate(part):
            e[r, : lengths[r]] = emissions[i]
        best = e[:, 0] + moves[0]
        back = np.zeros((len(part), top, K), np.int8)
        for t in range(1, top):
            way = best[:, :, None] + moves[None]
            back[:, t] = way.argmax(axis=1)
            new = way.max(axis=1) + e[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        label = (best + moves[:, 0]).argmax(axis=1)
        labels = np.zeros((len(part), top), int)
        for t in range(top - 1, -1, -1):
            inside = t < lengths
            labels[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[np.arange(len(part)), t, label], label)
        for r, i in enumerate(part):
            out[i] = labels[r, : lengths[r]]
    return out


def train(table: list[list[tuple[str, str]]] | None = None, steps: int = 250, rate: float = 0.1, decay: float = 3e-5) -> Field:
    """Full-batch Adam on the conditional log likelihood; ``table`` has sentences of (word, label)."""
    table = labelled_table() if table is None else table
    model = Field()
    rows = [features([w for w, _ in sentence]) for sentence in table]
    for f in (f for s in rows for r in s for f in r):
        model.at.setdefault(f, len(model.at))
    n, top = len(table), max(map(len, table))
    x = np.zeros((n, top, len(model.at)), np.float32)
    y = np.zeros((n, top), int)
    mask = np.zeros((n, top), bool)
    for i, (sentence, feats) in enumerate(zip(table, rows, strict=True)):
        for t, r in enumerate(feats):
            x[i, t, [model.at[f] for f in r]] = 1
        y[i, : len(sentence)] = [LABELS.index(label) for _, label in sentence]
        mask[i, : len(sentence)] = True
    flat = x.reshape(n * top, -1)
    lengths = mask.sum(axis=1)
    w, m = np.zeros((len(model.at), K)), np.zeros((K, K))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
    gold_moves = np.zeros((K, K))
    ends = y[np.arange(n), lengths - 1]
    np.add.at(gold_moves, (0, y[:, 0]), 1)
    np.add.at(gold_moves, (ends, 0), 1)
    inner = mask[:, 1:]
    np.add.at(gold_moves, (y[:, :-1][inner], y[:, 1:][inner]), 1)
    for step in range(1, steps + 1):
        e = (flat @ w.astype(np.float32)).reshape(n, top, K).astype(float)
        alpha = np.zeros((n, top, K))
        beta = np.zeros((n, top, K))
        alpha[:, 0] = e[:, 0] + m[0]
        for t in range(1, top):
            a = _lse(alpha[:, t - 1, :, None] + m[None], 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        z = _lse(alpha[:, -1] + m[:, 0], 1)
        beta[:, -1] = m[:, 0]
        for t in range(top - 2, -1, -1):
            b = _lse(m[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], b, m[:, 0])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        delta = -p
        delta[mask] += np.eye(K)[y[mask]]
        gw = (flat.T @ delta.reshape(n * top, K).astype(np.float32)).astype(float)
        gm = gold_moves.copy()
        gm[0] -= p[:, 0].sum(axis=0)
        gm[:, 0] -= p[np.arange(n), lengths - 1].sum(axis=0)
        pair = np.exp(alpha[:, :-1, :, None] + m + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        gm -= (pair * inner[..., None, None]).sum(axis=(0, 1))
        for v, g, at in ((w, gw / n - decay * w, 0), (m, gm / n - 100 * decay * m, 2)):
            state[at] += 0.1 * (g - state[at])
            state[at + 1] += 0.001 * (g * g - state[at + 1])
            v += rate * (state[at] / (1 - 0.9**step)) / (np.sqrt(state[at + 1] / (1 - 0.999**step)) + 1e-8)
    model.weights, model.moves = w, m
    return model


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def plain_is_other(model: Field) -> bool:
    """Whether relabelling any one plain word between plain words as other never lowers a path."""
    m = model.moves
    e = model.emissions(["w", "w", "w"])[1]
    # Least gain over all labels before and after (the ends count as other).
    return all(e[0] - e[k] + (m[:, 0] - m[:, k]).min() + (m[0] - m[k]).min() >= 0 for k in range(1, K))


def labelled_table(seed: int = 5, n: int = 600) -> list[list[tuple[str, str]]]:
    """Small labelled table: sentences of plain words with one item of personal data, or with
    something that only looks like it."""
    g = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, g.integers(0, 10, k)))
    word = lambda: "".join(g.choice(list("abcdefghinorstu"), g.integers(2, 9)))

    def card(ok: bool = True) -> str:
        while True:
            c = str(g.integers(1, 10)) + d(15)
            if luhn(c) == ok:
                return c

    octet = lambda: str(g.integers(0, 256))
    four = lambda c, s: s.join(c[i : i + 4] for i in range(0, 16, 4))
    makers = [
        ("email", lambda: f"{word()}.{d(2)}@{word()}.example.com"),
        ("email", lambda: f"{word()}@{word()}.org"),
        ("email", lambda: f"{word()} (at) {word()} (dot) com"),
        ("email", lambda: f"{word()} [at] {word()}.com"),
        ("ip", lambda: ".".join(octet() for _ in range(4))),
        ("card", card),
        ("card", lambda: four(card(), " ")),
        ("card", lambda: four(card(), "-")),
        ("phone", lambda: f"+1 ({d(3)}) 555-{d(4)}"),
        ("phone", lambda: f"({d(3)}) 555-{d(4)}"),
        ("phone", lambda: f"{d(3)}-555-{d(4)}"),
        ("phone", lambda: f"+49 {d(3)} {d(7)}"),
        ("phone", lambda: f"+{d(11)}"),
        ("other", lambda: card(False)),
        ("other", lambda: four(card(False), " ")),
        ("other", lambda: d(int(g.integers(1, 9)))),
        ("other", lambda: d(int(g.integers(9, 13)))),
        ("other", lambda: d(int(g.integers(20, 40)))),
        ("other", lambda: f"{d(1)}.{d(1)}."),
        ("other", lambda: f"Version {d(1)}.{d(1)}.{d(1)}"),
        ("other", lambda: f"20{d(2)}-0{g.integers(1, 10)}-1{d(1)}"),
        ("other", lambda: f"1{d(1)}:{d(2)}"),
        ("other", lambda: f"{d(2)},{d(3)},{d(3)}"),
        ("other", lambda: f"{d(1)}.{d(2)}.{d(1)}.{300 + int(d(2))}"),
        ("other", lambda: f'token = "{"".join(g.choice(list("0123456789abcdef"), 40))}"'),
        ("other", lambda: f"{word()}{d(2)}"),
        ("other", lambda: f"@{word()}"),
        ("other", lambda: f"{d(3)} {d(2)} {d(3)}"),
        ("other", lambda: f"({d(1)})"),
        ("other", lambda: f"{d(2)}%"),
    ]
    out = []
    marks = ["", "", "", "", ".", ",", "###", "***", "!!"]
    for i in range(n):
        label, make = makers[i % len(makers)]
        before = [word().capitalize() if g.random() < 0.2 else word() for _ in range(g.integers(0, 6))]
        item = make().split(" ")
        item[-1] += str(g.choice(marks))
        after = [word() + str(g.choice(["", "", "."])) for _ in range(g.integers(0, 6))]
        out.append([(w, "other") for w in before] + [(w, label) for w in item] + [(w, "other") for w in after])
    return out


# --- texts


def windows_of(text: str, whole: bool = False) -> list[tuple[list[str], list[int]]]:
    """(words, their starts) of the stretches that must be decoded."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    hot = ((cps >= 48) & (cps <= 57)) | (cps == 64)
    written = [m.start() for m in AT.finditer(text)] if "at" in text.lower() and re.search(r"[(\[{]", text) else []
    if not whole and not written and not hot.any():
        return []
    word = (cps != 32) & ((cps < 9) | (cps > 13))
    if not word.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    at = np.unique(np.searchsorted(starts, np.concatenate([np.flatnonzero(hot), np.array(written, int)]), "right") - 1)
    spans = []
    if whole:
        spans = [(0, len(starts))]
    else:
        lo, hi = np.maximum(at - 1, 0), np.minimum(at + 2, len(starts))
        first = np.concatenate([[True], lo[1:] > hi[:-1]])
        spans = list(zip(lo[first].tolist(), hi[np.concatenate([first[1:], [True]])].tolist(), strict=True))
    return [([text[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], starts[a:b].tolist()) for a, b in spans]


def _trim(text: str, kind: str, start: int, end: int) -> Span | None:
    opening = "+(" if kind == "phone" else "(" if kind == "email" else ""
    while start < end and not (text[start].isalnum() or text[start] in opening):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    return (kind, start, end) if start < end else None


def find(texts: list[str], model: Field, whole: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text; one Viterbi run for the batch."""
    owners, windows = [], []
    for i, text in enumerate(texts):
        for w in windows_of(text, whole):
            owners.append(i)
            windows.append(w)
    labels = viterbi([model.emissions(w) for w, _ in windows], model.moves)
    added: dict[int, list[Span]] = {}
    for i, (words, starts), path in zip(owners, windows, labels, strict=True):
        t = 0
        while t < len(words):
            u = t + 1
            while u < len(words) and path[u] == path[t]:
                u += 1
            if path[t]:
                span = _trim(texts[i], LABELS[path[t]], starts[t], starts[u - 1] + len(words[u - 1]))
                if span:
                    added.setdefault(i, []).append(span)
            t = u
    out = []
    for i, text in enumerate(texts):
        base = base_spans(text) if re.search("[0-9@]", text) else []
        taken = sorted((s, e) for _, s, e in base)
        free = [x for x in added.get(i, ()) if not _touches(taken, x[1], x[2])]
        every = sorted(base + free, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if free else base
        out.append((base, every))
    return out


def _touches(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in taken)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, model: Field | None = None, text: str = "text") -> DataFrame:
    """Adds the counts of pattern spans by kind, base_sha256 (of their list), spans (all) and n_added."""
    model = model or train()
    whole = not plain_is_other(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = ", ".join([*(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_added long"])

    @F.pandas_udf(schema)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for column in parts:
            rows = []
            texts = ["" if t is None else t for t in column]
            for lo in range(0, len(texts), 256):
                for base, every in find(texts[lo : lo + 256], known, whole):
                    rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base)))
            yield pd.DataFrame(rows, columns=names)

    kept = [c for c in docs.columns if c not in names]
    return docs.select(*kept, found(text).alias("_found")).select(*kept, "_found.*")
