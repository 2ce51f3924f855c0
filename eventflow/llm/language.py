"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything but letters becomes a space, and each run of three and of four
bytes is hashed to a bucket. The text's vector is the mean of the buckets' embeddings, a linear layer
and a softmax give one probability a language. As both steps are linear, prediction sums one row of
class scores for each run. Trained by stochastic gradient descent on the driver on a bounded sample
(``MAX_TRAIN`` rows of at most ``MAX_TRAIN_CHARS`` characters). Probabilities are calibrated by a
temperature on a fifth of the sample that is not trained on, and a text is accepted only above the
confidence from which ``PRECISION`` of that fifth were right.

Defined results: null text, and text without any letter, is ``und`` with score 0 and not accepted;
ties go to the language first in code point order; with no labelled rows every text is ``und``; null
languages are not learned from; texts of any length are read whole, slice by slice; repeated rows get
equal results; an empty table gives an empty table; columns named like an output are replaced, all
others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, fresh

MAX_TRAIN = 3000
MAX_TRAIN_CHARS = 6000
BUCKETS, DIM, RUNS = 1 << 15, 16, (3, 4)
PRECISION = 0.99
SLICE = 1 << 16
NO_LANGUAGE = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Letters stay, with all bytes of other scripts; the rest is a space.
KEPT = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    embed: np.ndarray | None = None
    out: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    accept: float = 0.0
    scores: np.ndarray | None = None  # buckets x languages

    def close(self) -> Model:
        self.scores = np.asfortranarray(self.embed @ self.out, np.float32)
        return self


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers, slice by slice; runs of spaces alone give none."""
    data = KEPT[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + max(RUNS) - 1]
        count = min(SLICE, len(part) - min(RUNS) + 1)
        h = np.full(max(count, 0), 0x811C9DC5, np.uint32)
        letters = np.zeros(len(h), bool)
        for k in range(max(RUNS)):
            n = min(len(h), len(part) - k)
            h, letters, byte = h[:n], letters[:n], part[k : k + n]
            h = h ^ byte
            h *= np.uint32(0x01000193)
            letters = letters | (byte != 32)
            if k + 1 in RUNS:
                yield ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))[letters]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = np.concatenate([*subwords(text), np.zeros(0, np.uint32)])
    which, n = np.unique(found, return_counts=True)
    return which.astype(np.int64), (n / max(len(found), 1)).astype(np.float32)


def logits(model: Model, text: str) -> np.ndarray:
    total, n = np.zeros(len(model.languages)), 0
    for found in subwords(text):
        total += [column[found].sum(dtype=np.float64) for column in model.scores.T]
        n += len(found)
    return total / max(n, 1) + model.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    if not model.languages or text is None or not LETTER.search(text):
        return NO_LANGUAGE, 0.0, False
    p = softmax(logits(model, text) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best]), bool(p[best] >= model.accept)


def train(texts: list[str], languages: list[str], epochs: int = 8, rate: float = 0.5, seed: int = 0) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model()
    g = np.random.default_rng(seed)
    model = Model(names, g.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32))
    model.out += g.normal(0, 0.1, model.out.shape).astype(np.float32)
    docs = [counted(t) for t in texts]
    y = np.array([names.index(x) for x in languages])
    # Rare languages count as much as frequent ones.
    weight = np.minimum(len(y) / (len(names) * np.bincount(y, minlength=len(names))), 10.0)
    checked = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    rows = np.flatnonzero(~checked)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in g.permutation(rows):
            which, share = docs[i]
            if not len(which):
                continue
            h = share @ model.embed[which]
            d = softmax(h @ model.out + model.bias)
            d[y[i]] -= 1
            d *= weight[y[i]] * step
            back = model.out @ d
            model.out -= np.outer(h, d)
            model.bias -= 0.1 * d
            # The mean spreads a step over all buckets of the text; they move as far together.
            model.embed[which] -= np.outer(share * np.float32(len(which) ** 0.5), back)
    model.close()
    held = np.flatnonzero(checked) if checked.any() else rows
    z = np.array([(docs[i][1] @ model.scores[docs[i][0]] if len(docs[i][0]) else 0) + model.bias for i in held])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(z / model.temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    order = np.argsort(-sure)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    model.accept = float(sure[order[np.flatnonzero(good).max()]]) if good.any() else 1.0
    return model


def fit(docs: DataFrame, held_out: int | None = 1, folds: int = 3, n: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from the documents with a language outside the held-out fold."""
    rows = docs.select(key, F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col(key).isNotNull() & (F.length("_text") <= max_chars))
    if held_out is not None:
        rows = rows.where(fold(key, folds) != held_out)
    picked = sorted(tuple(r) for r in bounded_sample(rows, key, n).collect())
    return train([r[1] for r in picked], [r[2] for r in picked])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (calibrated) and accepted."""
    slim = Model(model.languages, None, None, model.bias, model.temperature, model.accept, model.scores)
    shared = docs.sparkSession.sparkContext.broadcast(slim)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in parts:
            yield pd.DataFrame([predict(known, t) for t in texts], columns=["lang_pred", "score", "accepted"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    found = fresh(docs, "judged")
    return docs.select(*kept, judged(text).alias(found)).select(*kept, f"{found}.*")
