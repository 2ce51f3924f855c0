"""Quality classifier: a small byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over every position of the whole text, and each filter's
strongest response is taken in overlapping chunks (each of two neighbouring blocks). A document is
the mean and the maximum of its chunks' responses; a logistic unit over them gives one probability.
Texts of any length are read in slices of bounded size, of which only the blocks' maxima are kept.

The network is trained on the driver by Adam on a bounded sample of labelled documents
(``MAX_TRAIN`` rows of at most ``MAX_TRAIN_CHARS`` characters; longer ones are not trained on). Both
classes weigh the same in training, and the threshold applies to that probability as it is.

Defined results: null and empty text are one block of padding and get a score like any other;
repeated rows get equal scores; labels other than 0 and 1 and null labels are not learned from; with
no labelled rows of one of the classes the score is the share of the other; columns named like an
output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, give_back, takes_over

MAX_TRAIN = 2400
MAX_TRAIN_CHARS = 6000
DIM, WIDTH, FILTERS, BLOCK = 6, 6, 16, 128
SLICE = BLOCK * 512
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    conv: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float
    prior: float = 0.0


def new_network(seed: int = 0) -> Network:
    g = np.random.default_rng(seed)
    f = np.float32
    return Network(g.normal(0, 0.5, (256, DIM)).astype(f), g.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(f), np.zeros(FILTERS, f), np.zeros(2 * FILTERS, f), 0.0)


def windows(net: Network, data: np.ndarray) -> np.ndarray:
    """Embedded neighbourhoods of every position that has WIDTH bytes from it on."""
    e = net.embed[data]
    n = len(data) - WIDTH + 1
    return np.concatenate([e[k : k + n] for k in range(WIDTH)], axis=1)


def block_maxima(net: Network, text: bytes) -> np.ndarray:
    """blocks x FILTERS. The end is padded with zero bytes to a whole block."""
    blocks = max(1, -(-len(text) // BLOCK))
    data = np.zeros(blocks * BLOCK + WIDTH - 1, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    parts = []
    for at in range(0, blocks * BLOCK, SLICE):
        piece = data[at : min(at + SLICE, blocks * BLOCK) + WIDTH - 1]
        r = windows(net, piece) @ net.conv
        parts.append(r.reshape(-1, BLOCK, FILTERS).max(axis=1))
    return np.maximum(np.concatenate(parts) + net.bias, 0)


def features(maxima: np.ndarray) -> np.ndarray:
    """Chunks overlap by half: each is two neighbouring blocks."""
    chunks = np.maximum(maxima[:-1], maxima[1:]) if len(maxima) > 1 else maxima
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])


def logit(net: Network, text: str | None) -> float:
    return float(features(block_maxima(net, (text or "").encode("utf-8", "replace"))) @ net.out) + net.out_bias + net.prior


def probability(net: Network, text: str | None) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit(net, text), -40, 40))))


def train(texts: list[str], labels: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam on the balanced log loss. The gradient of a maximum goes to the position it came from."""
    net, g = new_network(seed), np.random.default_rng(seed)
    data = [np.frombuffer((t + "\0" * (WIDTH - 1)).encode("utf-8", "replace") if t else bytes(WIDTH), np.uint8) for t in texts]
    y = np.array(labels, np.float32)
    good = float(y.mean()) if len(y) else 0.5
    if not 0 < good < 1:
        net.prior = 40.0 * (2 * good - 1) if len(y) else 0.0
        return net
    weight = np.where(y > 0, 0.5 / good, 0.5 / (1 - good))
    params = [net.embed, net.conv, net.bias, net.out]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    mb = vb = 0.0
    step = 0
    for epoch in range(epochs):
        order = g.permutation(len(data))
        now = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            grads = [np.zeros_like(p) for p in params]
            gb = 0.0
            for i in picked:
                gb += _backward(net, data[i], y[i], float(weight[i]) / len(picked), grads)
            step += 1
            for p, grad, (m, v) in zip(params, grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            mb += 0.1 * (gb - mb)
            vb += 0.001 * (gb * gb - vb)
            net.out_bias -= now * (mb / (1 - 0.9**step)) / ((vb / (1 - 0.999**step)) ** 0.5 + 1e-8)
    return net


def _backward(net: Network, data: np.ndarray, y: float, weight: float, grads: list[np.ndarray]) -> float:
    x = windows(net, data)
    r = x @ net.conv
    starts = np.arange(0, len(r), BLOCK)
    if len(r) % BLOCK:
        r = np.concatenate([r, np.full((len(starts) * BLOCK - len(r), FILTERS), -1e9, r.dtype)])
    r = r.reshape(len(starts), BLOCK, FILTERS)
    arg = r.argmax(axis=1) + starts[:, None]
    top = np.take_along_axis(r, (arg - starts[:, None])[:, None, :], 1)[:, 0] + net.bias
    act = np.maximum(top, 0)
    chunks = np.maximum(act[:-1], act[1:]) if len(act) > 1 else act
    feats = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
    z = float(feats @ net.out) + net.out_bias
    d = weight * (1 / (1 + np.exp(-z)) - y)
    grads[3] += d * feats
    dchunks = np.broadcast_to(d * net.out[:FILTERS] / len(chunks), chunks.shape).copy()
    cols = np.arange(FILTERS)
    dchunks[chunks.argmax(axis=0), cols] += d * net.out[FILTERS:]
    dact = np.zeros_like(act)
    if len(act) > 1:
        left = act[:-1] >= act[1:]
        dact[:-1] += dchunks * left
        dact[1:] += dchunks * ~left
    else:
        dact += dchunks
    dact *= top > 0
    grads[2] += dact.sum(axis=0)
    at, f = np.nonzero(dact)
    if len(at):
        pos, dv = arg[at, f], dact[at, f].astype(np.float32)
        np.add.at(grads[1].T, f, x[pos] * dv[:, None])
        dx = (net.conv.T[f] * dv[:, None]).reshape(-1, WIDTH, DIM)
        np.add.at(grads[0], data[pos[:, None] + np.arange(WIDTH)], dx)
    return d


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", held_out: int | None = 0, folds: int = 5, n: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """(text, label) of a bounded sample of labelled documents outside the held-out fold."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("_label"))
    if held_out is not None:
        marked = marked.where(fold(key, folds) != held_out)
    marked = bounded_sample(marked.groupBy(key).agg(F.max("_label").alias("_label"), F.min("_label").alias("_least")).where("_label = _least").drop("_least"), key, n)
    texts = docs.select(key, F.col(text).alias("_text")).where(F.length("_text") <= max_chars)
    # The sample is bounded by n, so that it can be sent to every task.
    return texts.join(F.broadcast(marked), key).select(key, "_text", "_label")


def fit(docs: DataFrame, labels: DataFrame, **options) -> Network:
    rows = sorted((r[0], r[1], r[2]) for r in sample(docs, labels, **options).collect())
    return train([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold, else 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        takes_over("quality")
        model = shared.value
        for texts in parts:
            yield pd.Series([probability(model, t) for t in texts], dtype="float64")
        give_back()

    return docs.drop("score", "predicted").withColumn("score", scored(text)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
