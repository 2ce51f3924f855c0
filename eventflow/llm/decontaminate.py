"""Benchmark decontamination by latent semantic retrieval.

Words (letters and digits, A-Z lower-cased) are hashed to features. One pass over all documents, cut
into passages, gathers each feature's passage count and the product of the passage matrix's Gram
matrix with a random test matrix; from these the driver makes a rank-limited eigendecomposition of the
TF-IDF Gram matrix (Nystroem form of the randomised singular value decomposition), whose size does not
depend on the corpus. Passages and benchmark items are projected to the singular directions, each
scaled to unit variance.

A second pass slides over every document, for each benchmark length class with windows of that
length, and takes windows whose cosine with an item reaches ``COSINE`` as candidates, if enough of their
words are the item's at all. A window begins at every eighth word, so it holds up to 15 words that are not
the copy's, and the cosine of a short copy can be small; windows with as many of the item's words as the
item has are therefore candidates whatever their cosine, so that no verbatim copy is lost. A candidate
that shares enough words with the item, each counted as often as both have it (first by features, for all
candidates at once, then by words), counts if the longest common subsequence of the item's and the window's words covers ``OVERLAP`` of the
item. Of an item that carries a question and an answer (``answer_of``), an overlap below ``STRONG`` counts
only if ``ANSWER`` of the answer is covered too; other items have no answer (null). Word order is kept and
gaps are free, so paraphrases that change or insert words, and copies that lack a part, are found as well.

Defined results: null and empty texts have no hits; items that are null or shorter than ``MIN_WORDS``
words take no part; repeated items are reported each, repeated documents each; an item found several
times in a document is one row, its best window, ties to the first; texts of any length are searched
whole; empty tables give an empty table. ``clean`` hands on the columns of its input whatever they are
called; ``with_hits`` replaces a column that is called like its result, and ``contaminated`` names the
item ``item_id`` (``found_item_id`` if that is the documents' key).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, saved, takes_over

FEATURES, RANK, PASSAGE, BLOCK = 1 << 13, 64, 64, 8
COSINE, OVERLAP, STRONG, ANSWER, MIN_WORDS = 0.25, 0.6, 0.8, 0.5, 5
#: Marks of a last line that answers, and of a line before it that asks.
ANSWERS = re.compile(r"\s*(?:answer|a|solution|respuesta|réponse|antwort)\s*[:=)]", re.I)
ASKS = re.compile(r"[?？؟][\s\"'”»)\]]*$|^\s*(?:question|q|problem|pregunta|frage)\s*[:=)]", re.I)
#: Items that are broadcast at once (about 10 kB each); larger benchmarks are searched in parts.
ITEMS_AT_ONCE = 1000
#: Sums that one task adds up, or the driver.
SUMS_AT_ONCE = 8
#: Documents are taken together up to about so many characters; hashes and sums of longer ones go slice by slice.
CHARS_AT_ONCE = 200_000
BLOCKS_AT_ONCE = 1 << 11
WORDS_AT_ONCE = 1 << 15
HIT = "item_id long, lcs int, n_words int, overlap double, answer double, cosine double, start_word long, end_word long"
#: ASCII marks and control characters part words; other bytes stay.
PARTED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Hashes of words: a polynomial in an odd base over random numbers of their bytes, modulo 2^64.
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)


def clean_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower().translate(PARTED)


def words_of(text: str | None) -> list[bytes]:
    return clean_bytes(text).split()


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some documents as arrays: where each begins and ends in ``data``, its feature, how many
    words each document has, and the number of its first."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        byte = np.frombuffer(self.data, np.uint8)
        gap = np.concatenate([[True], byte == 32])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.begin, self.end = edge[::2], edge[1::2]
        bound = np.cumsum([len(t) + 1 for t in texts])
        last = np.searchsorted(self.begin, bound)
        self.count = np.diff(last, prepend=0)
        self.first = last - self.count
        self.feature = np.empty(len(self.begin), np.int64)
        for lo in range(0, len(self.begin), WORDS_AT_ONCE):
            begin, end = self.begin[lo : lo + WORDS_AT_ONCE], self.end[lo : lo + WORDS_AT_ONCE]
            self.feature[lo : lo + WORDS_AT_ONCE] = _hashed(byte[begin[0] : end[-1]], begin - begin[0], end - begin[0])

    def slice(self, document: int, lo: int, hi: int) -> list[bytes]:
        """Words lo to hi of a document."""
        at = self.first[document]
        return self.data[self.begin[at + lo] : self.end[at + hi - 1]].split()

    def laid_out(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(pieces x size features, pieces of each document). Each document fills whole pieces; what
        is left over holds FEATURES, the number of no feature."""
        pieces = -(-self.count // size)
        out = np.full(int(pieces.sum()) * size, FEATURES, np.int64)
        begin = (np.cumsum(pieces) - pieces) * size
        out[np.arange(len(self.feature)) + np.repeat(begin - self.first, self.count)] = self.feature
        return out.reshape(-1, size), pieces


_POWERS = [powers(BASE, 1), powers(pow(BASE, -1, 1 << 64), 1)]


def _hashed(byte: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A feature for each word, the same wherever the word stands."""
    power, inverse = _POWERS
    if len(power) < len(byte):
        power, inverse = powers(BASE, len(byte)), powers(pow(BASE, -1, 1 << 64), len(byte))
        if len(byte) <= 2 * CHARS_AT_ONCE:
            _POWERS[:] = power, inverse
    run = np.zeros(len(byte) + 1, np.uint64)
    np.cumsum(BYTES[byte] * power[: len(byte)], out=run[1:])
    h = (run[end] - run[begin]) * inverse[begin]
    h ^= h >> np.uint64(32)
    h *= MIX
    return (h >> np.uint64(51)).astype(np.int64)


def features_of(words: list[bytes]) -> np.ndarray:
    return Words([b" ".join(words)]).feature


def summed(rows: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Sum of the rows that each block names; slices bound the memory."""
    out = np.empty((len(blocks), rows.shape[1]), rows.dtype)
    for lo in range(0, len(blocks), BLOCKS_AT_ONCE):
        rows[blocks[lo : lo + BLOCKS_AT_ONCE]].sum(axis=1, out=out[lo : lo + BLOCKS_AT_ONCE])
    return out


def with_none(rows: np.ndarray) -> np.ndarray:
    """A row of zeros for no feature."""
    return np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])


def test_matrix(rank: int = RANK, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(FEATURES, rank)).astype(np.float32)


# --- first pass


class Statistics:
    """Sums over passages: how many there are, how many hold a feature, Gram matrix times tests."""

    def __init__(self) -> None:
        self.tests = with_none(test_matrix())
        self.n = 0
        self.df = np.zeros(FEATURES)
        self.gram = np.zeros((RANK, FEATURES))

    def add(self, words: Words) -> None:
        """Words of some documents; passages do not cross their ends."""
        passages, _ = words.laid_out(PASSAGE)
        for lo in range(0, len(passages), BLOCKS_AT_ONCE):
            self._add(passages[lo : lo + BLOCKS_AT_ONCE])

    def _add(self, passages: np.ndarray) -> None:
        y = np.concatenate([self.tests[p].sum(axis=1) for p in np.array_split(passages, -(-len(passages) // 64))]).astype(np.float64)
        flat = passages.ravel()
        for sums, column in zip(self.gram, y.T, strict=True):
            sums += np.bincount(flat, np.repeat(column, PASSAGE), FEATURES + 1)[:FEATURES]
        ordered = np.sort(passages.astype(np.int16), axis=1)
        new = np.concatenate([np.ones((len(ordered), 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
        self.df += np.bincount(ordered[new], minlength=FEATURES + 1)[:FEATURES]
        self.n += len(passages)

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.df, self.gram.ravel()]).tobytes()


def _chunks(texts: Iterable[str | None]) -> Iterator[Words]:
    """Documents' words, about CHARS_AT_ONCE characters together."""
    held, n = [], 0
    for t in texts:
        held.append(clean_bytes(t))
        n += len(held[-1])
        if n >= CHARS_AT_ONCE:
            yield Words(held)
            held, n = [], 0
    if held:
        yield Words(held)


def gather(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray, np.ndarray]:
    """(passages, passage counts of features, Gram matrix times tests) over all documents.

    Each task sends one sum of fixed size (4 MB). Sums are added up ``SUMS_AT_ONCE`` at a time, in rounds
    over tables, until so few are left; the driver receives these, however many tasks there were.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("decontaminate")
        sums = Statistics()
        for batch in batches:
            for chunk in _chunks(batch.column(0).to_pylist()):
                sums.add(chunk)
        if sums.n:
            yield _packed(sums.packed())
        give_back()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("decontaminate")
        total = _total(value.as_py() for batch in batches for value in batch.column(0))
        if total is not None:
            yield _packed(total.tobytes())
        give_back()

    sums = saved(docs.select(text).mapInArrow(task, "sums binary"), "passage-sums")
    while (n := sums.count()) > SUMS_AT_ONCE:
        sums = saved(sums.repartition(-(-n // SUMS_AT_ONCE)).mapInArrow(add_up, "sums binary"), "passage-sums")
    total = _total(r[0] for r in sums.collect())
    if total is None:
        return 0, np.zeros(FEATURES), np.zeros((FEATURES, RANK))
    return int(total[0]), total[1 : FEATURES + 1], total[FEATURES + 1 :].reshape(RANK, FEATURES).T


def _packed(sums: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sums], pa.binary())], names=["sums"])


def _total(sums: Iterable[bytes]) -> np.ndarray | None:
    total = None
    for part in sums:
        total = np.frombuffer(part).copy() if total is None else np.add(total, np.frombuffer(part), out=total)
    return total


@dataclass
class Space:
    """``project`` takes a feature to the latent space; ``values`` are the singular values."""

    project: np.ndarray
    values: np.ndarray


def decompose(n: int, df: np.ndarray, gram: np.ndarray) -> Space:
    """Singular values and directions of the passages' TF-IDF matrix A.

    With idf weights D and term counts T, A = T D. The gathered product is T'T R for the tests R; so
    D T'T R = A'A (D^-1 R) is the Gram matrix of A times the random tests D^-1 R.
    """
    idf = np.maximum(np.log((n + 1) / (df + 1)), 0.01)
    tests = test_matrix().astype(np.float64) / idf[:, None]
    y = gram * idf[:, None]
    shift = 1e-9 * max(np.linalg.norm(y), 1e-9)
    y = y + shift * tests
    core = tests.T @ y
    core = (core + core.T) / 2
    w, v = np.linalg.eigh(core)
    keep = w > max(w.max(), 1e-12) * 1e-10
    b = y @ (v[:, keep] / np.sqrt(w[keep]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    values = np.sqrt(np.maximum(s * s - shift, 0))
    keep = values > max(values.max(initial=0), 1e-12) * 1e-6
    return Space((idf[:, None] * u[:, keep] / values[keep]).astype(np.float32), values[keep])


# --- second pass


@dataclass
class Item:
    key: int | None
    words: list[bytes]
    answer: list[bytes]


def item_of(key: int | None, text: str | None) -> Item | None:
    words = words_of(text)
    if len(words) < MIN_WORDS:
        return None
    return Item(key, words, answer_of(text or ""))


def answer_of(text: str) -> list[bytes]:
    """Words of the last line, if it is marked as an answer or a line before it asks; else none."""
    lines = [x for x in text.split("\n") if words_of(x)]
    if len(lines) < 2:
        return []
    label = ANSWERS.match(lines[-1])
    if not label and not any(ASKS.search(x) for x in lines[:-1]):
        return []
    return words_of(lines[-1][label.end() :] if label else lines[-1])


def masks_of(pattern: list[bytes]) -> dict[bytes, int]:
    """For each word the positions at which it stands, as bits."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common(masks: dict[bytes, int], n: int, words: list[bytes], least: float = 0) -> int:
    """Length of the longest common subsequence with a pattern of n words, bit-parallel; 0 if fewer
    than ``least`` words are in the pattern at all."""
    met = [m for m in map(masks.get, words) if m]
    if len(met) < least:
        return 0
    full = (1 << n) - 1
    v = full
    for m in met:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Searcher:
    def __init__(self, space: Space, items: list[Item]):
        self.project, self.items = with_none(space.project), items
        self.masks = [(masks_of(i.words), masks_of(i.answer)) for i in items]
        self.counts = [Counter(i.words) for i in items]
        width = np.array([-(-len(i.words) // BLOCK) + 1 for i in items], int)
        #: Items by width of their windows; ``holds`` has a column for each in this order.
        self.order = np.argsort(width, kind="stable")
        features = [np.unique(features_of(items[i].words), return_counts=True) for i in self.order]
        most = max((int(n.max()) for _, n in features), default=1)
        #: How many words of a feature an item has, and whether it has any.
        self.times = np.zeros((FEATURES + 1, len(items)), np.min_scalar_type(most))
        self.classes: list[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        for c, (feature, n) in enumerate(features):
            self.times[feature, c] = n
        self.holds = (self.times > 0).astype(np.uint8)
        for w, lo, n in zip(*np.unique(width[self.order], return_index=True, return_counts=True), strict=True):
            of = [items[i].words for i in self.order[lo : lo + n]]
            y = np.stack([space.project[features_of(words)].sum(axis=0) for words in of])
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-20)
            least = np.ceil([OVERLAP * len(words) for words in of]).astype(np.int64)
            whole = np.array([len(words) for words in of], np.int64)
            self.classes.append((int(w), int(lo), int(lo + n), y.T.astype(np.float32), least, whole))

    def search(self, chunk: Words) -> list[list[tuple]]:
        """Hits of each document."""
        documents = len(chunk.count)
        hits: list[dict[int, tuple]] = [{} for _ in range(documents)]
        if not self.items or not len(chunk.feature):
            return [[] for _ in range(documents)]
        blocks, count = chunk.laid_out(BLOCK)
        owner = np.repeat(np.arange(documents), count)
        last = np.cumsum(count)[owner]
        inside = np.arange(len(owner)) - (last - count[owner])
        run = _running(summed(self.project, blocks), np.float32)
        # Words of the item in a window: no more than these can be common to both. Sums may wrap, as
        # only differences over a window count.
        widest = max(w for w, *_ in self.classes) * BLOCK
        shared = _running(summed(self.holds, blocks), np.uint16 if widest < 1 << 16 else np.uint32)
        for width, lo, hi, items, least, whole in self.classes:
            begin = np.flatnonzero((np.arange(len(owner)) + width <= last) | (inside == 0))
            end = np.minimum(begin + width, last[begin])
            met = shared[end, lo:hi] - shared[begin, lo:hi]
            row, column = np.nonzero(met >= least.astype(shared.dtype))
            # The cosine of pairs that share enough words at all; few windows do.
            near = np.empty(len(row), np.float32)
            for at in range(0, len(row), WORDS_AT_ONCE):
                r, c = row[at : at + WORDS_AT_ONCE], column[at : at + WORDS_AT_ONCE]
                z = run[end[r]] - run[begin[r]]
                near[at : at + WORDS_AT_ONCE] = np.einsum("ij,ij->i", z, items[:, c].T) / np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-20)
            candidate = (near >= COSINE) | (met[row, column] >= whole[column])
            row, column, near = row[candidate], column[candidate], near[candidate]
            alike = self._alike(blocks, begin[row], end[row], width, lo + column) >= least[column]
            for r, c, cosine in zip(row[alike].tolist(), column[alike].tolist(), near[alike].tolist(), strict=True):
                d, i = int(owner[begin[r]]), int(self.order[lo + c])
                first = int(inside[begin[r]]) * BLOCK
                after = min(first + int(end[r] - begin[r]) * BLOCK, int(chunk.count[d]))
                hit = self._check(i, chunk.slice(d, first, after), first, after, cosine)
                if hit and (i not in hits[d] or hit[1] > hits[d][i][1]):
                    hits[d][i] = hit
        return [[h[i] for i in sorted(h)] for h in hits]

    def _alike(self, blocks: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, column: np.ndarray) -> np.ndarray:
        """For pairs of a window and an item, how many features both have, each as often as both have it.
        Words of one feature count as one word, so it is never less than the words that both have."""
        out = np.empty(len(begin), np.int64)
        place = np.arange(width * BLOCK, dtype=np.int32)
        step = max(1, 8 * WORDS_AT_ONCE // len(place))
        for at in range(0, len(begin), step):
            of = begin[at : at + step, None] + np.arange(width)
            window = blocks[np.minimum(of, len(blocks) - 1)].astype(np.int16)
            window[of >= end[at : at + step, None]] = FEATURES
            window = np.sort(window.reshape(len(of), -1), axis=1)
            # The n-th occurrence counts if the item has so many.
            opens = np.zeros(window.shape, np.int32)
            np.copyto(opens[:, 1:], place[1:], where=window[:, 1:] != window[:, :-1])
            nth = place - np.maximum.accumulate(opens, axis=1)
            out[at : at + step] = (nth < self.times[window, column[at : at + step, None]]).sum(axis=1)
        return out

    def _check(self, i: int, part: list[bytes], lo: int, hi: int, near: float) -> tuple | None:
        item, (masks, answer_masks) = self.items[i], self.masks[i]
        size = len(item.words)
        # No subsequence is longer than the words that both have, each as often as both have it.
        if (Counter(part) & self.counts[i]).total() < OVERLAP * size:
            return None
        n = common(masks, size, part, OVERLAP * size)
        if n < OVERLAP * size:
            return None
        answer = common(answer_masks, len(item.answer), part) / len(item.answer) if item.answer else None
        if answer is not None and answer < ANSWER and n < STRONG * size:
            return None
        return item.key, n, size, n / size, answer, near, lo, hi


def _running(rows: np.ndarray, kind: type) -> np.ndarray:
    out = np.zeros((len(rows) + 1, rows.shape[1]), kind)
    np.cumsum(rows, axis=0, dtype=kind, out=out[1:])
    return out


def learn(docs: DataFrame, text: str = "text") -> Space:
    return decompose(*gather(docs, text))


def with_hits(docs: DataFrame, items: DataFrame, space: Space | None = None, text: str = "text", item_key: str = "item_id", item_text: str = "text", name: str = "hits") -> DataFrame:
    """Adds an array of hits to every document."""
    space = space or learn(docs, text)
    known = items.select(F.col(item_key).cast("long").alias("key"), F.col(item_text).alias("text"))
    parts = -(-max(known.count(), 1) // ITEMS_AT_ONCE)
    out = docs.withColumn(name, F.array().cast(f"array<struct<{_struct()}>>"))
    for p in range(parts):
        some = known.where(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) == p) if parts > 1 else known
        rows = sorted(((r[0] is None, r[0], r[1] or "") for r in some.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
        searcher = docs.sparkSession.sparkContext.broadcast(Searcher(space, [x for x in (item_of(k, t) for _, k, t in rows) if x]))

        out = out.withColumn(name, F.concat(name, _hits_of(searcher)(text)))
    return out


def _hits_of(searcher):
    @F.pandas_udf(f"array<struct<{_struct()}>>")
    def hits_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        takes_over("decontaminate")
        for texts in batches:
            found: list[list[tuple]] = []
            for chunk in _chunks(texts):
                found += searcher.value.search(chunk)
            yield pd.Series([[dict(zip(_NAMES, h, strict=True)) for h in hits] for hits in found])
        give_back()

    return hits_of


_NAMES = [x.split()[0] for x in HIT.split(", ")]


def _struct() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split() for x in HIT.split(", ")))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row for each document and item found in it."""
    name = fresh(docs, "hits")
    found = with_hits(docs, items, name=name, **options).select(key, F.explode(name).alias("hit"))
    columns = [F.col(f"hit.{n}").alias(f"found_{n}" if n == key else n) for n in _NAMES]
    return found.select(key, *columns)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item was found."""
    name = fresh(docs, "hits")
    return with_hits(docs, items, name=name, **options).where(F.size(name) == 0).select(docs.columns)


def checksum(space: Space) -> int:
    """For tests of reruns."""
    return zlib.crc32(np.round(space.values, 6).tobytes())
