"""Runs of periodically repeated words, by lag scans and multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``TIMES``
periods long, that no neighbouring word extends at that period. The words of many documents stand in
one integer array, each document closed by a number of its own, so that numpy works on all of them.

* Periods up to ``SHORT`` are found by direct lag scans: stretches in which words q apart are equal.
* Longer ones are found per scale g = 2 * SHORT, 4 * SHORT, ..: grams of g words are hashed by doubling,
  and the least hash in each window of g / 2 consecutive grams is a minimizer. In a run of period q with
  g / 2 < q <= g the window moved on by q holds the same grams, so minimizers come again q words later;
  and as a gram is at least one period long, it occurs nowhere between. So the run has two neighbouring
  minimizers of one hash at distance q. Each such pair is a seed that is extended to both sides on the
  words themselves, in steps of doubling length. A seed is already a gram repeated at once, so extending
  costs no more than the repetitions there are. Documents too short for a scale leave the array.

Extension, length and smallest period are checked on the words, so hashes only say where to look.

Defined results: null, empty and wordless texts have no run and the hash of the empty string; texts of
any length are read whole; repeated rows are rows of their own; of several longest runs the one of
smallest start, then period, is reported; an empty table gives an empty table; input columns named like
the results are replaced, all others are handed on.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh

SHORT = 8
LEAST = 6
TIMES = 4
#: Words of one array (a longer document has one of its own); steps of an extension begin so long.
AT_ONCE = 1 << 18
STEP = 64

RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _smallest(x: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether no proper divisor of the period is a period of the stretch, which holds several."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            lag = period // prime
            if np.array_equal(x[start : start + length - lag], x[start + lag : start + length]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _lag_scan(x: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches of this period that are long enough."""
    unequal = np.flatnonzero(np.concatenate([[True], x[:-lag] != x[lag:], [True]]))
    stretch = np.diff(unequal) - 1
    for at in np.flatnonzero(stretch + lag >= max(LEAST, TIMES * lag)):
        yield int(unequal[at]), int(stretch[at]) + lag


def _extend(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The widest stretch [start, end) around ``at`` in which words ``lag`` apart are equal."""
    start, end, step = at, at, STEP
    while start > 0:
        low = max(0, start - step)
        unequal = np.flatnonzero(x[low:start] != x[low + lag : start + lag])
        if len(unequal):
            start = low + int(unequal[-1]) + 1
            break
        start, step = low, 2 * step
    step = STEP
    while end + lag < len(x):
        high = min(len(x) - lag, end + step)
        unequal = np.flatnonzero(x[end:high] != x[end + lag : high + lag])
        if len(unequal):
            end += int(unequal[0])
            break
        end, step = high, 2 * step
    return start, end + lag


def _window_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Where the first least hash of each window of ``width`` (a power of two) stands."""
    least, where, half = hashes, np.arange(len(hashes)), 1
    while half < width:
        left, right = least[:-half], least[half:]
        later = right < left
        where = np.where(later, where[half:], where[:-half])
        least = np.where(later, right, left)
        half *= 2
    return where


def _seeds(hashes: np.ndarray, gram: int) -> Iterator[tuple[int, int]]:
    """(period, place) of neighbouring equal minimizers more than half a gram and at most one apart."""
    places = _window_least(hashes, gram // 2)
    places = places[np.concatenate([[True], places[1:] != places[:-1]])]
    places = np.unique(places)
    key = hashes[places]
    order = np.argsort(key, kind="stable")
    key, places = key[order], places[order]
    apart = places[1:] - places[:-1]
    near = (key[1:] == key[:-1]) & (2 * apart > gram) & (apart <= gram)
    return sorted(zip(apart[near].tolist(), places[:-1][near].tolist(), strict=True))


def _scale_runs(x: np.ndarray, hashes: np.ndarray, gram: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs whose period belongs to this scale."""
    lag, done = 0, 0
    for period, place in _seeds(hashes, gram):
        if period == lag and place < done:
            continue  # inside the stretch found last
        start, end = _extend(x, place, period)
        lag, done = period, end - period
        if end - start >= TIMES * period and _smallest(x, start, end - start, period):
            yield start, end - start, period


def find_runs(x: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in documents that stand one after another; ``sizes`` counts
    each document's numbers, the last one its own."""
    runs = []
    for lag in range(1, min(SHORT, (len(x) - 1) // TIMES) + 1):
        runs += [(s, n, lag) for s, n in _lag_scan(x, lag) if lag == 1 or _smallest(x, s, n, lag)]
    shift = np.zeros(len(sizes), np.int64)  # how far documents moved to the left
    gram, hashes = 1, _mix(x.astype(np.uint64))
    while True:
        gram *= 2
        hashes = _mix(hashes[: -(gram // 2)] * np.uint64(3) + hashes[gram // 2 :]) if len(hashes) > gram // 2 else hashes[:0]
        if not len(hashes):
            return runs
        if gram < 2 * SHORT:
            continue
        # The least run of this scale has periods of more than half a gram.
        stay = sizes > TIMES * (gram // 2 + 1)
        if not stay.all():
            words = np.repeat(stay, sizes)
            moved = np.cumsum(np.where(stay, 0, sizes))
            shift, x, sizes = (shift + moved)[stay], x[words], sizes[stay]
            hashes = np.concatenate([hashes, np.zeros(len(words) - len(hashes), np.uint64)])[words][: max(0, len(x) - gram + 1)]
            if not len(sizes):
                return runs
        ends = np.cumsum(sizes)
        for start, length, period in _scale_runs(x, hashes, gram):
            runs.append((start + int(shift[np.searchsorted(ends, start, "right")]), length, period))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _describe(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    if not runs:
        return 0, None, None, None, None, _sha256(""), _sha256(" ".join(words))
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return len(runs), start, length, period, 1000 * length // period, _sha256(listed), _sha256(" ".join([words[i] for i in kept]))


def runs_of(texts: list[str | None]) -> Iterator[tuple]:
    """The columns of ``RESULT`` for each text."""
    find = re.compile(WORD).findall
    held: list[list[str]] = []
    size = 0
    for text in texts:
        held.append(find(text or ""))
        size += len(held[-1]) + 1
        if size > AT_ONCE:
            yield from _together(held)
            held, size = [], 0
    yield from _together(held)


def _together(held: list[list[str]]) -> Iterator[tuple]:
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    sizes = np.array([len(words) + 1 for words in held], np.int64)
    ends = np.cumsum(sizes)
    x = np.empty(int(sizes.sum()), np.int64)
    for i, words in enumerate(held):
        x[ends[i] - sizes[i] : ends[i] - 1] = [numbers[w] for w in words]
    x[ends - 1] = -1 - np.arange(len(held))
    of: list[list[tuple[int, int, int]]] = [[] for _ in held]
    for start, length, period in find_runs(x, sizes) if len(held) else ():
        i = int(np.searchsorted(ends, start, "right"))
        of[i].append((start - int(ends[i] - sizes[i]), length, period))
    for words, runs in zip(held, of, strict=True):
        yield _describe(words, runs)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of ``RESULT`` to every row: number of runs, the longest one, all runs hashed, and
    the text without what runs repeat, hashed."""
    names = [part.split()[0] for part in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def runs(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = pd.DataFrame(list(runs_of(texts.tolist())), columns=names, dtype=object)
            yield rows.astype({n: "Int64" for n in names[:5]})

    rest, found = [c for c in docs.columns if c not in names], fresh(docs, "runs")
    return docs.select(*rest, runs(F.col(text)).alias(found)).select(*rest, f"{found}.*")
