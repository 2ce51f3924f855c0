"""Token counts of whole texts, by a broadcast table of frequent pre-tokens and worker caches.

A tokenizer of the library ``tokenizers`` cuts a text into pre-tokens and encodes each by itself, so a
text has as many tokens as its pre-tokens together. Two tiers give a pre-token's number of tokens:

* a compact table of the most frequent pre-tokens, broadcast (``ENTRIES`` rows of at most ``LONGEST``
  characters bound its size). The pre-tokens of all documents are counted where they are read; a task
  hands on only its ``PER_TASK`` most frequent ones, whose counts are added up. No pre-token is shuffled.
* pre-tokens outside the table are encoded by the library, once per batch, and kept in a bounded cache
  of the worker, which later tasks of the worker find again.

The tiers only decide how fast a length is found: the counts are those of the library in any case.
Pre-tokens are cut by a regular expression whose character classes are asked of the library, a block of
256 characters at a time when one is first met; other pre-tokenizers than the one named below are called
themselves.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; strings of added tokens inside
a text are one token each, as is the library's default; texts of any length are read whole, in pieces cut
at a space; ties and repeated rows do not matter, as every row is counted for itself; an empty table gives
an empty table; input columns named like the results are replaced, all others are handed on.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

ENTRIES = 1 << 16
PER_TASK = 1 << 14
LONGEST = 32
#: Entries of a worker's cache; characters held as pre-tokens at once.
CACHED = 1 << 18
AT_ONCE = 1 << 20

# The pre-tokenizer for which a regular expression is built, and its contractions.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# Fixed value: the normalizers under which texts below U+0300 are only lower-cased.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_BEYOND = re.compile("[̀-\U0010ffff]")
_SPACE = re.compile("[ \n]")


class Splitter:
    """Cuts texts into pre-tokens as the tokenizer of a vocabulary file does."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.encoder = Tokenizer.from_file(vocabulary)
        self.encoder.normalizer = Sequence([])  # pre-tokens are normalized, and not all would stay as they are
        with open(vocabulary, encoding="utf-8") as file:
            parts = json.load(file)
        added = parts["added_tokens"]
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that are normalized, stripped or single words are not supported")
        self.added = [a["content"] for a in added]
        self.cut = re.compile("|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) or "(?!)")
        steps = (parts["normalizer"] or {}).get("normalizers", [])
        first = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_words = [s["type"] for s in steps] == NORMALIZERS and first.get("pattern") == {"Regex": WORDS}
        self.letters = self.numbers = self.spaces = ""
        self.blocks: set[int] = set()
        if self.by_words:
            self._learn({0})

    def _learn(self, blocks: set[int]) -> None:
        """Ask the library for the classes of whole blocks of characters: white space leaves no
        pre-token, two equal numbers are two, and a letter goes on with the letter before it."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for block in blocks:
            letters, numbers, spaces = set(), set(), set()
            for c in map(chr, range(block << 8, (block + 1) << 8)):
                twice = len(split(c + c))
                kind = spaces if twice == 0 else numbers if twice == 2 else letters if len(split("a" + c)) == 1 else None
                if kind is not None:
                    kind.add(ord(c))
            self.letters += _ranges(letters)
            self.numbers += _ranges(numbers)
            self.spaces += _ranges(spaces)
        self.blocks |= blocks
        self.find = re.compile(f"{CONTRACTIONS}|[{self.letters}]+|[{self.numbers}]|[^{self.spaces}{self.letters}{self.numbers}]+").findall

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if not self.by_words:
            normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
            return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        # Below U+0300 nothing composes, and white space only separates.
        normal = self.tokenizer.normalizer.normalize_str(text) if _BEYOND.search(text) else text.lower()
        if not normal.isascii() and (new := {ord(c) >> 8 for c in set(normal)} - self.blocks):
            self._learn(new)
        return self.find(normal)

    def split(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(number of added tokens, pre-tokens) of each part of the text."""
        for part in _parts(text):
            if any(a in part for a in self.added):
                pieces = self.cut.split(part)
                yield len(pieces) - 1, [p for piece in pieces for p in self.plain(piece)]
            else:
                yield 0, self.plain(part)

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.encoder.encode_batch_fast(pieces, add_special_tokens=False)]


def _ranges(points: set[int]) -> str:
    """Code points as ranges inside a character class."""
    ordered = sorted(points)
    starts = [p for p in ordered if p - 1 not in points]
    ends = [p for p in ordered if p + 1 not in points]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about ``AT_ONCE`` characters, cut at a space, which no pre-token holds."""
    at = 0
    while len(text) - at > AT_ONCE and (space := _SPACE.search(text, at + AT_ONCE)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


class Lengths:
    """Both tiers. Sent to the workers as its table alone; a worker's cache lives as long as the worker."""

    def __init__(self, vocabulary: str, table: dict[str, int]):
        self.vocabulary, self.table = vocabulary, table
        self.known: dict[str, int] | None = None

    def __getstate__(self) -> tuple:
        return self.vocabulary, "\n".join(self.table), list(self.table.values())

    def __setstate__(self, state: tuple) -> None:
        self.__init__(state[0], dict(zip(state[1].split("\n"), state[2], strict=True)) if state[2] else {})

    def count(self, texts: list[str | None]) -> list[int]:
        if self.known is None:
            self.splitter, self.known = Splitter(self.vocabulary), dict(self.table)
        found, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for extra, pieces in self.splitter.split(text or ""):
                found[i] += extra
                held.append((i, pieces))
                size += sum(map(len, pieces))
                if size > AT_ONCE:
                    self._add(held, found)
                    held, size = [], 0
        self._add(held, found)
        return found

    def _add(self, held: list[tuple[int, list[str]]], found: list[int]) -> None:
        known = self.known
        missing = list(set().union(*[p for _, p in held]).difference(known))
        known.update(zip(missing, self.splitter.lengths(missing), strict=True))
        for i, pieces in held:
            found[i] += sum(map(known.__getitem__, pieces))
        for piece in missing:
            if len(piece) > LONGEST:
                del known[piece]
        if len(known) > len(self.table) + CACHED:
            self.known = dict(self.table)


def frequent(docs: DataFrame, vocabulary: str, entries: int = ENTRIES, text: str = "text") -> dict[str, int]:
    """The most frequent pre-tokens of all documents, at most ``entries``, with their numbers of tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen = Splitter(vocabulary), Counter()
        for batch in batches:
            for value in batch.column(0):
                for _, pieces in splitter.split(value.as_py() or ""):
                    seen.update(pieces)
                if len(seen) > 16 * PER_TASK:  # rare ones go, so that memory is bounded
                    seen = Counter(dict(seen.most_common(8 * PER_TASK)))
        top = [(p, n) for p, n in seen.most_common(PER_TASK) if n > 1 and len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    tops = docs.select(F.col(text)).mapInArrow(task, "piece string, n long")
    counts = tops.groupBy("piece").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 16))
    counts = saved(counts, "pre-tokens")
    held, least = 0, math.inf
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 16 * 63 levels
        held += row["count"]
        if held > entries:
            break
        least = row["level"]
    pieces = [r.piece for r in counts.where(F.col("level") >= F.lit(float(least))).select("piece").collect()]
    return dict(zip(pieces, Splitter(vocabulary).lengths(pieces), strict=True))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, text: str = "text", entries: int = ENTRIES) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``) to every row."""
    lengths = docs.sparkSession.sparkContext.broadcast(Lengths(vocabulary, frequent(docs, vocabulary, entries, text)))

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(lengths.value.count(texts.tolist()), dtype="int64")

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rest = [F.col(c) for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    counted = docs.select(*rest, size.alias("n_bytes"), tokens(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
