"""Exact Jaccard self-join of word n-grams by universe partition and pigeonhole.

A document's set holds the hashes of its distinct n-grams. Sizes are cut into bands so that two
similar sets lie in one band or in neighbouring ones; a band's scheme hashes the universe of n-grams
into m segments. Sets that are similar enough differ in at most H elements, H known for the scheme, so
of any H + 1 segments at least one is equal in both: a set with at least H + 1 non-empty segments
meets every partner on the hash of a whole segment. Empty segments, which would bring unlike sets
together, are never used for that. The few sets with fewer non-empty segments meet each other on
one-deletion neighbourhoods: on all segments, and on all segments less any one element, which finds
each segment that differs by at most one. m is chosen by cost: more segments are more signatures for
all, but leave fewer sets that need neighbourhoods.

Sets that are equal are one class from the start. Classes that share a signature are candidates, but
not all pairs of a group are made: the group's first class is compared with all others (then its next
eight, sixty-four, ...), and pairs whose classes already hang together are left out, until every group
is one component or all its pairs are decided. No link is lost, and a large group of copies costs one
comparison a member. Candidates are tested by size and by a bound on the difference from 512 parity
bits; two sets of more than 512 elements, most of which those bits cannot tell apart, then by as many
parity bits as they have elements; and the rest exactly on the whole sets, made again from the texts of
the classes concerned. Whole sets are thus moved only of pairs that are similar or nearly so.

N-grams are compared as 64-bit hashes, classes as 64-bit hashes of their sets.

Defined results: null text, and text without words, has size 0 and is linked with nothing; a text of
fewer than n words is one n-gram, its whole sequence; equal texts, repeated rows included, are one
class; a null key never is a component's smallest unless all its keys are null; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, give_back, saved, takes_over
from .components import connected

U = np.uint64
#: Distinct words whose hashes a worker remembers (some 20 MB; forgotten words are hashed again).
KNOWN_WORDS = 100_000
#: Documents whose sets a worker holds before it hands them on.
HELD = 500
#: Classes whose texts are fetched by a broadcast of their keys (16 bytes each), else by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Signatures are dealt out by value in so many passes, each with its share of them on disk.
PASSES = 2
SKETCH_WORDS = 8
#: Sets of more elements than the 512 bits have a second, longer row of bits.
WIDE_FROM = 64 * SKETCH_WORDS + 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def begin() -> None:
    """At the start of a task; its words are forgotten when another operator's begins."""
    takes_over("jaccard_join", _WORDS.clear)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A strong 64-bit mixing step (the finalizer of splitmix64)."""
    x = x ^ U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; A-Z lower-cased, words parted by ASCII space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, U)
    known = _WORDS
    h = np.fromiter((known[w] for w in words), U, len(words))
    size = min(n, len(words))
    grams = mixed(h[: len(h) - size + 1], size)
    for k in range(1, size):
        grams = mixed(grams * U(0x100000001B3) + h[k : len(h) - size + 1 + k], k)
    return np.unique(grams)


# --- schemes


@lru_cache(maxsize=None)
def band_start(band: int, percent: int) -> int:
    """Least size of a band: the largest partner of a band's set lies in the next band at most."""
    return 1 if band == 0 else band_start(band - 1, percent) * 100 // percent + 1


def band_of(size: int, percent: int) -> int:
    band = 0
    while band_start(band + 1, percent) <= size:
        band += 1
    return band


@lru_cache(maxsize=None)
def scheme(band: int, percent: int) -> tuple[int, int]:
    """(H, m) for pairs whose smaller set lies in the band."""
    largest = band_start(band + 1, percent) - 1
    apart = (100 - percent) * (largest + largest * 100 // percent) // (100 + percent)
    size = (band_start(band, percent) + largest) / 2

    def cost(m: int) -> float:
        """Expected signatures of a set: whole segments, and neighbourhoods if too many are empty."""
        return m + (1 - _poisson(m - apart - 1, m * math.exp(-size / m))) * (size + m)

    spare = sorted({round(1.25**k) - 1 for k in range(200) if 1.25**k <= apart + 2})
    return apart, min((apart + 1 + x for x in spare), key=cost)


def _poisson(most: int, mean: float) -> float:
    """Chance of at most so many empty segments."""
    if mean > 200:
        return 0.5 + 0.5 * math.erf((most + 0.5 - mean) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for k in range(1, min(most, 1000) + 1):
        term *= mean / k
        total += term
    return min(total, 1.0)


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set, under the schemes of its band and of the one below."""
    if not len(grams):
        return np.zeros(0, U)
    own = band_of(len(grams), percent)
    out = []
    values = mixed(grams, 101)
    for band in (own, own - 1):
        if band < 0:
            continue
        apart, m = scheme(band, percent)
        if not apart:
            continue  # equal sets only, which are one class anyway
        segment = (mixed(grams, 1000 + band) % U(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        seg, val = segment[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        sums, used = np.add.reduceat(val, first), seg[first]
        out.append(_signed(sums, used, band, 1))
        if len(used) < apart + 1:
            full = np.zeros(m, U)
            full[used] = sums
            out.append(_signed(full, np.arange(m), band, 2))
            out.append(_signed(full[seg] - val, seg, band, 2))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def _signed(sums: np.ndarray, segments: np.ndarray, band: int, family: int) -> np.ndarray:
    return mixed(mixed(sums, 7 + family) + segments.astype(U) * U(0x9E3779B97F4A7C15) + U(band), 31)


def parity(grams: np.ndarray) -> np.ndarray:
    """512 bits: how many elements fall on each, modulo 2. Two sets differ in at least as many
    elements as these differ in bits."""
    n = np.bincount((mixed(grams, 211) >> U(55)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(n.astype(np.uint8)).view(np.int64)


def wide_parity(grams: np.ndarray) -> np.ndarray | None:
    """As ``parity``, with a bit for each element at least; none for sets that 512 bits serve. The length
    is a power of two, and the first half of a row XOR its second half is the row of half the length."""
    if len(grams) < WIDE_FROM:
        return None
    length = 1 << (len(grams) - 1).bit_length()
    n = np.bincount((mixed(grams, 223) & U(length - 1)).astype(np.int64), minlength=length) & 1
    return np.packbits(n.astype(np.uint8)).view(np.int64)


# --- tables


def _pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        for at in range(0, max(len(part), 1), HELD):
            yield part.iloc[at : at + HELD]


def described(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """(key, text hash, size, class, signatures, parity bits, long parity bits) of every document."""

    @F.pandas_udf("size long, id long, sigs array<long>, bits array<long>, wide array<long>")
    def describe(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        begin()
        for texts in _pieces(parts):
            rows = []
            for t in texts:
                g = ngram_set(t, n)
                whole = mixed(np.array([mixed(g, 401).sum(dtype=U)], U) + U(len(g)), 5).view(np.int64)[0]
                rows.append((len(g), whole, signatures(g, percent).view(np.int64), parity(g), wide_parity(g)))
            yield pd.DataFrame(rows, columns=["size", "id", "sigs", "bits", "wide"])
        give_back()

    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), describe(text).alias("d")).select("key", "hash", "d.*")


def _sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """(id, grams) of the wanted (id, key, hash). ``repeated`` has the (key, hash) of several rows: only
    their texts are sorted, to keep one of each."""

    @F.pandas_udf("array<long>")
    def grams_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin()
        for texts in _pieces(parts):
            yield pd.Series([ngram_set(t, n).view(np.int64) for t in texts])
        give_back()

    # A sized side: 16 bytes a key up to BROADCAST_KEYS of them; beyond, Spark shuffles both.
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    found = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    met = found.join(side, found["key"].eqNullSafe(side["key"]) & (found["hash"] == side["hash"])).select("id", "text")
    if not repeated.isEmpty():
        several = wanted.join(repeated, wanted["key"].eqNullSafe(repeated["key"]) & (wanted["hash"] == repeated["hash"]), "left_semi").select("id")
        met = met.join(several, "id", "left_anti").unionByName(met.join(several, "id", "left_semi").dropDuplicates(["id"]))
    return met.select("id", grams_of("text").alias("grams"))


def _may_link(percent: int) -> Column:
    """False only for pairs whose sizes or parity bits rule a link out."""
    total = F.col("size_a") + F.col("size_b")
    apart = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("bits_a")[0].bitwiseXOR(F.col("bits_b")[0])))
    return (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & (apart * (100 + percent) <= (100 - percent) * total)


def _wide_may_link(percent: int) -> Column:
    """False only for pairs whose long parity bits rule a link out; rows of more than twice the other's
    length, which only a percentage under 50 allows, are not compared."""
    n = F.least(F.size("wide_a"), F.size("wide_b"))

    def cut(name: str) -> Column:
        halves = F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, n + 1, n), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) == n, F.col(name)).otherwise(halves)

    apart = F.aggregate(F.zip_with(cut("wide_a"), cut("wide_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    near = apart * (100 + percent) <= (100 - percent) * (F.col("size_a") + F.col("size_b"))
    return F.when(F.greatest(F.size("wide_a"), F.size("wide_b")) <= 2 * n, near).otherwise(F.lit(True))


def _nearer(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b, size_a, size_b) less those that the long parity bits rule out."""
    both = F.least("size_a", "size_b") >= WIDE_FROM
    large = pairs.where(both)
    if large.isEmpty():
        return pairs
    for side in ("a", "b"):
        large = large.join(classes.where(F.col("size") >= WIDE_FROM).select(F.col("id").alias(side), F.col("wide").alias(f"wide_{side}")), side)
    large = large.where(_wide_may_link(percent)).select(pairs.columns)
    return saved(pairs.where(~both).unionByName(large), "near-candidates")


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, repeated: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """Those of the (a, b) that are similar."""
    info = classes.select("id", "size", "bits")
    for side in ("a", "b"):
        pairs = pairs.join(info.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    pairs = saved(pairs.where(_may_link(percent)).select("a", "b", "size_a", "size_b"), "candidates")
    pairs = _nearer(pairs, classes, percent)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = saved(_sets(docs, saved(classes.join(ids, "id", "left_semi").select("id", "key", "hash"), "wanted"), repeated, n, key, text), "sets")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("grams").alias(f"grams_{side}")), side)
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return pairs.select("a", "b", "size_a", "size_b", shared.alias("shared")).where(100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))).select("a", "b")


def _once(rows: DataFrame, several: DataFrame) -> DataFrame:
    """(id, sigs), one row for each id. Signatures are long: those of ids with one row are not shuffled
    for it, unless the ids with ``several`` are too many to be broadcast."""
    if several.count() > BROADCAST_KEYS:
        return rows.dropDuplicates(["id"])
    side = F.broadcast(several)
    return rows.join(side, "id", "left_anti").unionByName(rows.join(side, "id", "left_semi").dropDuplicates(["id"]))


def _groups(filled: DataFrame, several: DataFrame, k: int) -> DataFrame:
    """(signature, id, least id) of the signatures that several ids have, in the k-th of PASSES."""
    own = F.filter("sigs", lambda sig: F.pmod(sig, F.lit(PASSES)) == k).alias("sigs")
    group = W.partitionBy("sig")
    met = _once(filled.select("id", own), several).select("id", F.explode("sigs").alias("sig")).withColumns({"first": F.min("id").over(group), "last": F.max("id").over(group)})
    return met.where("first <> last").select("sig", "id", "first")


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents as key, hash, size, id; classes as id, component, key and hash of the first)."""
    rows = saved(described(docs, n, percent, key, text), "described")
    documents = rows.select("key", "hash", "size", "id")
    repeated = saved(documents.groupBy("key", "hash").count().where("count > 1").select("key", "hash"), "repeated")
    filled = rows.where("size > 0")
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("hash"))
    # The rows of a class have one set, and so the same bits.
    merged = filled.groupBy("id").agg(F.min(order).alias("first"), F.max("size").alias("size"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.count("*").alias("rows"))
    classes = saved(merged.select("id", "size", "bits", "wide", "rows", "first.key", "first.hash"), "classes")
    several = classes.where("rows > 1").select("id")
    groups = reduce(DataFrame.unionByName, [saved(_groups(filled, several, k), "groups") for k in range(PASSES)])
    pairs = groups.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = saved(_linked(pairs, classes, docs, repeated, n, percent, key, text), "linked")
    components = connected(links)
    done, step = 1, 8
    while True:
        # Of each group the classes from rank ``done`` on have not been compared with each other.
        named = groups.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
        ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("sig").orderBy("id")) - 1).where(F.col("rank") >= done)
        open_ = ranked.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
        info = classes.select("id", F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
        left = saved(ranked.join(open_, "sig", "left_semi").select("sig", "id", "rank", "component").join(info, "id"), "open-groups")
        if left.isEmpty():
            break
        heads = left.where(F.col("rank") < done + step).select("sig", F.col("id").alias("a"), F.col("rank").alias("rank_a"), F.col("component").alias("component_a"), F.col("size_b").alias("size_a"), F.col("bits_b").alias("bits_a"))
        pairs = heads.join(left, "sig").where((F.col("rank") > F.col("rank_a")) & (F.col("component") != F.col("component_a")) & _may_link(percent)).select("a", F.col("id").alias("b")).distinct()
        more = saved(_linked(pairs, classes, docs, repeated, n, percent, key, text), "linked")
        if not more.isEmpty():
            components = connected(components.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
        done, step = done + step, step * 8
    named = classes.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return documents, named.select("id", "component", "key", "hash")


def _first_of(classes: DataFrame) -> DataFrame:
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("hash"))
    return classes.groupBy("component").agg(F.min(order).alias("first"))


def join_documents(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_shingles, component_id (smallest key it reaches by links)."""
    documents, classes = similar_classes(docs, n, percent, key, text)
    named = classes.join(_first_of(classes), "component").select("id", F.col("first.key").alias("component_id"))
    named = named.withColumn("known", F.lit(True))
    joined = documents.join(named, "id", "left")
    return joined.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.when((F.col("size") > 0) & F.col("known"), F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents less all but the first (smallest key) of each component; documents without words
    all stay."""
    documents, classes = similar_classes(docs, n, percent, key, text)
    first = _first_of(classes).select(F.col("first.key").alias("key"), F.col("first.hash").alias("hash"))
    rows = documents.groupBy("key", "hash").agg(F.max("size").alias("size"), F.count("*").alias("copies"))
    kept = rows.join(first.withColumn("is_first", F.lit(True)), rows["key"].eqNullSafe(first["key"]) & (rows["hash"] == first["hash"]), "left").select(rows["key"], rows["hash"], "size", "copies", "is_first")
    gone = saved(kept.where("size > 0 and is_first is null").select("key", "hash"), "gone")
    again = kept.where("size > 0 and is_first and copies > 1").select("key", "hash")
    k, h = fresh(docs, "key"), fresh(docs, "hash")
    named = docs.withColumns({k: F.col(key), h: F.xxhash64(text)})
    side = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    left = named.join(side, named[k].eqNullSafe(side["key"]) & (named[h] == side["hash"]), "left_anti")
    again = saved(again, "repeated")
    if again.isEmpty():
        return left.select(docs.columns)
    # Repeated rows of a first document: one of them stays.
    twice = left.join(again, left[k].eqNullSafe(again["key"]) & (left[h] == again["hash"]), "left_semi").dropDuplicates([k, h])
    single = left.join(again, left[k].eqNullSafe(again["key"]) & (left[h] == again["hash"]), "left_anti")
    return single.unionByName(twice).select(docs.columns)
