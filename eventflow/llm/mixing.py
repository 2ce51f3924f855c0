"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document expects the same number of copies, target / size of the source. The
documents stand in a fixed order, the expected copies are summed up along it, one offset drawn per
source is added, and a document is emitted once for each integer the running sum crosses. A document
is thus taken floor or ceil of its expectation times.

The order goes by word count first (in bands of at most an eighth), so that long and short documents
are taken in proportion and a source's taken words stay near its target, then by a hash of the
document. No source, however large, is ranked in one task: ranks are counted per (source, band,
hash bucket) and carried forward over the counts, of which a source has at most 8 * 64 bands of 256
buckets. Same rows, same seed: same result, in whatever order the rows come.

Defined results: null text has size 0; documents of size 0 are ranked like others and add no words;
a null source is a source of its own, ordered last; a source without words gets target 0 and is not
taken; repeated rows are documents of their own; texts of any length are counted whole; an empty table
gives an empty table. Input columns named like a result are replaced, all others are handed on, also those
named like a column used on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, saved, set_aside

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
RESULT = ("size", "source_size", "target", "copies", "taken")
#: Names of columns used on the way; the documents' columns of these names are set aside meanwhile.
INNER = ("_src", "_band", "_hash", "_digest", "_bucket", "_start", "_rank")


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, at most ``cap`` times
    the source's size, the excess shared anew by weight until none is above.

    That end state is min(cap * size, level * weight) for one level, found from running sums over the
    sources ordered by cap * size / weight. The table has one row a source.
    """
    ordered = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * F.lit(float(cap)))
    by_ratio = W.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    still = F.sum("_weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    t = t.withColumn("_level", left / still)
    full = F.col("_limit") / F.col("_weight") <= F.col("_level")
    level = F.max(F.when(~full, F.col("_level"))).over(every)
    target = F.when(full, F.col("_limit")).otherwise(F.coalesce(level * F.col("_weight"), F.col("_limit")))
    return t.select("source", "source_size", F.least(target, F.col("_limit")).alias("target"))


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents' columns with size, source_size, target, copies and taken (words)."""
    docs = docs.select(*[c for c in docs.columns if c not in RESULT])
    docs, name, back = set_aside(docs, INNER)
    own, key, text, source = docs.columns, name[key], name[text], name[source]
    binary = F.bin("size")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    base = docs.select(*own, word_count(F.col(text)).alias("size"))
    base = base.withColumns({"_src": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")), "_band": F.concat(F.lpad(F.length(binary).cast("string"), 2, "0"), F.substring(binary, 1, 4)), "_hash": digest, "_digest": F.md5(F.coalesce(F.col(text), F.lit("")))})
    base = base.withColumn("_bucket", F.substring("_hash", 1, 2))
    counts = saved(base.groupBy(F.col(source).alias("source"), "_src", "_band", "_bucket").agg(F.count("*").alias("_n"), F.sum("size").alias("_words")), "mixing-counts")
    bands = counts.groupBy("source", "_src", "_band").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"))
    goal = targets(bands.groupBy("source", "_src").agg(F.sum("_words").alias("source_size")).select("source", "source_size"), weights, share, cap)
    goal = goal.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_src"), "source_size", "target")
    band_start = _starts(bands, ["_src"], "_band", "_band_start")
    bucket_start = _starts(counts.select("_src", "_band", "_bucket", "_n"), ["_src", "_band"], "_bucket", "_bucket_start")
    start = bucket_start.join(band_start, ["_src", "_band"]).join(goal, "_src").withColumn("_start", F.col("_band_start") + F.col("_bucket_start")).drop("_band_start", "_bucket_start")
    in_bucket = W.partitionBy("_src", "_band", "_bucket").orderBy("_hash", F.col(key), "size", "_digest")
    ranked = base.join(start, ["_src", "_band", "_bucket"]).withColumn("_rank", F.col("_start") + F.row_number().over(in_bucket))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(f"offset {seed}:"), F.col("_src")))
    copies = F.floor(offset + rate * F.col("_rank")) - F.floor(offset + rate * (F.col("_rank") - 1))
    copies = F.least(copies, F.ceil(rate)).cast("long")
    mixed = ranked.select(*own, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return mixed.withColumnsRenamed(back)


def _starts(counts: DataFrame, group: list[str], step: str, name: str) -> DataFrame:
    """How many documents of the group stand before each step."""
    before = W.partitionBy(*group).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*group, step, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name))


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken."""
    copy = fresh(mixed, "copy")
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(copy)
