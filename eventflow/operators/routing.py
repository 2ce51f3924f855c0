"""Delivery of events to the subscriptions whose pattern matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.subjects import no_empty_token, subject_match

# Tables of up to this many rows (well below a megabyte) are broadcast. Larger ones are joined by the
# same keys, so the check decides only how rows travel.
BROADCAST_ROWS = 4096


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Size check before a broadcast; reads at most ``rows + 1`` rows."""
    return table.limit(rows + 1).count() <= rows


def match_subjects(subjects: DataFrame, patterns: DataFrame, small: bool = False) -> DataFrame:
    """Every row of ``subjects`` with every row of ``patterns`` that matches, by equality joins only.

    Patterns are reduced to shapes (which tokens are wild, how many, open end or not). Each subject is
    masked with every shape of fitting length, and the masked text must equal the pattern. Work per
    subject grows with the number of shapes, not of patterns. ``small`` patterns are broadcast.
    """
    hinted = F.broadcast if small else lambda table: table
    tokens = F.split("pattern", r"\.")
    open_end = F.element_at(tokens, -1) == ">"
    body = F.when(open_end, F.slice(tokens, 1, F.size(tokens) - 1)).otherwise(tokens)
    rules = patterns.withColumns(
        {"_open": open_end, "_wild": F.transform(body, lambda t: t == "*"), "_text": F.col("pattern")}
    )
    shapes = rules.select("_open", "_wild", F.size("_wild").alias("_depth")).distinct()

    parts = F.split("subject", r"\.")
    fits = F.flatten(
        F.array(
            F.array(F.struct(F.lit(False).alias("open"), F.size(parts).alias("depth"))),
            F.transform(
                F.sequence(F.lit(0), F.size(parts) - 1),
                lambda d: F.struct(F.lit(True).alias("open"), d.alias("depth")),
            ),
        )
    )
    head = F.slice(parts, F.lit(1), F.col("_depth"))
    masked = F.zip_with(head, "_wild", lambda t, w: F.when(w, F.lit("*")).otherwise(t))
    ending = F.when(F.col("_open"), F.array(F.lit(">"))).otherwise(F.array().cast("array<string>"))
    literal = ~(F.col("_open") | F.exists("_wild", lambda w: w))
    candidates = (
        subjects.withColumn("_fit", F.explode(fits))
        .withColumns({"_open": F.col("_fit.open"), "_depth": F.col("_fit.depth")})
        .join(hinted(shapes), ["_open", "_depth"])
        .where(literal | no_empty_token(F.col("subject")))
        .withColumn("_text", F.array_join(F.concat(masked, ending), "."))
        .drop("_fit", "_depth")
    )
    return candidates.join(hinted(rules), ["_open", "_wild", "_text"]).drop("_open", "_wild", "_text")


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per event and matching subscription; two matching patterns give two rows.

    ``subscriptions`` has ``pattern`` and any other columns. A small table (checked) is broadcast, so
    events are not shuffled at all. A larger one meets the distinct subjects, and events meet the
    matches.
    """
    if is_small(subscriptions):
        return match_subjects(events, subscriptions, small=True)
    return _by_subject(events, match_subjects(events.select("subject").distinct(), subscriptions))


def deliver_to_groups(events: DataFrame, subscriptions: DataFrame, group: str) -> DataFrame:
    """One row per event and group with any matching pattern.

    Repeated matches are removed among the distinct subjects, not among the deliveries.
    """
    subjects = events.select("subject").distinct()
    matches = match_subjects(subjects, subscriptions, is_small(subscriptions))
    return _by_subject(events, matches.select("subject", group).distinct())


def _by_subject(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Events with the rows of their subject: a small table (checked) is broadcast; beyond that hot
    subjects are split at run time, as the session sets ``forceOptimizeSkewedJoin``."""
    return events.join(F.broadcast(matches) if is_small(matches) else matches, "subject")


def assign_member(deliveries: DataFrame, position: str, members: Column) -> DataFrame:
    """Pick the one member of a queue group that gets each message."""
    return deliveries.withColumn("member", F.pmod(F.col(position), members))


def subjects_of(events: DataFrame, patterns: list[str]) -> DataFrame:
    """Everything one handler gets for its list of patterns, duplicates kept.

    One pass: each event is repeated for every pattern it matches.
    """
    hits = F.array_compact(
        F.array(*[F.when(subject_match(F.col("subject"), p), F.lit(p)) for p in patterns])
    )
    return events.withColumn("pattern", F.explode(hits))
