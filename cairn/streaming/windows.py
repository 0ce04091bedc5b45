"""The time operators over unbounded inputs. Inputs come from ``timed``: its watermark bounds all state, and rows later
than that go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    """``events`` with a watermark ``late`` behind their time ``ts``."""
    return events.withWatermark("ts", late)


def windowed_summary(events: DataFrame, length: str) -> DataFrame:
    """Per modality and tumbling window of event time ``ts``: n, least and largest value."""
    window = F.window("ts", length)
    out = events.groupBy(window.alias("w"), "modality").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("start"), "modality", "n", "least", "most")


def pairs_within(anchors: DataFrame, candidates: DataFrame, seconds: int) -> DataFrame:
    """(clock, anchor_id, candidate_id, offset in microseconds) for records of one clock within ``seconds`` of each
    other, bounds included: an inner interval join, whose state ends with the watermark."""
    a = anchors.select(F.col("clock"), F.col("event_id").alias("anchor_id"), F.col("ts").alias("anchor_ts"))
    c = candidates.select(F.col("clock").alias("_clock"), F.col("event_id").alias("candidate_id"), F.col("ts").alias("candidate_ts"))
    near = F.expr(f"clock = _clock AND candidate_ts >= anchor_ts - INTERVAL {seconds} SECONDS AND candidate_ts <= anchor_ts + INTERVAL {seconds} SECONDS")
    return a.join(c, near).select("clock", "anchor_id", "candidate_id", (F.unix_micros("candidate_ts") - F.unix_micros("anchor_ts")).alias("offset"))


def first_seen(events: DataFrame) -> DataFrame:
    """Each event id once, as long as its repeats come within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])
