"""Joins on time within a clock: nearest within a tolerance, and the records before and after an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_within(anchors: DataFrame, candidates: DataFrame, tolerance: int, *, clock: str = "clock") -> DataFrame:
    """Per anchor (clock, anchor_id, t) the candidate (clock, candidate_id, t) at the least distance, at most
    ``tolerance``; of equals the smaller id; a candidate may serve several anchors. All anchors stay: ``status`` is matched,
    outside_tolerance (the clock has candidates, none near enough), clock_id_mismatch (candidates on other clocks only) or
    no_candidate (none at all).

    Anchors go to the bucket of their time and its neighbours, candidates to their own, so that only those near in time
    meet: an equi-join, whatever the clocks' sizes."""
    width = max(1, tolerance)
    bucket = F.floor(F.col("t") / F.lit(width))
    near = anchors.select(clock, "anchor_id", F.col("t").alias("at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    found = (
        near.join(candidates.select(clock, "candidate_id", "t", bucket.alias("_b")), [clock, "_b"])
        .withColumn("offset", F.col("t") - F.col("at"))
        .filter(F.abs("offset") <= tolerance)
        .groupBy(clock, "anchor_id")
        .agg(F.min(F.struct(F.abs("offset").alias("d"), F.col("candidate_id"), F.col("offset"))).alias("m"))
    )
    clocks = candidates.groupBy(clock).agg(F.count("*").alias("_n"))
    any_ = F.lit(not candidates.isEmpty())
    joined = anchors.join(found, [clock, "anchor_id"], "left").join(clocks, clock, "left")
    status = F.when(F.col("m").isNotNull(), "matched").when(F.col("_n").isNotNull(), "outside_tolerance").when(any_, "clock_id_mismatch").otherwise("no_candidate")
    return joined.select(clock, "anchor_id", F.col("m.candidate_id").alias("candidate_id"), F.col("m.offset").alias("offset"), status.alias("status"))


def unmatched(matched: DataFrame, anchors: DataFrame, candidates: DataFrame, *, clock: str = "clock") -> DataFrame:
    """(candidate_id, reason) for the candidates that no anchor took: clock_id_mismatch where their clock has no anchor, else
    no_anchor_within_tolerance."""
    free = candidates.join(matched.filter("status = 'matched'").select("candidate_id"), "candidate_id", "left_anti")
    clocks = anchors.select(clock).distinct().withColumn("_has", F.lit(True))
    reason = F.when(F.col("_has"), "no_anchor_within_tolerance").otherwise("clock_id_mismatch")
    return free.join(clocks, clock, "left").select("candidate_id", reason.alias("reason"))


def neighbours_in_time(queries: DataFrame, records: DataFrame, value: str, *, clock: str = "clock", slots: int = 1024) -> DataFrame:
    """Per query (clock, query_id, t) the last record at or before it (t0, v0) and the first at or after it (t1, v1). Of
    records at one time the larger value counts.

    Time is dealt to ``slots`` equal slots; a task sorts a clock's slot, not a clock. What lies before and after a slot
    is carried over from its clock's other slots, of which each hands on two records."""
    span = records.select("t").unionByName(queries.select("t")).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    width = max(1, ((span["b"] or 0) - (span["a"] or 0)) // slots + 1)
    slot = F.floor((F.col("t") - F.lit(span["a"] or 0)) / F.lit(width)).alias("_slot")
    record = "struct<t:bigint,v:double>"
    own = records.groupBy(clock, "t").agg(F.max(value).cast("double").alias("_v")).select(clock, slot, "t", F.struct("t", F.col("_v").alias("v")).cast(record).alias("_r"))
    asked = queries.select(clock, "query_id", slot, "t", F.lit(None).cast(record).alias("_r"))
    both = asked.unionByName(own.select(clock, F.lit(None).cast("long").alias("query_id"), "_slot", "t", "_r"))
    ends = both.groupBy(clock, "_slot").agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    slots_ = Window.partitionBy(clock).orderBy("_slot")
    before = F.last("_last", ignorenulls=True).over(slots_.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(slots_.rowsBetween(1, Window.unboundedFollowing))
    carried = ends.select(clock, "_slot", before.alias("_before"), after.alias("_after"))
    order = Window.partitionBy(clock, "_slot").orderBy("t")
    here0 = F.last("_r", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    here1 = F.first("_r", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    placed = both.withColumn("_0", here0).withColumn("_1", here1).filter(F.col("query_id").isNotNull()).join(carried, [clock, "_slot"])
    r0, r1 = F.coalesce("_0", "_before"), F.coalesce("_1", "_after")
    return placed.select(clock, "query_id", "t", r0["t"].alias("t0"), r0["v"].alias("v0"), r1["t"].alias("t1"), r1["v"].alias("v1"))


def nearest_record(placed: DataFrame, limit: int) -> DataFrame:
    """Of ``neighbours_in_time`` the nearer record, of equals the earlier; out_of_range over ``limit``."""
    to0, to1 = F.col("t") - F.col("t0"), F.col("t1") - F.col("t")
    first = to1.isNull() | (to0 <= to1)
    delta = F.when(first, to0).otherwise(to1)
    ok = delta <= limit
    return placed.select("query_id", F.when(ok, F.when(first, F.col("v0")).otherwise(F.col("v1"))).alias("value"), F.when(ok, delta).alias("delta"), F.when(ok, "found").otherwise("out_of_range").alias("status"))


def interpolated(placed: DataFrame, max_gap: int) -> DataFrame:
    """Linear between the records about a query; a record at its time is exact; none on one side is out_of_range, more than
    ``max_gap`` between the two interpolation_gap."""
    exact = F.col("t0") == F.col("t")
    missing = F.col("t0").isNull() | F.col("t1").isNull()
    gap = F.col("t1") - F.col("t0")
    share = (F.col("t") - F.col("t0")) / gap
    status = F.when(exact, "exact").when(missing, "out_of_range").when(gap > max_gap, "interpolation_gap").otherwise("interpolated")
    value = F.when(exact, F.col("v0")).when(~missing & (gap <= max_gap), F.col("v0") + (F.col("v1") - F.col("v0")) * share)
    return placed.select("query_id", value.alias("value"), status.alias("status"))


def select_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with one of ``ids``. Ids that no row has are an error, which names the least of them."""
    missing = ids.join(df.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"), F.min(key).alias("first")).first()
    if missing["n"]:
        raise ValueError(f"{missing['n']} ids are not there, the first is {missing['first']}")
    return df.join(ids.distinct(), key, "left_semi")


def selection_identity(kind: str, *values: object) -> str:
    """A digest of what a selection asks for: full, positions, times or ids, and its bounds or sorted ids."""
    import hashlib
    import json

    if kind not in ("full", "positions", "times", "ids"):
        raise ValueError(f"no selection by {kind!r}")
    asked = sorted(map(str, values)) if kind == "ids" else list(values)
    return hashlib.sha256(json.dumps([kind, asked], separators=(",", ":")).encode()).hexdigest()
