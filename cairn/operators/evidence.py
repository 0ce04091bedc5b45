"""Evidence about supports: grouping, hypotheses, uncertainty, weighting, and decisions over channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hypotheses(claims: DataFrame) -> DataFrame:
    """Per support and label key: claims, different observations, those with it as primary, and the spelling most used
    (of equals the first in text order). ``claims``: support, observation, key, label, role. Claims are summed up by observation
    and spelling first; all counts come from those sums, so nothing is expanded to count what is different."""
    summed = claims.groupBy("support", "key", "observation", "label").agg(F.count("*").alias("n"), F.max((F.col("role") == "primary").cast("int")).alias("primary"))
    spelled = summed.groupBy("support", "key", "label").agg(F.sum("n").alias("n")).groupBy("support", "key").agg(F.min(F.struct(-F.col("n"), F.col("label"))).alias("s"))
    seen = summed.groupBy("support", "key", "observation").agg(F.sum("n").alias("n"), F.max("primary").alias("primary"))
    there = F.col("observation").isNotNull()
    counted = seen.groupBy("support", "key").agg(F.sum("n").alias("claims"), F.count_if(there).alias("observations"), F.count_if(there & (F.col("primary") == 1)).alias("primary_observations"))
    return counted.join(spelled, ["support", "key"]).select("support", "key", F.col("s.label").alias("label"), "claims", "observations", "primary_observations")


def uncertainty(found: DataFrame, margin: int) -> DataFrame:
    """(support, kind): contradiction where two hypotheses or more are primary, over two observations or more; else
    ambiguity where there are two or more; near_tie where the lead in different observations is at most ``margin``."""
    lead = F.max("observations").over(Window.partitionBy("support"))
    per = found.withColumn("lead", lead).groupBy("support").agg(
        F.count("*").alias("n"), F.count_if(F.col("primary_observations") > 0).alias("primary"), F.sum("primary_observations").alias("seen"), F.count_if(F.col("lead") - F.col("observations") <= margin).alias("close")
    )
    contradiction = (F.col("primary") >= 2) & (F.col("seen") >= 2)
    kinds = F.array_compact(F.array(F.when(contradiction, "contradiction"), F.when(~contradiction & (F.col("n") >= 2), "ambiguity"), F.when(F.col("close") >= 2, "near_tie")))
    return per.select("support", F.explode(kinds).alias("kind"))


def weighted_support(contributions: DataFrame) -> DataFrame:
    """Per support and hypothesis: the least quality factor of a contribution, their mean over an observation, the sum over
    observations. ``contributions``: support, key, observation, contribution, factor (null counts as neutral, 1)."""
    least = contributions.groupBy("support", "key", "observation", "contribution").agg(F.min(F.coalesce("factor", F.lit(1.0))).alias("w"))
    mean = least.groupBy("support", "key", "observation").agg(F.avg("w").alias("w"))
    return mean.groupBy("support", "key").agg(F.sum("w").alias("weight"), F.count("*").alias("observations"))


def channel_status(findings: Column) -> Column:
    """Of an array of findings: null or empty is unavailable, any conflicts dominates, then any supports."""
    return F.when(findings.isNull() | (F.size(findings) == 0), "unavailable").when(F.array_contains(findings, "conflicts"), "conflicts").when(F.array_contains(findings, "supports"), "supports").otherwise("neutral")


def resolve(geometry: Column, others: list[Column], least_support: int) -> tuple[Column, Column]:
    """(decision, reason) from the channels' statuses; an unavailable one casts no vote."""
    every = [geometry, *others]
    votes = lambda status: sum((F.when(c == status, 1).otherwise(0) for c in every[1:]), F.when(every[0] == status, 1).otherwise(0))
    supports, conflicts = votes("supports"), votes("conflicts")
    both = (supports > 0) & (conflicts > 0)
    match = (geometry == "supports") & (conflicts == 0) & (supports >= least_support)
    distinct = (geometry == "conflicts") & (supports == 0)
    decision = F.when(geometry == "unavailable", "unresolved").when(both, "unresolved").when(match, "match").when(distinct, "distinct").otherwise("unresolved")
    reason = F.when((geometry != "unavailable") & both, "conflicting").when((geometry != "unavailable") & ~both & (match | distinct), F.lit(None)).otherwise("insufficient")
    return decision, reason


def close_relations(relations: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Relations (subject, predicate, object, state) with the inverse of each added; a symmetric predicate is its own."""
    pairs = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    turned = relations.select(F.col("object").alias("subject"), pairs[F.col("predicate")].alias("predicate"), F.col("subject").alias("object"), "state").filter(F.col("predicate").isNotNull())
    return relations.select("subject", "predicate", "object", "state").unionByName(turned).distinct()


def demote_inconsistent(relations: DataFrame) -> DataFrame:
    """Both directions of a directed predicate supported: both become unresolved."""
    other = relations.filter("state = 'supported'").select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"), F.lit(True).alias("_both")).distinct()
    joined = relations.join(other, ["subject", "predicate", "object"], "left")
    return joined.withColumn("state", F.when((F.col("state") == "supported") & F.col("_both"), "unresolved").otherwise(F.col("state"))).drop("_both")


def materialize(supports: DataFrame) -> DataFrame:
    """(support, entity, rejection): one entity for each support (support, refs, resolved, first_t, last_t, valid), or why there is none: the
    first of empty_geometry, unresolvable_geometry, invalid_temporal_evidence and invalid_entity."""
    timed = F.coalesce(F.col("first_t") <= F.col("last_t"), F.lit(False))
    rejection = (
        F.when(F.coalesce("refs", F.lit(0)) == 0, "empty_geometry")
        .when(F.coalesce("resolved", F.lit(0)) < F.col("refs"), "unresolvable_geometry")
        .when(~timed, "invalid_temporal_evidence")
        .when(~F.coalesce("valid", F.lit(False)), "invalid_entity")
    )
    return supports.select("support", F.when(rejection.isNull(), F.concat(F.lit("entity-"), F.col("support").cast("string"))).alias("entity"), rejection.alias("rejection"))
