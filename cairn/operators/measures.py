"""Measures of regions, observations, entities and resolutions, each whole: counts, summaries, diagnostics and the reasons for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import AXES
from cairn.operators.graphs import components, shortest_paths
from cairn.operators.spatial_joins import within_radius


def region_membership(footprint: DataFrame, areas: DataFrame) -> DataFrame:
    """Per region (frame, region): points associated, occluded and outside the valid support, the different pixels that associated ones cover,
    their share of the mask's ``area``, and the visible share of the footprint. ``footprint``: (frame, region, point, row, col, state), state
    associated, occluded or outside. A region without a footprint stays, with nothing."""
    is_ = lambda s: F.col("state") == s
    counts = footprint.groupBy("frame", "region").agg(*[F.count_if(is_(s)).alias(s) for s in ("associated", "occluded", "outside")])
    pixels = footprint.filter(is_("associated")).select("frame", "region", "row", "col").distinct().groupBy("frame", "region").agg(F.count("*").alias("pixels"))
    rows = areas.join(counts, ["frame", "region"], "left").join(pixels, ["frame", "region"], "left").fillna(0, ["associated", "occluded", "outside", "pixels"])
    whole = F.col("associated") + F.col("occluded") + F.col("outside")
    return rows.select("frame", "region", "area", "associated", "occluded", "outside", "pixels", (F.col("pixels") / F.col("area")).alias("coverage"), F.try_divide("associated", whole).alias("visible_share"))


def regions_per_point(footprint: DataFrame) -> DataFrame:
    """(frame, regions, points): how many associated points lie in one region of the frame, in two, and so on."""
    per = footprint.filter("state = 'associated'").groupBy("frame", "point").agg(F.countDistinct("region").alias("regions"))
    return per.groupBy("frame", "regions").agg(F.count("*").alias("points"))


def observation_quality(support: DataFrame, membership: DataFrame, width: int, height: int) -> DataFrame:
    """Per region the least, middle and largest depth, angle to the optical axis and distance to the image's border of its associated points
    (frame, region, depth, range, u, v), points by mask pixel, and the shares of its footprint; ``unavailable`` names what there is none of:
    no_support, no_footprint."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("depth") / F.col("range"))))
    u, v = F.col("u") + 0.5, F.col("v") + 0.5
    border = F.least(u, width - u, v, height - v)
    three = lambda c, n: [F.min(c).alias(f"least_{n}"), F.median(c).alias(f"middle_{n}"), F.max(c).alias(f"largest_{n}")]
    found = support.withColumns({"_angle": angle, "_border": border}).groupBy("frame", "region").agg(*three(F.col("depth"), "depth"), *three(F.col("_angle"), "angle"), *three(F.col("_border"), "border"))
    footprint = F.col("associated") + F.col("occluded") + F.col("outside")
    reasons = F.array_compact(F.array(F.when(F.col("associated") == 0, "no_support"), F.when(footprint == 0, "no_footprint")))
    rows = membership.withColumns({"density": F.col("associated") / F.col("area"), "occluded_share": F.try_divide("occluded", footprint), "outside_share": F.try_divide("outside", footprint), "unavailable": reasons})
    return rows.join(found, ["frame", "region"], "left")


def residual_statistics(rows: DataFrame, group: str) -> DataFrame:
    """Per group of correspondences (residual, state): evaluated, invalid and not_evaluated apart, and of the evaluated the mean, median, 95th
    percentile (linear) and largest; null without any."""
    is_ = lambda s: F.col("state") == s
    r = F.when(is_("evaluated"), F.col("residual"))
    return rows.groupBy(group).agg(*[F.count_if(is_(s)).alias(s) for s in ("evaluated", "invalid", "not_evaluated")], F.avg(r).alias("mean"), F.median(r).alias("median"), F.percentile(r, 0.95).alias("p95"), F.max(r).alias("most"))


def geometry_summary(points: DataFrame, radius: float, sparse: int, most_connected: int) -> DataFrame:
    """Per entity of points (entity, point, x, y, z): n, the centroid kept within the bounds, the bounds, volume, density (null of flat ones), pieces
    linked within ``radius`` and the share of the largest, and the diagnostics sparse, connectivity_not_computed (more than
    ``most_connected`` points: pieces are null), disconnected and flat, sorted."""
    box = [f(F.col(a)).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))]
    whole = points.groupBy("entity").agg(F.count("*").alias("n"), *[F.avg(a).alias(f"_{a}") for a in AXES], *box)
    counted = points.join(whole.filter(F.col("n") <= most_connected).select("entity").hint("merge"), "entity", "left_semi")
    links = within_radius(counted, counted, radius, AXES, group="entity").filter("centre < point").select(F.col("centre").alias("a"), F.col("point").alias("b"))
    piece = components(counted.select(F.col("point").alias("node")), links)
    sizes = counted.join(piece.hint("merge"), counted["point"] == piece["node"]).groupBy("entity", "component").agg(F.count("*").alias("k")).groupBy("entity").agg(F.count("*").alias("pieces"), F.max("k").alias("_largest"))
    rows = whole.join(sizes.hint("merge"), "entity", "left")
    extent = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES]
    volume = extent[0] * extent[1] * extent[2]
    kinds = F.array_sort(F.array_compact(F.array(F.when(F.col("n") < sparse, "sparse"), F.when(F.col("pieces").isNull(), "connectivity_not_computed"), F.when(F.col("pieces") > 1, "disconnected"), F.when(F.least(*extent) == 0, "flat"))))
    centroid = [F.least(F.greatest(F.col(f"_{a}"), F.col(f"min_{a}")), F.col(f"max_{a}")).alias(f"c{a}") for a in AXES]
    return rows.select("entity", "n", *centroid, *[f"{m}_{a}" for a in AXES for m in ("min", "max")], volume.alias("volume"), F.when(volume > 0, F.col("n") / volume).alias("density"), "pieces", (F.col("_largest") / F.col("n")).alias("largest_share"), kinds.alias("diagnostics"))


def stances(claims: DataFrame) -> DataFrame:
    """(support, key, stance, claims, observations): how the claims of a support (support, observation, contribution, key, role; a null key abstains)
    stand to each of its hypotheses: supporting; ambiguous, where the contribution supports it too or the claim is an alternative;
    conflicting; abstaining. Hypotheses of one support are few, and claims meet them by the support."""
    keyed = claims.filter("key IS NOT NULL")
    known = keyed.groupBy("support", "key").agg(F.count("*").alias("_n")).select("support", F.col("key").alias("hypothesis"))
    backing = keyed.select("support", F.col("key").alias("hypothesis"), "contribution", F.lit(True).alias("_too")).distinct()
    # claims alike are counted before they meet the hypotheses
    alike = claims.groupBy("support", "observation", "contribution", "key", "role").agg(F.count("*").alias("_k"))
    rows = alike.join(known, "support").join(backing, ["support", "hypothesis", "contribution"], "left")
    stance = F.when(F.col("key").isNull(), "abstaining").when(F.col("key") == F.col("hypothesis"), "supporting").when(F.col("_too") | (F.col("role") == "alternative"), "ambiguous").otherwise("conflicting")
    return rows.groupBy("support", F.col("hypothesis").alias("key"), stance.alias("stance")).agg(F.sum("_k").alias("claims"), F.countDistinct("observation").alias("observations"))


def temporal_channel(pairs: DataFrame, spans: DataFrame, frames: DataFrame, static_scene: bool) -> DataFrame:
    """(a, b, overlap, gap, shared, together, status): of two entities' spans (entity, clock, first_t, last_t) the overlap and gap, and of their frames
    (entity, frame) how many they share and have. On different clocks it is unavailable; in a static scene a shared frame conflicts."""
    side = lambda df, n: df.select(F.col("entity").alias(n), *[F.col(c).alias(f"_{n}_{c}") for c in df.columns if c != "entity"])
    counted = frames.select("entity", "frame").distinct()
    sizes = counted.groupBy("entity").agg(F.count("*").alias("n"))
    shared = pairs.select("a", "b").join(side(counted, "a").withColumnRenamed("_a_frame", "frame"), "a").join(side(counted, "b").withColumnRenamed("_b_frame", "frame"), ["b", "frame"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    rows = pairs.select("a", "b").join(side(spans.join(sizes, "entity", "left"), "a"), "a").join(side(spans.join(sizes, "entity", "left"), "b"), "b").join(shared, ["a", "b"], "left").fillna(0, ["shared", "_a_n", "_b_n"])
    same = F.col("_a_clock") == F.col("_b_clock")
    late, early = F.greatest("_a_first_t", "_b_first_t"), F.least("_a_last_t", "_b_last_t")
    zero = F.lit(0).cast("long")
    of = lambda x: F.when(same, x)
    status = F.when(~same, "unavailable").when(F.lit(static_scene) & (F.col("shared") >= 1), "conflicts").otherwise("neutral")
    return rows.select("a", "b", of(F.greatest(early - late, zero)).alias("overlap"), of(F.greatest(late - early, zero)).alias("gap"), of(F.col("shared")).alias("shared"), of(F.col("_a_n") + F.col("_b_n") - F.col("shared")).alias("together"), status.alias("status"))


def segmentation_accuracy(predicted: DataFrame, targets: DataFrame, match: float) -> DataFrame:
    """Per frame of masks as pixels (frame, region, row, col): targets, predictions, the mean over targets of the best IoU and Dice, the share of targets
    found at ``match``, of target pixels covered, and by prediction over- and under-segmentation and duplicates. Overlaps are counted by
    an equi-join on pixels; regions that share none do not meet. Frames without a target are left out."""
    p, t = (df.select("frame", F.col("region").alias(n), "row", "col").distinct() for df, n in ((predicted, "p"), (targets, "t")))
    size = lambda df, n: df.groupBy("frame", n).agg(F.count("*").alias(f"n{n}"))
    met = p.join(t, ["frame", "row", "col"])
    both = met.groupBy("frame", "p", "t").agg(F.count("*").alias("c")).join(size(p, "p"), ["frame", "p"]).join(size(t, "t"), ["frame", "t"])
    both = both.withColumns({"iou": F.col("c") / (F.col("np") + F.col("nt") - F.col("c")), "dice": 2 * F.col("c") / (F.col("np") + F.col("nt"))})
    by_t = size(t, "t").join(both.groupBy("frame", "t").agg(F.max("iou").alias("iou"), F.max("dice").alias("dice"), F.count("*").alias("k")), ["frame", "t"], "left")
    per_t = by_t.groupBy("frame").agg(F.count("*").alias("targets"), F.avg(F.coalesce("iou", F.lit(0.0))).alias("mean_iou"), F.avg(F.coalesce("dice", F.lit(0.0))).alias("mean_dice"), F.avg((F.coalesce("iou", F.lit(0.0)) >= match).cast("int")).alias("recall"), F.sum(F.greatest(F.coalesce("k", F.lit(0)) - 1, F.lit(0))).alias("_over"))
    best = both.groupBy("frame", "p").agg(F.min(F.struct((-F.col("iou")).alias("i"), "t")).alias("m"), F.count("*").alias("k"))
    per_p = best.groupBy("frame").agg(F.count_if(F.col("k") > 1).alias("_under"), (F.count("*") - F.countDistinct("m.t")).alias("_again"))
    n_p = size(p, "p").groupBy("frame").agg(F.count("*").alias("predictions"))
    pixels = lambda df, n: df.select("frame", "row", "col").distinct().groupBy("frame").agg(F.count("*").alias(n))
    rows = per_t.join(n_p, "frame", "left").join(per_p, "frame", "left").join(pixels(met, "_hit"), "frame", "left").join(pixels(t, "_all"), "frame").fillna(0, ["predictions", "_under", "_again", "_hit"])
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("predictions")), F.lit(0.0))
    return rows.select("frame", "targets", "predictions", "mean_iou", "mean_dice", "recall", (F.col("_hit") / F.col("_all")).alias("coverage"), rate("_over").alias("over"), rate("_under").alias("under"), rate("_again").alias("duplicates"))


#: States from the surest to the least.
RANK = ("unambiguous", "ambiguous", "conflicting", "insufficient")


def against_decisions(found: DataFrame, apart: DataFrame) -> DataFrame:
    """(a, b, component), a < b, of the pairs (a, b) decided distinct that one component of ``found`` (node, component) holds."""
    of = lambda n: found.select(F.col("node").alias(n), F.col("component").alias(f"_{n}")).hint("merge")
    pairs = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(of("a"), "a").join(of("b"), "b").filter("_a = _b").select("a", "b", F.col("_a").alias("component"))


def resolve_components(entities: DataFrame, found: DataFrame, against: DataFrame, geometry: DataFrame) -> DataFrame:
    """The resolved entities of ``resolve_entities``, of components (node, component) that are known and the pairs within them that are
    decided distinct (``against_decisions``). No join is a broadcast."""
    bad = against.select("component").distinct().withColumn("withheld", F.lit(True))
    grouped = found.join(bad.hint("merge"), "component", "left").withColumn("withheld", F.coalesce("withheld", F.lit(False)))
    grouped = grouped.select(F.col("node").alias("entity"), F.when(F.col("withheld"), F.col("node")).otherwise(F.col("component")).alias("resolved"), "withheld").hint("merge")
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("state"))
    said = entities.join(grouped, "entity").groupBy("resolved").agg(F.count("*").alias("members"), F.array_sort(F.collect_set("label")).alias("labels"), F.max(rank).alias("_rank"), F.max("withheld").alias("withheld"))
    refs = geometry.join(grouped, "entity").groupBy("resolved", "index").agg(F.count("*").alias("k")).groupBy("resolved").agg(F.count("*").alias("geometry"), F.sum(F.col("k") - 1).alias("repeats"))
    worst = F.greatest(F.col("_rank"), F.when(F.size("labels") > 1, 2).otherwise(1))
    out = said.join(refs.hint("merge"), "resolved", "left").fillna(0, ["geometry", "repeats"])
    return out.select("resolved", "members", "geometry", "repeats", "labels", F.get(F.array(*map(F.lit, RANK)), (worst - 1).cast("int")).alias("state"), "withheld")


def resolve_entities(entities: DataFrame, decisions: DataFrame, geometry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, contradictions) of entities (entity, label, state) by decisions (a, b, decision) and their geometry (entity, index).

    Entities that matches connect are one, unless a pair of them is decided distinct: then the shortest chain of matches between the two
    is recorded (a, b, component, path) and the component falls apart into single ones. Resolved: resolved (the first member), members,
    geometry and repeats (references and how many more the members had), labels, state (the worst of the members', and ambiguous at
    least where they have several labels) and withheld."""
    matches = decisions.filter("decision = 'match'").select("a", "b")
    found = components(entities.select(F.col("entity").alias("node")), matches)
    against = against_decisions(found, decisions.filter("decision = 'distinct'"))
    contradictions = against.join(shortest_paths(matches, against.select("a", "b")), ["a", "b"])
    return resolve_components(entities, found, against, geometry), contradictions


def transform_points(points: DataFrame, poses: DataFrame) -> DataFrame:
    """``points`` (scan, x, y, z, ...) with their places on the map (mx, my, mz) by the rigid poses (scan, qx, qy, qz, qw, tx, ty, tz); the places they
    came with stay. Points that are not finite, before or after, go."""
    from cairn.functions.geometry import rotated
    from cairn.operators.assembly import finite

    rows = points.join(poses, "scan")
    moved = rotated(tuple(F.col(c) for c in ("qx", "qy", "qz", "qw")), tuple(F.col(a) for a in AXES))
    rows = rows.withColumns({f"m{a}": m + F.col(f"t{a}") for a, m in zip(AXES, moved, strict=True)})
    whole: Column = F.lit(True)
    for c in (*AXES, *[f"m{a}" for a in AXES]):
        whole &= finite(F.col(c))
    return rows.filter(whole).select(*points.columns, *[f"m{a}" for a in AXES])


def pooled_feature(cells: DataFrame, normalize: bool) -> DataFrame:
    """Per region of weighted cells (region, weight, vector; a null vector is a cell without features): the weighted mean of the vectors, at length one
    if asked, and the share of the weight that had features; null where it had none."""
    total = cells.groupBy("region").agg(F.sum("weight").alias("_all"), F.coalesce(F.sum(F.when(F.col("vector").isNotNull(), F.col("weight"))), F.lit(0.0)).alias("_had"))
    each = cells.select("region", "weight", F.posexplode("vector").alias("_i", "_x")).groupBy("region", "_i").agg((F.sum(F.col("weight") * F.col("_x")) / F.sum("weight")).alias("_x"))
    mean = each.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("vector"))
    if normalize:
        n = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        mean = mean.withColumn("_n", n).withColumn("vector", F.when(F.col("_n") > 0, F.transform("vector", lambda x: x / F.col("_n")))).drop("_n")
    return total.join(mean, "region", "left").select("region", "vector", (F.col("_had") / F.col("_all")).alias("coverage"))


def sync_offsets(matched: DataFrame, modality: str) -> DataFrame:
    """Per modality of matched candidates (offset): how many, and the least, largest and mean offset."""
    return matched.filter("status = 'matched'").groupBy(modality).agg(F.count("*").alias("n"), F.min("offset").alias("least"), F.max("offset").alias("most"), F.avg("offset").alias("mean"))


def evidence_by_run(results: DataFrame) -> DataFrame:
    """(observation, runs, problem): the results (observation, sequence, run, result) of each observation by run, a map; a run that has two for one,
    or results of different sequences, is a problem. Results without a run are one run's, with an empty name."""
    own = results.groupBy("observation", F.coalesce("run", F.lit("")).alias("run")).agg(F.count("*").alias("_n"), F.min("result").alias("result"), F.min("sequence").alias("_lo"), F.max("sequence").alias("_hi"))
    problem = F.when(F.min("_lo") != F.max("_hi"), "several_sequences").when(F.max("_n") > 1, "several_results")
    return own.groupBy("observation").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "result")))).alias("runs"), problem.alias("problem"))
