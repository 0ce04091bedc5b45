"""From scans to a map: which scans are used and why others are not, poses checked, points accumulated and read in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import AXES

#: The reasons for which a scan is left out, in the order in which they are looked at.
REJECTIONS = (
    "missing_source_frame", "missing_clock_identity", "missing_payload", "unsupported_layout", "inconsistent_motion_correction",
    "motion_correction_rejected", "no_static_transform", "clock_domain_mismatch", "pose_lookup_rejected",
)

#: What a run does with a scan by its declared state of correction; others are rejected.
DISPOSITIONS = {"corrected": "accept", "not_required": "accept", "unknown": "warn"}


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def assemble(scans: DataFrame, poses: DataFrame, extrinsics: DataFrame, declared: DataFrame, *, body: str, clock: str, formats: tuple[str, ...], dispositions: dict[str, str] = DISPOSITIONS) -> DataFrame:
    """Each scan with its pose, extrinsic and state of correction, and ``rejection``, the first reason against it, null where it is
    used; ``warning`` where the state is only tolerated. All scans stay.

    ``scans``: scan, frame, clock, t, n_points, format; ``poses``: scan, pose, status (of a lookup: exact, found or interpolated are
    good); ``extrinsics``: frame, extrinsic, from the frame to the body; ``declared``: scan, state, corrected_t (null unless
    corrected). A state that is corrected without a time, or has one without being so, is inconsistent; none is unknown."""
    rows = scans.join(declared.select("scan", "state", "corrected_t"), "scan", "left").join(poses.select("scan", "pose", F.col("status").alias("_found")), "scan", "left")
    rows = rows.join(extrinsics.select("frame", "extrinsic"), "frame", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    policy = F.create_map(*[F.lit(x) for kv in dispositions.items() for x in kv])
    disposition = F.coalesce(policy[F.col("state")], F.lit("reject"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    tests = (
        blank("frame"), blank("clock"), F.coalesce("n_points", F.lit(0)) <= 0, ~F.coalesce(F.col("format").isin(*formats), F.lit(False)), (F.col("state") == "corrected") != F.col("corrected_t").isNotNull(),
        disposition == "reject", (F.col("frame") != body) & F.col("extrinsic").isNull(), F.col("clock") != clock, ~F.coalesce(F.col("_found").isin("exact", "found", "interpolated"), F.lit(False)),
    )
    rejection = F.coalesce(*[F.when(test, reason) for test, reason in zip(tests, REJECTIONS, strict=True)])
    return rows.withColumn("rejection", rejection).withColumn("warning", F.col("rejection").isNull() & (disposition == "warn")).drop("_found")


def check_poses(poses: DataFrame, tolerance: float, max_gap: int | None = None) -> DataFrame:
    """``poses`` (trajectory, t, x, y, z, qx, qy, qz, qw) with ``problem``, the first of non_finite_translation, invalid_orientation (not
    finite, zero, or off unit length by more than ``tolerance``) and non_increasing_time; the orientation of the others at unit
    length, ``renormalized`` where it was not within 1e-9; and ``gap``, whether the good pose before is more than ``max_gap`` earlier."""
    translation = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    turn = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
    norm = F.sqrt(turn[0] * turn[0] + turn[1] * turn[1] + turn[2] * turn[2] + turn[3] * turn[3])
    upright = finite(norm) & (norm > 0) & (F.abs(norm - 1) <= tolerance)
    own = Window.partitionBy("trajectory")
    good = F.when(translation & upright, F.col("t"))
    before = F.max(good).over(own.orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    same = F.row_number().over(Window.partitionBy("trajectory", "t").orderBy(F.when(translation & upright, 0).otherwise(1), *AXES)) > 1
    problem = F.when(~translation, "non_finite_translation").when(~F.coalesce(upright, F.lit(False)), "invalid_orientation").when(same, "non_increasing_time")
    rows = poses.withColumn("problem", problem).withColumn("_before", before).withColumn("_norm", norm)
    ok = F.col("problem").isNull()
    rows = rows.withColumns({c: F.when(ok, F.col(c) / F.col("_norm")).otherwise(F.col(c)) for c in ("qx", "qy", "qz", "qw")})
    gap = F.lit(False) if max_gap is None else F.coalesce(F.col("t") - F.col("_before") > max_gap, F.lit(False))
    return rows.withColumn("renormalized", ok & (F.abs(F.col("_norm") - 1) > 1e-9)).withColumn("gap", ok & gap).drop("_before", "_norm")


def accumulate(scans: DataFrame, points: DataFrame) -> DataFrame:
    """The scans of a map (map, scan, frame, clock, t) in the order of time and id with ``ordinal``, ``first`` and ``n``, the range of places
    that their points (map, scan, x, y, z) have in it, and their bounds, null for scans without points. Points that are
    not finite are dropped and counted."""
    whole = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    box = [f(F.when(whole, F.col(a))).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))]
    summed = points.groupBy("map", "scan").agg(F.count_if(whole).alias("n"), F.count_if(~whole).alias("dropped"), *box)
    rows = scans.join(summed, ["map", "scan"], "left").fillna(0, ["n", "dropped"])
    order = Window.partitionBy("map").orderBy("t", "scan")
    first = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return rows.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).withColumn("first", first)


def map_summary(records: DataFrame) -> DataFrame:
    """Per map: scans with points, points, points dropped, bounds and time bounds of the scans with points, and ``problem``: duplicate_scan,
    mixed_frames, mixed_clocks or empty, the first that holds; null for a good map."""
    some = F.col("n") > 0
    box = [f(F.col(f"{n}_{a}")).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))]
    repeated = records.groupBy("map", "scan").agg(F.count("*").alias("k")).groupBy("map").agg((F.max("k") > 1).alias("_twice"))
    out = records.groupBy("map").agg(
        F.count_if(some).alias("scans"), F.sum("n").alias("points"), F.sum("dropped").alias("dropped"), *box, F.min(F.when(some, F.col("t"))).alias("first_t"), F.max(F.when(some, F.col("t"))).alias("last_t"),
        (F.min("frame") != F.max("frame")).alias("_frames"), (F.min("clock") != F.max("clock")).alias("_clocks"),
    )
    problem = F.when(F.col("_twice"), "duplicate_scan").when(F.col("_frames"), "mixed_frames").when(F.col("_clocks"), "mixed_clocks").when(F.col("points") == 0, "empty")
    return out.join(repeated, "map").withColumn("problem", problem).drop("_frames", "_clocks", "_twice")


def read_blocks(points: DataFrame, records: DataFrame, block: int, box: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``points`` (map, scan, index, x, y, z) with ``block``, the number of their block of ``block`` points within their scan: all of them, or
    those in a box, bounds included. Scans whose recorded bounds are apart from the box are not read; of those that lie
    in it no point is tested; blocks count from the scan's first place either way."""
    if block < 1:
        raise ValueError("a block has one point at least")
    kept = records.filter("n > 0")
    inside = F.lit(True)
    if box is not None:
        for a, (low, high) in box.items():
            kept = kept.filter((F.col(f"max_{a}") >= low) & (F.col(f"min_{a}") <= high))
            inside &= (F.col(f"min_{a}") >= low) & (F.col(f"max_{a}") <= high)
    zones = kept.select("map", "scan", F.col("first").alias("_first"), inside.alias("_inside"))
    rows = points.join(zones, ["map", "scan"])
    if box is not None:
        tests = [F.col(a).between(low, high) for a, (low, high) in box.items()]
        one = tests[0]
        for t in tests[1:]:
            one &= t
        rows = rows.filter(F.col("_inside") | one)
    return rows.withColumn("block", F.expr(f"(index - _first) div {block}")).drop("_first", "_inside")


def check_transforms(transforms: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``transforms`` (name, r array of nine numbers by rows, t array of three) with ``problem``: not_finite, not_orthonormal, mirrored
    (determinant -1) or no_inverse, the first that holds, and ``error``, by how much R'R differs from one at most."""
    r = lambda i, j: F.col("r")[3 * i + j]
    whole = (F.size("r") == 9) & (F.size("t") == 3) & F.forall(F.concat("r", "t"), finite)
    products = [F.abs(sum((r(k, i) * r(k, j) for k in (1, 2)), r(0, i) * r(0, j)) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)]
    error = F.greatest(*products)
    det = r(0, 0) * (r(1, 1) * r(2, 2) - r(1, 2) * r(2, 1)) - r(0, 1) * (r(1, 0) * r(2, 2) - r(1, 2) * r(2, 0)) + r(0, 2) * (r(1, 0) * r(2, 1) - r(1, 1) * r(2, 0))
    # the inverse of x -> R x + t is x -> R'(x - t): their round trip moves the origin by (R'R - 1) t at most
    back = F.greatest(*[F.abs(sum((r(k, i) * (sum((r(k, j) * F.col("t")[j] for j in (1, 2)), r(k, 0) * F.col("t")[0])) for k in (1, 2)), r(0, i) * sum((r(0, j) * F.col("t")[j] for j in (1, 2)), r(0, 0) * F.col("t")[0])) - F.col("t")[i]) for i in range(3)])
    scale = 1 + F.aggregate("t", F.lit(0.0), lambda s, x: s + F.abs(x))
    rows = transforms.withColumn("error", F.when(whole, error))
    problem = F.when(~F.coalesce(whole, F.lit(False)), "not_finite").when(F.col("error") > tolerance, "not_orthonormal").when(F.abs(det - 1) > tolerance, "mirrored").when(back > tolerance * scale, "no_inverse")
    return rows.withColumn("problem", problem)
