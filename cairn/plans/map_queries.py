"""Scans assembled, checked, accumulated and read; poses, cameras, grids and frames, over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.geometry import Camera, project, rotated, slerp
from cairn.functions.scalars import quaternion_product, rotation_angle
from cairn.operators.assembly import accumulate, assemble, check_poses, check_transforms, map_summary, read_blocks
from cairn.operators.grids import build_observations, dense_samples, merge_regions
from cairn.operators.moments import descriptors, orientation
from cairn.plans.registry import query
from cairn.plans.tables import SQL_EIGEN, SQL_ENTITY_POINTS, SQL_EVENTS, SQL_POINTS, entity_points, events, load, micros, points
from cairn.plans.time_queries import _PLACED, HOUR, _placed

# suppliers' scans on one map for each nation; items are the points, numbered within their scan
_SQL_SCANS = f"""{SQL_POINTS}, sc AS (SELECT s_nationkey::BIGINT AS map, s_suppkey AS scan, epoch_us(min_t) AS t FROM supplier JOIN (SELECT l_suppkey, min(l_shipdate) AS min_t FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
sp AS (SELECT map, scan, point, x, y, z FROM points JOIN sc USING (scan)),
sn AS (SELECT map, scan, sc.t, count(point) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM sc JOIN sp USING (map, scan) GROUP BY ALL),
sr AS (SELECT *, row_number() OVER w - 1 AS ordinal, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM sn WINDOW w AS (PARTITION BY map ORDER BY t, scan)),
si AS (SELECT sp.*, first + row_number() OVER (PARTITION BY map, scan ORDER BY point, x, y, z) - 1 AS index FROM sp JOIN sr USING (map, scan))"""


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = points(spark, sf_dir)
    start = items.groupBy("scan").agg(F.min("t").alias("t"))
    maps = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("scan"), F.col("s_nationkey").cast("long").alias("map"))
    scans = start.join(maps, "scan").withColumns({"frame": F.lit("map"), "clock": F.lit("clock")})
    return scans, items.join(maps, "scan").select("map", "scan", "point", "x", "y", "z")


@query("d3_accumulation", f"WITH {_SQL_SCANS} SELECT map, scan, ordinal, first, n::BIGINT AS n, min_x, max_x, min_y, max_y, min_z, max_z FROM sr")
def d3_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans in the order of time, with the range of places that their points have in the map."""
    scans, items = _scans(spark, sf_dir)
    return accumulate(scans, items).select("map", "scan", "ordinal", "first", "n", *[f"{m}_{a}" for a in "xyz" for m in ("min", "max")])


@query("d3_map_summary", f"WITH {_SQL_SCANS} SELECT map, count(*)::BIGINT AS scans, sum(n)::BIGINT AS points, min(min_x) AS min_x, max(max_x) AS max_x, min(t) AS first_t, max(t) AS last_t, NULL::VARCHAR AS problem FROM sr GROUP BY 1")
def d3_map_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_summary(accumulate(*_scans(spark, sf_dir))).select("map", "scans", "points", "min_x", "max_x", "first_t", "last_t", "problem")


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    scans, items = _scans(spark, sf_dir)
    records = accumulate(scans, items)
    nth = F.row_number().over(Window.partitionBy("map", "scan").orderBy("point", "x", "y", "z")) - 1
    return items.withColumn("_nth", nth).join(records.select("map", "scan", "first"), ["map", "scan"]).withColumn("index", (F.col("first") + F.col("_nth")).cast("long")).drop("first", "_nth"), records


@query("a10_block_scan", f"WITH {_SQL_SCANS} SELECT map, block, count(*)::BIGINT AS n, min(index) AS low, max(index) AS high FROM (SELECT si.map, si.scan, si.index, (si.index - sr.first) // 64 AS block FROM si JOIN sr USING (map, scan) WHERE x BETWEEN 10 AND 30 AND y BETWEEN 2 AND 6) GROUP BY map, scan, block")
def a10_block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box read in blocks of 64: scans apart from it are skipped by their bounds."""
    items, records = _indexed(spark, sf_dir)
    rows = read_blocks(items, records, 64, {"x": (10.0, 30.0), "y": (2.0, 6.0)})
    return rows.groupBy("map", "scan", "block").agg(F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high")).select("map", "block", "n", "low", "high")


_SQL_REASONS = """CASE WHEN coalesce(frame, '') = '' THEN 'missing_source_frame' WHEN coalesce(clock, '') = '' THEN 'missing_clock_identity' WHEN n <= 0 THEN 'missing_payload' WHEN format NOT IN ('small ring', 'red widget', 'blue bolt', 'small bolt', 'red ring', 'blue widget') THEN 'unsupported_layout'
  WHEN (state = 'corrected') <> (corrected_t IS NOT NULL) THEN 'inconsistent_motion_correction' WHEN state NOT IN ('corrected', 'not_required', 'unknown') THEN 'motion_correction_rejected' WHEN frame <> 'body' AND extrinsic IS NULL THEN 'no_static_transform' WHEN clock <> 'AUTOMOBILE' THEN 'clock_domain_mismatch' WHEN coalesce(found, '') <> 'found' THEN 'pose_lookup_rejected' END"""


@query(
    "c4_scan_assembly",
    f"""WITH o AS (SELECT o_orderkey AS scan, CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN c_acctbal > 0 THEN 'body' ELSE n_name END AS frame, nullif(c_mktsegment, 'HOUSEHOLD') AS clock, epoch_us(o_orderdate) AS t, o_orderstatus, o_totalprice, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
i AS (SELECT l_orderkey, count(*) AS n, min(p_name) AS format FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
d AS (SELECT scan, CASE o_orderstatus WHEN 'F' THEN 'corrected' WHEN 'P' THEN 'uncorrected' ELSE 'unknown' END AS state, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 20000 THEN t END AS corrected_t FROM o WHERE o_totalprice > 10000),
r AS (SELECT o.scan, o.frame, clock, coalesce(n, 0) AS n, format, coalesce(state, 'unknown') AS state, corrected_t, CASE WHEN n_nationkey < 12 THEN n_nationkey END AS extrinsic, CASE WHEN o_custkey % 5 <> 0 THEN 'found' ELSE 'out_of_range' END AS found FROM o LEFT JOIN i ON l_orderkey = scan LEFT JOIN d USING (scan) LEFT JOIN nation ON n_name = frame AND n_nationkey < 12)
SELECT scan, state, {_SQL_REASONS} AS rejection, {_SQL_REASONS} IS NULL AND state = 'unknown' AS warning FROM r""",
)
def c4_scan_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scans, their items the payload, customers their mounting; all nine reasons in their order."""
    orders, customers, nations = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"), load(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), load(spark, sf_dir, "nation", "n_nationkey", "n_name")
    o = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    frame = F.when(F.col("o_orderkey") % 37 == 0, None).when(F.col("c_acctbal") > 0, "body").otherwise(F.col("n_name"))
    o = o.select(F.col("o_orderkey").alias("scan"), frame.alias("frame"), F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("clock"), micros("o_orderdate").alias("t"), "o_orderstatus", "o_totalprice", "o_custkey")
    items = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").join(load(spark, sf_dir, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("scan")).agg(F.count("*").alias("n_points"), F.min("p_name").alias("format"))
    status = F.col("o_orderstatus")
    declared = o.filter("o_totalprice > 10000").select("scan", F.when(status == "F", "corrected").when(status == "P", "uncorrected").otherwise("unknown").alias("state"), F.when((status == "F") & (F.col("o_totalprice") > 20000), F.col("t")).alias("corrected_t"))
    poses = o.select("scan", F.col("scan").alias("pose"), F.when(F.col("o_custkey") % 5 != 0, "found").otherwise("out_of_range").alias("status"))
    extrinsics = nations.filter("n_nationkey < 12").select(F.col("n_name").alias("frame"), F.col("n_nationkey").alias("extrinsic"))
    scans = o.select("scan", "frame", "clock", "t").join(items, "scan", "left")
    found = assemble(scans, poses, extrinsics, declared, body="body", clock="AUTOMOBILE", formats=("small ring", "red widget", "blue bolt", "small bolt", "red ring", "blue widget"))
    return found.select("scan", "state", "rejection", "warning")


@query(
    "b6_pose_check",
    f"""WITH {SQL_EVENTS}, p AS (SELECT clock AS trajectory, event_id, t, CASE WHEN value > 60 THEN 'inf'::DOUBLE ELSE value END AS x, sin(value / 20) * CASE WHEN modality = 'error' THEN 1.2 ELSE 1.0001 END AS qz, cos(value / 20) * CASE WHEN modality = 'error' THEN 1.2 ELSE 1.0001 END AS qw FROM ev),
b AS (SELECT *, CASE WHEN isinf(x) THEN 'non_finite_translation' WHEN abs(sqrt(qz ** 2 + qw ** 2) - 1) > 0.001 THEN 'invalid_orientation' END AS problem FROM p),
g AS (SELECT *, max(CASE WHEN problem IS NULL THEN t END) OVER (PARTITION BY trajectory ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
SELECT event_id, problem, problem IS NULL AS renormalized, problem IS NULL AND coalesce(t - before > {24 * HOUR}, false) AS gap, round(CASE WHEN problem IS NULL THEN qz / sqrt(qz ** 2 + qw ** 2) END, 6) AS qz FROM g""",
)
def b6_pose_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as poses: the largest have no finite place, errors no unit orientation, the rest are brought to length one."""
    v, long = F.col("value"), F.when(F.col("modality") == "error", 1.2).otherwise(1.0001)
    poses = events(spark, sf_dir).select(F.col("clock").alias("trajectory"), "event_id", "t", F.when(v > 60, F.lit(float("inf"))).otherwise(v).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), (F.sin(v / 20) * long).alias("qz"), (F.cos(v / 20) * long).alias("qw"))
    found = check_poses(poses, 0.001, 24 * HOUR)
    return found.select("event_id", "problem", "renormalized", "gap", F.when(F.col("problem").isNull(), F.round("qz", 6)).alias("qz"))


@query(
    "b22_transform_preflight",
    """WITH t AS (SELECT p_partkey, p_size / 10.0 AS a, CASE WHEN p_size % 7 = 0 THEN 1.01::DOUBLE ELSE 1 END AS s, CASE WHEN p_size % 5 = 0 THEN -1.0 ELSE 1.0 END AS m, CASE WHEN p_size = 13 THEN 'nan'::DOUBLE ELSE p_retailprice END AS tx FROM part)
SELECT p_partkey AS name, CASE WHEN isnan(tx) THEN 'not_finite' WHEN s <> 1 THEN 'not_orthonormal' WHEN m < 0 THEN 'mirrored' END AS problem, CASE WHEN NOT isnan(tx) THEN round(abs(s * s - 1), 6) END AS error FROM t""",
)
def b22_transform_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns about z; some are stretched, some mirrored, some not finite."""
    size, a = F.col("p_size"), F.col("p_size") / 10.0
    s, m = F.when(size % 7 == 0, 1.01).otherwise(1.0), F.when(size % 5 == 0, -1.0).otherwise(1.0)
    zero = F.lit(0.0)
    r = F.array(s * F.cos(a), -s * F.sin(a), zero, s * F.sin(a), s * F.cos(a), zero, zero, zero, m * s)
    t = F.array(F.when(size == 13, F.lit(float("nan"))).otherwise(F.col("p_retailprice")), zero, zero)
    return check_transforms(load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select(F.col("p_partkey").alias("name"), r.alias("r"), t.alias("t"))).select("name", "problem", F.round("error", 6).alias("error"))


@query(
    "c3_pose_interpolation",
    _PLACED
    + f""", k1 AS (SELECT *, CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END AS s, cos(v0 / 20) * cos(v1 / 20) + sin(v0 / 20) * sin(v1 / 20) AS dot FROM p WHERE t0 IS NOT NULL AND t1 IS NOT NULL AND t1 - t0 <= {72 * HOUR}),
k2 AS (SELECT *, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS f, abs(dot) AS d FROM k1), k3 AS (SELECT *, CASE WHEN d > 0.9995 THEN 1 - s ELSE sin((1 - s) * acos(d)) / sin(acos(d)) END AS wa, CASE WHEN d > 0.9995 THEN s ELSE sin(s * acos(d)) / sin(acos(d)) END AS wb FROM k2),
k4 AS (SELECT *, wa * sin(v0 / 20) + wb * f * sin(v1 / 20) AS qz, wa * cos(v0 / 20) + wb * f * cos(v1 / 20) AS qw FROM k3) SELECT query_id, round(v0 + (v1 - v0) * s, 6) AS x, round(qz / sqrt(qz ** 2 + qw ** 2), 5) AS qz, round(qw / sqrt(qz ** 2 + qw ** 2), 5) AS qw FROM k4""",
)
def c3_pose_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places along the line, orientations along the shorter arc, between the poses about an instant."""
    rows = _placed(spark, sf_dir).filter(F.col("t0").isNotNull() & F.col("t1").isNotNull() & (F.col("t1") - F.col("t0") <= 72 * HOUR))
    share = F.when(F.col("t1") > F.col("t0"), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    turn = lambda v: (F.lit(0.0), F.lit(0.0), F.sin(F.col(v) / 20), F.cos(F.col(v) / 20))
    _, _, qz, qw = slerp(turn("v0"), turn("v1"), F.col("share"))
    return rows.withColumn("share", share).select("query_id", F.round(F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("share"), 6).alias("x"), F.round(qz, 5).alias("qz"), F.round(qw, 5).alias("qw"))


@query(
    "e1_pose_deltas",
    f"""WITH {SQL_EVENTS}, l AS (SELECT event_id, t - lag(t) OVER w AS dt, value, lag(value) OVER w AS v0 FROM ev WINDOW w AS (PARTITION BY clock ORDER BY t, event_id)),
q AS (SELECT *, sqrt((value - v0) ** 2 + (value / 2 - v0 / 2) ** 2) AS distance, abs(cos(v0 / 20) * cos(value / 20) + sin(v0 / 20) * sin(value / 20)) AS w, abs(cos(v0 / 20) * sin(value / 20) - sin(v0 / 20) * cos(value / 20)) AS s FROM l WHERE dt IS NOT NULL)
SELECT event_id, dt, round(distance, 6) AS distance, round(2 * atan2(s, w), 6) AS angle, CASE WHEN dt > 0 THEN round(2 * atan2(s, w) / dt * 1e9, 5) END AS turn_rate FROM q""",
)
def e1_pose_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far and by what angle each pose is from the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("clock").orderBy("t", "event_id")
    rows = events(spark, sf_dir).select("event_id", "value", (F.col("t") - F.lag("t").over(w)).alias("dt"), F.lag("value").over(w).alias("v0")).filter("dt IS NOT NULL")
    turn = lambda v, sign: (F.lit(0.0), F.lit(0.0), sign * F.sin(F.col(v) / 20), F.cos(F.col(v) / 20))
    angle = rotation_angle(quaternion_product(turn("v0", -1), turn("value", 1)))
    step = F.sqrt((F.col("value") - F.col("v0")) ** 2 + (F.col("value") / 2 - F.col("v0") / 2) ** 2)
    return rows.select("event_id", "dt", F.round(step, 6).alias("distance"), F.round(angle, 6).alias("angle"), F.when(F.col("dt") > 0, F.round(angle / F.col("dt") * 1e9, 5)).alias("turn_rate"))


@query("d17_orientation", f"WITH {SQL_ENTITY_POINTS}, {SQL_EIGEN('ep', 'entity', 'eo_')}, r AS (SELECT *, CASE WHEN n < 5 THEN 'too_few_points' WHEN NOT (e1 > 0 AND (e2 <= 0 OR e1 / greatest(e2, 0) >= 2) AND e2 > 0 AND (e3 <= 0 OR e2 / greatest(e3, 0) >= 2)) THEN 'not_distinct' END AS reason FROM eo_) SELECT entity, n::BIGINT AS n, round(greatest(e1, 0), 4) AS e1, CASE WHEN reason IS NULL THEN round(a1x, 4) + 0.0 END AS a1x, CASE WHEN reason IS NULL THEN round(a1z, 4) + 0.0 END AS a1z, CASE WHEN reason IS NULL THEN round(a2z, 3) + 0.0 END AS a2z, CASE WHEN reason IS NULL THEN round(a1x * a2y - a1y * a2x, 3) + 0.0 END AS a3z, reason FROM r")
def d17_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orientation(entity_points(spark, sf_dir), "entity", 5, 2.0)
    return found.select("entity", "n", F.round("e1", 4).alias("e1"), *[(F.round(c, k) + F.lit(0.0)).alias(c) for c, k in (("a1x", 4), ("a1z", 4), ("a2z", 3), ("a3z", 3))], "reason")


@query(
    "d18_descriptor",
    f"""WITH {SQL_ENTITY_POINTS}, {SQL_EIGEN('ep', 'entity', 'eo_')}, o AS (SELECT entity, arg_min(x, point) AS ox, arg_min(y, point) AS oy, arg_min(z, point) AS oz FROM ep GROUP BY 1),
s AS (SELECT entity, max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) AS far, max(sqrt((x - ox) ** 2 + (y - oy) ** 2 + (z - oz) ** 2)) AS reach FROM ep JOIN eo_ USING (entity) JOIN o USING (entity) GROUP BY 1)
SELECT entity, n::BIGINT AS n, CASE WHEN reach > 0 THEN round(n / (4.0 / 3.0 * pi() * reach ** 3), 9) END AS density, round(sqrt(xx + yy + zz), 5) AS rms_radius, round(far, 5) AS max_radius, round((e1 - e2) / e1, 5) AS linearity, round((e2 - e3) / e1, 5) AS planarity, round(e3 / e1, 5) AS scattering,
  round(e3 / (e1 + e2 + e3), 5) AS surface_variation, CASE WHEN e1 - e2 > 0.001 * e1 THEN round(abs(a1x), 4) END AS axis_x, CASE WHEN e1 - e2 > 0.001 * e1 THEN round(abs(a1z), 4) END AS axis_z FROM eo_ JOIN s USING (entity)""",
)
def d18_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen features; the support's centre is its first point."""
    rows = entity_points(spark, sf_dir)
    centre = rows.groupBy("entity").agg(*[F.min_by(a, "point").alias(f"o{a}") for a in "xyz"])
    found = descriptors(rows.join(centre, "entity"), "entity")
    names = {"density": 9, "rms_radius": 5, "max_radius": 5, "linearity": 5, "planarity": 5, "scattering": 5, "surface_variation": 5, "axis_x": 4, "axis_z": 4}
    return found.select("entity", "n", *[F.round(c, k).alias(c) for c, k in names.items()])


_WIDE = Camera(30.0, 30.0, 320.0, 240.0, 640, 480, "fisheye", (0.05, -0.01, 0.002, 0.0))
_BENT = Camera(40.0, 42.0, 320.0, 240.0, 640, 480, "pinhole", (0.01, -0.001, 0.002, -0.001, 0.0001, 0.02, 0.0, 0.0))
_ROUND = Camera(60.0, 60.0, 320.0, 240.0, 640, 480, "unified", (0.02, 0.001, 0.001, -0.002), 0.8)
_SQL_CAMERA = f"{SQL_POINTS}, c AS (SELECT point, x - 25 AS x, y - 5 AS y, z - 2 AS z, sqrt((x - 25) ** 2 + (y - 5) ** 2 + (z - 2) ** 2) AS r FROM points)"
_SQL_STAGE = "CASE WHEN u IS NULL THEN 'outside_domain' WHEN u >= -0.5 AND u < 639.5 AND v >= -0.5 AND v < 479.5 THEN 'inside' ELSE 'outside_image' END AS stage"


def _seen(spark: SparkSession, sf_dir: str, camera: Camera) -> DataFrame:
    u, v, stage = project(camera, F.col("x") - 25, F.col("y") - 5, F.col("z") - 2)
    return points(spark, sf_dir).select("point", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"), stage.alias("stage"))


@query("h3_fisheye", f"WITH {_SQL_CAMERA}, t AS (SELECT *, sqrt(x * x + y * y) AS rho, atan2(sqrt(x * x + y * y), z) AS a FROM c), d AS (SELECT *, a * (1 + a * a * (0.05 + a * a * (-0.01 + a * a * 0.002))) AS b FROM t), p AS (SELECT point, CASE WHEN r > 0 AND a < pi() THEN 30.0 * CASE WHEN rho > 0 THEN b / rho ELSE 0 END * x + 320 END AS u, CASE WHEN r > 0 AND a < pi() THEN 30.0 * CASE WHEN rho > 0 THEN b / rho ELSE 0 END * y + 240 END AS v FROM d) SELECT point, round(u, 5) AS u, round(v, 5) AS v, {_SQL_STAGE} FROM p")
def h3_fisheye(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equidistant lens whose radius grows over all angles, so that only the centre itself has no pixel."""
    return _seen(spark, sf_dir, _WIDE)


@query("h3_distorted", f"WITH {_SQL_CAMERA}, n AS (SELECT point, CASE WHEN z > 1e-9 * r THEN x / z END AS x, CASE WHEN z > 1e-9 * r THEN y / z END AS y FROM c), d AS (SELECT *, x * x + y * y AS q FROM n), e AS (SELECT *, (1 + q * (0.01 + q * (-0.001 + q * 0.0001))) / (1 + q * 0.02) AS k FROM d), p AS (SELECT e.point, 40.0 * (e.x * k + 0.004 * e.x * e.y - 0.001 * (q + 2 * e.x * e.x)) + 320 AS u, 42.0 * (e.y * k + 0.002 * (q + 2 * e.y * e.y) - 0.002 * e.x * e.y) + 240 AS v FROM e) SELECT point, round(u, 5) AS u, round(v, 5) AS v, {_SQL_STAGE} FROM p")
def h3_distorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, _BENT)


@query("h3_unified", f"WITH {_SQL_CAMERA}, n AS (SELECT point, CASE WHEN z > (-0.8 + 1e-9) * r THEN x / (z + 0.8 * r) END AS x, CASE WHEN z > (-0.8 + 1e-9) * r THEN y / (z + 0.8 * r) END AS y FROM c), d AS (SELECT *, x * x + y * y AS q FROM n), e AS (SELECT *, 1 + 0.02 * q + 0.001 * q * q AS k FROM d), p AS (SELECT e.point, 60.0 * (e.x * k + 0.002 * e.x * e.y - 0.002 * (q + 2 * e.x * e.x)) + 320 AS u, 60.0 * (e.y * k + 0.001 * (q + 2 * e.y * e.y) - 0.004 * e.x * e.y) + 240 AS v FROM e) SELECT point, round(u, 5) AS u, round(v, 5) AS v, {_SQL_STAGE} FROM p")
def h3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, _ROUND)


@query(
    "h1_rigid_motion",
    f"""WITH {SQL_POINTS}, r AS (SELECT point, x, y, z, sin(s_nationkey / 10.0) * 0.6 AS qx, sin(s_nationkey / 10.0) * 0.8 AS qy, cos(s_nationkey / 10.0) AS qw FROM points JOIN supplier ON s_suppkey = scan)
SELECT point, round(x + 2 * (qw * qy * z + qx * qy * y - qy * qy * x), 6) + 0.0 AS x, round(y + 2 * (-qw * qx * z - qx * qx * y + qx * qy * x), 6) + 0.0 AS y, round(z + 2 * (qw * (qx * y - qy * x) - (qx * qx + qy * qy) * z), 6) + 0.0 AS z FROM r""",
)
def h1_rigid_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points turned by their scan's unit quaternion."""
    own = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("scan"), (F.col("s_nationkey") / 10.0).alias("h"))
    s = F.sin("h")
    found = rotated((s * 0.6, s * 0.8, F.lit(0.0), F.cos("h")), (F.col("x"), F.col("y"), F.col("z")))
    return points(spark, sf_dir).join(own, "scan").select("point", *[(F.round(c, 6) + F.lit(0.0)).alias(a) for c, a in zip(found, "xyz", strict=True)])


_SQL_GRID = """g AS (SELECT vec_id AS frame, (generate_subscripts(embedding, 1) - 1) // 8 AS row, (generate_subscripts(embedding, 1) - 1) % 8 AS col, unnest(embedding)::DOUBLE AS e FROM embeddings),
s AS (SELECT vec_id AS frame, k AS sample, (vec_id * 7 + k * 13) % 80 / 10.0 - 0.3 AS u, (vec_id * 3 + k * 5) % 80 / 10.0 - 0.3 AS v FROM embeddings, range(4) AS r(k))"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    cells = rows.select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "e")).select("frame", F.expr("i div 8").alias("row"), (F.col("i") % 8).cast("long").alias("col"), F.array(F.col("e").cast("double"), -F.col("e").cast("double")).alias("vector"))
    at = rows.select(F.col("vec_id").alias("frame"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("sample"))
    return at.select("frame", "sample", (((F.col("frame") * 7 + F.col("sample") * 13) % 80) / 10.0 - 0.3).alias("u"), (((F.col("frame") * 3 + F.col("sample") * 5) % 80) / 10.0 - 0.3).alias("v")), cells


@query(
    "d20_dense_bilinear",
    f"""WITH {_SQL_GRID}, c AS (SELECT *, floor(v) AS r0, floor(u) AS c0, v - floor(v) AS fr, u - floor(u) AS fc FROM s WHERE u BETWEEN 0 AND 7 AND v BETWEEN 0 AND 7),
w AS (SELECT frame, sample, r0 + dr AS row, c0 + dc AS col, CASE dr WHEN 0 THEN 1 - fr ELSE fr END * CASE dc WHEN 0 THEN 1 - fc ELSE fc END AS w FROM c, range(2) AS a(dr), range(2) AS b(dc)),
f AS (SELECT frame, sample, sum(w * e) AS e FROM w JOIN g USING (frame, row, col) WHERE w > 0 GROUP BY ALL) SELECT s.frame, s.sample, CASE WHEN e IS NULL THEN 'outside' ELSE 'sampled' END AS status, round(e, 6) AS first, round(-e, 6) AS second FROM s LEFT JOIN f USING (frame, sample)""",
)
def d20_dense_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, cells = _grid(spark, sf_dir)
    found = dense_samples(samples, cells, 8, 8, "bilinear")
    return found.select("frame", "sample", "status", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[1], 6).alias("second"))


@query("d20_dense_nearest", f"WITH {_SQL_GRID} SELECT s.frame, s.sample, CASE WHEN e IS NULL THEN 'outside' ELSE 'sampled' END AS status, round(e, 6) AS first FROM s LEFT JOIN g ON g.frame = s.frame AND g.row = floor(v + 0.5) AND g.col = floor(u + 0.5)")
def d20_dense_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, cells = _grid(spark, sf_dir)
    return dense_samples(samples, cells, 8, 8, "nearest").select("frame", "sample", "status", F.round(F.col("vector")[0], 6).alias("first"))


@query(
    "c10_region_observations",
    """WITH c AS (SELECT l_orderkey AS region, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS claims, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), f AS (SELECT l_orderkey AS region, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS features FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS region, coalesce(claims, '') AS claims, coalesce(features, '') AS features FROM orders LEFT JOIN c ON c.region = o_orderkey LEFT JOIN f ON f.region = o_orderkey""",
)
def c10_region_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are regions; some of their items are claims, some features; a region without either stays."""
    items = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    regions = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("region"))
    claims = items.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("region"), F.col("l_partkey").cast("string").alias("claim"))
    features = items.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("region"), F.col("l_suppkey").cast("string").alias("feature"))
    found = build_observations(regions, claims, features)
    return found.select("region", F.array_join("claims", ",").alias("claims"), F.array_join("features", ",").alias("features"))


@query("g9_region_merge")
def g9_region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a frame in the order of their ids; each joins the first before it that it agrees with. The order decides, which SQL has
    not: tested against a plain loop."""
    parts = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    x, y = F.col("p_size").cast("double"), (F.col("p_retailprice") - 900) % 10
    regions = parts.select(F.expr("p_partkey div 20").alias("frame"), F.col("p_partkey").alias("region"), x.alias("min_x"), y.alias("min_y"), (x + 20).alias("max_x"), (y + 4).alias("max_y"))
    return merge_regions(regions, 0.4, 0.9)
