"""Points, voxels, boxes and neighbourhoods over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.spatial_joins import box_pairs, dealt, gathered, min_filter, nearest_k, within_radius
from cairn.operators.voxel import cell_of, inter_scan_voxels, intra_scan_voxels
from cairn.plans.registry import query
from cairn.plans.tables import SQL_POINTS, load, points


@query(
    "d2_voxel_aggregation",
    f"""WITH {SQL_POINTS}, v AS (SELECT *, floor(x / 5)::BIGINT AS vx, floor(y / 5)::BIGINT AS vy, floor(z / 5)::BIGINT AS vz FROM points)
SELECT vx, vy, vz, count(*)::BIGINT AS point_count, count(DISTINCT scan)::BIGINT AS scan_count, count(DISTINCT observation)::BIGINT AS observation_count,
  round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
  min(t) AS first_t, max(t) AS last_t FROM v GROUP BY ALL""",
)
def d2_voxel_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = inter_scan_voxels(points(spark, sf_dir), 5.0)
    return voxels.withColumns({c: F.round(c, 6) for c in ("cx", "cy", "cz")})


@query(
    "d1_scan_voxel_centroids",
    f"""WITH {SQL_POINTS}, v AS (SELECT *, floor(x / 10)::BIGINT AS vx, floor(y / 10)::BIGINT AS vy, floor(z / 10)::BIGINT AS vz FROM points)
SELECT scan, vx, vy, vz, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, count(*)::BIGINT AS point_count,
  CASE WHEN count(*) = 1 THEN min(point) ELSE -1 END AS source_index FROM v GROUP BY ALL""",
)
def d1_scan_voxel_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = intra_scan_voxels(points(spark, sf_dir), 10.0)
    return voxels.withColumns({c: F.round(c, 6) for c in ("cx", "cy", "cz")})


@query("a12_box_query", f"WITH {SQL_POINTS} SELECT point, x, y, z FROM points WHERE x BETWEEN 10 AND 20 AND y BETWEEN 2 AND 4 AND z BETWEEN 1 AND 3")
def a12_box_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries included; the ranges on quantity reach the scan."""
    return points(spark, sf_dir).filter("x BETWEEN 10 AND 20 AND y BETWEEN 2 AND 4 AND z BETWEEN 1 AND 3").select("point", "x", "y", "z")


@query("a13_zone_maps", f"WITH {SQL_POINTS} SELECT scan, count(*)::BIGINT AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, min(t) AS first_t, max(t) AS last_t FROM points GROUP BY 1")
def a13_zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return points(spark, sf_dir).groupBy("scan").agg(F.count("*").alias("n"), *box, F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select(F.col("p_partkey").alias("point"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


_SQL_PARTS = "p AS (SELECT p_partkey AS point, p_size::DOUBLE AS x, p_retailprice AS y FROM part)"


@query(
    "c11_radius_neighbours",
    f"WITH {_SQL_PARTS} SELECT a.point AS centre, b.point, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 6) AS d2 FROM p a, p b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4.0",
)
def c11_radius_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places meet, each with the parts there, and go back to parts after."""
    parts = gathered(_parts(spark, sf_dir), "point")
    return dealt(within_radius(parts, parts, 2.0, ("x", "y"), spread=True).withColumn("d2", F.round("d2", 6)), "centre", "point")


@query(
    "c12_nearest_k",
    f"WITH {_SQL_PARTS}, r AS (SELECT a.point AS centre, b.point, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM p a, p b) SELECT centre, point, round(d2, 6) AS d2, row_number() OVER (PARTITION BY centre ORDER BY d2, point)::INT AS rank FROM r QUALIFY rank <= 5",
)
def c12_nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return nearest_k(parts, parts, 5, 1.0, ("x", "y")).withColumn("d2", F.round("d2", 6))


@query(
    "c24_point_to_voxel",
    f"WITH {SQL_POINTS}, v AS (SELECT *, floor(x / 5)::BIGINT AS vx, floor(y / 5)::BIGINT AS vy, floor(z / 5)::BIGINT AS vz FROM points) SELECT point, vx, vy, vz, count(*) OVER (PARTITION BY vx, vy, vz) AS members FROM v",
)
def c24_point_to_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [cell_of(F.col(a), 5.0).alias(f"v{a}") for a in "xyz"]
    placed = points(spark, sf_dir).select("point", *keys)
    return placed.join(placed.groupBy("vx", "vy", "vz").agg(F.count("*").alias("members")), ["vx", "vy", "vz"])


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    return rows.select("point", F.col("scan").alias("frame"), cell_of(F.col("x"), 1.0).alias("row"), cell_of(F.col("y"), 1.0).alias("col"), (F.col("z") + F.col("x") / 100).alias("depth"))


_SQL_DEPTHS = f"{SQL_POINTS}, d AS (SELECT point, scan AS frame, floor(x)::BIGINT AS row, floor(y)::BIGINT AS col, z + x / 100 AS depth FROM points), c AS (SELECT frame, row, col, min(depth) AS depth FROM d GROUP BY ALL), m AS (SELECT c.frame, c.row, c.col, min(o.depth) AS window_min FROM c JOIN c o ON c.frame = o.frame AND abs(c.row - o.row) <= 1 AND abs(c.col - o.col) <= 1 GROUP BY ALL)"


@query("e4_window_minimum", f"WITH {_SQL_DEPTHS} SELECT frame, row, col, window_min FROM m")
def e4_window_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_filter(_depths(spark, sf_dir).groupBy("frame", "row", "col").agg(F.min("depth").alias("depth")), 1)


@query("e5_occlusion", f"WITH {_SQL_DEPTHS} SELECT point, depth > window_min + greatest(0.5, 0.1 * window_min) AS hidden FROM d JOIN m USING (frame, row, col)")
def e5_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden where deeper than the least depth about it by more than a margin."""
    depths = _depths(spark, sf_dir)
    near = min_filter(depths.groupBy("frame", "row", "col").agg(F.min("depth").alias("depth")), 1)
    hidden = F.col("depth") > F.col("window_min") + F.greatest(F.lit(0.5), 0.1 * F.col("window_min"))
    return depths.join(near, ["frame", "row", "col"]).select("point", hidden.alias("hidden"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    box = F.expr("p_partkey div 8").alias("box")
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return parts.groupBy(box).agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


@query(
    "c13_box_pairs",
    """WITH b AS (SELECT p_partkey // 8 AS box, min(p_size::DOUBLE) AS min_x, max(p_size::DOUBLE) AS max_x, min(p_retailprice) AS min_y, max(p_retailprice) AS max_y FROM part GROUP BY 1),
g AS (SELECT a.box AS a, b.box AS b, sqrt(greatest(0, a.min_x - b.max_x, b.min_x - a.max_x) ** 2 + greatest(0, a.min_y - b.max_y, b.min_y - a.max_y) ** 2) AS gap FROM b a JOIN b ON a.box < b.box)
SELECT a, b, round(gap, 6) AS gap FROM g WHERE gap <= 0.5""",
)
def c13_box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_pairs(_boxes(spark, sf_dir), 0.5, 16.0, ("x", "y")).select("a", "b", F.round("gap", 6).alias("gap"))


@query(
    "d16_entity_geometry",
    f"""WITH {SQL_POINTS} SELECT scan AS entity, count(*)::BIGINT AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz,
  round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 6) AS volume, round(covar_pop(x, y), 4) AS cov_xy FROM points GROUP BY 1""",
)
def d16_entity_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = [F.max(a) - F.min(a) for a in "xyz"]
    return points(spark, sf_dir).groupBy(F.col("scan").alias("entity")).agg(
        F.count("*").alias("n"), *[F.round(F.avg(a), 6).alias(f"c{a}") for a in "xyz"], F.round(extent[0] * extent[1] * extent[2], 6).alias("volume"), F.round(F.covar_pop("x", "y"), 4).alias("cov_xy")
    )
