"""Points by voxel: half-open cells ``[k * cell, (k + 1) * cell)`` counted from an origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_of(x: Column, cell: float, origin: float = 0.0) -> Column:
    return F.floor((x - F.lit(origin)) / F.lit(cell)).cast("long")


def intra_scan_voxels(points: DataFrame, cell: float, *, scan: str = "scan", index: str = "point", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """One point per scan and voxel: the centroid and how many points it stands for; the index is kept only where it is
    one point, else -1."""
    keys = [cell_of(F.col(a), cell).alias(f"v{a}") for a in axes]
    grouped = points.groupBy(F.col(scan), *keys)
    return grouped.agg(*[F.avg(a).alias(f"c{a}") for a in axes], F.count("*").alias("point_count"), F.when(F.count("*") == 1, F.min(index)).otherwise(F.lit(-1)).alias("source_index"))


def inter_scan_voxels(points: DataFrame, cell: float, *, scan: str = "scan", observation: str = "observation", at: str = "t", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """One row per voxel: points, scans, different observations, centroid as the mean offset from the voxel's corner,
    bounds, first and last time. Sums are combined where the points are and shuffle a row per voxel and task; scans and
    observations are counted each from its own distinct pairs with the voxel, so that neither multiplies the other."""
    keys = [f"v{a}" for a in axes]
    placed = points.select("*", *[cell_of(F.col(a), cell).alias(f"v{a}") for a in axes])
    offset = {a: F.col(a) - F.col(f"v{a}") * F.lit(cell) for a in axes}
    box = [f(F.col(a)).alias(f"{m}_{a}") for a in axes for f, m in ((F.min, "min"), (F.max, "max"))]
    sums = placed.groupBy(*keys).agg(F.count("*").alias("point_count"), *[F.avg(offset[a]).alias(f"o{a}") for a in axes], *box, F.min(at).alias("first_t"), F.max(at).alias("last_t"))
    of = lambda c, n: placed.select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).alias(n))
    joined = sums.join(of(scan, "scan_count"), keys).join(of(observation, "observation_count"), keys)
    centroid = [(F.col(f"o{a}") + F.col(f"v{a}") * F.lit(cell)).alias(f"c{a}") for a in axes]
    return joined.select(*keys, "point_count", "scan_count", "observation_count", *centroid, *[f"{m}_{a}" for a in axes for m in ("min", "max")], "first_t", "last_t")
