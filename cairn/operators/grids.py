"""Regions of frames and grids of features: samples between cells, observations of regions, and regions merged in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_samples(samples: DataFrame, cells: DataFrame, rows: int, cols: int, mode: str) -> DataFrame:
    """(frame, sample, status, vector): the features of ``cells`` (frame, row, col, vector), a grid of ``rows`` by ``cols`` cells whose
    centres have whole coordinates, at the places (u across, v down) of ``samples``: the nearest cell's, or the bilinear mean of the
    four about the place. Outside the grid (beyond half a cell for the nearest, beyond the outer centres for the mean) there is none.
    A sample asks for four cells at most, by an equi-join."""
    u, v = F.col("u"), F.col("v")
    if mode == "nearest":
        asked = samples.select("frame", "sample", F.floor(v + 0.5).alias("row"), F.floor(u + 0.5).alias("col"), F.lit(1.0).alias("w"))
    elif mode == "bilinear":
        inside = (u >= 0) & (u <= cols - 1) & (v >= 0) & (v <= rows - 1)
        fu, fv = u - F.floor(u), v - F.floor(v)
        four = [F.struct((F.floor(v) + dr).alias("row"), (F.floor(u) + dc).alias("col"), ((fv if dr else 1 - fv) * (fu if dc else 1 - fu)).alias("w")) for dr in (0, 1) for dc in (0, 1)]
        asked = samples.filter(inside).select("frame", "sample", F.inline(F.array(*four))).filter("w > 0")
    else:
        raise ValueError("nearest or bilinear")
    met = asked.join(cells, ["frame", "row", "col"]).select("frame", "sample", "w", F.posexplode("vector").alias("_i", "_x"))
    mean = met.groupBy("frame", "sample", "_i").agg(F.sum(F.col("w") * F.col("_x")).alias("_x")).groupBy("frame", "sample")
    found = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("vector"))
    out = samples.select("frame", "sample").join(found, ["frame", "sample"], "left")
    return out.select("frame", "sample", F.when(F.col("vector").isNull(), "outside").otherwise("sampled").alias("status"), "vector")


def build_observations(regions: DataFrame, claims: DataFrame, features: DataFrame) -> DataFrame:
    """Each region with its claims and its features, sorted, empty where it has none: both are gathered by region before they are joined,
    so that neither multiplies the other."""
    of = lambda df, name: df.groupBy("region").agg(F.array_sort(F.collect_list(name)).alias(f"{name}s"))
    rows = regions.join(of(claims, "claim"), "region", "left").join(of(features, "feature"), "region", "left")
    return rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("claims", "features")})


def merge_regions(regions: DataFrame, iou: float, containment: float) -> DataFrame:
    """(frame, region, kept): in the order of their ids each region (frame, region, min_x, min_y, max_x, max_y) joins the first representative
    before it with which it has an intersection over union of ``iou``, or of which, or in which, it is contained by ``containment``;
    else it stands for itself, as does a region without a whole box. What is first depends on what stood before, so a frame's regions are one task's, as an array."""
    import numpy as np
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for frame, own in zip(rows["frame"], rows["regions"], strict=True):
                boxes = np.array([[r["min_x"], r["min_y"], r["max_x"], r["max_y"]] for r in own], float)
                size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
                stand: list[int] = []
                for i, r in enumerate(own):
                    kept = i
                    if stand:
                        s = np.array(stand)
                        both = np.maximum(0, np.minimum(boxes[s, 2:], boxes[i, 2:]) - np.maximum(boxes[s, :2], boxes[i, :2])).prod(1)
                        union, least = size[s] + size[i] - both, np.minimum(size[s], size[i])
                        alike = (both >= iou * union) & (union > 0) | (both >= containment * least) & (least > 0)
                        if alike.any():
                            kept = int(s[alike.argmax()])
                    if kept == i:
                        stand.append(i)
                    out.append((frame, r["region"], own[kept]["region"]))
            yield pd.DataFrame(out, columns=["frame", "region", "kept"]).astype("Int64")

    each = F.struct("region", "min_x", "min_y", "max_x", "max_y")
    grouped = regions.groupBy("frame").agg(F.array_sort(F.collect_list(each)).alias("regions"))
    return grouped.mapInPandas(run, "frame long, region long, kept long")
