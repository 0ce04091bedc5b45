"""Tables as published artifacts: written once, listed with digests, verified, read by window, box or key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` as Parquet to a path that must not exist yet and returns its inventory. Sorted rows give narrow
    statistics per row group, by which later scans skip."""
    rows = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    rows.write.partitionBy(*partition_by).mode("errorifexists").parquet(path)
    return inventory(df.sparkSession, path)


def inventory(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file, length, sha256) of the files below ``path``, relative to it; each file is hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", re.escape(path.rstrip("/").rpartition("/")[2]) + "/(.*)$", 1)
    return files.select(name.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """(file, problem) for every file that is missing, unexpected or other than ``recorded``; none if all is well."""
    now = inventory(spark, path).select("file", F.col("sha256").alias("now"))
    both = recorded.select("file", "sha256").join(now, "file", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("file", problem.alias("problem")).filter("problem IS NOT NULL")


def in_window(df: DataFrame, clock: str, start: int, end: int) -> DataFrame:
    """Rows of one clock in [start, end); both conditions reach the scan."""
    return df.filter((F.col("clock") == clock) & (F.col("t") >= start) & (F.col("t") < end))


def content_digest(df: DataFrame, row_digest: Column, digits: int = 4) -> DataFrame:
    """One row (n, digest), the same in whatever order the rows come: SHA-256 over the sorted digests of rows, taken first by the rows'
    leading ``digits`` hexadecimal digits, then over those in order, so that no task holds more than a part."""
    rows = df.select(row_digest.alias("d")).withColumn("p", F.substring("d", 1, digits))
    parts = rows.groupBy("p").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("h"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256)
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), whole.alias("digest"))


def pose_lines(spark: SparkSession, path: str) -> DataFrame:
    """Poses from text lines of ``t x y z qx qy qz qw``: (file, line, t, ..., problem). Blank lines and ``#`` comments go;
    a malformed line stays with its text's problem and null values."""
    names = ("t", "x", "y", "z", "qx", "qy", "qz", "qw")
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    parts = lines.withColumn("_p", F.split("line", r"\s+"))
    value = lambda k: F.get("_p", F.lit(k)).try_cast("double")
    ok = (F.size("_p") == len(names)) & F.forall("_p", lambda x: x.try_cast("double").isNotNull())
    problem = F.when(F.size("_p") != len(names), "field count").when(~ok, "not a number")
    return parts.select("file", "line", *[F.when(ok, value(k)).alias(n) for k, n in enumerate(names)], problem.alias("problem"))


def unpack_points(scans: DataFrame, layout: list[tuple[str, str]], *, scan: str = "scan", data: str = "data") -> DataFrame:
    """Rows (scan, index, fields...) of packed binary clouds. ``layout`` names each field and its NumPy type with byte
    order, such as ``("x", "<f4")``. Null or empty data have no points; data that are no whole number of records are an
    error. Fields come out as doubles."""
    import numpy as np
    import pyarrow as pa

    record = np.dtype(layout)
    names = [n for n, _ in layout]

    def run(batches):
        for batch in batches:
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not packed:
                    continue
                if len(packed) % record.itemsize:
                    raise ValueError(f"scan {key}: {len(packed)} bytes are no whole number of records of {record.itemsize}")
                rows = np.frombuffer(packed, record)
                for start in range(0, len(rows), 1 << 16):
                    part = rows[start : start + (1 << 16)]
                    columns = [pa.array(np.full(len(part), key, np.int64)), pa.array(np.arange(start, start + len(part)))]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(part[n].astype(np.float64)) for n in names], ["scan", "index", *names])

    return scans.select(F.col(scan).cast("long").alias("scan"), F.col(data).alias("data")).mapInArrow(run, "scan long, index long, " + ", ".join(f"{n} double" for n in names))


def untiled(ranges: DataFrame) -> DataFrame:
    """The ranges (map, scan, first, n) that don't begin where the one before them in their map ends; the first begins
    at 0."""
    before = Window.partitionBy("map").orderBy("scan")
    due = F.coalesce(F.lag(F.col("first") + F.col("n")).over(before), F.lit(0).cast("long"))
    return ranges.withColumn("due", due).filter("first <> due")


def stale_zones(points: DataFrame, recorded: DataFrame) -> DataFrame:
    """Scans whose recorded bounds (scan, min_x, max_x) differ from those of their points, or that lack either."""
    actual = points.groupBy("scan").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return recorded.join(actual, "scan", "full").filter("NOT (min_x <=> lo AND max_x <=> hi)").select("scan")
