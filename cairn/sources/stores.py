"""Stored sequences, records, features and masks: written once, indexed, read by position, id, window or key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.graphs import cut
from cairn.sources.artifacts import inventory, publish, verify


def with_offsets(df: DataFrame, order: list[str], length: Column, name: str = "offset") -> DataFrame:
    """``df`` with how much of ``length`` stands before each row in the order of ``order``, over all rows. Rows are dealt by range and summed
    up within ranges; the ranges' totals, one number each, are added from before."""
    ranged = cut(df.withColumn("_length", length.cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum("_length").alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_sum")
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_own", F.coalesce(F.sum("_length").over(own), F.lit(0).cast("long"))).join(F.broadcast(before), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_own")).drop("_length", "_range", "_own", "_before")


def record_table(records: DataFrame, key: str) -> DataFrame:
    """(key, offset, length, line): each record as a line of JSON with its fields in the order of their names, and where it begins among all
    lines, which stand by key and end with a line feed."""
    fields = [F.col(f"`{c}`") for c in sorted(records.columns)]
    rows = records.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line")).withColumn("length", F.octet_length("line").cast("long"))
    return with_offsets(rows, ["key"], F.col("length") + 1).select("key", "offset", "length", "line")


def index_problems(index: DataFrame) -> DataFrame:
    """(key, problem) for the entries (key, offset, length) of an index that repeat a key, or do not begin where the one before ends."""
    again = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit("repeated").alias("problem"))
    due = with_offsets(index.withColumnRenamed("offset", "_given"), ["_given", "key"], F.col("length") + 1, "_due")
    return again.unionByName(due.filter("_given <> _due").select("key", F.lit("not contiguous").alias("problem")))


@dataclass
class SequenceReader:
    """A sequence published by ``write_sequence``: its index has no payload and is read without any; payloads are read by id."""

    spark: SparkSession
    path: str

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def payloads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/payload")

    def at(self, positions: list[int]) -> DataFrame:
        return self.index().filter(F.col("position").isin(positions))

    def get(self, observation: str) -> DataFrame:
        return self.index().filter(F.col("observation") == observation).join(self.payloads().filter(F.col("observation") == observation), "observation")

    def window(self, clock: str, start: int, stop: int) -> DataFrame:
        return self.index().filter((F.col("clock") == clock) & (F.col("t") >= start) & (F.col("t") < stop))

    def problems(self) -> DataFrame:
        """Files that are not as they were listed, and payloads that are missing or of other content than the index says."""
        files = verify(self.spark, self.path, self.spark.read.parquet(f"{self.path}.inventory")).select(F.col("file").alias("subject"), "problem")
        both = self.index().select("observation", "sha256").join(self.payloads().select("observation", F.sha2("payload", 256).alias("now")), "observation", "left")
        wrong = F.when(F.col("now").isNull(), "no payload").when(F.col("now") != F.col("sha256"), "another payload")
        return files.unionByName(both.select(F.col("observation").alias("subject"), wrong.alias("problem")).filter("problem IS NOT NULL"))


def write_sequence(observations: DataFrame, path: str) -> SequenceReader:
    """Observations (observation, modality, clock, t, payload binary, ...) as an index in the order of time and id, numbered from 0, a JSON line
    each beside it, and payloads by modality; then the inventory, last. Nothing that is there is overwritten."""
    spark = observations.sparkSession
    rows = observations.withColumn("sha256", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    index = with_offsets(rows.drop("payload"), ["t", "observation"], F.lit(1), "position")
    publish(index, f"{path}/index", sort_by=("position",))
    index = spark.read.parquet(f"{path}/index")
    index.select(F.to_json(F.struct(*sorted(index.columns))).alias("value")).write.mode("errorifexists").text(f"{path}/lines")
    publish(observations.select("observation", "modality", "payload"), f"{path}/payload", partition_by=("modality",), sort_by=("observation",))
    inventory(spark, path).write.mode("errorifexists").parquet(f"{path}.inventory")
    return SequenceReader(spark, path)


def write_features(features: DataFrame, path: str) -> None:
    """Vectors (feature, space, vector) with their digests, sorted by space and id so that a scan for either skips files and row groups."""
    digest = F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256)
    publish(features.select("feature", "space", F.size("vector").alias("dimension"), digest.alias("sha256"), "vector"), path, sort_by=("space", "feature"))


def load_features(spark: SparkSession, path: str, space: str, dimension: int | None = None) -> DataFrame:
    """(feature, vector) of a space; a vector of other content than its digest, or of another dimension, is an error when it is read."""
    rows = spark.read.parquet(path).filter(F.col("space") == space)
    digest = F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256)
    right = digest == F.col("sha256")
    if dimension is not None:
        right &= F.size("vector") == dimension
    return rows.select("feature", F.when(right, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("not the vector that was stored: "), F.col("feature").cast("string"))).cast("array<float>")).alias("vector"))


def pack_masks(pixels: DataFrame, width: int) -> DataFrame:
    """(mask, runs): masks from their pixels (mask, row, col) as runs of places row * width + col, array<struct<start, length>>."""
    place = pixels.select("mask", (F.col("row").cast("long") * width + F.col("col").cast("long")).alias("p")).distinct()
    own = Window.partitionBy("mask").orderBy("p")
    islands = place.withColumn("_g", F.col("p") - F.row_number().over(own)).groupBy("mask", "_g").agg(F.min("p").alias("start"), F.count("*").alias("length"))
    return islands.groupBy("mask").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs"))


def unpack_masks(masks: DataFrame, width: int) -> DataFrame:
    """(mask, row, col) of masks packed by ``pack_masks``."""
    each = masks.select("mask", F.inline("runs")).select("mask", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("p"))
    return each.select("mask", F.expr(f"p div {width}").alias("row"), F.expr(f"p % {width}").alias("col"))


#: The tables of a stage's run and the columns each must have.
CONTRACTS = {
    "state": {"poses": "trajectory string, t bigint, x double, y double, z double, qx double, qy double, qz double, qw double", "gaps": "trajectory string, first_t bigint, last_t bigint"},
    "mapping": {"scans": "map string, scan string, ordinal bigint, first bigint, n bigint, t bigint", "points": "map string, index bigint, x double, y double, z double"},
    "voxels": {"voxels": "map string, vx bigint, vy bigint, vz bigint, point_count bigint, scan_count bigint"},
    "perception": {"regions": "result string, region string, area bigint", "claims": "result string, region string, label string, role string"},
    "association": {"support": "observation string, index bigint", "observations": "observation string, frame string, region string"},
    "representation": {"vectors": "centre bigint, space string, vector array<double>"},
    "fusion": {"supports": "support string, observation string", "hypotheses": "support string, key string, weight double"},
    "semantic_mapping": {"entities": "entity string, support string, state string"},
    "resolution": {"decisions": "a string, b string, decision string", "resolved": "resolved string, entity string"},
    "relations": {"relations": "key string, subject string, predicate string, object string, state string"},
}


def write_run(spark: SparkSession, path: str, stage: str, tables: dict[str, DataFrame]) -> None:
    """A stage's run: all tables of its contract and no others, with the contract's columns, then the inventory, last."""
    contract = CONTRACTS[stage]
    if set(tables) != set(contract):
        raise ValueError(f"{stage}: {sorted(contract)} are the tables, not {sorted(tables)}")
    for name, df in tables.items():
        has = dict(df.dtypes)
        if wrong := [c for c in contract[name].split(", ") if has.get(c.split(" ", 1)[0]) != c.split(" ", 1)[1]]:
            raise ValueError(f"{stage}.{name} has not {wrong}")
    for name, df in tables.items():
        df.select(*[c.split(" ", 1)[0] for c in contract[name].split(", ")]).write.mode("errorifexists").parquet(f"{path}/{name}")
    inventory(spark, path).write.mode("errorifexists").parquet(f"{path}.inventory")


def read_run(spark: SparkSession, path: str, stage: str, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a run, after its files were compared with what was listed."""
    if check and not (bad := verify(spark, path, spark.read.parquet(f"{path}.inventory"))).isEmpty():
        raise ValueError(f"{path}: {[tuple(r) for r in bad.limit(5).collect()]}")
    return {name: spark.read.schema(columns).parquet(f"{path}/{name}") for name, columns in CONTRACTS[stage].items()}


def by_key(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of a table that have one of ``keys`` (key) in a column: regions of a point, support of an observation, entities of one,
    resolved of an entity and the like are this on their bridge tables."""
    return table.join(keys.select(F.col("key").alias(column)).distinct(), column, "left_semi")
