"""Sources behind one interface: what they can, their observations, their warnings and the digest of what was read."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.artifacts import content_digest, pose_lines
from cairn.sources.messages import decode, read_bags


@dataclass(frozen=True)
class Capabilities:
    modalities: tuple[str, ...]
    calibration: bool = False
    streaming: bool = False


@dataclass(frozen=True)
class SourceConfig:
    """``topics``: topic by modality; ``required``: modalities that must be there; ``start`` and ``stop``: ns, of [start, stop); ``clock``: the name of
    the source's clock."""

    path: str
    topics: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    start: int | None = None
    stop: int | None = None
    clock: str = "source"


class Adapter(Protocol):
    """``observations``: (observation, modality, clock, t, ...), read when an action needs them; ``warnings``: (subject, warning)."""

    capabilities: Capabilities

    def observations(self, spark: SparkSession) -> DataFrame: ...

    def warnings(self, spark: SparkSession) -> DataFrame: ...


def in_bounds(df: DataFrame, config: SourceConfig) -> DataFrame:
    if config.start is not None:
        df = df.filter(F.col("t") >= config.start)
    return df if config.stop is None else df.filter(F.col("t") < config.stop)


@dataclass(frozen=True)
class BagAdapter:
    config: SourceConfig
    capabilities: Capabilities = Capabilities(("image", "cloud", "imu", "odometry"))

    def messages(self, spark: SparkSession) -> DataFrame:
        c = self.config
        return read_bags(spark, c.path, topics={t: m in c.required for m, t in c.topics.items()} or None, start=c.start, stop=c.stop)

    def observations(self, spark: SparkSession) -> DataFrame:
        by_topic = F.create_map(*[F.lit(x) for m, t in self.config.topics.items() for x in (t, m)])
        rows = self.messages(spark).filter("warning IS NULL")
        name = F.concat_ws(":", F.regexp_extract("file", r"([^/]*)$", 1), F.col("position").cast("string"))
        return rows.select(name.alias("observation"), by_topic[F.col("topic")].alias("modality"), F.lit(self.config.clock).alias("clock"), "t", "file", "topic", "position", "data")

    def decoded(self, spark: SparkSession, modality: str, cdr: bool = False) -> DataFrame:
        return decode(self.messages(spark).filter(F.col("topic") == self.config.topics[modality]), modality, cdr)

    def warnings(self, spark: SparkSession) -> DataFrame:
        return self.messages(spark).filter("warning IS NOT NULL").select(F.col("file").alias("subject"), "warning")


@dataclass(frozen=True)
class PoseFileAdapter:
    """Poses as lines of text; times in seconds become ns."""

    config: SourceConfig
    capabilities: Capabilities = Capabilities(("pose",))

    def observations(self, spark: SparkSession) -> DataFrame:
        rows = pose_lines(spark, self.config.path).filter("problem IS NULL")
        t = F.round(F.col("t").cast("decimal(28,9)") * 1_000_000_000, 0).cast("long")
        rows = rows.withColumn("t", t).withColumn("observation", F.concat_ws(":", F.regexp_extract("file", r"([^/]*)$", 1), F.col("t").cast("string")))
        return in_bounds(rows, self.config).select("observation", F.lit("pose").alias("modality"), F.lit(self.config.clock).alias("clock"), "t", "x", "y", "z", "qx", "qy", "qz", "qw")

    def warnings(self, spark: SparkSession) -> DataFrame:
        return pose_lines(spark, self.config.path).filter("problem IS NOT NULL").select(F.col("line").alias("subject"), F.col("problem").alias("warning"))


@dataclass(frozen=True)
class TableAdapter:
    """Observations that are in a Parquet table already; the bounds reach its scan."""

    config: SourceConfig
    capabilities: Capabilities = Capabilities(("any",))

    def observations(self, spark: SparkSession) -> DataFrame:
        rows = in_bounds(spark.read.parquet(self.config.path), self.config)
        return rows.filter(F.col("modality").isin(*self.config.topics)) if self.config.topics else rows

    def warnings(self, spark: SparkSession) -> DataFrame:
        found = spark.read.parquet(self.config.path).select("modality").distinct()
        wanted = spark.createDataFrame([(m,) for m in self.config.required], "modality string")
        return wanted.join(found, "modality", "left_anti").select(F.col("modality").alias("subject"), F.lit("a required modality is not there").alias("warning"))


def digest_of(adapter: Adapter, spark: SparkSession) -> str:
    """Of exactly the observations that are read, in whatever order they come."""
    rows = adapter.observations(spark)
    row = F.sha2(F.to_json(F.struct(*[F.base64(c) if t == "binary" else F.col(c) for c, t in rows.dtypes])), 256)
    return content_digest(rows, row).first()["digest"]
