"""Published results: found by the key of all that they depend on, verified, listed, and selected by run."""

from __future__ import annotations

import time
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.runtime.config import digest
from cairn.sources.artifacts import inventory, verify

_MANIFEST = "key string, stage string, run string, name string, path string, content string, lineage map<string,string>, written double"


@dataclass
class Store:
    """A folder, shared by all machines, of results and of the manifests that list them; a manifest is a row written after its result,
    so that what has none is not there. Nothing is overwritten."""

    spark: SparkSession
    root: str

    def _manifests(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.root}/manifests")

    def publish(self, df: DataFrame, key: str, stage: str, run: str, name: str = "", lineage: dict[str, str] | None = None) -> dict:
        path = f"{self.root}/results/{stage}/{key}-{uuid4().hex[:8]}"
        df.write.mode("errorifexists").parquet(path)
        files = inventory(self.spark, path)
        files.write.mode("errorifexists").parquet(f"{path}.inventory")
        listed = sorted((r["file"], r["length"], r["sha256"]) for r in files.collect())  # a row per file
        row = (key, stage, run, name, path, digest([x[2] for x in listed]), lineage or {}, time.time())
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifests/{uuid4().hex}")
        return dict(zip(("key", "stage", "run", "name", "path", "content", "lineage", "written"), row, strict=True))

    def find(self, key: str) -> dict | None:
        """The newest result with this key whose files are what they were when it was written."""
        for row in self._manifests().filter(F.col("key") == key).orderBy(F.desc("written"), "path").collect():
            if self.problems(row["path"]).isEmpty():
                return row.asDict()
        return None

    def problems(self, path: str) -> DataFrame:
        return verify(self.spark, path, self.spark.read.parquet(f"{path}.inventory"))

    def runs(self) -> DataFrame:
        return self._manifests()

    def select(self, stage: str, reference: str, lineage: dict[str, str] | None = None) -> dict | None:
        """A stage's result: by run id (``run:...``), by name (``name:...``), or ``latest``, the newest whose lineage contradicts none of
        ``lineage``: every key that both have is equal. None where there is none."""
        kind, _, value = reference.partition(":")
        rows = self._manifests().filter(F.col("stage") == stage)
        if kind == "run":
            rows = rows.filter(F.col("run") == value)
        elif kind == "name":
            rows = rows.filter(F.col("name") == value)
        elif reference != "latest":
            raise ValueError(f"{reference!r}: run:..., name:... or latest")
        for key, theirs in (lineage or {}).items():
            rows = rows.filter(F.coalesce(F.col("lineage")[key] == theirs, F.lit(True)))
        newest = F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("written"), "path"))
        found = rows.withColumn("_nth", newest).filter("_nth = 1").drop("_nth").collect()
        return found[0].asDict() if found else None


def reuse_key(stage_digest: str, inputs: dict[str, str]) -> str:
    """Of a result: its stage, contract, configuration and code (one digest), and the contents of its inputs."""
    return digest({"stage": stage_digest, "inputs": inputs})
