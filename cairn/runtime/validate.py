"""The final map as tables, and their validation: sixteen checks in a fixed order, ten always and six only in full."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.artifacts import inventory

#: Tables of a map and the columns that each must have.
TABLES = {
    "entities": {"key": "string", "min_x": "double", "max_x": "double", "min_y": "double", "max_y": "double", "min_z": "double", "max_z": "double", "geometry": "array<bigint>", "labels": "array<string>", "state": "string"},
    "relations": {"key": "string", "subject": "string", "predicate": "string", "object": "string", "state": "string"},
    "adjacency": {"entity": "string", "as_subject": "array<string>", "as_object": "array<string>"},
    "lineage": {"artifact": "string", "kind": "string", "content": "string", "depends_on": "array<string>"},
    "metadata": {"map": "string", "frame": "string", "point_count": "bigint", "min_x": "double", "max_x": "double", "min_y": "double", "max_y": "double", "min_z": "double", "max_z": "double", "first_t": "bigint", "last_t": "bigint", "capabilities": "array<string>"},
}
STATES = {"entities": ("unambiguous", "ambiguous", "conflicting", "insufficient"), "relations": ("supported", "rejected", "unresolved")}
#: The checks in order; those of the second set read whole tables and run in full only.
ORDER = ("manifest", "inventory", "file_hashes", "payload_descriptors", "index_structure", "documents", "capabilities", "lineage", "dependencies", "geometry_consistency", "reference_integrity", "index_rebuild", "schema_invariants", "structural_references", "dependency_integrity", "unlisted_files")
FULL = ("file_hashes", "reference_integrity", "index_rebuild", "schema_invariants", "structural_references", "dependency_integrity")


def adjacency(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """For each entity its relations' keys as subject and as object, sorted; an entity without any has two empty lists."""
    ends = relations.select(F.inline(F.array(*[F.struct(F.col(own).alias("entity"), F.when(F.lit(own == "subject"), F.col("key")).alias("s"), F.when(F.lit(own == "object"), F.col("key")).alias("o")) for own in ("subject", "object")])))
    found = ends.groupBy("entity").agg(F.array_sort(F.collect_set("s")).alias("as_subject"), F.array_sort(F.collect_set("o")).alias("as_object"))
    return entities.select(F.col("key").alias("entity")).join(found, "entity", "left").select("entity", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("as_subject", "as_object")])


def write_map(spark: SparkSession, path: str, entities: DataFrame, relations: DataFrame, lineage: DataFrame, metadata: DataFrame) -> None:
    """The tables of a final map below a path that must not be there yet, then the manifest that lists their files, last."""
    given = {"entities": entities, "relations": relations, "adjacency": adjacency(entities, relations), "lineage": lineage, "metadata": metadata}
    for name, df in given.items():
        df.select(*TABLES[name]).write.mode("errorifexists").parquet(f"{path}/{name}")
    inventory(spark, path).write.mode("errorifexists").parquet(f"{path}/_manifest")


@dataclass
class MapReader:
    """A final map, read table by table as it is asked for; a lookup filters on a column and reads no more of the others."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def entity(self, key: str) -> DataFrame:
        return self.table("entities").filter(F.col("key") == key)

    def relation(self, key: str) -> DataFrame:
        return self.table("relations").filter(F.col("key") == key)

    def relations_of(self, entity: str) -> DataFrame:
        return self.table("relations").filter((F.col("subject") == entity) | (F.col("object") == entity))

    def geometry_of(self, entity: str, points: DataFrame) -> DataFrame:
        return points.join(self.entity(entity).select(F.explode("geometry").alias("index")), "index", "left_semi")

    def resolve(self, artifacts: dict[str, str]) -> DataFrame:
        """What the map depends on, with ``path`` where it is known now and null where it is not."""
        known = F.create_map(*[F.lit(x) for kv in artifacts.items() for x in kv]) if artifacts else None
        path = known[F.col("artifact")] if known is not None else F.lit(None).cast("string")
        return self.table("lineage").select("artifact", "kind", "content", path.alias("path"))


def _missing(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def validate_map(spark: SparkSession, path: str, *, full: bool = True, points: DataFrame | None = None, upstream: dict[str, str] | None = None) -> tuple[str, list[tuple[str, str]], DataFrame]:
    """(status, results, findings): invalid, structurally_valid or verified; each check with ok, failed or skipped, in order; and (severity,
    check, subject, message), errors first, none twice. The map is read only. Without ``points`` references to geometry, and without a
    path for it in ``upstream`` an artifact, cannot be followed, which is a warning."""
    results: dict[str, str] = {}
    found: list[DataFrame] = []
    blank = "severity string, check string, subject string, message string"

    def report(check: str, rows: DataFrame, subject: str, message: str, severity: str = "error") -> None:
        out = rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.expr(subject).cast("string").alias("subject"), F.lit(message).alias("message")).distinct()
        if not out.isEmpty():
            found.append(out)
            if severity == "error":
                results[check] = "failed"

    def single(check: str, subject: str, message: str, severity: str = "error") -> None:
        report(check, spark.createDataFrame([(subject,)], "s string"), "s", message, severity)

    def done() -> tuple[str, list[tuple[str, str]], DataFrame]:
        rows = spark.createDataFrame([], blank)
        for f in found:
            rows = rows.unionByName(f)
        status = "invalid" if "failed" in results.values() else "verified" if full else "structurally_valid"
        return status, [(c, results.get(c, "skipped")) for c in ORDER], rows.distinct().orderBy(F.desc(F.col("severity") == "error"), "check", "subject", "message")

    try:
        manifest = spark.read.parquet(f"{path}/_manifest")
        manifest.schema["sha256"]
    except Exception:  # noqa: BLE001  damage of any kind is a finding
        single("manifest", path, "the manifest cannot be read")
        return done()
    for check in ORDER:
        results[check] = "ok" if full or check not in FULL else "skipped"
    listed = inventory(spark, path).filter("NOT startswith(file, '_manifest/')")
    report("inventory", manifest.join(listed, "file", "left_anti"), "file", "listed but not there")
    both = manifest.select("file", "length", "sha256").join(listed.select("file", F.col("length").alias("n"), F.col("sha256").alias("h")), "file")
    report("inventory", both.filter("length <> n"), "file", "of another length than listed")
    report("unlisted_files", listed.join(manifest, "file", "left_anti"), "file", "there but not listed", "warning")
    if full:
        report("file_hashes", both.filter("sha256 <> h"), "file", "of other content than listed")
    tables: dict[str, DataFrame] = {}
    for name, columns in TABLES.items():
        try:
            df = spark.read.parquet(f"{path}/{name}")
            df.count()
        except Exception:  # noqa: BLE001
            single("payload_descriptors", name, "the table cannot be read")
            continue
        has = dict(df.dtypes)
        if wrong := sorted(c for c, t in columns.items() if has.get(c) != t):
            single("payload_descriptors", name, f"columns missing or of another type: {', '.join(wrong)}")
        else:
            tables[name] = df
    if len(tables) < len(TABLES):
        return done()
    e, r, adj, lin, meta = (tables[n] for n in TABLES)
    for name, key in (("entities", "key"), ("relations", "key"), ("adjacency", "entity"), ("lineage", "artifact")):
        twice = tables[name].groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1))
        report("index_structure", twice, key, f"null or more than one row in {name}")
    if meta.count() != 1:
        single("documents", "metadata", "one row is expected")
    report("documents", meta.filter("first_t > last_t OR point_count < 0"), "map", "times or counts that cannot be")
    has = {"entities": not e.isEmpty(), "relations": not r.isEmpty()}
    said = meta.select(F.explode("capabilities").alias("c"))
    report("capabilities", said.filter(~F.col("c").isin(list(has))), "c", "no such capability")
    report("capabilities", said.filter(F.col("c").isin([n for n, there in has.items() if not there] or [""])), "c", "declared, but its table is empty")
    needs = lin.select("artifact", F.explode("depends_on").alias("on"))
    report("lineage", _missing(needs, "on", lin, "artifact"), "on", "depended on, but not in the lineage")
    report("lineage", needs.filter(F.col("on") == F.col("artifact")), "artifact", "depends on itself")
    report("lineage", lin.filter("content IS NULL OR content = ''"), "artifact", "without a content identity")
    known = sorted(upstream or {})
    report("dependencies", lin.filter(~F.col("artifact").isin(known or [""])), "artifact", "where it is now is not known", "warning")
    boxes = e.crossJoin(F.broadcast(meta.select(*[F.col(f"{m}_{a}").alias(f"_{m}_{a}") for a in "xyz" for m in ("min", "max")]).limit(1)))
    outside = " OR ".join(f"min_{a} < _min_{a} OR max_{a} > _max_{a} OR min_{a} > max_{a}" for a in "xyz")
    report("geometry_consistency", boxes.filter(outside), "key", "a box outside the map's, or inside out")
    if not full:
        return done()
    refs = e.select("key", F.explode("geometry").alias("index"))
    if points is None:
        single("reference_integrity", "geometry", "there are no points to follow references to", "warning")
    else:
        report("reference_integrity", _missing(refs, "index", points, "index"), "key", "a reference to a point that is not there")
    want = adjacency(e, r)
    lists = [F.struct("entity", *[F.array_sort(c).alias(c) for c in ("as_subject", "as_object")]).alias("x")]
    mine, theirs = adj.select(*lists), want.select(*lists)
    report("index_rebuild", mine.exceptAll(theirs).unionByName(theirs.exceptAll(mine)), "x.entity", "the adjacency index is not what the relations give")
    for name, allowed in STATES.items():
        report("schema_invariants", tables[name].filter(F.col("state").isNull() | ~F.col("state").isin(*allowed)), "key", f"{name}: no such state")
    report("schema_invariants", e.filter(F.coalesce(F.size("geometry"), F.lit(0)) <= 0), "key", "an entity without geometry")
    for end in ("subject", "object"):
        report("structural_references", _missing(r, end, e, "key"), "key", f"the {end} is no entity")
    report("structural_references", r.filter("subject = object"), "key", "an entity related to itself")
    for artifact, where in (upstream or {}).items():
        try:
            stated = spark.read.parquet(f"{where}.inventory")
            now = inventory(spark, where)
            off = stated.select("file", "sha256").exceptAll(now.select("file", "sha256"))
            report("dependency_integrity", off, f"'{artifact}'", "its files are not what they were")
        except Exception:  # noqa: BLE001
            single("dependency_integrity", artifact, "it cannot be read")
    return done()


def export_bundle(spark: SparkSession, source: str, target: str, embed: dict[str, str], omit: tuple[str, ...] = ()) -> DataFrame:
    """A map and the artifacts it depends on in one folder that needs no other: all are embedded but those in ``omit``, which are listed.
    An artifact of the lineage that is neither is an error. Returns the bundle's inventory, which is written last."""
    needed = {r["artifact"] for r in spark.read.parquet(f"{source}/lineage").select("artifact").collect()}  # a row per upstream run
    if open_ := sorted(needed - set(embed) - set(omit)):
        raise ValueError(f"neither embedded nor omitted: {open_}")
    for name in TABLES:
        spark.read.parquet(f"{source}/{name}").write.mode("errorifexists").parquet(f"{target}/map/{name}")
    inventory(spark, f"{target}/map").write.mode("errorifexists").parquet(f"{target}/map/_manifest")
    for artifact, path in embed.items():
        spark.read.parquet(path).write.mode("errorifexists").parquet(f"{target}/artifacts/{artifact}")
    rows = [(a, "embedded" if a in embed else "omitted") for a in sorted(needed)]
    spark.createDataFrame(rows, "artifact string, closure string").coalesce(1).write.mode("errorifexists").parquet(f"{target}/closure")
    files = inventory(spark, target)
    files.write.mode("errorifexists").parquet(f"{target}.inventory")
    return spark.read.parquet(f"{target}.inventory")


def verify_bundle(spark: SparkSession, target: str) -> tuple[str, DataFrame]:
    """(status, findings) of a bundle: its files against its inventory, and its map in full."""
    from cairn.sources.artifacts import verify

    damage = verify(spark, target, spark.read.parquet(f"{target}.inventory"))
    status, _, findings = validate_map(spark, f"{target}/map")
    out = damage.select(F.lit("error").alias("severity"), F.lit("bundle").alias("check"), F.col("file").alias("subject"), F.col("problem").alias("message")).unionByName(findings)
    return ("invalid" if status == "invalid" or not damage.isEmpty() else "verified"), out
