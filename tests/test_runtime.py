"""Configurations, plans, stored results, runs and the validation of final maps."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.runtime import cli, config
from cairn.runtime.execute import Cancelled, content_of, run_plan
from cairn.runtime.plan import Input, PlanError, Stage, preflight, resolve, topological_order
from cairn.runtime.store import Store
from cairn.runtime.validate import MapReader, adjacency, export_bundle, validate_map, verify_bundle, write_map

DEFAULTS = {"double": {"by": 2, "api_token": None}, "limit": {"above": 1.5}}


def _double(spark, inputs, section):
    return inputs["rows"].select("k", (F.col("v") * section["by"]).cast("long").alias("v"))


def _total(spark, inputs, section):
    return inputs["doubled"].agg(F.sum("v").alias("total"))


def _extra(spark, inputs, section):
    raise RuntimeError("no model here")


def _both(spark, inputs, section):
    return inputs["total"].withColumn("with_extra", F.lit("extra" in inputs))


STAGES = (
    Stage("double", _double, {"rows": Input("numbers", {"k": "bigint", "v": "bigint"})}, {"k": "bigint", "v": "bigint"}, section="double"),
    Stage("total", _total, {"doubled": Input("double", {"v": "bigint"})}, {"total": "bigint"}),
    Stage("extra", _extra, {"doubled": Input("double")}, optional=True),
    Stage("both", _both, {"total": Input("total"), "extra": Input("extra", optional=True)}),
)


@pytest.fixture
def numbers(spark):
    return spark.range(5).select(F.col("id").alias("k"), F.col("id").alias("v"))


def test_layers_override_and_problems_come_together(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"limit": {"above": 3}}))
    found = config.load(DEFAULTS, {"double": {"by": 4}}, [str(tmp_path / "a.json")], ["double.by=5"])
    assert found == {"double": {"by": 5, "api_token": None}, "limit": {"above": 3}}
    with pytest.raises(config.ConfigError) as error:
        config.merge(DEFAULTS, {"double": {"by": "x", "what": 1}, "limit": 3, "more": {}})
    assert len(error.value.problems) == 4
    assert config.digest({"a": 1, "b": [2]}) == config.digest({"b": [2], "a": 1}) != config.digest({"a": 1, "b": [3]})
    assert config.redacted({"x": [{"my_token": "t", "by": 1}]}) == {"x": [{"my_token": "[redacted]", "by": 1}]}
    with pytest.raises(config.ConfigError):
        config.parse_override("a..b=1")


def test_plans_order_scope_and_contracts():
    plan = resolve(STAGES, ["numbers"])
    assert plan.order == ("double", "extra", "total", "both") and plan.scope(["total"]) == ["double", "total"]
    assert plan.scope(["both"], ["total"]) == ["double", "extra", "both"] and plan.scope(["total"], ["double"]) == ["total"]
    assert resolve(STAGES, ["numbers"], {"extra": False}).order == ("double", "total", "both")
    for wrong in ({"total": False}, {"none": True, "x": False}):
        with pytest.raises(PlanError):
            resolve(STAGES, ["numbers"], wrong)
    with pytest.raises(PlanError):
        resolve(STAGES, [])
    with pytest.raises(PlanError):
        resolve([*STAGES[:1], Stage("total", _total, {"doubled": Input("double", {"v": "string"})})], ["numbers"])
    with pytest.raises(PlanError, match="a -> b -> a"):
        topological_order({"a": ["b"], "b": ["a"], "c": []})
    assert plan.stage_digest("double", DEFAULTS) != plan.stage_digest("double", {"double": {"by": 3}})


def test_preflight_reads_schemas_only(spark, numbers):
    plan = resolve(STAGES, ["numbers"])
    assert preflight(plan, {"numbers": numbers}, DEFAULTS) == []
    assert len(preflight(plan, {"numbers": numbers.drop("v")}, {})) == 2 and len(preflight(plan, {}, DEFAULTS)) == 1


def test_runs_reuse_fail_and_resume(spark, numbers, tmp_path):
    store, plan, sources = Store(spark, str(tmp_path / "s")), resolve(STAGES, ["numbers"]), {"numbers": numbers}
    kinds = lambda out: {e.stage: e.kind for e in out.events}
    first = run_plan(spark, plan, sources, DEFAULTS, store, run="r1", name="base", lineage={"sequence": "a"})
    assert kinds(first) == {"double": "ran", "extra": "failed", "total": "ran", "both": "ran"} and not first.ok
    assert spark.read.parquet(first.results["both"]).first().asDict() == {"total": 20, "with_extra": False}
    again = run_plan(spark, plan, {"numbers": numbers.orderBy(F.desc("k"))}, DEFAULTS, store, run="r2", targets=["total"])
    assert kinds(again) == {"double": "reused", "total": "reused"} and again.ok
    other = run_plan(spark, plan, sources, config.merge(DEFAULTS, {"double": {"by": 3}}), store, run="r3", targets=["total"], lineage={"sequence": "b"})
    assert kinds(other) == {"double": "ran", "total": "ran"}
    assert store.select("total", "latest")["run"] == "r3" and store.select("total", "latest", {"sequence": "a"})["run"] == "r1"
    assert store.select("total", "name:base")["run"] == store.select("total", "run:r1")["run"] == "r1" and store.select("total", "run:none") is None
    with pytest.raises(ValueError):
        store.select("total", "newest")
    # a result whose files have changed is not taken
    found = store.select("double", "run:r1")
    numbers.limit(1).write.mode("append").parquet(found["path"])
    assert kinds(run_plan(spark, plan, sources, DEFAULTS, store, targets=["double"])) == {"double": "ran"}
    stopped = run_plan(spark, plan, sources, DEFAULTS, store, reuse=False, cancelled=lambda: True)
    assert kinds(stopped) == {"double": "cancelled"}
    wrong = resolve([Stage("double", lambda *_: numbers.select("k"), STAGES[0].inputs, STAGES[0].columns, section="double", version="2"), *STAGES[1:]], ["numbers"])
    out = run_plan(spark, wrong, sources, DEFAULTS, store)
    assert kinds(out) == {"double": "failed", "extra": "skipped", "total": "skipped", "both": "skipped"} and out.events[0].category == "contract"

    def give_up(*_):
        raise Cancelled("asked to")

    ended = resolve([Stage("double", give_up, STAGES[0].inputs, version="3"), *STAGES[1:]], ["numbers"])
    assert [e.kind for e in run_plan(spark, ended, sources, DEFAULTS, store).events] == ["cancelled"]


def test_contents_do_not_depend_on_order(spark, numbers):
    assert content_of(numbers) == content_of(numbers.repartition(3)) != content_of(numbers.unionByName(numbers.limit(1)))


def test_command_line(spark, numbers, tmp_path, capsys):
    numbers.write.parquet(f"{tmp_path}/n")
    common = ["--module", "tests.test_runtime", "--source", f"numbers={tmp_path}/n", "--store", f"{tmp_path}/s"]
    said = lambda: json.loads(capsys.readouterr().out)
    assert cli.main(["run", *common, "--off", "extra", "--set", "double.by=3", "--name", "x"], spark) == 0 and set(said()["results"]) == {"double", "total", "both"}
    assert cli.main(["run", *common], spark) == 1 and said()["events"][1]["kind"] == "failed"
    assert cli.main(["stage", *common, "total", "--use", "double=name:x"], spark) == 0 and list(said()["results"]) == ["total"]
    assert cli.main(["stage", *common, "total", "--use", "double=name:none"], spark) == 2
    capsys.readouterr()
    assert cli.main(["inspect", "plan", *common], spark) == 0 and said()["order"] == ["double", "extra", "total", "both"]
    assert cli.main(["inspect", "config", *common], spark) == 0 and said()["config"] == DEFAULTS
    assert cli.main(["ingest", "--store", f"{tmp_path}/s", "numbers", f"{tmp_path}/n"], spark) == 0
    path = said()["path"]
    assert cli.main(["inspect", "artifact", *common, "--path", path], spark) == 0 and said()["problems"] == []
    assert cli.main(["inspect", "run", *common], spark) == 0 and len(said()) >= 5
    assert cli.main(["run", *common, "--set", "nothing=1"], spark) == 2


def tables(spark):
    box = "min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"
    e = spark.createDataFrame([(k, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, g, ["chair"], "unambiguous") for k, g in (("a", [1, 2]), ("b", [3]), ("c", [4]))], f"key string, {box}, geometry array<bigint>, labels array<string>, state string")
    r = spark.createDataFrame([("r1", "a", "above", "b", "supported"), ("r2", "b", "next_to", "a", "rejected")], "key string, subject string, predicate string, object string, state string")
    lin = spark.createDataFrame([("up", "map", "sha", []), ("own", "entities", "sha2", ["up"])], "artifact string, kind string, content string, depends_on array<string>")
    meta = spark.createDataFrame([("m", "map", 4, 0.0, 2.0, 0.0, 2.0, 0.0, 2.0, 5, 9, ["entities", "relations"])], f"map string, frame string, point_count bigint, {box}, first_t bigint, last_t bigint, capabilities array<string>")
    return e, r, lin, meta


def test_a_map_is_written_read_and_verified(spark, tmp_path):
    e, r, lin, meta = tables(spark)
    points = spark.range(1, 5).select(F.col("id").alias("index"))
    write_map(spark, f"{tmp_path}/m", e, r, lin, meta)
    with pytest.raises(Exception, match="already exists"):
        write_map(spark, f"{tmp_path}/m", e, r, lin, meta)
    reader = MapReader(spark, f"{tmp_path}/m")
    assert reader.relations_of("a").count() == 2 and reader.entity("a").count() == reader.relation("r1").count() == 1 and reader.geometry_of("a", points).count() == 2
    assert {x["artifact"]: x["path"] for x in reader.resolve({"up": "/x"}).collect()} == {"up": "/x", "own": None}
    assert {x["entity"]: (x["as_subject"], x["as_object"]) for x in adjacency(e, r).collect()} == {"a": (["r1"], ["r2"]), "b": (["r2"], ["r1"]), "c": ([], [])}
    status, checks, findings = validate_map(spark, f"{tmp_path}/m", points=points, upstream={})
    assert status == "verified" and len(checks) == 16 and {x["severity"] for x in findings.collect()} == {"warning"}
    status, checks, _ = validate_map(spark, f"{tmp_path}/m", full=False)
    assert status == "structurally_valid" and [s for _, s in checks].count("skipped") == 6
    assert validate_map(spark, f"{tmp_path}/none")[0] == "invalid"


def test_damage_of_a_map_is_found(spark, tmp_path):
    e, r, lin, meta = tables(spark)
    bad = e.withColumn("state", F.lit("odd")).withColumn("max_x", F.when(F.col("key") == "a", 5.0).otherwise(F.col("max_x")))
    worse = r.unionByName(r.limit(1).withColumn("key", F.lit("r3")).withColumn("object", F.lit("zz")))
    write_map(spark, f"{tmp_path}/m", bad, worse, lin.filter("artifact = 'own'"), meta.withColumn("capabilities", F.array(F.lit("sounds"))))
    status, checks, findings = validate_map(spark, f"{tmp_path}/m", points=spark.range(3).select(F.col("id").alias("index")))
    failed = {c for c, s in checks if s == "failed"}
    assert status == "invalid" and failed == {"capabilities", "lineage", "geometry_consistency", "reference_integrity", "schema_invariants", "structural_references"}
    rows = [x["severity"] for x in findings.collect()]
    assert rows == sorted(rows) and rows[0] == "error"
    worse.limit(1).write.mode("append").parquet(f"{tmp_path}/m/relations")
    found = {x["check"] for x in validate_map(spark, f"{tmp_path}/m")[2].collect()}
    assert {"unlisted_files", "index_structure"} <= found


def test_bundles_close_over_what_they_need(spark, tmp_path):
    e, r, lin, meta = tables(spark)
    write_map(spark, f"{tmp_path}/m", e, r, lin, meta)
    e.write.parquet(f"{tmp_path}/up")
    with pytest.raises(ValueError):
        export_bundle(spark, f"{tmp_path}/m", f"{tmp_path}/b", {"up": f"{tmp_path}/up"})
    export_bundle(spark, f"{tmp_path}/m", f"{tmp_path}/b", {"up": f"{tmp_path}/up"}, ("own",))
    assert verify_bundle(spark, f"{tmp_path}/b")[0] == "verified"
    assert {x["artifact"]: x["closure"] for x in spark.read.parquet(f"{tmp_path}/b/closure").collect()} == {"up": "embedded", "own": "omitted"}
    e.limit(1).write.mode("append").parquet(f"{tmp_path}/b/artifacts/up")
    assert verify_bundle(spark, f"{tmp_path}/b")[0] == "invalid"
