"""The command line: run, stage, ingest, inspect, validate. Stages come from a module that has STAGES and DEFAULTS."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.runtime import config as configs
from cairn.runtime.execute import run_plan
from cairn.runtime.plan import preflight, resolve
from cairn.runtime.store import Store
from cairn.runtime.validate import validate_map


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cairn")
    commands = out.add_subparsers(dest="command", required=True)

    def common(p: argparse.ArgumentParser) -> None:
        p.add_argument("--module", required=True, help="Python module with STAGES and DEFAULTS")
        p.add_argument("--source", action="append", default=[], metavar="NAME=PATH", help="a Parquet table")
        p.add_argument("--config", action="append", default=[], metavar="FILE")
        p.add_argument("--set", action="append", default=[], metavar="PATH=VALUE", dest="overrides")
        p.add_argument("--off", action="append", default=[], metavar="STAGE")
        p.add_argument("--store", required=True)

    run = commands.add_parser("run", help="run all stages, or those that the targets need")
    common(run)
    run.add_argument("--target", action="append", default=None)
    run.add_argument("--name", default="")
    run.add_argument("--no-reuse", action="store_true")
    stage = commands.add_parser("stage", help="run one stage on results that are selected")
    common(stage)
    stage.add_argument("stage")
    stage.add_argument("--use", action="append", default=[], metavar="STAGE=REFERENCE", help="run:..., name:... or latest")
    ingest = commands.add_parser("ingest", help="publish a table as a source")
    ingest.add_argument("--store", required=True)
    ingest.add_argument("name")
    ingest.add_argument("path")
    inspect = commands.add_parser("inspect", help="show the configuration, the plan, the runs or an artifact")
    inspect.add_argument("what", choices=("config", "plan", "run", "artifact"))
    common(inspect)
    inspect.add_argument("--path")
    validate = commands.add_parser("validate", help="validate a final map")
    validate.add_argument("path")
    validate.add_argument("--structural", action="store_true")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well, 1 if something failed or is invalid, 2 for a request that cannot be."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    show = lambda x: print(json.dumps(x, indent=1, sort_keys=True, default=str))
    try:
        return _do(args, spark, show)
    except (ValueError, KeyError) as error:
        print(error, file=sys.stderr)
        return 2


def _do(args: argparse.Namespace, spark: SparkSession, show) -> int:
    if args.command == "validate":
        status, results, findings = validate_map(spark, args.path, full=not args.structural)
        show({"status": status, "checks": results, "findings": [r.asDict() for r in findings.collect()]})
        return int(status == "invalid")
    store = Store(spark, args.store)
    if args.command == "ingest":
        show(store.publish(spark.read.parquet(args.path), configs.digest({"path": args.path}), args.name, "ingest", args.name))
        return 0
    module = importlib.import_module(args.module)
    config = configs.load(module.DEFAULTS, None, args.config, args.overrides)
    paths = dict(s.split("=", 1) for s in args.source)
    plan = resolve(module.STAGES, paths, {n: False for n in args.off})
    if args.command == "inspect":
        if args.what == "config":
            show({"config": configs.redacted(config), "digest": configs.digest(config)})
        elif args.what == "plan":
            show({"order": plan.order, "dropped": plan.dropped, "digests": {n: plan.stage_digest(n, config) for n in plan.order}})
        elif args.what == "run":
            show([r.asDict() for r in store.runs().orderBy(F.desc("written")).limit(100).collect()])
        else:
            show({"columns": spark.read.parquet(args.path).dtypes, "problems": [r.asDict() for r in store.problems(args.path).collect()]})
        return 0
    sources = {n: spark.read.parquet(p) for n, p in paths.items()}
    provided, targets = {}, getattr(args, "target", None)
    if args.command == "stage":
        targets = [args.stage]
        for use in args.use:
            name, _, reference = use.partition("=")
            if (found := store.select(name, reference or "latest")) is None:
                raise ValueError(f"{use}: there is no such result")
            provided[name] = found["path"]
    if problems := preflight(plan, sources, config, targets):
        raise ValueError("; ".join(problems))
    done = run_plan(spark, plan, sources, config, store, targets=targets, provided=provided, name=getattr(args, "name", ""), reuse=not getattr(args, "no_reuse", False))
    show({"run": done.run, "events": done.rows(), "results": done.results})
    return int(not done.ok)


if __name__ == "__main__":
    sys.exit(main())
