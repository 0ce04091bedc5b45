"""Running a plan: stage by stage, reusing what is there, with a record of events; what fails stops only what needs it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.runtime.plan import Plan, preflight
from cairn.runtime.store import Store, reuse_key


class Cancelled(Exception):
    """Raised by a stage to end the run; what was published stays."""


@dataclass(frozen=True)
class Event:
    """``kind``: reused, ran, failed, skipped or cancelled; ``category`` of a failure: contract, input, cancelled or stage."""

    stage: str
    kind: str
    seconds: float = 0.0
    detail: str = ""
    category: str = ""


@dataclass
class Outcome:
    run: str
    events: list[Event] = field(default_factory=list)
    results: dict[str, str] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return all(e.kind in ("ran", "reused") for e in self.events)

    def rows(self) -> list[dict]:
        return [{"run": self.run, **asdict(e)} for e in self.events]


def content_of(df: DataFrame) -> str:
    """A digest of a table's rows in whatever order they come: number and sums of two hashes, taken where the rows are."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = df.select(F.xxhash64(row).alias("a"), F.hash(row).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("long"))).first()
    return ":".join(str(x) for x in (*df.dtypes, *found))


def run_plan(
    spark: SparkSession, plan: Plan, sources: Mapping[str, DataFrame], config: Mapping[str, Any], store: Store, *, targets: Iterable[str] | None = None, run: str | None = None,
    name: str = "", lineage: dict[str, str] | None = None, reuse: bool = True, cancelled: Callable[[], bool] = lambda: False, provided: Mapping[str, str] | None = None,
) -> Outcome:
    """Runs what ``targets`` need, all stages by default. ``provided`` are paths of results to take instead of a stage. A run that failed
    or was cancelled is resumed by running it again: results that were published are found by their keys. A failed stage leaves
    out those that need it, and no others."""
    out = Outcome(run or uuid4().hex)
    if problems := preflight(plan, sources, config, targets):
        raise ValueError("; ".join(problems))
    tables: dict[str, DataFrame] = dict(sources)
    contents: dict[str, str] = {}
    for stage, path in (provided or {}).items():
        tables[stage], contents[stage] = spark.read.parquet(path), f"path:{path}"
    gone: set[str] = set()
    for at in plan.scope(targets if targets is not None else plan.order, provided or ()):
        stage, began = plan.stages[at], time.time()
        if missing := sorted(i.source for i in stage.inputs.values() if i.source in gone and not i.optional):
            gone.add(at)
            out.events.append(Event(at, "skipped", detail=f"needs {', '.join(missing)}"))
            continue
        if cancelled():
            out.events.append(Event(at, "cancelled"))
            break
        inputs = {k: tables[i.source] for k, i in stage.inputs.items() if i.source not in gone}
        for i in stage.inputs.values():
            if i.source not in contents and i.source not in gone:
                contents[i.source] = content_of(tables[i.source])
        key = reuse_key(plan.stage_digest(at, config), {k: contents[i.source] for k, i in stage.inputs.items() if i.source not in gone})
        kind, found = "reused", store.find(key) if reuse else None
        try:
            if found is None:
                kind, df = "ran", stage.run(spark, inputs, config.get(stage.section, {}) if stage.section else {})
                has = dict(df.dtypes)
                if wrong := {c: t for c, t in stage.columns.items() if has.get(c) != t}:
                    raise TypeError(f"the result has not {wrong}")
                found = store.publish(df, key, at, out.run, name, lineage)
        except Cancelled as error:
            out.events.append(Event(at, "cancelled", time.time() - began, str(error), "cancelled"))
            break
        except Exception as error:  # noqa: BLE001  what a stage raises is recorded, and ends only what needs it
            category = "contract" if isinstance(error, TypeError) else "input" if isinstance(error, AnalysisException) else "stage"
            gone.add(at)
            out.events.append(Event(at, "failed", time.time() - began, f"{type(error).__name__}: {error}"[:500], category))
            continue
        tables[at], contents[at], out.results[at] = spark.read.parquet(found["path"]), found["content"], found["path"]
        out.events.append(Event(at, kind, time.time() - began))
    return out
