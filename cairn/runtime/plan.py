"""Plans of stages: which take part, in what order, what must run for given results, and what is wrong with them before they run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from cairn.runtime.config import digest

Run = Callable[[SparkSession, Mapping[str, DataFrame], Mapping[str, Any]], DataFrame]


@dataclass(frozen=True)
class Input:
    """A stage's input: the stage or source it comes from, the columns (name: type) that it must have, and whether the stage can do
    without it."""

    source: str
    columns: Mapping[str, str] = field(default_factory=dict)
    optional: bool = False


@dataclass(frozen=True)
class Stage:
    """``columns``: what the result has; ``version``: of the code, part of the key by which results are reused; ``section``: of the
    configuration, which the stage sees and on which its result depends; ``optional``: may be left out of a plan, or fail."""

    name: str
    run: Run
    inputs: Mapping[str, Input] = field(default_factory=dict)
    columns: Mapping[str, str] = field(default_factory=dict)
    version: str = "1"
    section: str | None = None
    optional: bool = False


class PlanError(ValueError):
    pass


def topological_order(edges: Mapping[str, Iterable[str]]) -> list[str]:
    """The nodes so that each comes after those it needs (``edges``: by node), of equals by name. A cycle is an error that names it."""
    left = {n: {x for x in needs if x in edges} for n, needs in edges.items()}
    out: list[str] = []
    while left:
        ready = sorted(n for n, needs in left.items() if not needs)
        if not ready:
            at, seen = min(left), []
            while at not in seen:
                seen.append(at)
                at = min(left[at])
            raise PlanError("cycle: " + " -> ".join([*seen[seen.index(at) :], at]))
        for n in ready:
            del left[n]
        out += ready
        for needs in left.values():
            needs.difference_update(ready)
    return out


@dataclass(frozen=True)
class Plan:
    stages: Mapping[str, Stage]
    order: tuple[str, ...]
    sources: frozenset[str]
    dropped: tuple[str, ...] = ()

    def scope(self, targets: Iterable[str], provided: Iterable[str] = ()) -> list[str]:
        """What must run for ``targets``: all that they reach backwards, up to what is provided, in order."""
        have, todo, found = set(provided), list(targets), set()
        if unknown := sorted(set(todo) - set(self.stages)):
            raise PlanError(f"no stages: {unknown}")
        while todo:
            name = todo.pop()
            if name in found or name in have or name in self.sources:
                continue
            found.add(name)
            todo += [i.source for i in self.stages[name].inputs.values() if i.source in self.stages or i.source in self.sources]
        return [n for n in self.order if n in found]

    def stage_digest(self, name: str, config: Mapping[str, Any]) -> str:
        stage = self.stages[name]
        return digest({"stage": name, "version": stage.version, "columns": dict(stage.columns), "inputs": {k: i.source for k, i in stage.inputs.items()}, "config": config.get(stage.section) if stage.section else None})


def resolve(stages: Iterable[Stage], sources: Iterable[str], enabled: Mapping[str, bool] | None = None, replaced: Mapping[str, str] | None = None) -> Plan:
    """The plan of the stages that take part. A stage that is not enabled is left out; a stage that needs one that is left out goes too,
    if it is optional, and is an error else; an optional input of one is dropped. ``replaced`` sends all who read a stage to another.
    A result must have the columns that its readers ask for, where it says what it has."""
    given, have = {s.name: s for s in stages}, frozenset(sources)
    off = {n for n, on in (enabled or {}).items() if not on}
    if unknown := sorted((off | set(replaced or {})) - set(given)):
        raise PlanError(f"no stages: {unknown}")
    if fixed := sorted(n for n in off if not given[n].optional):
        raise PlanError(f"stages that cannot be left out: {fixed}")
    kept = {n: s for n, s in given.items() if n not in off}
    for name, s in kept.items():
        inputs = {k: Input((replaced or {}).get(i.source, i.source) if (replaced or {}).get(i.source) != name else i.source, i.columns, i.optional) for k, i in s.inputs.items()}
        kept[name] = Stage(s.name, s.run, inputs, s.columns, s.version, s.section, s.optional)
    while True:
        lost = {n for n, s in kept.items() if any(i.source not in kept and i.source not in have and not i.optional for i in s.inputs.values())}
        if not lost:
            break
        if bad := sorted(n for n in lost if not kept[n].optional):
            raise PlanError(f"stages without an input: {bad}")
        kept = {n: s for n, s in kept.items() if n not in lost}
    for name, s in list(kept.items()):
        inputs = {k: i for k, i in s.inputs.items() if i.source in kept or i.source in have}
        kept[name] = Stage(s.name, s.run, inputs, s.columns, s.version, s.section, s.optional)
        for key, i in inputs.items():
            made = kept[i.source].columns if i.source in kept else {}
            if made and (wrong := {c: t for c, t in i.columns.items() if made.get(c) != t}):
                raise PlanError(f"{name}.{key}: {i.source} has not {wrong}")
    order = topological_order({n: [i.source for i in s.inputs.values()] for n, s in kept.items()})
    return Plan(kept, tuple(order), have, tuple(sorted(set(given) - set(kept))))


def preflight(plan: Plan, sources: Mapping[str, DataFrame], config: Mapping[str, Any], targets: Iterable[str] | None = None) -> list[str]:
    """What is wrong before anything runs: sources that are missing or lack columns, sections that the configuration has not. Reads
    schemas only."""
    problems = []
    for name in plan.scope(targets if targets is not None else plan.order):
        stage = plan.stages[name]
        if stage.section and stage.section not in config:
            problems.append(f"{name}: the configuration has no section {stage.section}")
        for key, i in stage.inputs.items():
            if i.source in plan.sources:
                if i.source not in sources:
                    problems.append(f"{name}.{key}: there is no source {i.source}")
                else:
                    has = dict(sources[i.source].dtypes)
                    problems += [f"{name}.{key}: {i.source} has no {c} {t}" for c, t in i.columns.items() if has.get(c) != t]
    return problems
