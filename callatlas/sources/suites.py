"""Suites of scenarios, as YAML files. A file that can't be used is an error, never left out: it would test nothing and always pass."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..errors import SuiteError
from ..operators.graders import EXPECTATION, GRADERS
from .packs import Pack, parsed

SCENARIO = "scenario_id string, ord int, name string, situation string, conditions array<string>"


@dataclass
class Expectation:
    type: str
    tool: str | None = None
    values: list[str] | None = None
    value: int | None = None
    pattern: str | None = None
    patterns: list[str] | None = None
    reason: str | None = None

    def signature(self) -> tuple:
        """What it tests; expectations with one signature are the same."""
        return self.type, self.tool, self.pattern, tuple(self.patterns or ()), self.value


@dataclass
class Scenario:
    id: str
    name: str
    situation: str
    description: str = ""
    owner: str = "unassigned"
    priority: str = "P2"
    language: str = "hi-IN"
    persona: dict = field(default_factory=dict)
    opening_utterance: str = ""
    conditions: list[str] = field(default_factory=list)
    expectations: list[Expectation] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    generated_from_cluster: str | None = None


def _made(kind, raw: dict, where: str):
    if not isinstance(raw, dict):
        raise SuiteError(f"{where}: a mapping is needed")
    fields_ = kind.__dataclass_fields__
    if stray := sorted(raw.keys() - fields_.keys()):
        raise SuiteError(f"{where}: unknown key {stray[0]}")
    for name, f in fields_.items():
        value, kinds = raw.get(name), str(f.type)
        if value is None and "None" not in kinds and (name in raw or kinds == "str" and name in ("id", "name", "situation", "type")):
            raise SuiteError(f"{where}: {name} is missing")
        wanted = str if kinds.startswith("str") else int if kinds.startswith("int") else list if kinds.startswith("list") else dict
        if value is not None and (not isinstance(value, wanted) or isinstance(value, bool)):
            raise SuiteError(f"{where}: {name} has the wrong type")
        if "list[str]" in kinds and value and not all(isinstance(x, str) for x in value):
            raise SuiteError(f"{where}: {name} has to hold strings")
    return kind(**raw)


def scenario_of(raw: dict, where: str) -> Scenario:
    s = _made(Scenario, raw, where)
    s.expectations = [_made(Expectation, e, f"{where}: expectations.{i}") for i, e in enumerate(s.expectations)]
    if bad := [e.type for e in s.expectations if e.type not in GRADERS]:
        raise SuiteError(f"{where}: unknown expectation type {bad[0]}")
    return s


def load_suite(directory: str | Path) -> list[Scenario]:
    at = Path(directory)
    if not at.is_dir():
        raise SuiteError(f"no suite at {at}")
    out: list[Scenario] = []
    where: dict[str, str] = {}
    for path in [*sorted(at.glob("*.yaml")), *sorted(at.glob("*.yml"))]:
        s = scenario_of(parsed(path, SuiteError), path.name)
        if s.id in where:
            raise SuiteError(f"{path.name}: scenario {s.id} is already in {where[s.id]}")
        where[s.id] = path.name
        out.append(s)
    if not out:
        raise SuiteError(f"no scenarios in {at}")
    return out


def write_scenario(scenario: Scenario, directory: str | Path) -> Path:
    """Into the suite as an ordinary file, so that it is reviewed like any other."""
    at = Path(directory)
    at.mkdir(parents=True, exist_ok=True)
    path = at / f"gen_{scenario.situation.replace('/', '_')}.yaml"
    body = {k: v for k, v in asdict(scenario).items() if v is not None and k != "expectations"}
    body["expectations"] = [{k: v for k, v in asdict(e).items() if v is not None} for e in scenario.expectations]
    path.write_text("# Proposed from production calls. Check that it says what should happen, not what does.\n" + yaml.safe_dump(body, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return path


def mismatch(suite: list[Scenario], pack: Pack) -> tuple[set[str], set[str]]:
    """(situations that only the pack wants declared, situations that only the suite declares)"""
    has = {s.situation for s in suite}
    return pack.declared - has, has - pack.declared


def scenario_table(spark: SparkSession, suite: list[Scenario]) -> DataFrame:
    return spark.createDataFrame([(s.id, i, s.name, s.situation, s.conditions) for i, s in enumerate(suite)], SCENARIO)


def expectation_table(spark: SparkSession, suite: list[Scenario]) -> DataFrame:
    return spark.createDataFrame([(s.id, i, e.type, e.tool, e.values, e.value, e.pattern, e.patterns) for s in suite for i, e in enumerate(s.expectations)], EXPECTATION)
