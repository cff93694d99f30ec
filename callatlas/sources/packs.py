"""Domain packs: what situations a domain knows, as YAML files. Read on the driver; a pack is as small as its file."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import yaml

from ..errors import ConfigError

PACKS = Path(__file__).parent.parent / "packs"
SUITES = Path(__file__).parent.parent / "suites"
DEFAULT = "lending"


@dataclass(frozen=True)
class Pack:
    name: str
    situations: dict[str, dict]
    rule_order: list[str]
    display: str = ""
    aliases: dict[str, str] = field(default_factory=dict)
    condition_rules: dict[str, list[str]] = field(default_factory=dict)
    opening: str = ""
    names: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    products: list[str] = field(default_factory=list)
    regression: dict = field(default_factory=dict)

    @property
    def rules(self) -> dict[str, list[str]]:
        """Keywords of each situation that has some, in order of precedence."""
        return {s: self.situations[s]["keywords"] for s in self.rule_order if self.situations[s].get("keywords")}

    @property
    def flags(self) -> dict[str, list[str]]:
        return {s: spec["compliance"] for s, spec in self.situations.items() if spec.get("compliance")}

    @property
    def declared(self) -> set[str]:
        """Situations that the pack wants the suite to have."""
        return {s for s, spec in self.situations.items() if spec.get("in_suite")}

    @property
    def suite_dir(self) -> Path:
        return SUITES / self.name


def parsed(path: Path, error: type[Exception]) -> dict:
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise error(f"{path.name}: not YAML: {str(e)[:200]}") from e
    if not isinstance(raw, dict):
        raise error(f"{path.name}: a mapping is needed at the top")
    return raw


def problems(raw: dict):
    missing = [k for k in ("name", "situations", "rule_order") if k not in raw]
    if missing:
        yield f"no {missing[0]}"
        return
    if not isinstance(raw["situations"], dict) or not raw["situations"]:
        yield "situations has to be a mapping with entries"
        return
    if unknown := [s for s in raw["rule_order"] if s not in raw["situations"]]:
        yield f"rule_order names situations that aren't there: {unknown}"
    for slug, spec in raw["situations"].items():
        lacks = [k for k in ("weight", "fail", "caller", "agent") if k not in spec]
        if lacks:
            yield f"situation {slug} has no {lacks[0]}"
        elif not 0 <= spec["fail"] <= 1:
            yield f"situation {slug}: fail is no probability: {spec['fail']}"
        if any(k != k.lower() for k in spec.get("keywords") or ()):
            yield f"situation {slug}: keywords are compared with lower-cased text, so they have to be in lower case"


@lru_cache(maxsize=16)
def load_pack(name: str = DEFAULT, directory: Path = PACKS) -> Pack:
    path = Path(directory) / f"{name}.yaml"
    if not path.exists():
        raise ConfigError(f"no pack {name} in {directory}; there are {available(directory)}")
    raw = parsed(path, ConfigError)
    for problem in problems(raw):
        raise ConfigError(f"{path.name}: {problem}")
    return Pack(**{k: v for k, v in raw.items() if k in Pack.__dataclass_fields__ and v is not None})


def available(directory: Path = PACKS) -> list[str]:
    return sorted(p.stem for p in Path(directory).glob("*.yaml"))
