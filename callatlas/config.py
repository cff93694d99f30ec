"""Settings of a run. Real environment variables win over those in a .env file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from .errors import ConfigError

PREFIX = "CALLATLAS_"


@dataclass(frozen=True)
class Settings:
    api_key: str | None = None
    base_url: str = "http://localhost:8080"
    model: str = "labeler"
    offline: bool = False
    # Limits of the remote labeller.
    timeout_s: float = 45.0
    max_attempts: int = 4
    backoff_base_s: float = 0.75
    backoff_most_s: float = 20.0
    max_concurrency: int = 6
    breaker_failures: int = 5
    breaker_reset_s: float = 30.0
    run_budget: float = 25.0
    state_dir: str = ".callatlas"

    def key(self) -> str:
        if not self.api_key:
            raise ConfigError(f"{PREFIX}API_KEY isn't set; set it, or run offline")
        return self.api_key


def read_dotenv(path: str | Path) -> dict[str, str]:
    at = Path(path)
    lines = (x.strip() for x in at.read_text(encoding="utf-8").splitlines()) if at.exists() else ()
    pairs = (x.partition("=") for x in lines if "=" in x and not x.startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


def _as(kind: str, name: str, value: str):
    try:
        return {"float": float, "int": int, "bool": lambda v: v.lower() in ("1", "true", "yes")}.get(kind, str)(value)
    except ValueError as e:
        raise ConfigError(f"{name} isn't a number: {value!r}") from e


def load_settings(dotenv: str | Path = ".env", **overrides) -> Settings:
    found = {**read_dotenv(dotenv), **os.environ}
    given = {f.name: _as(str(f.type), PREFIX + f.name.upper(), found[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in found}
    made = replace(Settings(), **(given | {k: v for k, v in overrides.items() if v is not None}))
    for name, bad in (("run_budget", made.run_budget <= 0), ("max_attempts", made.max_attempts < 1), ("max_concurrency", made.max_concurrency < 1)):
        if bad:
            raise ConfigError(f"{name} is too small")
    return made
