"""Slugs that runs of a pack have used, as a file of their own for each pack. It only grows."""

from __future__ import annotations

import json
from pathlib import Path


def _at(state_dir: str | Path, pack: str) -> Path:
    return Path(state_dir) / f"known_{pack}.json"


def load_known(state_dir: str | Path, pack: str) -> set[str]:
    """None where there is no file, or one that can't be read: then a run doesn't converge, but works."""
    try:
        return {*json.loads(_at(state_dir, pack).read_text(encoding="utf-8"))}
    except (OSError, ValueError, TypeError):
        return set()


def save_known(state_dir: str | Path, pack: str, slugs: set[str]) -> None:
    at = _at(state_dir, pack)
    at.parent.mkdir(parents=True, exist_ok=True)
    new = at.with_suffix(".new")
    new.write_text(json.dumps(sorted(load_known(state_dir, pack) | slugs), indent=1), encoding="utf-8")
    new.replace(at)
