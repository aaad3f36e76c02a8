"""Settings from YAML by dotted names, and secrets from the environment; neither enters a DataFrame."""

from __future__ import annotations

import os
from functools import lru_cache
from pathlib import Path
from typing import Any


class Settings(dict):
    def at(self, name: str, default: Any = None) -> Any:
        found: Any = self
        for part in name.split("."):
            if not isinstance(found, dict) or part not in found:
                return default
            found = found[part]
        return found

    def path(self, name: str, root: str = ".") -> Path:
        """A path of the settings against the root; a missing name raises KeyError."""
        found = self.at(name)
        if found is None:
            raise KeyError(name)
        p = Path(found)
        return p if p.is_absolute() else Path(root) / p


@lru_cache(maxsize=8)
def load(path: str) -> Settings:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Settings(yaml.safe_load(f) or {})


def secret(*names: str) -> str | None:
    """The first of the names that the environment has."""
    return next((os.environ[n] for n in names if os.environ.get(n)), None)
