"""Settings of a deployment: a nested mapping that is read by dotted names."""

from __future__ import annotations

import json
from typing import Any


class Settings:
    """``get("a.b.c")`` walks a nested mapping; a missing step, or one that is no mapping, gives the default."""

    def __init__(self, values: dict[str, Any]):
        self.values = values

    @classmethod
    def load(cls, path: str) -> Settings:
        """From a JSON file, or a YAML one where a parser for it is installed."""
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                return cls(json.load(f))
            import yaml

            return cls(yaml.safe_load(f) or {})

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at
