"""Parameters of a run, checked when they are made."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

#: Where a file of parameters is looked for, from the working folder.
CANDIDATES = ("config/config.yaml", "config.yaml", "config/config.json", "config.json")


@dataclass(frozen=True)
class RunConfig:
    """Fixed values as defaults: windows, leads, thresholds and shares."""

    box: tuple[float, float, float, float] = (80.20, 12.95, 80.32, 13.07)
    short: int = 6
    long: int = 12
    static: int = 16
    input_dim: int = 34
    leads: tuple[int, ...] = (1, 3, 6, 12)
    rain_range: tuple[float, float] = (15.0, 80.0)
    half_life: float = 4.0
    split: tuple[float, float] = (0.85, 0.075)
    threshold: float = 0.5
    version: str = "1"
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        w, s, e, n = self.box
        if not (w < e and s < n):
            raise ValueError("box: (west, south, east, north)")
        if self.input_dim != self.static + self.short + self.long:
            raise ValueError("input_dim: static + short + long")
        if not (0 < self.split[0] < 1 and 0 <= self.split[1] < 1 and sum(self.split) < 1):
            raise ValueError("split: shares that leave some for the test")
        if not 0 < self.rain_range[0] < self.rain_range[1]:
            raise ValueError("rain_range: two rising amounts")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RunConfig:
        raw = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    @classmethod
    def load(cls, path: str | None = None, candidates: Sequence[str] = CANDIDATES) -> RunConfig:
        """From a YAML or JSON file: the given one, else the first candidate that is there, else the defaults.

        A given path without a file gives the defaults too. Unknown parameters are an error. YAML needs the yaml package.
        """
        found = path if path else next((c for c in candidates if os.path.exists(c)), None)
        if not found or not os.path.exists(found):
            return cls()
        with open(found, encoding="utf-8") as f:
            text = f.read()
        if found.endswith((".yaml", ".yml")):
            import yaml

            text = json.dumps(yaml.safe_load(text) or {})
        return cls.from_json(text)
