"""Settings of a run: one frozen object with dotted overrides and coherence checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

from .errors import Misconfigured


@dataclass(frozen=True)
class Windows:
    window_s: float = 12.0
    stride_s: float = 9.0
    fps: float = 2.0
    max_frames: int = 32


@dataclass(frozen=True)
class States:
    step_s: float = 1.0
    span_s: float = 2.0
    max_bracket_s: float = 4.0
    target: str = "open"


@dataclass(frozen=True)
class Merge:
    gap_s: float = 0.5
    max_span_s: float = 60.0
    iou: float = 0.3


@dataclass(frozen=True)
class Limits:
    max_queries: int = 100
    max_query_chars: int = 500
    max_calls: int = 100_000
    max_bytes: int = 2 << 30
    min_duration_s: float = 0.5
    max_duration_s: float = 1_800.0


@dataclass(frozen=True)
class Config:
    strategy: str = "windows"
    windows: Windows = field(default_factory=Windows)
    states: States = field(default_factory=States)
    merge: Merge = field(default_factory=Merge)
    limits: Limits = field(default_factory=Limits)

    def checked(self) -> Config:
        """Itself, if its parts agree with each other."""
        w, s, m = self.windows, self.states, self.merge
        rules = (
            (self.strategy in ("windows", "states"), "strategy is windows or states"),
            (0 < w.stride_s <= w.window_s, "the stride leaves gaps between windows"),
            (w.fps > 0 and w.window_s >= 1 / w.fps, "a window is shorter than one sample"),
            (s.step_s > 0 and s.span_s > 0, "polls need a positive step and span"),
            (s.step_s <= s.span_s, "the step leaves time between polls unseen"),
            (m.max_span_s >= w.window_s, "the span cap is shorter than a window"),
        )
        for good, problem in rules:
            if not good:
                raise Misconfigured(problem)
        return self

    def warnings(self) -> list[str]:
        out = []
        if self.windows.window_s * self.windows.fps > self.windows.max_frames:
            out.append("windows hold more samples than the frame cap; they will be thinned")
        if self.states.max_bracket_s < self.states.step_s:
            out.append("every bracket is wider than the limit; no boundary will be interpolated")
        return out


def with_overrides(config: Config, **dotted: Any) -> Config:
    """config with values such as windows__fps=4.0 or "windows.fps"; None is skipped."""
    for name, value in dotted.items():
        if value is None:
            continue
        *path, last = name.replace("__", ".").split(".")
        if not path:
            if not hasattr(config, last):
                raise Misconfigured(f"no setting {name}")
            config = replace(config, **{last: value})
            continue
        part = getattr(config, path[0], None)
        if part is None or not hasattr(part, last):
            raise Misconfigured(f"no setting {name}")
        config = replace(config, **{path[0]: replace(part, **{last: value})})
    return config


def load_config(path: str | None = None, **dotted: Any) -> Config:
    """Settings from a JSON file (or YAML, where a YAML parser is installed), then the overrides."""
    flat: dict[str, Any] = {}
    if path:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise Misconfigured("no YAML parser is installed") from e
            data = yaml.safe_load(text) or {}
        else:
            data = json.loads(text)
        for name, value in data.items():
            flat |= {f"{name}.{k}": v for k, v in value.items()} if isinstance(value, dict) else {name: value}
    return with_overrides(with_overrides(Config(), **flat), **dotted).checked()


def as_dict(config: Config) -> dict:
    return asdict(config)
