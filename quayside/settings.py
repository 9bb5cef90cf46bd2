"""Validated settings of a run."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import MISSING, dataclass, field, fields
from typing import Any


def _ruled(accepts: Callable[[Any], bool], wants: str, default: Any = MISSING, factory: Any = MISSING) -> Any:
    """A field that carries its own rule; ``Settings`` reports all broken rules at once."""
    return field(default=default, default_factory=factory, metadata={"accepts": accepts, "wants": wants})


def _count(default: int) -> Any:
    return _ruled(lambda v: type(v) is int and v >= 1, "a whole number from 1", default)


def _share(default: float) -> Any:
    return _ruled(lambda v: type(v) in (int, float) and 0 < v <= 1, "a number above 0, at most 1", default)


def _switch() -> Any:
    return _ruled(lambda v: v is True or v is False, "true or false", False)


def _names(v: Any) -> bool:
    return all(isinstance(x, str) for x in v)


@dataclass(frozen=True)
class Settings:
    """``end`` is exclusive. ``feed_groups`` maps retailers to families that share a feed."""

    start: dt.date
    end: dt.date
    max_state_age_days: int = _count(7)
    min_match_confidence: float = _share(0.9)
    assume_store_success_confirms_state: bool = _switch()
    retrospective_mapping: bool = _switch()
    assume_continuous_observation: bool = _switch()
    feed_groups: dict = _ruled(lambda v: isinstance(v, dict) and _names(v) and _names(v.values()) and all(v) and all(v.values()), "a map of names to names", factory=dict)
    min_train_days: int = _count(60)
    test_days: int = _count(30)
    min_train_events: int = _count(30)
    exposure_days: int = _count(3)
    seed: int = 20260913
    grocery_categories: list = _ruled(lambda v: isinstance(v, list) and _names(v), "a list of names", factory=list)
    min_index_weight_coverage: float = _share(0.8)
    currency: str = "KZT"

    def __post_init__(self) -> None:
        broken = [f"{f.name} is {getattr(self, f.name)!r}, wanted {f.metadata['wants']}" for f in fields(self) if f.metadata and not f.metadata["accepts"](getattr(self, f.name))]
        if self.end <= self.start:
            broken.append(f"the period from {self.start} to {self.end} is empty")
        if broken:
            raise ValueError("; ".join(broken))

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path) as f:
            raw = json.load(f)
        if unknown := set(raw) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**raw | {k: dt.date.fromisoformat(raw[k]) for k in ("start", "end")})
