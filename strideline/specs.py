"""Declarative inputs of the analyses. Plain data, checked when built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

# Limits of the specs.
MAX_CONDITIONS = 5
MIN_PATH_STEPS = 2
MAX_PATH_STEPS = 10
MAX_FLOW_DEPTH = 20
MAX_TOP_N = 50
MAX_IMPACT_EVENTS = 10


class SpecError(ValueError):
    """A spec that no dataset could satisfy, or that does not fit this one."""


@dataclass(frozen=True)
class Filter:
    """``column operator value``; the allowed operators depend on the column type."""

    column: str
    operator: str
    value: Any


@dataclass(frozen=True)
class Condition:
    """A user did ``event_name`` at least ``min_count`` times (or never, if negated)."""

    event_name: str
    min_count: int = 1
    where: Filter | None = None
    negated: bool = False

    def __post_init__(self) -> None:
        if not self.event_name:
            raise SpecError("a condition needs an event name")
        if self.min_count < 1:
            raise SpecError("min_count starts at 1")


@dataclass(frozen=True)
class Cohort:
    """A named set of users. No conditions means every user in scope."""

    cohort_id: int
    name: str
    conditions: Sequence[Condition] = ()
    logic: str = "OR"
    join_type: str = "condition_met"
    hidden: bool = False
    all_met: bool = False  # AND joins at the latest condition instead of the earliest

    def __post_init__(self) -> None:
        if self.logic not in ("AND", "OR"):
            raise SpecError(f"unknown logic {self.logic!r}")
        if self.join_type not in ("condition_met", "first_event"):
            raise SpecError(f"unknown join type {self.join_type!r}")
        if len(self.conditions) > MAX_CONDITIONS:
            raise SpecError(f"at most {MAX_CONDITIONS} conditions")


@dataclass(frozen=True)
class EventMatch:
    """An event name with optional equality filters on its properties."""

    event_name: str
    filters: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class PathStep:
    """One step of a path: any of the alternatives may satisfy it."""

    groups: Sequence[EventMatch]

    @staticmethod
    def of(*names: str) -> PathStep:
        return PathStep(tuple(EventMatch(name) for name in names))

    @property
    def label(self) -> str:
        parts = []
        for group in self.groups:
            pairs = " & ".join(f"{key}={value}" for key, value in group.filters.items())
            parts.append(f"{group.event_name} ({pairs})" if pairs else group.event_name)
        return " OR ".join(parts)


def check_path(steps: Sequence[PathStep]) -> None:
    """Shape checks that need no data."""
    if not MIN_PATH_STEPS <= len(steps) <= MAX_PATH_STEPS:
        raise SpecError(f"a path has {MIN_PATH_STEPS} to {MAX_PATH_STEPS} steps")
    for number, step in enumerate(steps, start=1):
        if not step.groups:
            raise SpecError(f"step {number} has no events")
        seen = set()
        for group in step.groups:
            if not group.event_name:
                raise SpecError(f"step {number} has an event without a name")
            key = (group.event_name, tuple(sorted((k, str(v)) for k, v in group.filters.items())))
            if key in seen:
                raise SpecError(f"step {number} repeats the alternative {group.event_name!r}")
            seen.add(key)


@dataclass(frozen=True)
class RevenueRule:
    """Whether an event earns revenue, and a fixed price per event if it does."""

    event_name: str
    included: bool = True
    override: float | None = None


def merge_rules(current: Sequence[RevenueRule], updates: Sequence[RevenueRule]) -> list[RevenueRule]:
    """Replace the rules of the named events, keep the others."""
    merged = {rule.event_name: rule for rule in current}
    merged.update({rule.event_name: rule for rule in updates})
    return [merged[name] for name in sorted(merged)]
