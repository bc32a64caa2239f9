"""Cohorts that come from other cohorts: parts of a split, and those who reached or left a path.

A derived cohort holds its parent and the step that made it, not a list of users. Membership is evaluated from the
events at hand in the order of the graph, so derived cohorts follow a change of scope as their parents do. Children of
one parent and one rule are evaluated together: one ranking for all groups of a split, one walk for all cohorts of a
path. Each generation is stored before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.operators.cohorts import build_membership, cohort_sizes
from strideline.operators.paths import path_trails
from strideline.operators.skew import HotKeys, hot_keys
from strideline.operators.splits import MIN_SPLIT_USERS, OTHER, property_split, random_split
from strideline.operators.staging import stage
from strideline.specs import Cohort, PathStep, SpecError, check_path


@dataclass(frozen=True)
class RandomGroups:
    """Near-equal groups by a seeded hash of the user."""

    groups: int
    seed: str

    def __post_init__(self) -> None:
        if self.groups < 2:
            raise SpecError("a split needs at least 2 groups")


@dataclass(frozen=True)
class PropertyValues:
    """Users who ever had each of some values, and the others."""

    column: str
    values: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.values:
            raise SpecError("a property split needs a value")
        if OTHER in self.values:
            raise SpecError(f"{OTHER!r} stands for the users without any of the values")


@dataclass(frozen=True)
class PathWalk:
    """A walk along a path."""

    steps: tuple[PathStep, ...]
    gap_minutes: int | None = None

    def __post_init__(self) -> None:
        check_path(self.steps)


@dataclass(frozen=True)
class Derived:
    """A cohort that is a ``part`` of its parent by a rule.

    The part of a random split is its group number, of a property split its value or ``_other``, of a path
    ``("reached", step)`` or ``("dropped", step)``, steps from 1.
    """

    cohort_id: int
    name: str
    parent_id: int
    rule: RandomGroups | PropertyValues | PathWalk
    part: int | str | tuple[str, int]
    hidden: bool = False

    def __post_init__(self) -> None:
        rule, part = self.rule, self.part
        if isinstance(rule, RandomGroups):
            fits = isinstance(part, int) and 0 <= part < rule.groups
        elif isinstance(rule, PropertyValues):
            fits = part == OTHER or part in rule.values
        else:
            fits = isinstance(part, tuple) and part[0] in ("reached", "dropped") and 1 <= part[1] <= len(rule.steps)
        if not fits:
            raise SpecError(f"{part!r} is no part of {rule}")

    @property
    def is_split(self) -> bool:
        return not isinstance(self.rule, PathWalk)


def generations(cohorts: Sequence[Cohort], derived: Sequence[Derived]) -> list[list[Derived]]:
    """Derived cohorts in the order of evaluation: the parents of a generation are all in earlier ones.

    Unknown parents, numbers used twice and circles raise.
    """
    known = [c.cohort_id for c in cohorts]
    numbers = [*known, *(d.cohort_id for d in derived)]
    if len(set(numbers)) < len(numbers):
        raise SpecError("a cohort id is used twice")
    for one in derived:
        if one.parent_id not in set(numbers):
            raise SpecError(f"cohort {one.cohort_id} has no parent {one.parent_id}")
    done, left, out = set(known), list(derived), []
    while left:
        ready = [d for d in left if d.parent_id in done]
        if not ready:
            raise SpecError(f"cohorts {sorted(d.cohort_id for d in left)} are derived from each other")
        out.append(ready)
        done.update(d.cohort_id for d in ready)
        left = [d for d in left if d.cohort_id not in done]
    return out


def with_descendants(removed: Iterable[int], derived: Sequence[Derived]) -> set[int]:
    """The ids that go when some cohorts are removed: their own and all those derived from them."""
    gone = set(removed)
    while True:
        more = {d.cohort_id for d in derived if d.parent_id in gone} - gone
        if not more:
            return gone
        gone |= more


def build_all(events: DataFrame, cohorts: Sequence[Cohort], derived: Sequence[Derived], scope: Column | None = None, hot: HotKeys | None = None) -> DataFrame:
    """``(cohort_id, user_id, join_time)`` of all cohorts, derived ones with their parent's join times.

    ``scope`` filters the events first; everything is evaluated inside it. Hidden cohorts are evaluated where a
    visible one needs them, and left out of the result. A parent without members gives children without any.
    """
    order = generations(cohorts, derived)
    events = events if scope is None else events.where(scope)
    heavy = hot_keys(events) if hot is None else hot
    visible = {d.cohort_id: d for d in derived if not d.hidden}
    needed = _ancestors(visible.values(), derived)
    base = [c if c.cohort_id not in needed else replace(c, hidden=False) for c in cohorts]
    layers = [stage(build_membership(events, base, hot=heavy))]
    for generation in order:
        wanted = [d for d in generation if d.cohort_id in needed or d.cohort_id in visible]
        if wanted:
            above = reduce(DataFrame.unionByName, layers)
            layers.append(stage(_children(events, above, wanted, heavy)))
    hidden = [c.cohort_id for c in cohorts if c.hidden] + [d.cohort_id for d in derived if d.hidden]
    members = reduce(DataFrame.unionByName, layers)
    return members.where(~F.col("cohort_id").isin(hidden)) if hidden else members


def _ancestors(some: Iterable[Derived], derived: Sequence[Derived]) -> set[int]:
    by_id = {d.cohort_id: d for d in derived}
    found: set[int] = set()
    for one in some:
        at: int | None = one.parent_id
        while at is not None and at not in found:
            found.add(at)
            at = by_id[at].parent_id if at in by_id else None
    return found


def _children(events: DataFrame, members: DataFrame, wanted: Sequence[Derived], hot: HotKeys) -> DataFrame:
    by_rule: dict[object, list[Derived]] = {}
    for one in wanted:
        by_rule.setdefault(repr(one.rule), []).append(one)
    out = []
    for children in by_rule.values():
        rule = children[0].rule
        parents = members.where(F.col("cohort_id").isin(sorted({d.parent_id for d in children})))
        if isinstance(rule, RandomGroups):
            placed, part = random_split(parents, rule.groups, rule.seed, min_users=0), lambda d: F.col("group_index") == d.part
        elif isinstance(rule, PropertyValues):
            placed, part = property_split(parents, events, rule.column, rule.values), lambda d: F.col("split_value") == d.part
        else:
            placed = path_trails(events, parents, rule.steps, rule.gap_minutes, hot=hot).withColumn("_done", F.size("trail"))
            part = lambda d: (F.col("_done") >= d.part[1]) if d.part[0] == "reached" else (F.col("_done") == d.part[1] - 1)
        mine = [F.when((F.col("cohort_id") == d.parent_id) & part(d), F.lit(d.cohort_id)) for d in children]
        child = F.explode(F.array_compact(F.array(*mine)))
        out.append(placed.select(child.alias("cohort_id"), "user_id", "join_time"))
    return reduce(DataFrame.unionByName, out)


def split(
    events: DataFrame, cohorts: Sequence[Cohort], derived: Sequence[Derived], parent_id: int, rule: RandomGroups | PropertyValues, first_id: int, scope: Column | None = None
) -> list[Derived]:
    """The derived cohorts after a split of ``parent_id``: an earlier split of it, with what came from that, is
    replaced; the new children are numbered from ``first_id``. Looks at the data now.

    A parent that is part of a split itself, hidden, or without members raises, as does a random split of fewer than
    ``MIN_SPLIT_USERS`` users. A property split has the child ``_other`` only if it has members.
    """
    names = {c.cohort_id: (c.name, c.hidden, False) for c in cohorts} | {d.cohort_id: (d.name, d.hidden, d.is_split) for d in derived}
    if parent_id not in names:
        raise SpecError(f"no cohort {parent_id}")
    name, hidden, is_part = names[parent_id]
    if is_part:
        raise SpecError("cannot split a sub-cohort")
    if hidden:
        raise SpecError("cannot split a hidden cohort")
    members = build_all(events, cohorts, derived, scope).where(F.col("cohort_id") == parent_id)
    sizes = cohort_sizes(members).collect()  # one row
    size = sizes[0]["size"] if sizes else 0
    if not size:
        raise SpecError("the parent cohort has no members to split")
    if isinstance(rule, RandomGroups):
        if size < MIN_SPLIT_USERS:
            raise SpecError(f"a random split needs at least {MIN_SPLIT_USERS} users")
        parts: list[int | str] = list(range(rule.groups))
    else:
        scoped = events if scope is None else events.where(scope)
        others = property_split(members, scoped, rule.column, rule.values).where(F.col("split_value") == OTHER)
        parts = [*rule.values, *([] if others.isEmpty() else [OTHER])]
    old = with_descendants([d.cohort_id for d in derived if d.parent_id == parent_id and d.is_split], derived)
    kept = [d for d in derived if d.cohort_id not in old]
    children = [Derived(first_id + i, f"{name} {part}", parent_id, rule, part) for i, part in enumerate(parts)]
    generations(cohorts, [*kept, *children])
    return [*kept, *children]
