"""Stepwise matching of one ordered event sequence, for open quantifiers and timeouts.

The caller feeds events in order as (condition values, time, payload).  State is the
set of open partial matches only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from .spec import Stage

_OPEN = {"oneormore", "timesormore", "timesgreedy", "timesoptional"}


@dataclass
class Step:
    """A positive stage with the negative ones that guard its entry."""

    cond: int
    strict: bool
    least: int
    most: int | None
    optional: bool
    greedy: bool
    not_next: list[int] = field(default_factory=list)
    not_between: list[int] = field(default_factory=list)


class Partial(NamedTuple):
    """An open match: ``count`` events taken by ``step``; ``adjacent`` while no event was passed."""

    step: int
    count: int
    adjacent: bool
    start: float
    events: tuple
    first_len: int


class Match(NamedTuple):
    events: tuple
    first_len: int


class Nfa:
    """Steps of a pattern; ``feed`` returns (matches, timed out partial matches)."""

    def __init__(self, stages: Sequence[Stage], within: float = -1):
        self.within = within
        self.steps: list[Step] = []
        self.last_not: list[int] = []
        not_next: list[int] = []
        not_between: list[int] = []
        for i, s in enumerate(stages):
            if s.kind == "notnext":
                not_next.append(i)
            elif s.kind == "notfollowedby":
                not_between.append(i)
            else:
                least = 1 if s.quantifier in ("", "oneormore") else s.times
                most = None if s.quantifier in _OPEN else least
                self.steps.append(Step(i, s.kind == "next", least, most,
                                       s.quantifier == "timesoptional",
                                       s.quantifier == "timesgreedy", not_next, not_between))
                not_next, not_between = [], []
        self.last_not = not_next

    # -- one event -------------------------------------------------------------------

    def feed(self, partials: list[Partial], conds: Sequence[bool], ts: float, payload: Any,
             may_start: bool = True) -> tuple[list[Partial], list[Match], list[Partial]]:
        """Advance by one event: (open partials, matches, timed out partials)."""
        alive: list[Partial] = []
        matches: list[Match] = []
        late: list[Partial] = []
        for p in partials:
            if self.within > 0 and ts - p.start >= self.within:
                late.append(p)
            else:
                self._advance(p, conds, payload, alive, matches)
        if may_start:
            self._start(conds, ts, payload, alive, matches)
        return alive, matches, late

    def _start(self, conds, ts, payload, alive, matches) -> None:
        for i, step in enumerate(self.steps):
            if conds[step.cond]:
                self._took(i, 1, ts, (payload,), 1 if i == 0 else 0, alive, matches)
            if not step.optional:
                break

    def _advance(self, p: Partial, conds, payload, alive, matches) -> None:
        if p.step == len(self.steps):           # only the trailing "not next" is open
            if not any(conds[c] for c in self.last_not):
                matches.append(Match(p.events, p.first_len))
            return
        if p.count == 0:
            self._enter(p, p.step, p.adjacent, conds, payload, alive, matches)
            return
        step = self.steps[p.step]
        following = self.steps[p.step + 1] if p.step + 1 < len(self.steps) else None
        if following and any(conds[c] for c in following.not_between):
            return
        if conds[step.cond]:
            self._took(p.step, p.count + 1, p.start, (*p.events, payload),
                       p.first_len + (p.step == 0), alive, matches)
        else:
            alive.append(p._replace(adjacent=False))
        # leave the loop on this event; a loop that passed an event left it then
        if p.count >= step.least and p.adjacent:
            if following:
                self._enter(p, p.step + 1, True, conds, payload, alive, matches)
            elif self.last_not and not any(conds[c] for c in self.last_not):
                matches.append(Match(p.events, p.first_len))

    def _enter(self, p: Partial, i: int, adjacent: bool, conds, payload, alive, matches) -> None:
        """Offer the event to step ``i``, which has taken nothing yet."""
        step = self.steps[i]
        if any(conds[c] for c in step.not_between):
            return
        if adjacent and any(conds[c] for c in step.not_next):
            return
        # an event the greedy loop before could take belongs to the loop
        loop = self.steps[i - 1] if i else None
        if not (loop and loop.greedy and conds[loop.cond]):
            if conds[step.cond]:
                self._took(i, 1, p.start, (*p.events, payload), p.first_len, alive, matches)
            elif not step.strict:
                alive.append(Partial(i, 0, False, p.start, p.events, p.first_len))
        if step.optional and adjacent and i + 1 < len(self.steps):
            self._enter(p, i + 1, adjacent, conds, payload, alive, matches)

    def _took(self, i: int, count: int, start, events, first_len, alive, matches) -> None:
        step = self.steps[i]
        done = count >= step.least
        if done and all(s.optional for s in self.steps[i + 1:]) and not self.last_not:
            matches.append(Match(events, first_len))
        if step.most is None or count < step.most:
            alive.append(Partial(i, count, True, start, events, first_len))
        elif i + 1 < len(self.steps) or self.last_not:
            alive.append(Partial(i + 1, 0, True, start, events, first_len))
