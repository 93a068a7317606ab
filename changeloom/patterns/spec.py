"""Pattern specification objects.

Semantics, fixed here because they decide results:

* ``next`` is the adjacent event; ``followedby`` takes the first later event that
  matches; ``notnext`` and ``notfollowedby`` forbid an event right after, or
  anywhere before the next stage's event;
* inside a quantified stage events need not be adjacent, and each step takes the
  first later event that matches;
* an open quantifier gives one match per possible length; after a greedy one, an event
  the loop could take ends the wait for the next stage;
* the last event is less than ``within_seconds`` after the first;
* skip strategies work through matches by first event, then by completion.
  ``skip_past_last_event`` drops those that start at or before the last event of a
  kept match, ``skip_to_first`` / ``skip_to_last`` those that start before its first
  / last event of the begin stage.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

KINDS = ("begin", "next", "followedby", "notnext", "notfollowedby")
QUANTIFIERS = ("", "times", "oneormore", "timesormore", "timesgreedy", "timesoptional")
STRATEGIES = ("no_skip", "skip_past_last_event", "skip_to_first", "skip_to_last")
OUTPUTS = ("agg", "detail", "filteredrow", "timeout")
FUNCTIONS = ("min", "max", "head", "last", "sum", "avg", "count")


@dataclass(frozen=True)
class Stage:
    """One stage: kind, condition (tree of FLT-10, Column, SQL text or none), quantifier."""

    kind: str
    condition: Mapping[str, Any] | Column | str | None = None
    quantifier: str = ""
    times: int = 1

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown stage kind {self.kind!r}")
        if self.quantifier not in QUANTIFIERS:
            raise ValueError(f"unknown quantifier {self.quantifier!r}")
        if self.negative and self.quantifier:
            raise ValueError("a negative stage takes no quantifier")

    @property
    def negative(self) -> bool:
        return self.kind.startswith("not")


@dataclass(frozen=True)
class OutputField:
    """An aggregate of the output: function, column and output name."""

    function: str
    field: str = ""
    alias: str = ""

    @property
    def name(self) -> str:
        return self.alias or self.field


@dataclass(frozen=True)
class Output:
    """How a match is written: ``agg``, ``detail``, ``filteredrow`` or ``timeout``."""

    kind: str = "detail"
    fields: Sequence[OutputField] = ()

    def __post_init__(self):
        if self.kind not in OUTPUTS:
            raise ValueError(f"unknown output {self.kind!r}")
        names = [f.name for f in self.fields]
        if self.kind == "agg" and len(names) != len(set(names)):
            raise ValueError("output aliases must differ")
        for f in self.fields:
            if f.function not in FUNCTIONS:
                raise ValueError(f"unknown output function {f.function!r}")


@dataclass(frozen=True)
class PatternSpec:
    """Stages, keys, skip strategy, time bound (-1: none) and output."""

    stages: Sequence[Stage]
    key_by: Sequence[str] = ()
    strategy: str = "no_skip"
    within_seconds: float = -1
    output: Output = field(default_factory=Output)

    def __post_init__(self):
        if not self.stages or self.stages[0].kind != "begin":
            raise ValueError("the first stage is begin")
        if any(s.kind == "begin" for s in self.stages[1:]):
            raise ValueError("only the first stage is begin")
        if self.stages[-1].kind == "notfollowedby":
            raise ValueError("notfollowedby may not be the last stage")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")

    @classmethod
    def from_json(cls, text: str) -> "PatternSpec":
        """Read the JSON form of a pattern."""
        d = json.loads(text)
        stages = []
        for s in d["pattern_seq"]:
            q = s.get("quantifier") or {}
            stages.append(Stage(s["pattern_type"].lower(), s.get("conditions") or None,
                                (q.get("type") or "").lower(), int(q.get("value") or 1)))
        out = d.get("output") or {"type": "detail"}
        fields = out.get("field_list") or []
        fields = json.loads(fields) if isinstance(fields, str) else fields
        keys = d.get("key_by_fields") or ""
        return cls(tuple(stages), tuple(k.strip() for k in keys.split(",") if k.strip()),
                   d.get("strategy", "no_skip").lower(),
                   float(d.get("max_interval_seconds", -1)),
                   Output(out["type"].lower(), tuple(
                       OutputField(f["function_type"], f.get("field_name", ""),
                                   f.get("alias_name", "")) for f in fields)))
