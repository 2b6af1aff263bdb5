"""Questions as data: what to measure, in days and raw tokens."""

from __future__ import annotations

import dataclasses
from typing import Literal

PERSON = ["person_id"]
RUN = ["person_id", "age_start", "age_stop"]
GENERATED = ["person_id", "seed", "age_start", "age_stop"]
WINDOW = ["age_start", "age_stop"]


@dataclasses.dataclass(frozen=True)
class Timing:
    """When the occurrence-th target happens, counted from birth or from origin."""

    target: str
    occurrence: int = 1
    origin: Timing | None = None

    def __post_init__(self):
        if self.origin and self.origin.origin:
            raise ValueError("an origin has no origin of its own")


@dataclasses.dataclass(frozen=True)
class Frame:
    """by_age: an age; within: days from the jump-off; within_origin: days from the origin."""

    kind: Literal["by_age", "within", "within_origin"]
    value: int


@dataclasses.dataclass(frozen=True)
class Framed:
    """Does that occurrence fall into the frame?"""

    name: str
    timing: Timing
    frame: Frame
    given: str | None = None

    def __post_init__(self):
        if self.frame.kind == "within_origin" and self.timing.origin is None:
            raise ValueError("within_origin needs an origin")


@dataclasses.dataclass(frozen=True)
class Counted:
    """Do min_events or more fall into the frame, after the jump-off?"""

    name: str
    event: str
    min_events: int
    frame: Frame
    given: str | None = None

    def __post_init__(self):
        if self.frame.kind == "within_origin":
            raise ValueError("a count has no origin")


@dataclasses.dataclass(frozen=True)
class Condition:
    """Groups with min_count to max_count events up to before_age, or up to the jump-off."""

    name: str
    event: str
    min_count: int = 0
    max_count: int | None = None
    before_age: int | None = None


@dataclasses.dataclass(frozen=True)
class Rule:
    """A pattern that can't or shouldn't be. Each field that is set flags by itself."""

    name: str
    event: str
    occurrence: int | None = None
    min_age: int | None = None
    max_age: int | None = None
    min_spacing: int | None = None
    not_after: str | None = None
    not_before: str | None = None
    not_after_occurrence: int = 1
    not_before_occurrence: int = 1
    max_count: int | None = None
    severity: Literal["illegal", "warn"] = "illegal"


@dataclasses.dataclass(frozen=True)
class Replicates:
    interval: Literal["jeffreys", "wilson"] = "jeffreys"
    level: float = 0.95
    min_replicates: int = 5


@dataclasses.dataclass(frozen=True)
class Grid:
    max_parity: int = 6
    age_bin_width: float = 1.0
