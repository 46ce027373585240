"""What a statement asks for, after the front end has read it."""

from __future__ import annotations

from dataclasses import dataclass, field

AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG")


@dataclass(frozen=True)
class Aggregate:
    """``function(argument) AS alias``; without an argument it counts rows. ``fill`` is COALESCE's second part."""

    function: str
    argument: str | None
    alias: str
    fill: str | None = None


@dataclass(frozen=True)
class Derived:
    """A sum of aliases of the same SELECT."""

    alias: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class WindowShape:
    kind: str  # tumble, hop, session
    event_time: str
    size_ms: int  # a session's gap
    slide_ms: int | None
    group_columns: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]
    derived: tuple[Derived, ...] = ()
    where: str | None = None
    source: str | None = None  # None: a union of tables

    @property
    def output_columns(self) -> list[str]:
        return [*self.group_columns, "window_start", "window_end", *(a.alias for a in self.aggregates), *(d.alias for d in self.derived)]


@dataclass(frozen=True)
class JoinColumn:
    side: str  # left or right
    column: str
    alias: str


@dataclass(frozen=True)
class IntervalJoinShape:
    """left.key = right.key and the other time between the base's time + lower and + upper, both inclusive."""

    left: str
    right: str
    left_alias: str
    right_alias: str
    left_key: str
    right_key: str
    left_time: str
    right_time: str
    base_is_left: bool
    lower_ms: int
    upper_ms: int
    columns: tuple[JoinColumn, ...]
    where: str | None = None


@dataclass(frozen=True)
class LookupShape:
    left: str
    right: str
    left_alias: str
    right_alias: str
    left_key: str
    right_key: str
    kind: str  # inner, left
    items: tuple[str, ...]
    where: str | None = None


@dataclass(frozen=True)
class Branch:
    """A plain SELECT of one table."""

    source: str
    alias: str
    items: tuple[str, ...]
    where: str | None = None
    limit: int | None = None
    inner: Branch | None = None  # a derived table in FROM


@dataclass(frozen=True)
class Statement:
    """``kind``: plain, union, window, interval, lookup, or general (batch only)."""

    kind: str
    target: str
    select_sql: str
    source_tables: tuple[str, ...]
    plain: Branch | None = None
    union: tuple[Branch, ...] = field(default=())
    window: WindowShape | None = None
    interval: IntervalJoinShape | None = None
    lookup: LookupShape | None = None
    why_batch_only: str | None = None
