"""Proof statuses and the planning of provable predicates."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from evidenta.schema import DIMENSIONS, EVENT_TYPES

LOWEST, HIGHEST = None, None
ONE_AT_A_TIME = "a second predicate on a provable dimension, and the index sorts by one at a time"


@dataclass(frozen=True)
class Proof:
    """``full``, ``partial`` with its reasons, or ``none`` with why. Downgrades only go down."""

    status: str = "full"
    unproved: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()

    @property
    def is_full(self) -> bool:
        return self.status == "full"

    def downgrade(self, *reasons: str) -> "Proof":
        if not reasons or self.status == "none":
            return self
        return replace(self, status="partial", unproved=tuple(dict.fromkeys((*self.unproved, *reasons))))

    def refuse(self, why: str) -> "Proof":
        return replace(self, status="none", unproved=(why,))

    def both(self, other: "Proof") -> "Proof":
        if self.status == "none" or other.status == "none":
            return self if self.status == "none" else other
        return self.downgrade(*other.unproved)


@dataclass(frozen=True)
class Predicate:
    """``equals`` or ``between`` on a column, an ``opaque`` text, or ``absorbed`` into another bound."""

    kind: str
    column: str = ""
    lo: object = None  # None: no bound
    hi: object = None
    text: str = ""

    @staticmethod
    def equals(column: str, key) -> "Predicate":
        return Predicate("equals", column, key, key)

    @staticmethod
    def between(column: str, lo=None, hi=None) -> "Predicate":
        return Predicate("between", column, lo, hi)

    @staticmethod
    def opaque(text: str) -> "Predicate":
        return Predicate("opaque", text=text)


@dataclass(frozen=True)
class Plan:
    dimension: str
    lo: object
    hi: object
    placements: tuple[str, ...]
    unproved: tuple[str, ...] = field(default=())

    @property
    def proof(self) -> Proof:
        return Proof().downgrade(*self.unproved)


def key_of(column: str, value) -> object | None:
    """An index key for a literal, or None if the literal has not the column's shape (never coerced)."""
    if column == "recorded_at_nanos":
        return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else None
    if not isinstance(value, str):
        return None
    if column == "record_id":
        return value if len(value) == 32 and not set(value) - set("0123456789abcdef") else None
    if column == "event_type":
        return value if value in EVENT_TYPES else None
    return value if column in DIMENSIONS else None


def merge_bounds(predicates: list[Predicate]) -> list[Predicate]:
    """Ranges on one column are one range: the first holds the intersection, the others are absorbed."""
    out, first = [], {}
    for p in predicates:
        if p.kind != "between":
            out.append(p)
        elif p.column not in first:
            first[p.column] = len(out)
            out.append(p)
        else:
            at = first[p.column]
            lows = [x for x in (out[at].lo, p.lo) if x is not None]
            highs = [x for x in (out[at].hi, p.hi) if x is not None]
            out[at] = replace(out[at], lo=max(lows, default=None), hi=min(highs, default=None))
            out.append(Predicate("absorbed", p.column))
    return out


def plan(predicates: list[Predicate], fallback: str = "recorded_at_nanos") -> Plan:
    """Which predicate the sorted index answers, and why the others are not proved."""
    predicates = merge_bounds(predicates)
    usable = lambda kind: next((i for i, p in enumerate(predicates) if p.kind == kind and p.column in DIMENSIONS), None)
    chosen = usable("equals")
    chosen = usable("between") if chosen is None else chosen
    placements, unproved = [], []
    for i, p in enumerate(predicates):
        if i == chosen or p.kind == "absorbed":
            placements.append("indexed")
        else:
            placements.append("engine")
            unproved.append(p.text if p.kind == "opaque" else f"{p.column}: {ONE_AT_A_TIME}")
    if chosen is None:
        return Plan(fallback, None, None, tuple(placements), tuple(dict.fromkeys(unproved)))
    c = predicates[chosen]
    return Plan(c.column, c.lo, c.hi, tuple(placements), tuple(dict.fromkeys(unproved)))
