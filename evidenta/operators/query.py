"""Point, range and as-of reads with filters, and the status each answer has."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenta.plans.proof import Proof
from evidenta.schema import DIMENSIONS, EVENT_TYPES, SEVERITIES


def severity_rank(column: Column) -> Column:
    """Rank of a severity from 0; null for anything else."""
    out = None
    for i, s in enumerate(SEVERITIES):
        out = F.when(column == s, i) if out is None else out.when(column == s, i)
    return out


def event_code(column: Column) -> Column:
    """The index code of an event type; null for anything else."""
    out = None
    for name, code in EVENT_TYPES.items():
        out = F.when(column == name, code) if out is None else out.when(column == name, code)
    return out


@dataclass(frozen=True)
class Query:
    """A read on one sorted dimension. Filters are applied after it and cost the proof, by name."""

    dimension: str
    lo: object = None
    hi: object = None
    as_of_nanos: int | None = None
    filters: tuple[tuple[str, object], ...] = ()

    @staticmethod
    def point(dimension: str, key) -> "Query":
        return Query(dimension, key, key)

    @staticmethod
    def range(dimension: str, lo, hi) -> "Query":
        return Query(dimension, lo, hi)

    @staticmethod
    def time_between(lo: int, hi: int) -> "Query":
        return Query("recorded_at_nanos", lo, hi)

    def as_of(self, nanos: int) -> "Query":
        """On the time dimension the upper bound narrows (it never widens); elsewhere a filter."""
        if self.dimension == "recorded_at_nanos":
            return replace(self, hi=nanos if self.hi is None else min(self.hi, nanos))
        return replace(self, as_of_nanos=nanos)

    def with_filter(self, name: str, value) -> "Query":
        """``tenant``, ``severity``, ``min_severity``, ``verdict``, ``error`` or ``payload`` (bool)."""
        if name not in _FILTERS:
            raise ValueError(f"there is no filter {name}")
        return replace(self, filters=(*self.filters, (name, value)))

    def key(self) -> Column:
        return event_code(F.col("event_type")) if self.dimension == "event_type" else F.col(self.dimension)

    def bound(self, value):
        return EVENT_TYPES.get(value, -1) if self.dimension == "event_type" else value

    def matched(self, records: DataFrame) -> DataFrame:
        """Rows of the index range alone; a reversed range is empty."""
        if self.dimension not in DIMENSIONS:
            raise ValueError(f"{self.dimension} is not a sorted dimension")
        if self.lo is not None and self.lo == self.hi:
            return records.where(F.col(self.dimension) == self.lo)
        if self.lo is not None:
            records = records.where(self.key() >= self.bound(self.lo))
        return records if self.hi is None else records.where(self.key() <= self.bound(self.hi))

    def rows(self, records: DataFrame) -> DataFrame:
        found = self.matched(records)
        if self.as_of_nanos is not None:
            found = found.where(F.col("recorded_at_nanos") <= self.as_of_nanos)
        for name, value in self.filters:
            found = found.where(_FILTERS[name][1](value))
        return found

    @property
    def proof(self) -> Proof:
        """Filters downgrade even where they remove nothing, each name once."""
        names = [] if self.as_of_nanos is None else ["as_of"]
        return Proof().downgrade(*names, *(_FILTERS[name][0] for name, _ in self.filters))


_FILTERS = {
    "tenant": ("tenant", lambda v: F.col("tenant") == v),
    "severity": ("severity", lambda v: F.col("severity") == v),
    "min_severity": ("severity", lambda v: severity_rank(F.col("severity")) >= SEVERITIES.index(v)),
    "verdict": ("outcome.verdict", lambda v: F.col("verdict") == v),
    "error": ("outcome.error", lambda v: F.col("error") == v),
    "payload": ("payload", lambda v: F.col("payload_hash").isNotNull() if v else F.col("payload_hash").isNull()),
}


@dataclass
class Found:
    rows: DataFrame
    proof: Proof
    matched: DataFrame

    @property
    def matched_before_filters(self) -> int:
        return self.matched.count()


def answer(records: DataFrame, query: Query) -> Found:
    return Found(query.rows(records), query.proof, query.matched(records))
