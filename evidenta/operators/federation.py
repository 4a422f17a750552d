"""Answers of several environments as one, and acceptance of replicated records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenta.operators.chain import COMMITTED, canonical, link_column
from evidenta.plans.proof import Proof

PART = 1 << 16  # arrival numbers of a range


@dataclass(frozen=True)
class Registry:
    """The environments that must answer. ``signing_text`` is what an attestation signs."""

    members: tuple[str, ...]
    version: int = 1
    attested: bool = False

    @staticmethod
    def of(names: list[str], version: int = 1, attested: bool = False) -> "Registry":
        return Registry(tuple(sorted(set(names))), version, attested)

    @property
    def signing_text(self) -> str:
        return f"registry/v1|{self.version}|{len(self.members)}|" + "|".join(f"{len(m)}:{m}" for m in self.members)


@dataclass
class Composed:
    rows: DataFrame | None
    proof: Proof
    silent: list[str] = field(default_factory=list)
    unexpected: list[str] = field(default_factory=list)


def compose(registry: Registry, answers: dict[str, tuple[DataFrame, Proof]]) -> Composed:
    """Union without deduplication in (recorded_at, id) order; full only if all members answered in full."""
    silent = [m for m in registry.members if m not in answers]
    unexpected = sorted(set(answers) - set(registry.members))
    reasons = [] if registry.attested else ["the registry is not attested"]
    reasons += [f"{m} did not answer" for m in silent] + [f"{m} is not in the registry" for m in unexpected]
    reasons += [f"{m}: {r}" for m, (_, p) in sorted(answers.items()) if not p.is_full for r in p.unproved or (p.status,)]
    rows = None
    for name, (frame, _) in sorted(answers.items()):
        part = frame.withColumn("environment", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return Composed(None if rows is None else rows.orderBy("recorded_at_nanos", "record_id"), Proof().downgrade(*reasons), silent, unexpected)


def fan_out(registry: Registry, peers: dict[str, Callable[[], tuple[DataFrame, Proof]]]) -> Composed:
    """Ask every peer; one that fails is silent, never empty."""
    answers = {}
    for name, ask in peers.items():
        try:
            answers[name] = ask()
        except Exception:  # noqa: BLE001, S112  whatever a peer fails with, it did not answer
            continue
    return compose(registry, answers)


def first_refusal(records: DataFrame, shard: int, head: str | None = None, bits: int = 384, columns: list[str] = COMMITTED, part: int = PART) -> DataFrame:
    """The first reason to refuse a replicated run of records, as one row ``(at_seq, refusal)``; no row if accepted.

    Order for each record: shard-changed, not-contiguous, link-broken; before all, empty and, with a ``head``,
    not-a-continuation. A record follows on if it has the next number of its segment or is the first of the next one.
    Links are computed here, from bytes, and never taken from the sender. ``arrival`` is cut into ranges of ``part``
    numbers that are checked in parallel; only the last record of each range meets the others.
    """
    body = F.sha2(canonical(columns), bits)
    rows = records.select("arrival", "shard", "segment_id", "seq", "prev_hash", link_column(F.col("prev_hash"), F.col("seq"), body, bits).alias("made"), F.expr(f"arrival div {part}").alias("part"))
    last = F.struct("made", "segment_id", "seq")
    order = Window.partitionBy("part").orderBy("arrival")
    # one row a range
    tails = rows.groupBy("part").agg(F.max_by(last, "arrival").alias("tail"))
    tails = tails.select(F.col("part").alias("tail_part"), F.lag("tail").over(Window.orderBy("part")).alias("tail"))
    seen = rows.withColumn("last", F.lag(last).over(order)).join(tails, F.col("part") == F.col("tail_part")).withColumn("last", F.coalesce("last", "tail"))
    first: Column = F.col("last").isNull()
    follows = ((F.col("segment_id") == F.col("last.segment_id")) & (F.col("seq") == F.col("last.seq") + 1)) | ((F.col("segment_id") == F.col("last.segment_id") + 1) & (F.col("seq") == 1))
    refusal = F.when(first & F.lit(head is not None) & (F.col("prev_hash") != F.lit(head)), "not-a-continuation").when(F.col("shard") != shard, "shard-changed")
    refusal = refusal.when(~first & ~follows, "not-contiguous").when(~first & (F.col("prev_hash") != F.col("last.made")), "link-broken")
    bad = seen.select("arrival", F.col("seq").alias("at_seq"), refusal.alias("refusal")).where("refusal is not null").orderBy("arrival").limit(1).select("at_seq", "refusal")
    empty = records.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("long").alias("at_seq"), F.lit("empty").alias("refusal"))
    return bad.unionByName(empty)
