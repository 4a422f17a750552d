"""Range proofs over a segment's sorted index, and their composition over segments, shards and the store."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenta.operators.chain import ENTRY, inclusion, leaf_hash, levels, verify_inclusion


@dataclass(frozen=True)
class Entry:
    key: str
    seq: int
    chain_link: str

    def leaf(self, bits: int = 384) -> str:
        return leaf_hash(f"{ENTRY}|{len(self.key)}:{self.key}|{self.seq}|{self.chain_link}", bits)


@dataclass(frozen=True)
class Placed:
    entry: Entry
    at: int
    path: tuple[str, ...]


@dataclass(frozen=True)
class RangeProof:
    """All entries of a key range with the neighbours that show nothing lies between."""

    dimension: str
    lo: str
    hi: str
    size: int
    root: str
    entries: tuple[Placed, ...] = ()
    left: Placed | None = None
    right: Placed | None = None


class SortedIndex:
    """One segment's index of one dimension: entries in order of (key, seq), and its tree."""

    def __init__(self, dimension: str, entries: list[Entry], bits: int = 384):
        self.dimension, self.bits = dimension, bits
        self.entries = sorted(entries, key=lambda e: (e.key, e.seq))
        places = [(e.key, e.seq) for e in self.entries]
        if len(set(places)) < len(places):
            raise ValueError("duplicate position")
        self.tree = levels([e.leaf(bits) for e in self.entries], bits) if entries else []
        self.root = self.tree[-1][0] if entries else leaf_hash("empty", bits)

    def _placed(self, at: int) -> Placed:
        return Placed(self.entries[at], at, tuple(inclusion(self.tree, at)))

    def range(self, lo: str, hi: str) -> RangeProof:
        """A reversed range is empty, not an error."""
        inside = [i for i, e in enumerate(self.entries) if lo <= e.key <= hi]
        before = max((i for i, e in enumerate(self.entries) if e.key < lo), default=None)
        after = min((i for i, e in enumerate(self.entries) if e.key > hi), default=None)
        if lo > hi:
            inside, before, after = [], None, None
        return RangeProof(self.dimension, lo, hi, len(self.entries), self.root, tuple(map(self._placed, inside)), None if before is None else self._placed(before), None if after is None else self._placed(after))


def verify_range(proof: RangeProof, dimension: str, lo: str, hi: str, size: int, root: str, bits: int = 384) -> list[str]:
    """Why a range proof fails against what the verifier itself knows; empty if it holds."""
    found = []
    for name, ours, theirs in (("wrong-dimension", dimension, proof.dimension), ("wrong-range", (lo, hi), (proof.lo, proof.hi)), ("wrong-size", size, proof.size), ("wrong-root", root, proof.root)):
        if ours != theirs:
            found.append(name)
    if found:
        return found
    if lo > hi:
        return ["entries-in-reversed-range"] if proof.entries else []
    if size == 0:
        return ["entries-in-empty-index"] if proof.entries or proof.left or proof.right else []
    row = [p for p in (proof.left, *proof.entries, proof.right) if p]
    for p in row:
        if not verify_inclusion(p.entry.leaf(bits), p.at, size, list(p.path), root, bits):
            found.append("inclusion-broken")
            break
    for p in proof.entries:
        if not lo <= p.entry.key <= hi:
            found.append("entry-outside-range")
            break
    if any((a.entry.key, a.entry.seq) >= (b.entry.key, b.entry.seq) for a, b in zip(row, row[1:])):
        found.append("not-sorted")
    if any(b.at != a.at + 1 for a, b in zip(row, row[1:])):
        found.append("gap")
    if proof.left and proof.left.entry.key >= lo:
        found.append("left-boundary-inside")
    if proof.right and proof.right.entry.key <= hi:
        found.append("right-boundary-inside")
    if not row:
        found.append("nothing-shown")
    else:
        if not proof.left and row[0].at != 0:
            found.append("left-boundary-missing")
        if not proof.right and row[-1].at != size - 1:
            found.append("right-boundary-missing")
    return found


def indexes(entries: DataFrame, dimension: str, segments: list[tuple[int, int]], bits: int = 384) -> dict[tuple[int, int], SortedIndex]:
    """Indexes of the touched segments alone, gathered for proofs (a segment holds a few thousand entries)."""
    places = F.concat_ws("/", "shard", "segment_id").isin([f"{a}/{b}" for a, b in segments])
    rows = entries.where((F.col("dimension") == dimension) & places).select("shard", "segment_id", "key", "seq", "chain_link").collect()
    found: dict[tuple[int, int], list[Entry]] = {tuple(s): [] for s in segments}
    for r in rows:
        found[(r["shard"], r["segment_id"])].append(Entry(r["key"], r["seq"], r["chain_link"]))
    return {k: SortedIndex(dimension, v, bits) for k, v in found.items()}


@dataclass(frozen=True)
class CompositeProof:
    """A range answered over all segments: each proved, or skipped by its committed time span."""

    dimension: str
    lo: str
    hi: str
    segments: dict[tuple[int, int], RangeProof] = field(default_factory=dict)
    skipped: frozenset[tuple[int, int]] = frozenset()


def compose(dimension: str, lo: str, hi: str, manifests: list, entries: DataFrame, bits: int = 384, root_of=None) -> CompositeProof:
    """``manifests``: rows of the manifest table. Only the time dimension may skip segments, by their span."""
    skip = set()
    if dimension == "recorded_at_nanos":
        skip = {(m["shard"], m["segment_id"]) for m in manifests if _outside(m, lo, hi)}
    touched = [(m["shard"], m["segment_id"]) for m in manifests if (m["shard"], m["segment_id"]) not in skip]
    found = indexes(entries, dimension, touched, bits)
    return CompositeProof(dimension, lo, hi, {k: i.range(lo, hi) for k, i in found.items()}, frozenset(skip))


def _outside(m, lo: str, hi: str) -> bool:
    return str(m["max_recorded_at"]).rjust(20, "0") < lo or str(m["min_recorded_at"]).rjust(20, "0") > hi


def verify_composite(proof: CompositeProof, dimension: str, lo: str, hi: str, manifests: list, bits: int = 384) -> list[str]:
    """Failures over the manifests the verifier holds; every segment must be answered once."""
    found = []
    if (proof.dimension, proof.lo, proof.hi) != (dimension, lo, hi):
        return ["wrong-question"]
    known = {(m["shard"], m["segment_id"]): m for m in manifests}
    found += [f"unknown-segment {s}" for s in [*proof.segments, *proof.skipped] if s not in known]
    found += [f"segment-answered-twice {s}" for s in proof.skipped if s in proof.segments]
    for place, m in known.items():
        if place in proof.skipped:
            if dimension != "recorded_at_nanos":
                found.append(f"skip-not-allowed {place}")
            elif not _outside(m, lo, hi):
                found.append(f"skip-overlaps-span {place}")
        elif place not in proof.segments:
            found.append(f"segment-missing {place}")
        else:
            found += [f"{x} {place}" for x in verify_range(proof.segments[place], dimension, lo, hi, m["n_records"], m[f"root_{dimension}"], bits)]
    return found


def prove(dimension: str, lo: str, hi: str, manifests: DataFrame, entries: DataFrame, bits: int = 384) -> DataFrame:
    """``shard, segment_id, size, entries, skipped, failures, caught``: a composite proof made and verified where each segment's entries are.

    ``failures`` counts those of the segment's own proof; ``caught`` says whether one that leaves out the first entry of the range fails.
    A segment's proof depends on no other, so nothing is gathered; entries of skipped segments are not read, those of a segment without a manifest fail.
    """
    place, root = ["shard", "segment_id"], f"root_{dimension}"
    known = manifests.select(*place, "n_records", F.col(root).alias("root"), "min_recorded_at", "max_recorded_at")
    skip = F.lit(False)
    if dimension == "recorded_at_nanos":
        low, high = (F.lpad(F.col(c).cast("string"), 20, "0") for c in ("min_recorded_at", "max_recorded_at"))
        skip = (high < lo) | (low > hi)
    passed = known.where(skip).select(*place, F.col("n_records").alias("size"), F.lit(0).cast("long").alias("entries"), F.lit(True).alias("skipped"), F.lit(0).alias("failures"), F.lit(False).alias("caught"))
    some = entries.where(F.col("dimension") == dimension).select(*place, "key", "seq", "chain_link").join(known.where(skip).select(*place), place, "left_anti")

    def one(key: tuple, said: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        at = (int(key[0]), int(key[1]))
        made = [{"shard": at[0], "segment_id": at[1], "n_records": int(m.n_records), root: m.root, "min_recorded_at": int(m.min_recorded_at), "max_recorded_at": int(m.max_recorded_at)} for m in said.itertuples()]
        found = SortedIndex(dimension, [Entry(k, int(q), link) for k, q, link in zip(rows["key"], rows["seq"], rows["chain_link"], strict=True)], bits).range(lo, hi)

        def failures(proof: RangeProof) -> int:
            return len(verify_composite(CompositeProof(dimension, lo, hi, {at: proof}), dimension, lo, hi, made, bits))

        caught = bool(found.entries) and failures(replace(found, entries=found.entries[1:])) > 0
        return pd.DataFrame([(*at, made[0]["n_records"] if made else 0, len(found.entries), False, failures(found), caught)])

    schema = "shard int, segment_id long, size long, entries long, skipped boolean, failures int, caught boolean"
    # names of their own: both may come from one table
    said, rows = (f.withColumnsRenamed({c: f"{side}_{c}" for c in place}) for f, side in ((known.where(~skip), "said"), (some, "row")))
    proved = said.groupBy("said_shard", "said_segment_id").cogroup(rows.groupBy("row_shard", "row_segment_id")).applyInPandas(one, schema)
    return proved.unionByName(passed.withColumn("shard", F.col("shard").cast("int")))


def boundaries(entries: DataFrame, dimension: str, lo: str, hi: str) -> DataFrame:
    """Per segment: entries in the range and the positions of both neighbours, by aggregates alone."""
    some = entries.where(F.col("dimension") == dimension)
    return some.groupBy("shard", "segment_id").agg(
        F.count(F.when(F.col("key").between(lo, hi), 1)).alias("n_inside"), F.max(F.when(F.col("key") < lo, F.col("pos"))).alias("left_pos"), F.min(F.when(F.col("key") > hi, F.col("pos"))).alias("right_pos"),
    )


def tampered(proof: RangeProof, **changes) -> RangeProof:
    """A changed copy, for adversarial tests."""
    return replace(proof, **changes)
