"""What a segment's rows prove against its manifest: nothing of the rows is trusted, the manifests are.

For one index dimension each segment is rebuilt where its rows are: digests of the records, the chain through them,
the index of the dimension and its tree. A segment is proved when all that its manifest commits to follows from
the rows, so no row was removed, added, changed or moved, and a range of the index is known to be complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenta.operators import chain
from evidenta.schema import EVENT_TYPES

PLACE = ["shard", "segment_id"]
REASONS = ["not-committed", "missing", "wrong-size", "link-broken", "chain-broken", "wrong-ends", "wrong-root"]


def outside(manifest_lo, manifest_hi, lo, hi):
    """Whether a committed time span (columns or numbers) lies outside a range; None is no bound."""
    apart = F.lit(False)
    if lo is not None:
        apart = apart | (manifest_hi < lo)
    if hi is not None:
        apart = apart | (manifest_lo > hi)
    return apart


def check(records: DataFrame, manifests: DataFrame, dimension: str, lo=None, hi=None, bits: int = 384, columns: list[str] | None = None) -> DataFrame:
    """``shard, segment_id, n_records, n_entries, status, reason`` for each segment that can hold a key in ``lo..hi``.

    ``n_records`` is what the manifest commits to (null: no manifest), ``n_entries`` the index entries
    in the range. Only time may rule segments out, by their committed spans; rows of a segment without a
    manifest always count. Groups are segments, which have a few thousand rows, and are checked in parallel.
    """
    columns = columns or chain.COMMITTED
    wanted = manifests
    if dimension == "recorded_at_nanos":
        wanted = manifests.where(~outside(F.col("min_recorded_at"), F.col("max_recorded_at"), lo, hi))
        skipped = manifests.where(outside(F.col("min_recorded_at"), F.col("max_recorded_at"), lo, hi)).select(*PLACE)
        records = records.join(skipped, PLACE, "left_anti")
    order = Window.partitionBy(*PLACE).orderBy("seq", "record_id")
    link = chain.link_column(F.col("prev_hash"), F.col("seq"), F.sha2(chain.canonical(columns), bits), bits)
    key = chain.key_column(dimension)
    inside = F.lit(True)
    for bound, holds in ((lo, lambda b: key >= b), (hi, lambda b: key <= b)):
        if bound is not None:
            inside = inside & holds(F.lit(_text(dimension, bound)))
    rows = records.select(
        *PLACE, "seq", "prev_hash", "chain_link", key.alias("key"), inside.alias("inside"), (link == F.col("chain_link")).alias("linked"),
        F.coalesce(F.col("prev_hash") == F.lag("chain_link").over(order), F.lit(True)).alias("joined"),
    )
    facts = rows.groupBy(*PLACE).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("inside"), 1)).alias("n_entries"), F.count(F.when(~F.coalesce("linked", F.lit(False)), 1)).alias("n_unlinked"), F.count(F.when(~F.col("joined"), 1)).alias("n_apart"),
        F.min_by("prev_hash", "seq").alias("before"), F.max_by("chain_link", "seq").alias("after"),
    )
    roots = chain.merkle_roots(chain.index_entries(records, [dimension], bits), PLACE, "pos", "leaf", bits).select(*PLACE, F.col("root").alias("found_root"))
    said = wanted.select(*PLACE, "n_records", "chain_before", "chain_after", F.col(f"root_{dimension}").alias("said_root"))
    both = said.join(facts.join(roots, PLACE, "left"), PLACE, "full")
    reason = (
        F.when(F.col("n_records").isNull(), "not-committed").when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("n_records"), "wrong-size")
        .when(F.col("n_unlinked") > 0, "link-broken").when(F.col("n_apart") > 0, "chain-broken")
        .when(~F.col("before").eqNullSafe(F.col("chain_before")) | ~F.col("after").eqNullSafe(F.col("chain_after")), "wrong-ends")
        .when(~F.col("found_root").eqNullSafe(F.col("said_root")), "wrong-root")
    )
    return both.select(*PLACE, "n_records", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.when(reason.isNull(), "full").otherwise("partial").alias("status"), reason.alias("reason"))


def _text(dimension: str, bound) -> str:
    """A bound as its index key; event types are given by their names."""
    if dimension == "recorded_at_nanos":
        return str(bound).rjust(20, "0")
    return str(EVENT_TYPES[bound]).rjust(3, "0") if dimension == "event_type" else bound


def failures(found: DataFrame) -> tuple[str, ...]:
    """Reasons for a proof: the kinds of failure with their numbers of segments, and the first place."""
    bad = found.where("reason is not null")
    counts = bad.groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).collect()  # a row a kind
    return tuple(f"{r['reason']}: {r['n']} segment{'s' if r['n'] > 1 else ''}, first {r['first'][0]}/{r['first'][1]}" for r in sorted(counts, key=lambda r: REASONS.index(r["reason"])))
