"""Crypto-erasure bookkeeping: sealed payloads, subjects' keys, forgetting, and the manifest of it.

Each payload is sealed under a random key of its own, which a provider holds in a table with its own access; a subject
owns the keys that were attributed to it. Forgetting destroys keys, rewrites no payload, and leaves it
unreadable: a destroyed key leaves a tombstone, is derived from nothing, and is never issued again.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload classes from the least to the most restrictive.
RESTRICTIVE = ["diagnostic", "document", "tool_arguments", "tool_result", "completion", "prompt"]


def most_restrictive(classes: Column) -> Column:
    """Of an array of payload classes."""
    rank = F.transform(classes, lambda c: F.array_position(F.array(*[F.lit(x) for x in RESTRICTIVE]), c))
    return F.element_at(F.array(*[F.lit(x) for x in RESTRICTIVE]), F.greatest(F.lit(1), F.array_max(rank).cast("int")))


def key_id(record_id: Column) -> Column:
    return F.concat(F.lit("key-"), F.substring(F.sha2(F.concat_ws("|", F.lit("key/v1"), record_id), 256), 1, 40))


class KeyProvider:
    """A table ``key_id, key`` of random 256-bit keys in a folder; a null key is destroyed for good.

    Each change writes a whole new version beside the old one and deletes the old ones after it, so a run that
    dies leaves one readable version, and no older version keeps a destroyed key.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def table(self) -> DataFrame:
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], "key_id string, key binary")
        return self.spark.read.schema("key_id string, key binary").parquet(f"{self.folder}/v{found[-1]}")

    def _replace(self, frame: DataFrame) -> None:
        old = self._versions()
        frame.write.mode("overwrite").parquet(f"{self.folder}/v{old[-1] + 1 if old else 0}")
        for v in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{v}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def issue(self, ids: DataFrame) -> DataFrame:
        """Keys for ids that have none yet; an id whose key was destroyed stays without one."""
        held = self.table()
        fresh = ids.select("key_id").distinct().join(held.select("key_id"), "key_id", "left_anti")

        def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(key=[secrets.token_bytes(32) for _ in range(len(batch))])

        if not fresh.isEmpty():
            self._replace(held.unionByName(fresh.mapInPandas(drawn, "key_id string, key binary")))
        return self.table()

    def destroy(self, ids: DataFrame) -> None:
        gone = ids.select("key_id").distinct().withColumn("gone", F.lit(True))
        self._replace(self.table().join(gone, "key_id", "left").select("key_id", F.when(F.col("gone").isNull(), F.col("key")).alias("key")))


def _aad(record_id: Column, kind: Column, content_hash: Column, key_id: Column) -> Column:
    return F.concat_ws("|", record_id, kind, content_hash, key_id)


def seal(payloads: DataFrame, provider: KeyProvider) -> DataFrame:
    """``record_id, payload_class, key_id, payload_hash, sealed`` of ``record_id, payload_class, content`` (binary).

    AES-256-GCM; the additional data bind record, class, content hash and key. The nonce is derived from
    what is sealed under a key that seals once, so a rerun writes the same bytes. Keys are joined from the
    provider's table and stand in no plan.
    """
    rows = payloads.withColumn("key_id", key_id(F.col("record_id"))).withColumn("payload_hash", F.sha2("content", 384))
    keyed = rows.join(provider.issue(rows), "key_id").where("key is not null")
    nonce = F.substring(F.unhex(F.sha2(F.concat_ws("|", F.lit("nonce/v1"), "record_id", "payload_hash"), 256)), 1, 12)
    aad = _aad(F.col("record_id"), F.col("payload_class"), F.col("payload_hash"), F.col("key_id"))
    sealed = F.aes_encrypt(F.col("content"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)
    return keyed.select("record_id", "payload_class", "key_id", "payload_hash", sealed.alias("sealed"))


def open_(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """``record_id, status, content``: opened, missing, erased, wrong-key or wrong-content."""
    joined = sealed.join(keys.withColumn("known", F.lit(True)), "key_id", "left")
    aad = _aad(F.col("record_id"), F.col("payload_class"), F.col("payload_hash"), F.col("key_id"))
    content = F.try_aes_decrypt(F.col("sealed"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), aad)
    status = F.when(F.col("known").isNull(), "missing").when(F.col("key").isNull(), "erased").when(F.col("content").isNull(), "wrong-key")
    status = status.when(F.sha2("content", 384) != F.col("payload_hash"), "wrong-content").otherwise("opened")
    return joined.withColumn("content", content).select("record_id", status.alias("status"), F.when(status == "opened", F.col("content")).alias("content"))


def subject_tag(subject: Column) -> Column:
    """What an erasure names a subject by; the subject itself is not stored."""
    return F.sha2(F.concat_ws("|", F.lit("subject/v1"), subject), 384)


def attribute(ledger: DataFrame | None, subject_keys: DataFrame) -> DataFrame:
    """Add ``(subject, key_id)`` rows to the ledger; no payload is rewritten."""
    rows = subject_keys.select(subject_tag(F.col("subject")).alias("subject_tag"), "key_id")
    return (rows if ledger is None else ledger.unionByName(rows)).distinct()


@dataclass
class Forgotten:
    """``manifest``: ``entry, outcome, completes_at, reversible``, one row a key; ``ledger``: what still awaits erasure stays in it."""

    manifest: DataFrame
    ledger: DataFrame
    verdict: str


def forget(subject: str, ledger: DataFrame, provider: KeyProvider, now_nanos: int, scheduled_for: int | None = None) -> Forgotten:
    """Destroy all keys of a subject, now or at a later time.

    The manifest has one hashed entry a key, sorted, with ``now``, ``already`` or ``scheduled`` and when it completes; only
    what is scheduled can be taken back, so its rows stay in the ledger until a call at or after that time. The
    erasure record's verdict: ``not_applicable`` without keys, ``held`` while any is scheduled, else ``allowed``.
    """
    tag = subject_tag(F.lit(subject))
    mine = ledger.where(F.col("subject_tag") == tag).select("key_id").distinct()
    later = scheduled_for is not None and scheduled_for > now_nanos
    state = F.when(F.col("key").isNull(), "already").when(F.lit(later), "scheduled").otherwise("now")
    entry = F.sha2(F.concat_ws("|", F.lit("erased/v1"), tag, "key_id"), 384)
    touched = mine.join(provider.table(), "key_id", "left").select("key_id", state.alias("outcome"), entry.alias("entry"))
    waits = F.col("outcome") == "scheduled"
    # settled before keys go: the manifest says what was found
    rows = [(r["key_id"], r["entry"], r["outcome"], scheduled_for if r["outcome"] == "scheduled" else now_nanos, r["outcome"] == "scheduled") for r in touched.collect()]  # one subject's keys
    found = ledger.sparkSession.createDataFrame(rows, "key_id string, entry string, outcome string, completes_at long, reversible boolean")
    due = found.where("outcome = 'now'")
    if any(r[2] == "now" for r in rows):
        provider.destroy(due)
    left = ledger.join(found.where(~waits).select("key_id", tag.alias("subject_tag")), ["subject_tag", "key_id"], "left_anti")
    outcomes = {r[2] for r in rows}
    verdict = "not_applicable" if not outcomes else "held" if "scheduled" in outcomes else "allowed"
    return Forgotten(found.select("entry", "outcome", "completes_at", "reversible").orderBy("entry"), left, verdict)
