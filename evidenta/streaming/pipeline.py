"""Structured Streaming: event files to sealed segments, at least once, each id kept once.

Every micro-batch is deduplicated, chained after the last sealed segment of its shard and appended as one
segment; the checkpoint commits the source position only after that, so a batch that died is read again and
its ids are found sealed already. Late data are never dropped: ``recorded_at`` is ours, the emitter's
time is kept as it came, and the skew between both is recorded.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from evidenta.operators import chain, ingest
from evidenta.schema import RECORDS
from evidenta.sources import agent_event

SEAL_RECORDS, SEAL_SECONDS = 4096, 60


def read_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of files as they appear; ``max_files`` a batch holds back the rest."""
    reader = spark.readStream.option("lineSep", "\n")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(folder)


def as_records(mapped: DataFrame, shard: int, now_nanos: int, seed: int = 0) -> DataFrame:
    """Mapped agent events as records without a place yet. The id follows from the line's content, so a
    line delivered twice has one id."""
    kept = mapped.where("reject_reason is null")
    text = F.to_json(F.struct(*[c for c in mapped.columns]))
    rid = F.substring(F.sha2(text, 256), 1, 32)
    made = {
        "record_id": rid, "shard": F.lit(shard), "recorded_at_nanos": F.lit(now_nanos), "clock_skew_nanos": ingest.skew(F.col("occurred_at_nanos"), F.lit(now_nanos)),
        "payload_hash": F.when(F.col("payload").isNotNull(), F.sha2("payload", 384)), "payload_size_bytes": F.octet_length("payload"), "payload_class": F.when(F.col("payload").isNotNull(), "diagnostic"),
        "hash_alg": F.lit("sha384"), "sig_alg": F.lit("es384"), "kem_alg": F.lit("mlkem768"), "chain_link": F.lit(""), "prev_hash": F.lit(""), "segment_id": F.lit(0), "seq": F.lit(0),
    }
    out = []
    for f in RECORDS.fields:
        c = made.get(f.name)
        if c is None:
            c = F.col(f.name) if f.name in mapped.columns else F.expr("cast(array() as array<string>)") if f.dataType.simpleString().startswith("array") else F.lit(None)
        out.append((c if isinstance(f.dataType, ArrayType) else c.cast(f.dataType)).alias(f.name))
    return kept.select(*out)


def append(rows: DataFrame, table: str, bits: int = 384) -> int:
    """Seal rows as the next segment of their shard; ids that are sealed already are left out."""
    spark = rows.sparkSession
    try:
        sealed = spark.read.parquet(table)
        rows = rows.join(sealed.select("record_id"), "record_id", "left_anti").select(*rows.columns)
        heads = {r["shard"]: (r["segment_id"], r["head"]) for r in sealed.groupBy("shard").agg(F.max("segment_id").alias("segment_id"), F.max_by("chain_link", F.struct("segment_id", "seq")).alias("head")).collect()}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        heads = {}
    rows = ingest.deduplicated(rows)
    order = Window.partitionBy("shard").orderBy("recorded_at_nanos", "occurred_at_nanos", "record_id")
    last = F.create_map(*[F.lit(x) for s, (n, _) in heads.items() for x in (s, n)]) if heads else None
    segment = F.coalesce(last[F.col("shard")], F.lit(0)) if heads else F.lit(0)
    placed = rows.withColumn("n", F.row_number().over(order) - 1)
    placed = placed.withColumn("segment_id", (segment + 1 + F.floor(F.col("n") / SEAL_RECORDS)).cast("long")).withColumn("seq", (F.col("n") % SEAL_RECORDS + 1).cast("long")).drop("n")
    done = chain.seal(placed, bits, heads={s: h for s, (_, h) in heads.items()})
    done = done.persist()
    n = done.count()
    if n:
        done.write.mode("append").parquet(table)
    done.unpersist()
    return n


def run(lines: DataFrame, table: str, checkpoint: str, shard: int = 0, clock=time.time_ns, rejects: str | None = None, once: bool = True, bits: int = 384):
    """Start the query; ``once`` takes what is there and stops. ``clock`` gives the time of receipt."""

    def sealed(batch: DataFrame, _: int) -> None:
        mapped = agent_event.map_lines(batch).persist()
        append(as_records(mapped, shard, clock()), table, bits)
        if rejects:
            agent_event.rejections(mapped).write.mode("append").parquet(rejects)
        mapped.unpersist()

    writer = lines.writeStream.foreachBatch(sealed).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{SEAL_SECONDS} seconds")).start()


def deduplicated(stream: DataFrame, window: str = "1 hour") -> DataFrame:
    """Bounded stateful deduplication by id on a stream with ``received_at`` (timestamp)."""
    return stream.withWatermark("received_at", window).dropDuplicatesWithinWatermark(["record_id"])


def correlated(stream: DataFrame, most: int = 65_536) -> DataFrame:
    """Parent span ids resolved over a stream, with a bounded window of the first writers of each run."""
    import pandas as pd

    out = "run_id string, span_id string, parent_span_id string, record_id string, caused_by string"

    def step(key, frames, state):
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        for frame in frames:
            for span, record in zip(frame["span_id"], frame["record_id"], strict=True):
                if span is not None:
                    known.setdefault(span, record)
            cause = [known.get(p) if p is not None and p != s else None for p, s in zip(frame["parent_span_id"], frame["span_id"], strict=True)]
            yield pd.DataFrame({**frame[["run_id", "span_id", "parent_span_id", "record_id"]].to_dict("list"), "caused_by": cause})
        kept = list(known.items())[-most:]
        state.update(([k for k, _ in kept], [v for _, v in kept]))

    return stream.groupBy("run_id").applyInPandasWithState(step, out, "spans array<string>, records array<string>", "append", "NoTimeout")
