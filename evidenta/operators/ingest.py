"""From mapped rows to records: column mappings, minted ids, edges between spans, losses and anomalies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evidenta.sources import telemetry
from evidenta.sources.agent_event import REGISTRY, SEVERITY_BANDS

SKEW_LIMIT = 5_000_000_000


def event_type(operation: Column, has_parent: Column) -> Column:
    agent = F.when(has_parent, "delegation").otherwise("request_received")
    return (
        F.when(operation.isin(telemetry.MODEL_OPERATIONS), "model_call").when(operation.isin(telemetry.TOOL_OPERATIONS), "tool_call")
        .when(operation.isin(telemetry.AGENT_OPERATIONS), agent).when(operation.isin(telemetry.MEMORY_OPERATIONS), "memory_access")
    )


def error_code(raw: Column) -> Column:
    flat = F.lower(F.regexp_replace(raw, "[^0-9A-Za-z]", ""))
    out = None
    for code, words in telemetry.ERROR_WORDS:
        hit = flat.contains(words[0])
        for w in words[1:]:
            hit = hit | flat.contains(w)
        out = (F if out is None else out).when(hit, code)
    return out.otherwise("upstream_error")


def severity_band(raw: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SEVERITY_BANDS.items() for x in pair])[raw]


def registry(spark) -> DataFrame:
    """The type registry as a table of its few rows."""
    return spark.createDataFrame([(k, *v) for k, v in REGISTRY.items()], "type string, event_type string, verdict string, error string, severity string")


def run_id(trace_id: Column) -> Column:
    """Lower-case hex of a binary trace id; null if it is empty or all zero."""
    text = F.lower(F.hex(trace_id))
    return F.when(text.rlike("[1-9a-f]"), text)


def skew(occurred: Column, recorded: Column) -> Column:
    return F.abs(recorded - occurred)


def mint(rows: DataFrame, keys: str = "shard", order: str = "recorded_at_nanos", seed: int = 0) -> DataFrame:
    """Adds ``record_id``: 48 bits of milliseconds, then 80 bits from a seed, strictly increasing in each shard.

    A millisecond that repeats, or a clock that steps back, adds one to the last id. Streams over sorted rows.
    """
    ordered = rows.repartition(keys).sortWithinPartitions(keys, order)

    def minted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, last, rng = None, -1, None
        for batch in batches:
            ids = []
            for s, nanos in zip(batch[keys], batch[order], strict=True):
                if s != shard:
                    shard, last, rng = s, -1, np.random.default_rng([seed, int(s)])
                made = (int(nanos) // 1_000_000 << 80) | int.from_bytes(rng.bytes(10), "big")
                if made <= last:
                    made = last + 1
                last = made
                ids.append(format(made, "032x"))
            yield batch.assign(record_id=ids)

    return ordered.mapInPandas(minted, StructType([*rows.schema.fields, StructField("record_id", StringType())]))


def resolve_edges(spans: DataFrame) -> DataFrame:
    """``caused_by`` from parent span ids, whatever order spans come in; the first writer of a span id wins.

    Adds ``caused_by`` and ``edge_lost`` (a parent named but not found, or a span that names itself).
    """
    first = Window.partitionBy("run_id", "span_id").orderBy("recorded_at_nanos", "record_id")
    owners = spans.where("span_id is not null").withColumn("n", F.row_number().over(first)).where("n = 1")
    owners = owners.select(F.col("run_id").alias("o_run"), F.col("span_id").alias("o_span"), F.col("record_id").alias("owner"))
    joined = spans.join(owners, (F.col("run_id") == F.col("o_run")) & (F.col("parent_span_id") == F.col("o_span")), "left")
    own = F.col("owner").isNotNull() & (F.col("owner") != F.col("record_id")) & ~F.coalesce(F.col("span_id") == F.col("parent_span_id"), F.lit(False))
    cause = F.when(own, F.array("owner")).otherwise(F.expr("cast(array() as array<string>)"))
    return joined.select(*spans.columns, cause.alias("caused_by"), (F.col("parent_span_id").isNotNull() & ~own).alias("edge_lost"))


def lost_edge_events(resolved: DataFrame) -> DataFrame:
    """One store event a run with lost edges; ``tokens_in`` has their number."""
    return _store_events(resolved.where("edge_lost").groupBy("run_id").agg(F.count("*").alias("tokens_in"), F.max("recorded_at_nanos").alias("recorded_at_nanos")), "internal")


def anomaly_event(mapped: DataFrame) -> DataFrame:
    """One store event for all lines of a batch that were lost; spans of other kinds are not losses."""
    lost = mapped.where("reject_reason is not null and reject_reason != 'not-gen-ai'").agg(F.count("*").alias("tokens_in")).where("tokens_in > 0")
    return _store_events(lost.select(F.lit("store").alias("run_id"), "tokens_in", F.lit(0).cast("long").alias("recorded_at_nanos")), "malformed")


def declined_notes(payloads: DataFrame) -> DataFrame:
    """One store event a run whose payloads the vault declined."""
    return _store_events(payloads.where("declined").groupBy("run_id").agg(F.count("*").alias("tokens_in"), F.max("recorded_at_nanos").alias("recorded_at_nanos")), "internal")


def _store_events(rows: DataFrame, error: str) -> DataFrame:
    return rows.select("run_id", F.lit("store_event").alias("event_type"), F.lit("warning").alias("severity"), F.lit("failed").alias("verdict"), F.lit(error).alias("error"), "tokens_in", "recorded_at_nanos")


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row an id, the first recorded: what at-least-once delivery leaves."""
    order = Window.partitionBy("record_id").orderBy("recorded_at_nanos", "segment_id", "seq")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
