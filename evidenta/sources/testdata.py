"""Decision records from the star-schema test tables, by SQL that Spark and DuckDB agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from evidenta.schema import RECORDS

SEGMENT_ROWS = 4096

_DIALECTS = {
    "spark": {"hex": "lower(hex({}))", "micros": "unix_micros(cast({} as timestamp))", "day": "date_format({}, 'yyyyMMdd')", "sha": "sha2({}, 256)", "div": "(({}) div {})"},
    "duckdb": {"hex": "lower(to_hex({}))", "micros": "epoch_us({})", "day": "strftime({}, '%Y%m%d')", "sha": "sha256({})", "div": "(({}) // {})"},
}


def records_sql(dialect: str, events: str = "events") -> str:
    """A SELECT of the derived scalar columns; ``caused_by_one`` is the single cause or null."""
    d = _DIALECTS[dialect]
    rid = lambda x: f"lpad({d['hex'].format(x)}, 32, '0')"
    sha = d["sha"].format("props")
    return f"""
    SELECT {rid('event_id')} AS record_id, CASE WHEN user_id % 10 = 0 THEN 'globex' ELSE 'acme' END AS tenant, CAST(user_id % 4 AS int) AS shard,
      {d['div'].format('rn - 1', SEGMENT_ROWS)} + 1 AS segment_id, (rn - 1) % {SEGMENT_ROWS} + 1 AS seq,
      concat('agent://acme.example/u-', CAST(user_id AS varchar(20))) AS agent_id, run_id,
      CASE WHEN last_run <> run_id THEN last_run END AS parent_run_id,
      nanos - event_id % 7000 * 1000000 AS occurred_at_nanos, nanos AS recorded_at_nanos,
      CASE event_type WHEN 'error' THEN 'tool_call' WHEN 'click' THEN 'request_received' WHEN 'view' THEN 'memory_access' WHEN 'purchase' THEN 'budget_check' ELSE 'model_call' END AS event_type,
      CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END AS severity,
      {rid('last_event')} AS caused_by_one,
      CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'allowed' END AS verdict,
      CASE event_type WHEN 'error' THEN 'upstream_error' END AS error,
      event_id % 1000 * 10 AS latency_micros, CAST(floor(value) AS bigint) AS tokens_in, CAST(floor(value * 100) AS bigint) AS cost_micros,
      CASE WHEN event_type = 'purchase' THEN concat({sha}, substr({sha}, 1, 32)) END AS payload_hash
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS rn,
        lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_event, lag(run_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_run
      FROM (SELECT *, concat('run-', CAST(user_id AS varchar(20)), '-', {d['day'].format('ts')}) AS run_id, {d['micros'].format('ts')} * 1000 AS nanos FROM {events}) e) w"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 42-column table derived from ``events``; unset columns are null or empty lists."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("evidenta_events")
    base = spark.sql(records_sql("spark", "evidenta_events").replace("varchar(20)", "string"))
    made = {
        "caused_by": F.when(F.col("caused_by_one").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("caused_by_one")),
        "clock_skew_nanos": F.abs(F.col("recorded_at_nanos") - F.col("occurred_at_nanos")),
        "chain_link": F.lit(""), "prev_hash": F.lit(""), "hash_alg": F.lit("sha384"), "sig_alg": F.lit("es384"), "kem_alg": F.lit("mlkem768"), "mapper_version": F.lit(1),
        "payload_class": F.when(F.col("payload_hash").isNotNull(), "document"), "payload_size_bytes": F.when(F.col("payload_hash").isNotNull(), 64),
    }
    out = []
    for f in RECORDS.fields:
        if f.name in made:
            c = made[f.name]
        elif f.name in base.columns:
            c = F.col(f.name)
        elif f.dataType.simpleString().startswith("array"):
            c = F.expr("cast(array() as array<string>)")
        else:
            c = F.lit(None)
        out.append((c if isinstance(f.dataType, ArrayType) else c.cast(f.dataType)).alias(f.name))
    return base.select(*out)
