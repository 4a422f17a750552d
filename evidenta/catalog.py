"""All registered queries of the engine and their SQL counterparts.

Keys start with the handle of the operator family they show. Oracle texts select from ``r``, the
derived records, which both engines compute by the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.operators import causal, chain, completeness, federation, ingest, segments, storage, verify
from evidenta.operators.query import Query, answer, event_code, severity_rank
from evidenta.plans.proof import Proof
from evidenta.plans.session import Session
from evidenta.sources import agent_event, testdata
from evidenta.sources.testdata import records
from evidenta.tables import Scratch

RUN, AGENT = "run-33-20240128", "agent://acme.example/u-33"
RECORD = "0000000000000000000000000000007d"
LO, HI = 1704100000000000000, 1704300000000000000
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"]
SHOWN = "record_id, run_id, agent_id, event_type, severity, recorded_at_nanos"
BITS = 256  # what the oracle's engine has; the default of the operators is 384
LINKED = ["record_id", "tenant", "agent_id", "run_id", "parent_run_id", "recorded_at_nanos", "event_type", "severity", "verdict"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a query; ``oracle`` may use ``r``."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if oracle:
            _ORACLE[key] = with_records(oracle)
        return f

    return add


def with_records(sql: str) -> str:
    head = f"r AS ({testdata.records_sql('duckdb')})"
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {head}, {text[5:]}"
    return f"WITH {head} {text}"


def flagship(spark: SparkSession, sf_dir: str, run: str = RUN) -> DataFrame:
    """One run's records, through gate and proof planner."""
    return Session(records(spark, sf_dir)).query(f"SELECT {SHOWN} FROM records WHERE run_id = '{run}'").rows


def tables(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    records(spark, sf_dir).createOrReplaceTempView("r")


def same(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query whose text both engines read; ``spark_sql`` where Spark's differs."""
    query(sql, name)(lambda spark, sf_dir: (tables(spark, sf_dir), spark.sql(spark_sql or sql))[1])


def shown(frame: DataFrame) -> DataFrame:
    return frame.selectExpr(*SHOWN.split(", "))


# --- sources and session (SRC, P, G) ---


@query(f"SELECT {SHOWN}, tenant, shard, segment_id, seq, parent_run_id, occurred_at_nanos, verdict, error, latency_micros, tokens_in, cost_micros, payload_hash FROM r")
def src1_records(spark, sf_dir):
    names = SHOWN.split(", ") + ["tenant", "shard", "segment_id", "seq", "parent_run_id", "occurred_at_nanos", "verdict", "error", "latency_micros", "tokens_in", "cost_micros", "payload_hash"]
    return records(spark, sf_dir).select(*names)


@query(f"SELECT {SHOWN} FROM r WHERE run_id = '{RUN}'")
def src1_session_sql(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"SELECT {SHOWN} FROM r WHERE recorded_at_nanos <= 1704153600000000000")
def src3_records_as_of(spark, sf_dir):
    return Session(records(spark, sf_dir)).query(f"SELECT {SHOWN} FROM records_as_of('2024-01-02T00:00:00Z')").rows


@query(f"SELECT {SHOWN}, segment_id, seq FROM r WHERE seq BETWEEN 5 AND 20")
def src6_journal_range(spark, sf_dir):
    return Session(records(spark, sf_dir), raw=True).query(f"SELECT {SHOWN}, segment_id, seq FROM journal(5, 20)").rows


@query(f"SELECT {SHOWN} FROM r WHERE seq BETWEEN 2000 AND 99999999 AND event_type = 'tool_call'")
def src6_journal_open_end(spark, sf_dir):
    return Session(records(spark, sf_dir), raw=True).query(f"SELECT {SHOWN} FROM journal(2000, 99999999) WHERE event_type = 'tool_call'").rows


def store(spark, sf_dir, **options) -> Session:
    """A session over sealed records and their manifests."""
    scratch = Scratch(spark, "store")
    rows = scratch.save(sealed(spark, sf_dir), "sealed")
    return Session(rows, scratch.save(chain.manifests(rows, BITS), "manifests"), bits=BITS, columns=LINKED, **options)


PROOFS = [
    ("all", "SELECT record_id FROM records", "full", 0),
    ("point_run", f"SELECT record_id FROM records WHERE run_id = '{RUN}'", "full", 0),
    ("mirrored", f"SELECT record_id FROM records WHERE '{AGENT}' = agent_id", "full", 0),
    ("event", "SELECT record_id FROM records WHERE event_type = 'tool_call'", "full", 0),
    ("range", f"SELECT record_id FROM records WHERE recorded_at_nanos BETWEEN {LO} AND {HI}", "full", 0),
    ("two_bounds", f"SELECT record_id FROM records WHERE recorded_at_nanos >= {LO} AND recorded_at_nanos <= {HI}", "full", 0),
    ("strict", f"SELECT record_id FROM records WHERE recorded_at_nanos > {LO}", "partial", 1),
    ("severity", "SELECT record_id FROM records WHERE severity = 'error'", "partial", 1),
    ("two_dimensions", f"SELECT record_id FROM records WHERE run_id = '{RUN}' AND event_type = 'model_call'", "partial", 1),
    ("like", "SELECT record_id FROM records WHERE lower(agent_id) LIKE '%u-3%'", "partial", 1),
    ("or", f"SELECT record_id FROM records WHERE run_id = '{RUN}' OR severity = 'error'", "partial", 1),
    ("in", f"SELECT record_id FROM records WHERE run_id IN ('{RUN}', 'x')", "partial", 1),
    ("event_range", "SELECT record_id FROM records WHERE event_type >= 'm'", "partial", 1),
    ("having", "SELECT run_id, count(*) FROM records GROUP BY run_id HAVING count(*) > 3", "partial", 1),
    ("alias", f"SELECT x FROM (SELECT run_id AS x FROM records) s WHERE x = '{RUN}'", "full", 0),
    ("as_of", "SELECT record_id FROM records_as_of('2024-01-02T00:00:00Z')", "full", 0),
    ("journal", "SELECT record_id FROM journal(5, 20)", "partial", 1),
    ("grouped", "SELECT event_type, count(*) FROM records GROUP BY event_type", "full", 0),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', {k})" for n, _, s, k in PROOFS) + ") t(query_id, proof, unproved)")
def p9_proof_status(spark, sf_dir):
    session = store(spark, sf_dir, raw=True)
    rows = [(n, p.status, len(p.unproved)) for n, sql, _, _ in PROOFS for p in (session.query(sql).proof,)]
    return spark.createDataFrame(rows, "query_id string, proof string, unproved int")


LOST_ROW, FORGED_ROW, BARE_SEGMENT = "shard = 1 AND seq % 1000 = 5", "shard = 2 AND seq % 1500 = 7", "shard = 3 AND segment_id = 1"


@query(f"""WITH s AS (SELECT *, {LOST_ROW} AS lost, {FORGED_ROW} AS forged, {BARE_SEGMENT} AS bare FROM r)
    SELECT shard, segment_id, CASE WHEN NOT bool_or(bare) THEN count(*) END AS n_records, count(*) FILTER (WHERE NOT lost AND run_id BETWEEN 'run-2' AND 'run-3') AS n_entries,
      CASE WHEN bool_or(bare) OR bool_or(lost) OR bool_or(forged) THEN 'partial' ELSE 'full' END AS status,
      CASE WHEN bool_or(bare) THEN 'not-committed' WHEN bool_or(lost) THEN 'wrong-size' WHEN bool_or(forged) THEN 'link-broken' END AS reason FROM s GROUP BY shard, segment_id""")
def p9_segment_proofs(spark, sf_dir):
    """Each segment's proof of a range of runs where rows were lost, forged, and left without a manifest."""
    scratch = Scratch(spark, "segments")
    rows = scratch.save(sealed(spark, sf_dir), "sealed")
    manifests = scratch.save(chain.manifests(rows, BITS), "manifests").where(f"NOT ({BARE_SEGMENT})")
    rows = rows.where(f"NOT ({LOST_ROW})").withColumn("severity", F.when(F.expr(FORGED_ROW), "debug").otherwise(F.col("severity")))
    return segments.check(rows, manifests, "run_id", "run-2", "run-3", BITS, LINKED)


@query("SELECT * FROM (VALUES ('removed', 'partial'), ('forged', 'partial'), ('unsealed', 'none'), ('sealed', 'full'), ('foreign', 'partial'), ('constant', 'none')) t(rows_are, proof)")
def src1_honest_status(spark, sf_dir):
    """One full scan over rows in each condition; the last two read another table, and none."""
    scratch = Scratch(spark, "honest")
    rows = scratch.save(sealed(spark, sf_dir), "sealed")
    manifests = scratch.save(chain.manifests(rows, BITS), "manifests")
    cases = {"sealed": rows, "removed": rows.where("seq % 2 = 0"), "forged": rows.withColumn("severity", F.lit("debug"))}
    found = [(n, Session(frame, manifests, bits=BITS, columns=LINKED).query("SELECT * FROM records").proof.status) for n, frame in cases.items()]
    found.append(("unsealed", Session(rows).query("SELECT * FROM records").proof.status))
    last = Session(rows, manifests, tables={"customer": spark.read.parquet(f"{sf_dir}/customer.parquet")}, bits=BITS, columns=LINKED)
    found += [("foreign", last.query("SELECT * FROM customer WHERE c_custkey > 5").proof.status), ("constant", last.query("SELECT 1 AS one").proof.status)]
    return spark.createDataFrame(found, "rows_are string, proof string")


GATED = [
    ("select", "SELECT 1 AS one", True), ("with", "WITH x AS (SELECT * FROM records) SELECT count(*) AS n FROM x", True), ("explain", "EXPLAIN SELECT * FROM records", True),
    ("show", "SHOW TABLES", True), ("set", "SET spark.sql.runSQLOnFiles=true", True), ("begin", "BEGIN", True), ("commit", "COMMIT", True),
    ("insert", "INSERT INTO records SELECT * FROM records", False), ("update", "UPDATE records SET tenant = 'x'", False), ("delete", "DELETE FROM records", False),
    ("drop", "DROP TABLE records", False), ("create", "CREATE TABLE t (a INT)", False), ("function", "CREATE TEMPORARY FUNCTION f AS 'x.Y'", False), ("two", "SELECT 1; SELECT 2", False),
    ("file", "SELECT * FROM text.`/etc/hostname`", False), ("reflect", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", False),
    ("transform", "SELECT TRANSFORM(run_id) USING 'cat' FROM records", False), ("jar", "ADD JAR '/x.jar'", False), ("cache", "CACHE TABLE records", False), ("unknown", "SELECT * FROM other", False), ("travel", "SELECT * FROM other VERSION AS OF 1", False),
    ("travel_temp", "SELECT * FROM global_temp.x TIMESTAMP AS OF '2024-01-01'", False), ("travel_known", "SELECT * FROM records VERSION AS OF 1", False), ("inside", "SELECT input_file_name() FROM records", False),
    ("scalar", "SELECT upper(run_id) AS u, size(caused_by) AS n, date_trunc('day', timestamp_micros(recorded_at_nanos div 1000)) AS d FROM records", True),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(ok).lower()})" for n, _, ok in GATED) + ") t(statement, allowed)")
def g1_statement_gate(spark, sf_dir):
    session = Session(records(spark, sf_dir))
    rows = []
    for name, sql, _ in GATED:
        try:
            session.query(sql)
            rows.append((name, True))
        except PermissionError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "statement string, allowed boolean")


# --- reads (Q) ---


def read(name: str, q: Query, where: str) -> None:
    query(f"SELECT {SHOWN} FROM r WHERE {where}", name)(lambda spark, sf_dir: shown(answer(records(spark, sf_dir), q).rows))


TIME = Query.time_between(LO, HI)
BETWEEN = f"recorded_at_nanos BETWEEN {LO} AND {HI}"
RANK = "CASE severity WHEN 'debug' THEN 0 WHEN 'info' THEN 1 WHEN 'notice' THEN 2 WHEN 'warning' THEN 3 WHEN 'error' THEN 4 WHEN 'critical' THEN 5 END"
read("q1_point_run", Query.point("run_id", RUN), f"run_id = '{RUN}'")
read("q1_point_agent", Query.point("agent_id", AGENT), f"agent_id = '{AGENT}'")
read("q1_point_event_type", Query.point("event_type", "tool_call"), "event_type = 'tool_call'")
read("q1_point_record_id", Query.point("record_id", RECORD), f"record_id = '{RECORD}'")
read("q2_range_run", Query.range("run_id", "run-2", "run-3"), "run_id BETWEEN 'run-2' AND 'run-3'")
read("q2_range_event_codes", Query.range("event_type", "tool_call", "memory_access"), "event_type IN ('tool_call', 'policy_decision', 'budget_check', 'memory_access')")
read("q2_range_reversed", Query.time_between(HI, LO), "1 = 0")
read("q3_time_between", TIME, BETWEEN)
read("q4_as_of_time", TIME.as_of(LO + 10**14), f"recorded_at_nanos BETWEEN {LO} AND {LO + 10**14}")
read("q4_as_of_run", Query.point("agent_id", AGENT).as_of(HI), f"agent_id = '{AGENT}' AND recorded_at_nanos <= {HI}")
read("q5_tenant", TIME.with_filter("tenant", "globex"), f"{BETWEEN} AND tenant = 'globex'")
read("q6_severity", TIME.with_filter("severity", "error"), f"{BETWEEN} AND severity = 'error'")
read("q7_min_severity", TIME.with_filter("min_severity", "warning"), f"{BETWEEN} AND {RANK} >= 3")
read("q8_verdict", TIME.with_filter("verdict", "allowed"), f"{BETWEEN} AND verdict = 'allowed'")
read("q9_error", TIME.with_filter("error", "upstream_error"), f"{BETWEEN} AND error = 'upstream_error'")
read("q10_has_payload", TIME.with_filter("payload", True), f"{BETWEEN} AND payload_hash IS NOT NULL")


@query(f"SELECT count(*) AS matched, count(*) FILTER (WHERE severity = 'error') AS n FROM r WHERE {BETWEEN}")
def q12_matched_before_filters(spark, sf_dir):
    found = answer(records(spark, sf_dir), TIME.with_filter("severity", "error"))
    return found.matched.agg(F.count("*").alias("matched")).crossJoin(found.rows.agg(F.count("*").alias("n")))  # one row each


# --- causes (C) ---

CLOSED = "agent://acme.example/u-7"


def _closure_run(frame: DataFrame) -> str:
    row = frame.where(F.col("agent_id") == CLOSED).agg(F.max("run_id")).first()
    return row[0] or "none"


LINKS = """links AS (SELECT DISTINCT a.run_id, b.run_id AS up FROM r a JOIN r b ON a.caused_by_one = b.record_id WHERE a.run_id <> b.run_id
    UNION SELECT run_id, parent_run_id FROM r WHERE parent_run_id IS NOT NULL AND parent_run_id <> run_id)"""


@query(f"""WITH RECURSIVE {LINKS}, up(run_id, depth) AS (SELECT max(run_id), 0 FROM r WHERE agent_id = '{CLOSED}'
    UNION SELECT l.up, u.depth + 1 FROM up u JOIN links l ON l.run_id = u.run_id) SELECT run_id, min(depth) AS depth FROM up GROUP BY run_id""")
def c1_run_closure(spark, sf_dir):
    base = records(spark, sf_dir)
    return causal.run_closure(base, _closure_run(base))


@query(f"""WITH RECURSIVE up(record_id, run_id, parent_run_id, caused_by_one, recorded_at_nanos) AS (
      SELECT record_id, run_id, parent_run_id, caused_by_one, recorded_at_nanos FROM r WHERE run_id = (SELECT max(run_id) FROM r WHERE agent_id = '{CLOSED}')
      UNION SELECT b.record_id, b.run_id, b.parent_run_id, b.caused_by_one, b.recorded_at_nanos FROM up a JOIN r b ON b.record_id = a.caused_by_one OR b.run_id = a.parent_run_id)
    SELECT record_id, run_id, recorded_at_nanos FROM up""")
def c1_causal_closure(spark, sf_dir):
    base = records(spark, sf_dir)
    return causal.upstream(base, _closure_run(base)).drop("depth")


LOST = "record_id LIKE '%7'"


@query(f"SELECT a.record_id, a.caused_by_one AS target FROM r a WHERE a.caused_by_one LIKE '%7' AND NOT a.{LOST}")
def c2_dangling_edges(spark, sf_dir):
    """Every record whose id ends in 7 is lost; the causes that name them dangle."""
    return causal.dangling(records(spark, sf_dir).where(f"NOT {LOST}"))


@query("SELECT 'cause' AS kind, record_id, caused_by_one AS target FROM r WHERE caused_by_one IS NOT NULL UNION ALL SELECT 'parent_run', record_id, parent_run_id FROM r WHERE parent_run_id IS NOT NULL")
def c4_edges(spark, sf_dir):
    return causal.edges(records(spark, sf_dir))


# --- chains and indexes (H) ---

BODY = "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN 'N' ELSE concat(length(CAST({c} AS varchar)), ':', {c}) END" for c in LINKED) + "))"
CHAINED = f"""body AS (SELECT shard, segment_id, seq, record_id, recorded_at_nanos, event_type, run_id, agent_id, row_number() OVER (PARTITION BY shard ORDER BY segment_id, seq) AS n, {BODY} AS body FROM r),
    ch(shard, n, prev_hash, chain_link) AS (SELECT shard, 1::BIGINT, sha256(concat('genesis/v1|', shard)), sha256(concat('chain/v1|', sha256(concat('genesis/v1|', shard)), '|', seq, '|', body)) FROM body WHERE n = 1
      UNION ALL SELECT b.shard, b.n, c.chain_link, sha256(concat('chain/v1|', c.chain_link, '|', b.seq, '|', b.body)) FROM ch c JOIN body b ON b.shard = c.shard AND b.n = c.n + 1),
    sealed AS (SELECT b.*, c.prev_hash, c.chain_link FROM body b JOIN ch c ON b.shard = c.shard AND b.n = c.n)"""


def sealed(spark, sf_dir, bits=BITS):
    return chain.seal(records(spark, sf_dir), bits, LINKED)


@query(f"WITH RECURSIVE {CHAINED} SELECT shard, segment_id, seq, record_id, prev_hash, chain_link FROM sealed")
def h2_chain_links(spark, sf_dir):
    return chain.link(records(spark, sf_dir), BITS, LINKED)


@query("SELECT 0::BIGINT AS broken, count(*) AS checked FROM r")
def h5_chain_verify(spark, sf_dir):
    rows = sealed(spark, sf_dir)
    return chain.verify_chain(rows, BITS, LINKED).agg(F.count("*").alias("broken")).crossJoin(rows.agg(F.count("*").alias("checked")))  # one row each


@query(f"""WITH RECURSIVE {CHAINED}, lv(shard, segment_id, level, pos, node) AS (
      SELECT shard, segment_id, 0, seq - 1, sha256(concat('0|', chain_link)) FROM sealed
      UNION ALL SELECT shard, segment_id, level + 1, pos // 2, CASE WHEN nxt IS NULL THEN node ELSE sha256(concat('1|', node, '|', nxt)) END
        FROM (SELECT *, lead(node) OVER (PARTITION BY shard, segment_id ORDER BY pos) AS nxt, count(*) OVER (PARTITION BY shard, segment_id) AS n FROM lv) w WHERE pos % 2 = 0 AND n > 1)
    SELECT shard, segment_id, n_leaves, node AS root FROM (SELECT *, max(level) OVER (PARTITION BY shard, segment_id) AS top FROM lv) t JOIN (SELECT shard, segment_id, count(*) AS n_leaves FROM sealed GROUP BY ALL) c USING (shard, segment_id) WHERE level = top""")
def h7_merkle_roots(spark, sf_dir):
    return chain.history_roots(sealed(spark, sf_dir), BITS)


@query("""SELECT 'run_id' AS dimension, shard, segment_id, row_number() OVER (PARTITION BY shard, segment_id ORDER BY run_id, seq) - 1 AS pos, run_id AS key, seq FROM r UNION ALL
    SELECT 'recorded_at_nanos', shard, segment_id, row_number() OVER (PARTITION BY shard, segment_id ORDER BY recorded_at_nanos, seq) - 1, lpad(CAST(recorded_at_nanos AS varchar), 20, '0'), seq FROM r""")
def h12_index_positions(spark, sf_dir):
    return chain.index_entries(records(spark, sf_dir), ["run_id", "recorded_at_nanos"], BITS).select("dimension", "shard", "segment_id", "pos", "key", "seq")


@query("""SELECT shard, segment_id, count(*) FILTER (WHERE key BETWEEN 'run-2' AND 'run-3') AS n_inside, max(pos) FILTER (WHERE key < 'run-2') AS left_pos, min(pos) FILTER (WHERE key > 'run-3') AS right_pos
    FROM (SELECT shard, segment_id, run_id AS key, row_number() OVER (PARTITION BY shard, segment_id ORDER BY run_id, seq) - 1 AS pos FROM r) GROUP BY ALL""")
def h14_range_boundaries(spark, sf_dir):
    return completeness.boundaries(chain.index_entries(records(spark, sf_dir), ["run_id"], BITS), "run_id", "run-2", "run-3")


CODE = "CASE event_type WHEN 'request_received' THEN 1 WHEN 'model_call' THEN 2 WHEN 'tool_call' THEN 3 WHEN 'budget_check' THEN 5 WHEN 'memory_access' THEN 6 END"
KEYS = {"record_id": "record_id", "recorded_at_nanos": "lpad(CAST(recorded_at_nanos AS varchar), 20, '0')", "agent_id": "agent_id", "run_id": "run_id", "event_type": f"lpad(CAST({CODE} AS varchar), 3, '0')"}
TREES = " UNION ALL ".join(
    f"SELECT shard, segment_id, '{d}' AS tree, row_number() OVER (PARTITION BY shard, segment_id ORDER BY key, seq) - 1 AS pos, sha256(concat('0|entry/v1|', length(key), ':', key, '|', seq, '|', chain_link)) AS node FROM (SELECT *, {k} AS key FROM sealed) k"
    for d, k in KEYS.items()
)
ROOTS = f"""leaves AS (SELECT shard, segment_id, 'history' AS tree, seq - 1 AS pos, sha256(concat('0|', chain_link)) AS node FROM sealed UNION ALL {TREES}),
    lv(shard, segment_id, tree, level, pos, node) AS (SELECT shard, segment_id, tree, 0, pos, node FROM leaves
      UNION ALL SELECT shard, segment_id, tree, level + 1, pos // 2, CASE WHEN nxt IS NULL THEN node ELSE sha256(concat('1|', node, '|', nxt)) END
        FROM (SELECT *, lead(node) OVER (PARTITION BY shard, segment_id, tree ORDER BY pos) AS nxt, count(*) OVER (PARTITION BY shard, segment_id, tree) AS n FROM lv) w WHERE pos % 2 = 0 AND n > 1),
    roots AS (SELECT shard, segment_id, max(CASE WHEN tree = 'history' THEN node END) AS history_root, {", ".join(f"max(CASE WHEN tree = '{d}' THEN node END) AS root_{d}" for d in KEYS)}
      FROM (SELECT *, max(level) OVER (PARTITION BY shard, segment_id, tree) AS top FROM lv) t WHERE level = top GROUP BY shard, segment_id)"""
MANIFEST = "shard, segment_id, n_records, min_recorded_at, max_recorded_at, chain_before, chain_after, history_root, " + ", ".join(f"root_{d}" for d in KEYS)


@query(f"""WITH RECURSIVE {CHAINED}, {ROOTS}, facts AS (SELECT shard, segment_id, count(*) AS n_records, min(seq) AS first_seq, max(seq) AS last_seq, min(recorded_at_nanos) AS min_recorded_at, max(recorded_at_nanos) AS max_recorded_at,
      arg_min(prev_hash, seq) AS chain_before, arg_max(chain_link, seq) AS chain_after FROM sealed GROUP BY shard, segment_id)
    SELECT {MANIFEST}, first_seq, last_seq, sha256(concat_ws('|', 'manifest/v1', {MANIFEST})) AS manifest_root FROM facts JOIN roots USING (shard, segment_id)""")
def h16_manifests(spark, sf_dir):
    return chain.manifests(sealed(spark, sf_dir), BITS).drop("seal_error")


@query(f"""SELECT shard, segment_id, count(*) AS size, count(*) FILTER (WHERE {BETWEEN}) AS entries, max(recorded_at_nanos) < {LO} OR min(recorded_at_nanos) > {HI} AS skipped, 0 AS failures,
    count(*) FILTER (WHERE {BETWEEN}) > 0 AS caught FROM r GROUP BY shard, segment_id""")
def h21_composite_proof(spark, sf_dir):
    """A range of time over all segments: what each proves, and whether leaving its first entry out is caught."""
    scratch = Scratch(spark, "composite")
    rows = scratch.save(sealed(spark, sf_dir), "sealed")
    made = scratch.save(chain.manifests(rows, BITS), "manifests")
    entries = chain.index_entries(rows, ["recorded_at_nanos"], BITS)
    return completeness.prove("recorded_at_nanos", str(LO).rjust(20, "0"), str(HI).rjust(20, "0"), made, entries, BITS)


@query("SELECT shard, segment_id, CASE WHEN max(segment_id) OVER (PARTITION BY shard) - segment_id < 4 THEN 'hot' ELSE 'cold' END AS tier FROM (SELECT DISTINCT shard, segment_id FROM r)")
def q14_tiers(spark, sf_dir):
    return storage.hot_segments(records(spark, sf_dir).select("shard", "segment_id").distinct())


# --- mapping (M) ---

TYPES = ", ".join(f"({k!r}, {e!r}, {repr(v) if v else 'NULL'}, {repr(x) if x else 'NULL'}, {s!r})" for k, (e, v, x, s) in agent_event.REGISTRY.items())
KIND = "CASE event_id % 6 WHEN 0 THEN 'policy_deny' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'budget_exhausted' WHEN 3 THEN 'approval_requested' WHEN 4 THEN 'memory_written' ELSE 'not_a_type' END"
BAND = "CASE event_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'odd' END"


def _event_lines(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.to_json(F.struct(
        F.lit("agent-event/v0.1").alias("schema"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.expr(KIND).alias("type"), F.expr(BAND).alias("severity"),
        F.concat(F.when(F.col("event_id") % 11 == 0, "agent://other.example/u-").otherwise("agent://acme.example/u-"), F.col("user_id").cast("string")).alias("agent_id"),
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("run-"), F.col("user_id").cast("string"))).alias("run_id"),
    ))
    return events.select(line.alias("value"))


MAPPED = f"""ev AS (SELECT *, {KIND} AS type, {BAND} AS band, CASE WHEN event_id % 11 = 0 THEN 'foreign-trust-domain' WHEN {KIND} = 'not_a_type' THEN 'unknown-type' WHEN event_id % 13 = 0 THEN 'no-run-id' END AS reject_reason FROM events),
    types(type, event_type, verdict, error, severity) AS (SELECT * FROM (VALUES {TYPES}) t)"""


@query(f"""WITH {MAPPED} SELECT concat('agent://acme.example/u-', user_id) AS agent_id, concat('run-', user_id) AS run_id, epoch_us(ts) * 1000 AS occurred_at_nanos, t.event_type, t.verdict, t.error,
    CASE band WHEN 'low' THEN 'notice' WHEN 'medium' THEN 'warning' WHEN 'high' THEN 'error' ELSE t.severity END AS severity FROM ev JOIN types t USING (type) WHERE reject_reason IS NULL""")
def m13_map_agent_event(spark, sf_dir):
    mapped = agent_event.map_lines(_event_lines(spark, sf_dir)).where("reject_reason is null")
    return mapped.select("agent_id", "run_id", "occurred_at_nanos", "event_type", "verdict", "error", "severity")


@query(f"WITH {MAPPED} SELECT reject_reason, count(*) AS count FROM ev WHERE reject_reason IS NOT NULL GROUP BY reject_reason")
def m12_rejections(spark, sf_dir):
    return agent_event.rejections(agent_event.map_lines(_event_lines(spark, sf_dir)))


@query("SELECT record_id, abs(recorded_at_nanos - occurred_at_nanos) AS skew_nanos, abs(recorded_at_nanos - occurred_at_nanos) > 5000000000 AS excessive FROM r")
def m17_clock_skew(spark, sf_dir):
    s = ingest.skew(F.col("occurred_at_nanos"), F.col("recorded_at_nanos"))
    return records(spark, sf_dir).select("record_id", s.alias("skew_nanos"), (s > ingest.SKEW_LIMIT).alias("excessive"))


OPS = ["chat", "execute_tool", "invoke_agent", "search_memory", "other"]
OP = "CASE event_id % 5 WHEN 0 THEN 'chat' WHEN 1 THEN 'execute_tool' WHEN 2 THEN 'invoke_agent' WHEN 3 THEN 'search_memory' ELSE 'other' END"


@query(f"SELECT event_id, CASE {OP} WHEN 'chat' THEN 'model_call' WHEN 'execute_tool' THEN 'tool_call' WHEN 'invoke_agent' THEN CASE WHEN event_id % 2 = 0 THEN 'delegation' ELSE 'request_received' END WHEN 'search_memory' THEN 'memory_access' END AS mapped FROM events")
def m1_event_types(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ingest.event_type(F.expr(OP), F.col("event_id") % 2 == 0).alias("mapped"))


RAW = "CASE event_id % 7 WHEN 0 THEN 'DeadlineExceeded' WHEN 1 THEN 'HTTP 429' WHEN 2 THEN 'Permission-Denied' WHEN 3 THEN 'insufficient_quota' WHEN 4 THEN 'Invalid Request' WHEN 5 THEN 'Timed out' ELSE 'boom' END"


@query(f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'unauthorized' WHEN 3 THEN 'budget_exceeded' WHEN 4 THEN 'malformed' WHEN 5 THEN 'timeout' ELSE 'upstream_error' END AS code FROM events")
def m2_error_codes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ingest.error_code(F.expr(RAW)).alias("code"))


SPANS = "SELECT record_id, run_id, recorded_at_nanos, concat('s', seq % 50) AS span_id, CASE WHEN seq % 3 > 0 THEN concat('s', seq % 60) END AS parent_span_id FROM r"
RESOLVED = f"""sp AS ({SPANS}), own AS (SELECT run_id, span_id, record_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY run_id, span_id ORDER BY recorded_at_nanos, record_id) AS n FROM sp) w WHERE n = 1),
    res AS (SELECT sp.*, CASE WHEN owner <> record_id AND sp.span_id <> sp.parent_span_id THEN owner END AS cause FROM sp LEFT JOIN own ON sp.run_id = own.run_id AND sp.parent_span_id = own.span_id)"""


def _resolved(spark, sf_dir):
    spans = records(spark, sf_dir).selectExpr("record_id", "run_id", "recorded_at_nanos", "concat('s', seq % 50) AS span_id", "CASE WHEN seq % 3 > 0 THEN concat('s', seq % 60) END AS parent_span_id")
    return ingest.resolve_edges(spans)


@query(f"WITH {RESOLVED} SELECT record_id, cause, parent_span_id IS NOT NULL AND cause IS NULL AS edge_lost FROM res")
def m20_edge_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("record_id", F.try_element_at("caused_by", F.lit(1)).alias("cause"), "edge_lost")


@query(f"WITH {RESOLVED} SELECT run_id, 'store_event' AS event_type, 'internal' AS error, count(*) AS tokens_in FROM res WHERE parent_span_id IS NOT NULL AND cause IS NULL GROUP BY run_id")
def m21_lost_edge_events(spark, sf_dir):
    return ingest.lost_edge_events(_resolved(spark, sf_dir)).select("run_id", "event_type", "error", "tokens_in")


# --- federation, replication, dedup, verification (F, S, V) ---

EAST, WEST = "tenant = 'acme'", "tenant = 'globex'"


@query(f"SELECT {SHOWN}, 'east' AS environment FROM r WHERE {EAST} UNION ALL SELECT {SHOWN}, 'west' FROM r WHERE {WEST}")
def f2_federated_compose(spark, sf_dir):
    base = records(spark, sf_dir)
    answers = {"east": (base.where(EAST), Proof()), "west": (base.where(WEST), Proof())}
    return federation.compose(federation.Registry.of(["west", "east"], attested=True), answers).rows.selectExpr(*SHOWN.split(", "), "environment")


@query("SELECT * FROM (VALUES ('all', 'full', 0), ('silent', 'partial', 1), ('unexpected', 'partial', 1), ('unattested', 'partial', 1), ('partial', 'partial', 1)) t(question, proof, reasons)")
def f2_federation_status(spark, sf_dir):
    base, full = records(spark, sf_dir), Proof()
    both = {"east": (base, full), "west": (base, full)}
    reg = federation.Registry.of(["east", "west"], attested=True)
    cases = {
        "all": (reg, both), "silent": (reg, {"east": both["east"]}), "unexpected": (federation.Registry.of(["east"], attested=True), both),
        "unattested": (federation.Registry.of(["east", "west"]), both), "partial": (reg, {**both, "west": (base, full.downgrade("severity"))}),
    }
    rows = [(n, p.status, len(p.unproved)) for n, (g, a) in cases.items() for p in (federation.compose(g, a).proof,)]
    return spark.createDataFrame(rows, "question string, proof string, reasons int")


@query(f"""WITH RECURSIVE {CHAINED}, run AS (SELECT n, shard, segment_id, seq, prev_hash, chain_link FROM sealed WHERE shard = 1),
    runs AS (SELECT 'accepted' AS run, * FROM run UNION ALL SELECT 'gap', * FROM run WHERE n <> 107 UNION ALL SELECT 'shard', n, CASE WHEN n = 109 THEN 2 ELSE shard END, segment_id, seq, prev_hash, chain_link FROM run
      UNION ALL SELECT 'broken', n, shard, segment_id, seq, CASE WHEN n = 110 THEN repeat('0', 64) ELSE prev_hash END, chain_link FROM run),
    seen AS (SELECT *, lag(chain_link) OVER w AS last_link, lag(segment_id) OVER w AS last_segment, lag(seq) OVER w AS last_seq FROM runs WINDOW w AS (PARTITION BY run ORDER BY n)),
    bad AS (SELECT run, n, seq, CASE WHEN shard <> 1 THEN 'shard-changed' WHEN NOT ((segment_id = last_segment AND seq = last_seq + 1) OR (segment_id = last_segment + 1 AND seq = 1)) THEN 'not-contiguous' WHEN prev_hash <> last_link THEN 'link-broken' END AS refusal FROM seen)
    SELECT run, arg_min(seq, n) FILTER (WHERE refusal IS NOT NULL) AS at_seq, arg_min(refusal, n) FILTER (WHERE refusal IS NOT NULL) AS refusal FROM bad GROUP BY run""")
def f4_replication_refusal(spark, sf_dir):
    """A whole shard as sent, with a record missing, with one of another shard, and with a broken link."""
    scratch = Scratch(spark, "replicated")
    run = sealed(spark, sf_dir).where("shard = 1").withColumn("arrival", (F.col("segment_id") - 1) * testdata.SEGMENT_ROWS + F.col("seq"))
    run = scratch.save(run, "run")
    cases = {
        "accepted": run, "gap": run.where("arrival != 107"), "shard": run.withColumn("shard", F.when(F.col("arrival") == 109, 2).otherwise(F.col("shard"))),
        "broken": run.withColumn("prev_hash", F.when(F.col("arrival") == 110, F.lit("0" * 64)).otherwise(F.col("prev_hash"))),
    }
    names = spark.createDataFrame([(n,) for n in cases], "run string")
    found = None
    for n, frame in cases.items():
        part = federation.first_refusal(frame, 1, bits=BITS, columns=LINKED).withColumn("run", F.lit(n))
        found = part if found is None else found.unionByName(part)
    return names.join(found, "run", "left").select("run", "at_seq", "refusal")


@query(f"SELECT record_id, count(*) AS n FROM (SELECT DISTINCT {SHOWN} FROM (SELECT * FROM r UNION ALL SELECT * FROM r WHERE seq % 3 = 0)) GROUP BY record_id")
def s4_dedup_by_id(spark, sf_dir):
    base = records(spark, sf_dir)
    return ingest.deduplicated(base.unionByName(base.where("seq % 3 = 0"))).groupBy("record_id").agg(F.count("*").alias("n"))


@query(f"""WITH segs AS (SELECT shard, segment_id, count(*) FILTER (WHERE {LOST_ROW}) AS lost FROM r GROUP BY shard, segment_id), hit AS (SELECT count(*) AS n FROM segs WHERE lost > 0)
    SELECT 'weak' AS level, x AS check_name, 1 AS n FROM (VALUES ('root-signature'), ('witnesses')) t(x)
    UNION ALL SELECT 'broken', x, n FROM hit, (VALUES ('record-count'), ('history-root'), ('index-root'), ('manifest-root'), ('sequence-contiguous'), ('chain-within-segment')) t(x) WHERE n > 0""")
def v1_verify_findings(spark, sf_dir):
    """Findings where records were lost from one shard: what each damaged segment breaks."""
    rows, made = _pack(spark, sf_dir)
    found = verify.findings(rows.where(f"NOT ({LOST_ROW})"), made)
    return found.groupBy("level", F.col("check").alias("check_name")).agg(F.count("*").alias("n"))


def _pack(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "pack")
    rows = scratch.save(chain.seal(records(spark, sf_dir)), "sealed")
    return rows, scratch.save(chain.manifests(rows), "manifests")


@query("SELECT framework, reference, CASE WHEN answer <> 'checked' THEN answer WHEN bad IS NULL AND (SELECT count(*) FROM r) > 0 THEN 'shown' ELSE 'not in this pack' END AS coverage, bad AS failing FROM (VALUES "
       + ", ".join(f"('{f}', '{r}', '{c if isinstance(c, str) else 'checked' if c else 'not addressed'}', {repr(','.join(sorted(set(c) & {'root-signature', 'witnesses'}))) if not isinstance(c, str) and set(c) & {'root-signature', 'witnesses'} else 'NULL'})" for (f, r), c in verify.TEXTS.items())
       + ") t(framework, reference, answer, bad)")
def v4_coverage(spark, sf_dir):
    rows, made = _pack(spark, sf_dir)
    return verify.coverage(verify.findings(rows, made), rows.count())


@query("SELECT severity, count(*) AS n, min(rank) AS rank FROM (SELECT severity, " + RANK + " AS rank FROM r) GROUP BY severity")
def q7_severity_ranks(spark, sf_dir):
    return records(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.min(severity_rank(F.col("severity"))).alias("rank"))


@query("SELECT event_type, CASE event_type WHEN 'request_received' THEN 1 WHEN 'model_call' THEN 2 WHEN 'tool_call' THEN 3 WHEN 'budget_check' THEN 5 WHEN 'memory_access' THEN 6 END AS code, count(*) AS n FROM r GROUP BY event_type")
def h12_event_codes(spark, sf_dir):
    return records(spark, sf_dir).groupBy("event_type", event_code(F.col("event_type")).alias("code")).agg(F.count("*").alias("n"))


# --- relational surface (R) over records and the star schema: text that both engines read ---

same("r1_projection", "SELECT record_id AS id, upper(event_type) AS kind, 1 AS one, tokens_in + 1 AS more FROM r")
same("r2_filter", "SELECT record_id FROM r WHERE lower(agent_id) LIKE '%u-3%' AND recorded_at_nanos BETWEEN 1704100000000000000 AND 1705000000000000000 AND severity <> 'info'")
same("r3_limit_of_one_group", "SELECT severity FROM r WHERE severity = 'error' ORDER BY severity LIMIT 1")
same("r4_topk", "SELECT record_id, tokens_in FROM r ORDER BY tokens_in DESC, record_id LIMIT 25")
same("r5_aggregate", "SELECT event_type, count(*) AS n, sum(tokens_in) AS tokens, min(latency_micros) AS lo, max(latency_micros) AS hi, round(avg(tokens_in), 4) AS mean, count(DISTINCT run_id) AS runs FROM r GROUP BY event_type HAVING count(*) > 10")
same("r5_distinct", "SELECT DISTINCT tenant, severity, verdict FROM r")
same("r5_statistics", "SELECT severity, round(stddev_samp(tokens_in), 4) AS sd, round(var_pop(tokens_in), 4) AS vp, round(corr(tokens_in, latency_micros), 6) AS c, bool_and(tokens_in >= 0) AS ok, bool_or(tokens_in > 99) AS large FROM r GROUP BY severity")
same("r5_max_by", "SELECT severity, arg_max(tokens_in, latency_micros * 100000000 + seq * 10 + shard) AS last FROM r GROUP BY severity", "SELECT severity, max_by(tokens_in, latency_micros * 100000000 + seq * 10 + shard) AS last FROM r GROUP BY severity")
same("r6_cube", "SELECT tenant, severity, count(*) AS n FROM r GROUP BY CUBE (tenant, severity)")
same("r6_rollup", "SELECT event_type, severity, sum(cost_micros) AS cost FROM r GROUP BY ROLLUP (event_type, severity)")
same("r6_grouping_sets", "SELECT tenant, event_type, count(*) AS n, grouping(tenant) AS g FROM r GROUP BY GROUPING SETS ((tenant), (event_type), ())")
same("r7_join_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
same("r7_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
same("r7_join_full", "SELECT a.run_id AS a, b.run_id AS b FROM (SELECT DISTINCT run_id FROM r WHERE event_type = 'tool_call') a FULL JOIN (SELECT DISTINCT run_id FROM r WHERE event_type = 'budget_check') b ON a.run_id = b.run_id")
same("r7_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
same("r7_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
same("r7_join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 9000")
same("r7_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("r7_join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same("r7_join_records", "SELECT c.c_mktsegment, count(*) AS n FROM r JOIN customer c ON r.agent_id = concat('agent://acme.example/u-', CAST(c.c_custkey AS varchar(20))) GROUP BY c.c_mktsegment", "SELECT c.c_mktsegment, count(*) AS n FROM r JOIN customer c ON r.agent_id = concat('agent://acme.example/u-', CAST(c.c_custkey AS string)) GROUP BY c.c_mktsegment")
same("r8_join_as_of", "SELECT record_id, (SELECT max(b.recorded_at_nanos) FROM r b WHERE b.agent_id = a.agent_id AND b.event_type = 'budget_check' AND b.recorded_at_nanos <= a.recorded_at_nanos) AS last_budget FROM r a WHERE event_type = 'tool_call'",
     "SELECT record_id, last_budget FROM (SELECT record_id, event_type, max(CASE WHEN event_type = 'budget_check' THEN recorded_at_nanos END) OVER (PARTITION BY agent_id ORDER BY recorded_at_nanos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_budget FROM r) w WHERE event_type = 'tool_call'")
same("r9_window_rank", "SELECT record_id, row_number() OVER w AS rn, rank() OVER (PARTITION BY run_id ORDER BY tokens_in) AS rk, dense_rank() OVER (PARTITION BY run_id ORDER BY tokens_in) AS dr, ntile(3) OVER w AS nt FROM r WINDOW w AS (PARTITION BY run_id ORDER BY recorded_at_nanos, record_id)")
same("r9_window_frames", "SELECT record_id, sum(tokens_in) OVER (PARTITION BY run_id ORDER BY recorded_at_nanos, record_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3, lag(severity) OVER w AS before, lead(severity) OVER w AS after, first_value(record_id) OVER w AS first FROM r WINDOW w AS (PARTITION BY run_id ORDER BY recorded_at_nanos, record_id)")
same("r9_window_range", "SELECT record_id, count(*) OVER (PARTITION BY agent_id ORDER BY recorded_at_nanos RANGE BETWEEN 86400000000000 PRECEDING AND CURRENT ROW) AS day FROM r")
same("r9_window_distribution", "SELECT record_id, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, nth_value(record_id, 2) OVER w AS second FROM r WINDOW w AS (PARTITION BY run_id ORDER BY recorded_at_nanos, record_id)")
same("r10_union", "SELECT run_id FROM r WHERE severity = 'error' UNION SELECT run_id FROM r WHERE verdict = 'allowed'")
same("r10_union_all", "SELECT run_id FROM r WHERE severity = 'error' UNION ALL SELECT run_id FROM r WHERE verdict = 'allowed'")
same("r10_intersect", "SELECT run_id FROM r WHERE severity = 'error' INTERSECT SELECT run_id FROM r WHERE verdict = 'allowed'")
same("r10_except", "SELECT run_id FROM r WHERE severity = 'error' EXCEPT SELECT run_id FROM r WHERE verdict = 'allowed'")
same("r11_cte", "WITH x AS (SELECT run_id, count(*) AS n FROM r GROUP BY run_id), y AS (SELECT max(n) AS top FROM x) SELECT x.run_id, x.n FROM x JOIN y ON x.n = y.top")
same("r11_subquery", "SELECT record_id FROM r WHERE tokens_in > (SELECT avg(tokens_in) FROM r) AND run_id IN (SELECT run_id FROM r WHERE severity = 'error')")
same("r11_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")
same("r12_string", "SELECT record_id, length(run_id) AS n, substring(run_id, 1, 5) AS head, concat(tenant, '/', event_type) AS path, replace(run_id, '-', '_') AS under, lpad(tenant, 8, '*') AS padded, trim(concat(' ', tenant)) AS t, reverse(tenant) AS rev FROM r")
same("r12_pattern", "SELECT record_id, regexp_extract(run_id, 'run-([0-9]+)-', 1) AS usr, regexp_replace(run_id, '[0-9]', '#', 'g') AS masked, agent_id LIKE '%u-1%' AS hit FROM r", "SELECT record_id, regexp_extract(run_id, 'run-([0-9]+)-', 1) AS usr, regexp_replace(run_id, '[0-9]', '#') AS masked, agent_id LIKE '%u-1%' AS hit FROM r")
same("r12_hash", "SELECT record_id, sha256(run_id) AS h, md5(run_id) AS m FROM r", "SELECT record_id, sha2(run_id, 256) AS h, md5(run_id) AS m FROM r")
same("r13_date", "SELECT record_id, CAST(date_trunc('day', make_timestamp(recorded_at_nanos // 1000)) AS date) AS day, extract(hour FROM make_timestamp(recorded_at_nanos // 1000)) AS hour FROM r",
     "SELECT record_id, CAST(date_trunc('day', timestamp_micros(recorded_at_nanos div 1000)) AS date) AS day, extract(hour FROM timestamp_micros(recorded_at_nanos div 1000)) AS hour FROM r")
same("r13_math", "SELECT record_id, abs(tokens_in - 50) AS a, tokens_in % 7 AS m, greatest(tokens_in, latency_micros) AS g, least(tokens_in, 10) AS l, sign(tokens_in - 50) AS s, round(sqrt(tokens_in), 6) AS q, CAST(floor(tokens_in / 3.0) AS bigint) AS f FROM r")
same("r13_conditional", "SELECT record_id, coalesce(verdict, 'none') AS v, nullif(tenant, 'acme') AS t, CASE WHEN error IS NULL THEN 0 ELSE 1 END AS e FROM r")
same("r14_arrays", "SELECT record_id, CASE WHEN caused_by_one IS NULL THEN 0 ELSE 1 END AS n, caused_by_one AS first, coalesce(caused_by_one = lpad('7d', 32, '0'), false) AS hit FROM r",
     "SELECT record_id, size(caused_by) AS n, try_element_at(caused_by, 1) AS first, array_contains(caused_by, lpad('7d', 32, '0')) AS hit FROM r")
same("r14_explode", "SELECT record_id, caused_by_one AS cause FROM r WHERE caused_by_one IS NOT NULL", "SELECT record_id, cause FROM r LATERAL VIEW explode(caused_by) x AS cause")
same("r15_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS bigint) AS k FROM events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS bigint) AS k FROM events")
same("r16_percentiles", "SELECT severity, quantile_cont(tokens_in, 0.5) AS median FROM r GROUP BY severity", "SELECT severity, percentile(tokens_in, 0.5) AS median FROM r GROUP BY severity")
same("star_pricing", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 1) AS net FROM lineitem GROUP BY l_returnflag, l_linestatus")
same("star_regions", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
same("star_turns", "SELECT role, count(*) AS n, max(turn) AS last FROM conversations GROUP BY role")


@query()
def r16_approximate(spark, sf_dir):
    """Within the stated error of the exact figures; beside them, for a check."""
    return records(spark, sf_dir).groupBy("severity").agg(
        F.approx_count_distinct("run_id", 0.02).alias("about"), F.countDistinct("run_id").alias("exact"), F.percentile_approx("tokens_in", 0.5, 10000).alias("median"),
    )


@query()
def h16_manifests_sha384(spark, sf_dir):
    """The default hash, which the oracle's engine lacks; tests hold it against ``hashlib``."""
    return chain.manifests(chain.seal(records(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
