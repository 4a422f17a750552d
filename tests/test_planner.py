"""Proof planning, the statement gate and the session, over the six-row fixture."""

import pytest
from evidenta.operators import causal, chain, segments
from evidenta.plans.gate import Refused
from evidenta.plans.proof import ONE_AT_A_TIME, Predicate, Proof, key_of, merge_bounds, plan
from evidenta.plans.session import Session
from evidenta.schema import RECORDS
from pyspark.sql import functions as F

SIX = [("job-red", "model_call", "ledger"), ("job-red", "tool_call", "ledger"), ("job-teal", "model_call", "ledger"), ("job-teal", "model_call", "desk"), ("job-grey", "tool_call", "desk"), ("job-grey", "model_call", "desk")]


def make(spark, rows):
    """Records from dicts; unset columns are null, empty or zero."""
    base = {"tenant": "acme", "shard": 0, "segment_id": 1, "chain_link": "", "prev_hash": "", "severity": "info", "hash_alg": "sha384", "sig_alg": "es384", "kem_alg": "mlkem768", "mapper_version": 1, "occurred_at_nanos": 0, "event_type": "model_call", "agent_id": "agent://shop.example/a"}
    out = []
    for r in rows:
        d = {**base, **r}
        out.append(tuple(d.get(f.name, [] if f.dataType.typeName() == "array" else None) for f in RECORDS.fields))
    return spark.createDataFrame(out, RECORDS)


@pytest.fixture(scope="module")
def six(spark):
    return make(spark, [
        {"record_id": format(i, "032x"), "seq": i, "run_id": r, "event_type": e, "agent_id": f"agent://shop.example/{a}", "recorded_at_nanos": 7_000_000 + i, "occurred_at_nanos": 1000 + i, "severity": "error" if i % 2 == 0 else "info"}
        for i, (r, e, a) in enumerate(SIX, 1)
    ])


@pytest.fixture(scope="module")
def held(six):
    """Sealed rows and their manifests."""
    rows = chain.seal(six).persist()
    return rows, chain.manifests(rows).persist()


@pytest.fixture(scope="module")
def session(held):
    return Session(*held, raw=True)


CASES = [
    ("run_id='job-teal'", 2, True), ("agent_id='agent://shop.example/desk'", 3, True), ("event_type='tool_call'", 2, True), ("recorded_at_nanos=7000003", 1, True),
    ("record_id='00000000000000000000000000000004'", 1, True), ("recorded_at_nanos BETWEEN 7000002 AND 7000004", 3, True), ("1=1 AND 'job-red' = run_id", 2, False), ("'job-red' = run_id", 2, True),
    ("recorded_at_nanos >= 7000002 AND recorded_at_nanos <= 7000004", 3, True), ("7000002 <= recorded_at_nanos", 5, True), ("recorded_at_nanos > 7000002", 4, False),
    ("severity='error'", 3, False), ("run_id='job-teal' AND event_type='model_call'", 2, False), ("lower(agent_id) LIKE '%desk%'", 3, False), ("run_id IN ('job-red','job-teal')", 4, False),
    ("run_id <> 'job-red'", 4, False), ("run_id = 'job-red' OR severity='error'", 4, False), ("event_type >= 'n'", 2, False), ("event_type='nope'", 0, False), ("run_id = agent_id", 0, False), ("record_id='4'", 0, False),
]


@pytest.mark.parametrize("where,n,full", CASES)
def test_predicates(session, where, n, full):
    answer = session.query(f"SELECT * FROM records WHERE {where}")
    assert answer.rows.count() == n and answer.proof.is_full == full, answer.proof
    assert bool(answer.proof.unproved) != full


def test_reasons_are_named(session):
    assert any(ONE_AT_A_TIME in r for r in session.query("SELECT * FROM records WHERE run_id='job-teal' AND event_type='model_call'").proof.unproved)
    assert any("like" in r.lower() for r in session.query("SELECT * FROM records WHERE lower(agent_id) LIKE '%x%'").proof.unproved)
    assert session.query("SELECT * FROM records").proof == Proof()
    assert session.query("SELECT * FROM records LIMIT 1").proof.notes == ("truncated",)
    assert [p.placements for p in session.explain("SELECT * FROM records WHERE run_id='a' AND severity='x'")] == [("indexed", "engine")]


SHAPES = [
    ("SELECT x FROM (SELECT run_id AS x FROM records) s WHERE x = 'job-red'", True), ("WITH c AS (SELECT * FROM records) SELECT * FROM c WHERE run_id = 'job-red'", True),
    ("SELECT a.seq FROM records a JOIN records b ON a.run_id = b.run_id WHERE a.run_id = 'job-red'", False), ("SELECT * FROM records a CROSS JOIN (SELECT 1 AS one) o WHERE a.run_id = 'job-red'", True),
    ("SELECT count(*) FROM records", True), ("SELECT run_id FROM records GROUP BY run_id HAVING count(*) > 1", False), ("SELECT * FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM records) w WHERE n < 3", False),
    ("SELECT run_id FROM records WHERE run_id = 'job-red' UNION ALL SELECT run_id FROM records WHERE severity = 'error'", False), ("SELECT * FROM records WHERE run_id IN (SELECT run_id FROM records WHERE severity = 'error')", False),
    ("SELECT * FROM (SELECT upper(run_id) AS x FROM records) s WHERE x = 'JOB-RED'", False), ("SELECT 1 AS one", False),
    ("SELECT * FROM (SELECT 1 AS k) o LEFT JOIN records r ON r.seq = o.k WHERE r.run_id = 'job-red'", False),
]


@pytest.mark.parametrize("sql,full", SHAPES)
def test_plan_shapes(session, sql, full):
    assert session.query(sql).proof.is_full == full


def test_table_functions(session, six):
    for at, n in (("9999999999", 6), ("7000003", 3), ("1", 0)):
        answer = session.query(f"SELECT * FROM records_as_of('{at}')")
        assert answer.rows.count() == n and answer.proof.is_full
    for at in ("2025-11-30", "last tuesday", "2025-11-30T08:15:00+05:30"):
        with pytest.raises(ValueError, match="instant"):
            session.query(f"SELECT * FROM records_as_of('{at}')")
    assert session.query("SELECT * FROM causal_closure('job-red')").rows.count() == 2
    assert session.query("SELECT * FROM causal_closure('job-none')").rows.count() == 0
    for lo, hi, n in ((1, 6, 6), (2, 4, 3), (1, 999_999, 6)):
        answer = session.query(f"SELECT * FROM journal({lo},{hi})")
        assert answer.rows.count() == n and "past the projections" in answer.proof.unproved[0]
    assert session.query("SELECT * FROM journal(1,6) WHERE run_id='job-red'").rows.count() == 2
    for args in ("99,200", "5,2", "1"):
        with pytest.raises(ValueError):
            session.query(f"SELECT * FROM journal({args})")
    with pytest.raises(Refused, match="journal"):
        Session(six).query("SELECT * FROM journal(1,6)")


def test_proof_slot(held):
    one, two = Session(*held), Session(*held)
    assert one.query("SELECT * FROM answer_proof()").rows.first()["proof"] == "none"
    one.query("SELECT * FROM records WHERE severity='error'")
    assert one.last.proof.status == "partial" and two.last is None
    one.query("SELECT * FROM records WHERE run_id='x'")
    assert tuple(one.query("SELECT * FROM answer_proof()").rows.first()) == ("full", 0, None)


def test_status_follows_from_segments(spark, held):
    rows, manifests = held
    ask = lambda frame, made=manifests, sql="SELECT * FROM records", **k: Session(frame, made, **k).query(sql).proof
    assert ask(rows).is_full
    assert ask(rows, None).status == "none"
    cases = {
        "wrong-size": rows.where("seq <> 3"), "link-broken": rows.withColumn("run_id", F.when(F.col("seq") == 2, "other").otherwise(F.col("run_id"))), "missing": rows.limit(0),
        "wrong-ends": chain.seal(rows, heads={0: "ab"}),
    }
    for why, frame in cases.items():
        proof = ask(frame)
        assert proof.status == "partial" and proof.unproved[0].startswith(f"{why}: 1 segment"), (why, proof)
    assert ask(rows, manifests.limit(0)).unproved[0].startswith("not-committed")
    assert ask(rows, manifests.withColumn("root_run_id", F.lit("x")), "SELECT * FROM records WHERE run_id = 'job-red'").unproved[0].startswith("wrong-root")
    assert ask(rows, manifests.withColumn("root_run_id", F.lit("x"))).is_full  # another dimension's index answers
    # a segment whose committed span lies outside a range of time is not read
    assert ask(rows.limit(0), sql="SELECT * FROM records WHERE recorded_at_nanos >= 9000000").is_full
    assert ask(rows.limit(0), sql="SELECT * FROM records WHERE recorded_at_nanos >= 7000006").status == "partial"
    other = spark.range(3).withColumnRenamed("id", "k")
    for sql in ("SELECT * FROM other", "SELECT r.seq FROM records r JOIN other o ON r.seq = o.k"):
        assert "outside the store" in " ".join(ask(rows, sql=sql, tables={"other": other}).unproved)
    found = segments.check(rows, manifests, "run_id", "job-red", "job-red").collect()
    assert [(r["n_records"], r["n_entries"], r["status"], r["reason"]) for r in found] == [(6, 2, "full", None)]


REFUSED = [
    "INSERT INTO records SELECT * FROM records", "UPDATE records SET tenant='x'", "DELETE FROM records", "DROP TABLE records", "CREATE TABLE t (a INT)", "SELECT 1; DROP TABLE records", "SELECT * FROM text.`/etc/hostname`",
    "SELECT reflect('java.lang.System','getProperty','x')", "SELECT java_method('java.lang.System','getProperty','x')", "SELECT TRANSFORM(run_id) USING 'cat' FROM records", "SELECT * FROM other", "CACHE TABLE records", "ADD JAR 'x'",
    "SELECT (SELECT max(a) FROM other)", "SELECT * FROM other VERSION AS OF 1", "SELECT * FROM global_temp.x TIMESTAMP AS OF '2024-01-01'", "SELECT * FROM records VERSION AS OF 1",
    "SELECT input_file_name() FROM records", "SELECT current_user()", "SELECT * FROM (SELECT try_reflect('a', 'b')) x", "WITH x AS (SELECT reflect('a','b')) SELECT * FROM x", "SELECT * FROM range(3) r, nothing('x')",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_gate_refuses(session, sql):
    with pytest.raises(Refused) as e:
        session.query(sql)
    assert e.value.sqlstate == "42501"


def test_gate_lets_through(session):
    for sql in ("SELECT 1", "EXPLAIN SELECT * FROM records", "SHOW TABLES", "BEGIN", "COMMIT", "ROLLBACK", "RESET"):
        session.query(sql)
    session.query("SET spark.sql.runSQLOnFiles=true")
    assert session.spark.conf.get("spark.sql.runSQLOnFiles") == "false"


def test_gate_lets_functions_of_dates_through(session):
    row = session.query("SELECT date_trunc('day', timestamp_micros(recorded_at_nanos div 1000)) AS d, year(DATE '2024-01-02') AS y FROM records").rows.first()
    assert row["d"].hour == 0 and row["y"] == 2024


def test_merging_and_keys():
    b = Predicate.between
    assert merge_bounds([b("run_id", "a"), b("run_id", None, "c"), b("run_id", "b")]) == [b("run_id", "b", "c"), Predicate("absorbed", "run_id"), Predicate("absorbed", "run_id")]
    p = plan([b("recorded_at_nanos", 1), Predicate.equals("run_id", "x")])
    assert (p.dimension, p.placements) == ("run_id", ("engine", "indexed")) and ONE_AT_A_TIME in p.unproved[0]
    assert plan([]).dimension == "recorded_at_nanos" and plan([]).proof.is_full
    assert plan([Predicate.equals("tenant", "x")]).proof.status == "partial"
    assert key_of("record_id", "A" * 32) is None and key_of("recorded_at_nanos", -1) is None and key_of("recorded_at_nanos", "5") is None
    assert Proof().downgrade("a", "a", "b").unproved == ("a", "b") and Proof().refuse("x").downgrade("y").status == "none"


CAUSAL = [(1, "ticket-9", 1000, None, []), (2, "ticket-9", 1010, None, [1]), (3, "ticket-9", 1020, None, [2, 11]), (11, "invoice-4", 990, "intake-2", []), (12, "intake-2", 980, None, [])]


def graph(spark, rows):
    return make(spark, [{"record_id": format(i, "032x"), "seq": i, "run_id": r, "recorded_at_nanos": at, "parent_run_id": p, "caused_by": [format(c, "032x") for c in cs], **(more[0] if more else {})} for i, r, at, p, cs, *more in rows])


def ids(found):
    return [int(r["record_id"], 16) for r in found.records.collect()]


def test_causal(spark):
    found = causal.reconstruct(graph(spark, CAUSAL), "ticket-9")
    assert ids(found) == [12, 11, 1, 2, 3] and found.is_complete
    assert [h[0] for h in found.hops] == ["root", "cause", "parent_run"] or found.hops[0][0] == "root"
    dangling = causal.reconstruct(graph(spark, [*CAUSAL, (4, "ticket-9", 1030, None, [99])]), "ticket-9")
    assert dangling.proof.unproved == (causal.DANGLING,) and not dangling.is_complete
    lost = causal.reconstruct(graph(spark, [*CAUSAL, (5, "intake-2", 970, None, [], {"event_type": "store_event", "verdict": "failed"})]), "ticket-9")
    assert lost.proof.unproved == (causal.LOSS,)
    assert causal.reconstruct(graph(spark, CAUSAL), "ticket-9", causal.Bounds(1, 100)).stopped == "hop_limit"
    cut = causal.reconstruct(graph(spark, CAUSAL), "ticket-9", causal.Bounds(64, 2))
    assert cut.stopped == "record_limit" and len(ids(cut)) == 2 and not cut.is_complete
    deep = graph(spark, [(1, "leaf", 100, "r0", []), *[(10 + i, f"r{i}", 90 - i, f"r{i + 1}", []) for i in range(40)]])
    assert causal.run_closure(deep, "leaf").count() == 42 and {int(r["record_id"], 16) for r in causal.upstream(deep, "leaf").collect()} == {1, *range(10, 50)}
    assert {int(r["record_id"], 16) for r in causal.upstream(graph(spark, CAUSAL), "ticket-9").collect()} == {1, 2, 3, 11, 12}
    cycle = causal.reconstruct(graph(spark, [(1, "a", 1, "b", [2]), (2, "b", 2, "a", [1])]), "a")
    assert ids(cycle) == [1, 2] and cycle.is_complete
    assert ids(causal.reconstruct(graph(spark, CAUSAL), "none")) == []
    assert {r["run_id"] for r in causal.run_closure(graph(spark, [(1, "a", 1, "b", [2]), (2, "b", 2, "a", [1])]), "a").collect()} == {"a", "b"}
