"""A read session over one records table: SQL in, rows and their proof out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.operators import causal, segments
from evidenta.plans import gate
from evidenta.plans.planner import report
from evidenta.plans.proof import Proof
from evidenta.sources.instants import query_instant


UNSEALED = "no manifests: nothing commits to these records"


class Answer:
    """Rows and their proof. Rows are lazy; segments are verified when the proof is first read."""

    def __init__(self, rows: DataFrame, proof: Proof, settle: Callable[[], Proof] | None = None):
        self.rows, self._proof, self._settle = rows, proof, settle

    @property
    def proof(self) -> Proof:
        if self._settle is not None:
            self._proof, self._settle = self._settle(), None
        return self._proof


class Session:
    """One scope's SQL surface.

    Rows and proof are returned together; ``answer_proof()`` also gives the last one in SQL. The session
    is a Spark session of its own, so another session's statements never change its proof slot. There is no
    row filter by tenant: give each scope a session over its own records. ``raw`` adds ``journal(from, to)``.

    ``manifests`` are what the reader trusts. An answer is full only if no predicate is unproved and every segment that
    the index range touches is proved against its manifest; without manifests the status is ``none``. Verified
    ranges are remembered, since sealed records do not change.
    """

    def __init__(
        self, records: DataFrame, manifests: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, raw: bool = False, bounds: causal.Bounds = causal.Bounds(),
        bits: int = 384, columns: list[str] | None = None,
    ):
        self.spark: SparkSession = records.sparkSession.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.given, self.manifests, self.bits, self.columns = records, manifests, bits, columns
        self.verified: dict[tuple, tuple[str, ...]] = {}
        self.records = self._register("records", records)
        self.tables = {"records", *(name.lower() for name in tables or {})}
        for name, frame in (tables or {}).items():
            self._register(name, frame)
        self.raw, self.bounds = raw, bounds
        self.last: Answer | None = None
        self.functions = set(gate.TABLE_FUNCTIONS) - (set() if raw else {"journal"})
        self._columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
        self._function("records_as_of", "at STRING", "SELECT * FROM records WHERE recorded_at_nanos <= CASE WHEN at RLIKE '^[0-9]+$' THEN CAST(at AS BIGINT) ELSE unix_micros(to_timestamp(at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")) * 1000 END")
        if raw:
            self._function("journal", "lo BIGINT, hi BIGINT", "SELECT * FROM records WHERE seq BETWEEN lo AND hi")

    def segments(self, dimension: str, lo=None, hi=None) -> DataFrame:
        """Each segment a range touches, with its size, entries in the range, and status."""
        if self.manifests is None:
            raise ValueError(UNSEALED)
        return segments.check(self.given, self.manifests, dimension, lo, hi, self.bits, self.columns)

    def _settled(self, planned: Proof, leaves: list) -> Proof:
        """The proof of a plan and of the segments its scans touch."""
        if planned.status == "none" or not leaves:
            return planned
        if self.manifests is None:
            return planned.refuse(UNSEALED)
        proof = planned
        for leaf in leaves:
            if leaf.raw:
                continue  # a raw range is partial whatever its segments hold
            at = leaf.plan
            # beyond time every segment is touched, whatever the range
            key = (at.dimension, at.lo, at.hi) if at.dimension == "recorded_at_nanos" else (at.dimension, None, None)
            if key not in self.verified:
                self.verified[key] = segments.failures(self.segments(*key))
            proof = proof.downgrade(*self.verified[key])
        return Proof(proof.status, proof.unproved, planned.notes)

    def _register(self, name: str, frame: DataFrame) -> DataFrame:
        """A view in this session of a frame of another one; the plan is shared, nothing is copied."""
        own = DataFrame(_in_session(self.spark, frame), self.spark)
        own.createOrReplaceTempView(name)
        return own

    def _function(self, name: str, args: str, body: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({self._columns}) RETURN {body}")

    def query(self, sql: str) -> Answer:
        """Gate, prepare table functions, analyze, prove; the rows are lazy."""
        kind = gate.allow(self.spark, sql, self.tables, self.functions)
        if kind == "inert":
            return Answer(self.spark.range(0), self.last.proof if self.last else Proof("none", ("nothing was asked",)))
        closures, instant = ({}, None) if kind == "show" else self._prepare(sql)
        rows = self.spark.sql(sql)
        if kind != "query":
            return Answer(rows, Proof("none", ("not a query of records",)))
        planned, leaves = report(rows, closures, instant)
        self.last = Answer(rows, planned, lambda: self._settled(planned, leaves))
        return self.last

    def explain(self, sql: str) -> list:
        """The placement of each scan's predicates, without running anything."""
        gate.allow(self.spark, sql, self.tables, self.functions)
        closures, instant = self._prepare(sql)
        return [leaf.plan for leaf in report(self.spark.sql(sql), closures, instant)[1]]

    def _prepare(self, sql: str) -> tuple[dict[str, Proof], int | None]:
        closures, parts, instant = {}, [], None
        for name, args in gate.literal_calls(self.spark, sql):
            if name == "records_as_of":
                if len(args) != 1:
                    raise ValueError("records_as_of takes one instant")
                at = query_instant(args[0])
                instant = at if instant is None else max(instant, at)
            elif name == "journal":
                self._bounds(args)
            elif name == "causal_closure":
                if len(args) != 1:
                    raise ValueError("causal_closure takes one run")
                found = causal.reconstruct(self.records, args[0], self.bounds)
                proof = found.proof if found.is_complete else found.proof.downgrade(f"the traversal stopped at its {found.stopped.replace('_', ' ')}")
                closures[args[0]] = proof
                parts.append(found.records.withColumn("__run", F.lit(args[0])))
            elif name == "answer_proof":
                last = self.last.proof if self.last else Proof("none")
                row = [(last.status, len(last.unproved), "; ".join(last.unproved) or None)]
                self.spark.createDataFrame(row, "proof string, unproved long, reason string").createOrReplaceTempView("__proof")
                self.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION answer_proof() RETURNS TABLE(proof STRING, unproved BIGINT, reason STRING) RETURN SELECT * FROM __proof")
        if parts:
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            whole.createOrReplaceTempView("__closure")
            self._function("causal_closure", "run STRING", "SELECT * EXCEPT (__run) FROM __closure WHERE __run = run")
        return closures, instant

    def _bounds(self, args: list[str]) -> None:
        if len(args) != 2 or not all(a.lstrip("-").isdigit() for a in args):
            raise ValueError("journal takes two sequence numbers")
        lo, hi = map(int, args)
        low, high = self.records.agg(F.min("seq"), F.max("seq")).first()
        if low is None:
            raise ValueError("nothing is sealed")
        if lo > hi:
            raise ValueError(f"from {lo} is after to {hi}")
        if lo < low or lo > high:
            raise ValueError(f"from {lo} is outside the sealed range {low}..{high}")


def _in_session(spark: SparkSession, frame: DataFrame):
    jvm = spark._jvm
    return jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, frame._jdf.logicalPlan())
