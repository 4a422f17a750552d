"""Chains, proofs, storage, mapping, federation, erasure, verification and streaming."""

import hashlib
import json
import os
import struct

import pytest
from evidenta import catalog, schema
from evidenta.operators import chain, completeness, erasure, federation, ingest, storage, verify
from evidenta.operators.query import Query, answer
from evidenta.plans.proof import Proof
from evidenta.sources import agent_event, instants, strict_json, telemetry
from evidenta.streaming import pipeline
from pyspark.sql import functions as F

from tests.test_planner import make


@pytest.fixture(scope="module")
def twelve(spark):
    """Three segments of four rows on two shards."""
    rows = [
        {"record_id": format(i, "032x"), "shard": (i - 1) // 8, "segment_id": (i - 1) // 4 % 2 + 1, "seq": (i - 1) % 4 + 1, "run_id": f"run-{-(-i // 3)}", "recorded_at_nanos": 1000 + 10 * i,
         "agent_id": f"agent://acme.example/{'support' if i % 2 == 0 else 'billing'}", "severity": "critical" if i % 4 == 0 else "info", "verdict": "denied" if i % 3 == 0 else "allowed", "error": "none"}
        for i in range(1, 13)
    ]
    return make(spark, rows)


@pytest.fixture(scope="module")
def sealed(twelve):
    return chain.seal(twelve).persist()


@pytest.fixture(scope="module")
def manifests(sealed):
    return chain.manifests(sealed).persist()


def test_schema():
    assert len(schema.RECORDS.fields) == 42 and schema.violations(schema.RECORDS) == [] and "recorded_at" not in schema.RECORDS.names
    bad = schema.StructType([schema.StructField("note", schema.StringType(), True, {"plane": "metadata", "kind": "free_text", "pii": "possible"})])
    assert len(schema.violations(bad)) == 2
    assert schema.is_token("run_id", "run-a.1") and not schema.is_token("run_id", "a sentence") and not schema.is_token("run_id", "a" * 65)
    assert schema.is_token("agent_id", "agent://d.example/x", strict=True) and not schema.is_token("agent_id", "user://d/x", strict=True)
    assert json.loads(schema.to_json())["fields"][0]["name"] == "record_id" and len(schema.UNERASABLE) == 9
    # no free text: every metadata string is a bounded kind
    assert all(f.metadata["kind"] in {"hash", "token", "enum", "u16", "u32", "u64", "i64", "timestamp"} for f in schema.RECORDS.fields)


def test_queries(twelve):
    found = answer(twelve, Query.time_between(1030, 1080))
    assert found.rows.count() == 6 and found.proof.is_full
    assert answer(twelve, Query.point("agent_id", "agent://acme.example/billing")).rows.count() == 6
    critical = answer(twelve, Query.time_between(1000, 1120).with_filter("severity", "critical"))
    assert (critical.rows.count(), critical.matched_before_filters, critical.proof.unproved) == (3, 12, ("severity",))
    assert answer(twelve, Query.time_between(1080, 1030)).rows.count() == 0
    assert Query.time_between(0, 50).as_of(90).hi == 50 and Query.point("run_id", "x").as_of(5).proof.unproved == ("as_of",)
    twice = Query.time_between(0, 9).with_filter("min_severity", "error").with_filter("severity", "info").with_filter("verdict", "denied").with_filter("error", "none").with_filter("payload", False)
    assert twice.proof.unproved == ("severity", "outcome.verdict", "outcome.error", "payload")
    assert answer(twelve, Query.range("event_type", "request_received", "model_call")).rows.count() == 12
    with pytest.raises(ValueError):
        answer(twelve, Query.point("tenant", "acme"))


def test_chain(spark, sealed, twelve):
    rows = sealed.orderBy("shard", "segment_id", "seq").withColumn("body", F.sha2(chain.canonical(), 384)).collect()
    head = {}
    for r in rows:
        prev = head.get(r["shard"]) or hashlib.sha384(f"genesis/v1|{r['shard']}".encode()).hexdigest()
        link = hashlib.sha384(f"chain/v1|{prev}|{r['seq']}|{r['body']}".encode()).hexdigest()
        assert (r["prev_hash"], r["chain_link"]) == (prev, link) and len(link) == 96
        head[r["shard"]] = link
    assert chain.verify_chain(sealed).count() == 0
    for column, value in (("run_id", "run-x"), ("prev_hash", "0" * 96), ("chain_link", "0" * 96), ("severity", "debug")):
        forged = sealed.withColumn(column, F.when(F.col("record_id") == format(6, "032x"), value).otherwise(F.col(column)))
        assert chain.verify_chain(forged).count() >= 1, column
    assert chain.verify_chain(sealed.where("seq != 2 or shard = 1")).count() >= 1


def reference_root(leaves):
    if not leaves:
        return hashlib.sha384(b"").hexdigest()
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return chain.node_hash(reference_root(leaves[:k]), reference_root(leaves[k:]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 21, 34])
def test_merkle(n):
    leaves = [chain.leaf_hash(str(i)) for i in range(n)]
    tree = chain.levels(leaves)
    root = tree[-1][0]
    assert root == reference_root(leaves) == chain.root(leaves)
    for i in range(n):
        path = chain.inclusion(tree, i)
        assert chain.verify_inclusion(leaves[i], i, n, path, root)
        assert not chain.verify_inclusion(leaves[i], i, n, [*path, root], root) and not chain.verify_inclusion("x", i, n, path, root) and not chain.verify_inclusion(leaves[i], n, n, path, root)
        old = i + 1
        proof = chain.consistency(tree, old)
        assert chain.verify_consistency(old, chain.root(leaves[:old]), n, root, proof)
        assert not chain.verify_consistency(old, "x", n, root, proof) and not chain.verify_consistency(old, chain.root(leaves[:old]), n, "x", proof)
    assert chain.root([]) == hashlib.sha384(b"").hexdigest()


def test_range_proofs():
    entries = [completeness.Entry(f"k{i // 2:02d}", i, chain.digest(str(i))) for i in range(14)]
    index = completeness.SortedIndex("run_id", entries)
    known = ("run_id", 14, index.root)
    keys = ["a", *[f"k{i:02d}" for i in range(7)], "z"]
    for lo in keys:
        for hi in keys:
            proof = index.range(lo, hi)
            assert completeness.verify_range(proof, "run_id", lo, hi, *known[1:]) == []
            assert len(proof.entries) == sum(lo <= e.key <= hi for e in entries)
    proof = index.range("k02", "k04")
    check = lambda p: completeness.verify_range(p, "run_id", "k02", "k04", 14, index.root)
    e = proof.entries
    t = completeness.tampered
    hidden = [t(proof, entries=e[1:]), t(proof, entries=e[:2] + e[3:]), t(proof, entries=e[:-1]), t(proof, entries=()), t(proof, left=None), t(proof, right=None), t(proof, entries=(e[1], e[0], *e[2:])), t(proof, left=proof.entries[0])]
    hidden += [t(proof, entries=(completeness.Placed(completeness.Entry("k03", 99, "x"), 5, e[1].path), *e[1:])), t(proof, size=13), t(proof, root="x"), t(proof, lo="k03"), t(proof, dimension="agent_id"), t(proof, entries=e * 2)]
    assert all(check(p) for p in hidden)
    with pytest.raises(ValueError):
        completeness.SortedIndex("run_id", [entries[0], entries[0]])


def test_composites(sealed, manifests):
    rows, entries = manifests.collect(), chain.index_entries(sealed)
    lo, hi = "1030".rjust(20, "0"), "1040".rjust(20, "0")
    proof = completeness.compose("recorded_at_nanos", lo, hi, rows, entries)
    assert completeness.verify_composite(proof, "recorded_at_nanos", lo, hi, rows) == [] and len(proof.skipped) == 2
    assert sum(len(p.entries) for p in proof.segments.values()) == 2
    place = next(iter(proof.segments))
    for bad in (completeness.CompositeProof("recorded_at_nanos", lo, hi, {}, proof.skipped), completeness.CompositeProof("recorded_at_nanos", lo, hi, {}, proof.skipped | {place}), completeness.CompositeProof("run_id", lo, hi, proof.segments, proof.skipped)):
        assert completeness.verify_composite(bad, "recorded_at_nanos", lo, hi, rows)
    by_run = completeness.compose("run_id", "run-1", "run-1", rows, entries)
    assert completeness.verify_composite(by_run, "run_id", "run-1", "run-1", rows) == [] and not by_run.skipped


def test_composites_by_segment(sealed, manifests):
    """Each segment is proved by itself, without a driver that gathers entries; a changed or missing one fails alone."""
    entries, lo, hi = chain.index_entries(sealed), "1030".rjust(20, "0"), "1040".rjust(20, "0")
    proof = completeness.compose("recorded_at_nanos", lo, hi, manifests.collect(), entries)
    ask = lambda e, m=manifests, d="recorded_at_nanos", a=lo, b=hi: {(r["shard"], r["segment_id"]): tuple(r)[2:] for r in completeness.prove(d, a, b, m, e).collect()}
    found, sizes = ask(entries), {(r["shard"], r["segment_id"]): r["n_records"] for r in manifests.collect()}
    assert found == {p: (n, len(proof.segments[p].entries) if p in proof.segments else 0, p in proof.skipped, 0, bool(p in proof.segments and proof.segments[p].entries)) for p, n in sizes.items()}
    assert sum(f[1] for f in found.values()) == 2 and sum(f[2] for f in found.values()) == 2
    place = next(iter(proof.segments))
    here = f"shard = {place[0]} and segment_id = {place[1]}"
    assert ask(entries.where(f"not ({here})"))[place][3] > 0 and ask(entries.where(f"not ({here} and pos = 0)"))[place][3] > 0
    assert ask(entries, manifests.where(f"not ({here})"))[place][3] > 0  # not committed
    by_run = ask(entries, d="run_id", a="run-1", b="run-1")
    assert not any(f[2] or f[3] for f in by_run.values()) and len(by_run) == 3
    assert all(f == (sizes[p], 0, False, 0, False) for p, f in ask(entries, d="run_id", a="run-2", b="run-1").items())


def test_manifests_and_verification(spark, sealed, manifests, twelve):
    assert manifests.count() == 3 and manifests.where("seal_error is not null").count() == 0
    rows = manifests.collect()
    root = chain.store_root(rows)
    broken = lambda r, m, s=root: {x["check"] for x in verify.findings(r, m, s).where("level = 'broken'").collect()}
    assert broken(sealed, manifests) == set()
    assert broken(sealed.where("not (shard = 0 and segment_id = 2 and seq = 4)"), manifests) >= {"record-count", "history-root"}
    assert "records-present" in broken(sealed.where("shard = 0"), manifests)
    assert "orphan-records" in broken(sealed, manifests.where("shard = 0"))
    assert "store-root" in broken(sealed, manifests, "x")
    forged = sealed.withColumn("run_id", F.when(F.col("seq") == 2, "run-z").otherwise(F.col("run_id")))
    assert broken(forged, manifests) >= {"index-root", "chain-within-segment"}
    assert "segment-numbering" in broken(sealed.where("not (shard = 0 and segment_id = 1)"), manifests.where("not (shard = 0 and segment_id = 1)"))
    mixed = chain.manifests(sealed.withColumn("hash_alg", F.when(F.col("seq") == 2, "sha256").otherwise("sha384")))
    assert {r["seal_error"] for r in mixed.collect()} == {"mixed-algorithms"}
    lines = {r["reference"]: r for r in verify.coverage(verify.findings(sealed, manifests), 12).collect()}
    assert len(lines) == len(verify.TEXTS) and lines["Article 12(1)"]["coverage"] == "shown" and lines["Audit trail integrity"]["failing"] == "root-signature,witnesses"
    worse = {r["reference"]: r for r in verify.coverage(verify.findings(forged, manifests), 12).collect()}
    assert worse["Ongoing monitoring"]["coverage"] == "not in this pack" and "chain-within-segment" in worse["Change control"]["failing"] and worse["Model inventory"]["coverage"] == "not addressed"
    assert {r["coverage"] for r in verify.coverage(verify.findings(sealed, manifests), 0).collect()} == {"not in this pack", "not addressed", "operator"}


def test_storage(spark, sealed, manifests, tmp_path):
    storage.project(sealed, f"file://{tmp_path}/p")
    back = storage.read_projection(spark, f"file://{tmp_path}/p").select(*sealed.columns)
    assert back.exceptAll(sealed).count() == 0 and back.count() == 12
    plan = back.where("shard = 0 and recorded_at_nanos = 1030")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan
    folder = f"file://{tmp_path}/pub"
    assert [storage.publish(sealed, folder, "s1"), storage.publish(sealed, folder, "s1"), storage.publish(sealed.limit(3), folder, "s1")] == ["committed", "already-published", "diverged"]
    assert storage.fetch(spark, folder, "s1").exceptAll(sealed).count() == 0
    with pytest.raises(FileNotFoundError):
        storage.fetch(spark, folder, "s2")
    (tmp_path / "pub" / "s3.manifest").write_text("")  # a run that died while it committed
    assert storage.publish(sealed, folder, "s3") == "committed" and storage.fetch(spark, folder, "s3").count() == sealed.count()
    assert storage.reseal_differences(sealed, manifests).count() == 0
    root = storage.evidence_pack(sealed, manifests, f"file://{tmp_path}/pack")
    records, held, header = storage.open_pack(spark, f"file://{tmp_path}/pack")
    assert header["store_root"] == root and verify.findings(records, held, root).where("level = 'broken'").count() == 0
    tiers = {(r["shard"], r["segment_id"]): r["tier"] for r in storage.hot_segments(manifests, 1).collect()}
    assert tiers == {(0, 1): "cold", (0, 2): "hot", (1, 1): "hot"}


def test_federation(spark, twelve):
    full = Proof()
    reg = federation.Registry.of(["b", "a", "a"], attested=True)
    assert reg.members == ("a", "b") and "registry/v1|1|2|1:a|1:b" == reg.signing_text
    both = federation.compose(reg, {"a": (twelve, full), "b": (twelve, full)})
    assert both.proof.is_full and both.rows.count() == 24

    def fails():
        raise OSError("down")

    part = federation.fan_out(reg, {"a": lambda: (twelve, full), "b": fails})
    assert part.silent == ["b"] and not part.proof.is_full and part.rows.count() == 12


def test_replication(sealed):
    run = sealed.where("shard = 0 and segment_id = 1").withColumn("arrival", F.col("seq"))
    head = chain.genesis(0)
    why = lambda r, **k: [tuple(x) for x in federation.first_refusal(r, 0, **k).collect()]
    assert why(run) == [] and why(run, head=head) == []
    assert why(run, head="x") == [(1, "not-a-continuation")] and why(run.limit(0)) == [(None, "empty")]
    assert why(run.where("seq != 2")) == [(3, "not-contiguous")]
    assert why(run.withColumn("shard", F.lit(1))) == [(1, "shard-changed")]
    assert why(run.withColumn("run_id", F.when(F.col("seq") == 2, "x").otherwise(F.col("run_id")))) == [(3, "link-broken")]


def test_erasure(spark, tmp_path):
    payloads = spark.createDataFrame([(format(i, "032x"), "prompt", bytearray(f"text {i}".encode())) for i in range(3)], "record_id string, payload_class string, content binary")
    provider = erasure.KeyProvider(spark, f"file://{tmp_path}/keys")
    plan = erasure.seal(payloads, provider)
    sealed = plan.persist()
    assert {r["status"] for r in erasure.open_(sealed, provider.table()).collect()} == {"opened"}
    assert {bytes(r["content"]) for r in erasure.open_(sealed, provider.table()).collect()} == {b"text 0", b"text 1", b"text 2"}
    other = erasure.KeyProvider(spark, f"file://{tmp_path}/other")
    assert {r["status"] for r in erasure.open_(sealed, other.issue(sealed)).collect()} == {"wrong-key"}
    assert {r["status"] for r in erasure.open_(sealed, provider.table().limit(0)).collect()} == {"missing"}
    keys = [bytes(r["key"]) for r in provider.table().collect()]
    assert len(set(keys)) == 3 and not any(k.hex() in plan._jdf.queryExecution().toString() for k in keys)
    ledger = erasure.attribute(None, sealed.where("record_id != '" + format(2, "032x") + "'").select(F.lit("ann").alias("subject"), "key_id"))
    held = erasure.forget("ann", ledger, provider, 10, scheduled_for=20)
    assert held.verdict == "held" and held.ledger.count() == 2 and provider.table().where("key is null").count() == 0
    assert {(r["outcome"], r["completes_at"], r["reversible"]) for r in held.manifest.collect()} == {("scheduled", 20, True)}
    done = erasure.forget("ann", held.ledger, provider, 20, scheduled_for=20)
    assert done.verdict == "allowed" and [(r["outcome"], r["reversible"]) for r in done.manifest.collect()] == [("now", False)] * 2 and done.ledger.count() == 0
    assert sorted(r["status"] for r in erasure.open_(sealed, provider.table()).collect()) == ["erased", "erased", "opened"]
    # issuing keys again does not bring destroyed ones back, and no file holds them any more
    assert sorted(r["status"] for r in erasure.open_(sealed, provider.issue(sealed)).collect()) == ["erased", "erased", "opened"]
    assert len(os.listdir(tmp_path / "keys")) == 1
    assert {r["outcome"] for r in erasure.forget("ann", ledger, provider, 30).manifest.collect()} == {"already"}
    assert erasure.forget("bob", ledger, provider, 10).verdict == "not_applicable"
    got = spark.range(1).select(erasure.most_restrictive(F.array(F.lit("document"), F.lit("prompt"), F.lit("diagnostic"))).alias("c")).first()["c"]
    assert got == "prompt"


def test_instants():
    assert instants.query_instant("17") == 17 and instants.query_instant("1970-01-01T00:00:01Z") == 10**9
    for bad in ("2026-03-01", "yesterday", "-1", "2026-13-01T00:00:00Z", str(1 << 64), "2026-01-01T00:00:00+01:00"):
        with pytest.raises(ValueError):
            instants.query_instant(bad)
    assert instants.rfc3339("2026-01-01T01:00:00.123456789+01:00") == instants.query_instant("2026-01-01T00:00:00Z") + 123_456_789
    assert instants.rfc3339("2026-01-01T00:00:00") is None and instants.rfc3339("1969-12-31T23:59:59Z") is None and instants.rfc3339(None) is None


@pytest.mark.parametrize("line,why", [
    ('{"a":1,"a":2}', "duplicate-name"), ('"\\ud800"', "lone-surrogate"), ("[" * 40 + "]" * 40, "too-deep"), ("{" + ",".join(f'"k{i}":1' for i in range(300)) + "}", "too-many-members"),
    ("1" * 2000, "number-too-long"), ("NaN", "not-json"), ('{"a":}', "not-json"), ("", "empty"), (b"\xff", "invalid-utf8"), ('"a\tb"', "not-json"),
])
def test_strict_json(line, why):
    with pytest.raises(strict_json.Rejected, match=why):
        strict_json.read(line)


def test_framer():
    data = strict_json.BOM + b'{"a":1}\r\n' + b"x" * 50 + b"\n" + b"tail"
    for step in range(1, 20):
        f = strict_json.Framer(most=20)
        got = [x for i in range(0, len(data), step) for x in f.push(data[i : i + step])]
        assert got == [b'{"a":1}'] and f.oversize == 1 and f.finish() == b"tail", step


def event(**changes):
    base = {"schema": "agent-event/v0.1", "ts": "2026-01-01T00:00:00Z", "type": "policy_deny", "agent_id": "agent://acme.example/a", "run_id": "run-1", "data": {"x": 1}}
    return json.dumps({k: v for k, v in (base | changes).items() if v is not None})


def test_agent_events(spark):
    good = agent_event.map_line(event(severity="low", on_behalf_of=["user://acme.example/bob"]))
    assert (good["event_type"], good["verdict"], good["error"], good["severity"], good["on_behalf_of"]) == ("policy_decision", "denied", "policy_denied", "notice", ["user://acme.example/bob"])
    assert agent_event.map_line(event(on_behalf_of=["user://acme.example/bob", "Bob Smith"]))["on_behalf_of"] == []
    refused = {"unknown-schema": {"schema": "x"}, "no-agent": {"agent_id": "Bob"}, "foreign-trust-domain": {"agent_id": "agent://other/a"}, "unknown-type": {"type": "x"}, "no-run-id": {"run_id": "a b"}, "bad-time": {"ts": "now"}}
    for why, change in refused.items():
        assert agent_event.map_line(event(**change))["reject_reason"] == why
    assert len(agent_event.REGISTRY) == 22
    assert all(agent_event.map_line(event(type=t))["severity"] == s for t, (_, _, _, s) in agent_event.REGISTRY.items())
    lines = spark.createDataFrame([(event(),), ("not json",), (event(type="x"),)], "value string")
    assert {r["reject_reason"]: r["count"] for r in agent_event.rejections(agent_event.map_lines(lines)).collect()} == {"not-json": 1, "unknown-type": 1}


def _field(n, data):
    def varint(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    if isinstance(data, int):
        return varint(n << 3) + varint(data)
    return varint(n << 3 | 2) + varint(len(data)) + data


def test_telemetry(spark):
    def attr(k, v):
        return {"key": k, "value": v}

    span = {"traceId": "0a" * 16, "spanId": "01" * 8, "parentSpanId": "02" * 8, "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000", "status": {"code": 2}, "attributes": [
        attr("gen_ai.operation.name", {"stringValue": "invoke_agent"}), attr("gen_ai.agent.name", {"stringValue": "helper"}), attr("gen_ai.request.model", {"stringValue": "m-1"}), attr("gen_ai.request.temperature", {"doubleValue": 0.7}),
        attr("gen_ai.usage.input_tokens", {"intValue": "17"}), attr("error.type", {"stringValue": "Deadline_Exceeded"}), attr("gen_ai.input.messages", {"stringValue": "hi"}), attr("other", {"boolValue": True})]}
    line = json.dumps({"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"scope": {"name": "s"}, "spans": [span, {**span, "traceId": "00" * 16}, {**span, "attributes": []}]}]}]})
    rows = telemetry.map_requests(spark.createDataFrame([(line,), ('{"resourceLogs":[]}',), ("{",)], "value string")).collect()
    assert [r["reject_reason"] for r in rows] == [None, "no-run-id", "not-gen-ai", "wrong-signal", "not-json"]
    r = rows[0]
    assert (r["agent_id"], r["run_id"], r["event_type"], r["verdict"], r["error"], r["latency_micros"], r["tokens_in"], r["temperature_milli"], r["model"]) == ("agent://acme.example/helper", "0a" * 16, "delegation", "failed", "timeout", 2000, 17, 700, "m-1")
    assert r["prompt_hash"] == hashlib.sha384(b'"hi"').hexdigest() and {p["class"] for p in r["payload"]} == {"prompt", "diagnostic"}
    text = lambda s: _field(1, s.encode())
    kv = lambda k, v: _field(1, k.encode()) + _field(2, v)
    attrs = [kv("gen_ai.operation.name", text("invoke_agent")), kv("gen_ai.agent.name", text("helper")), kv("gen_ai.request.model", text("m-1")), kv("gen_ai.request.temperature", b"\x21" + struct.pack("<d", 0.7)), kv("gen_ai.usage.input_tokens", _field(3, 17)), kv("error.type", text("Deadline_Exceeded")), kv("gen_ai.input.messages", text("hi")), kv("other", _field(2, 1))]
    raw = _field(1, bytes.fromhex("0a" * 16)) + _field(2, b"\1" * 8) + _field(4, b"\2" * 8) + b"\x39" + struct.pack("<Q", 1_000_000) + b"\x41" + struct.pack("<Q", 3_000_000) + b"".join(_field(9, a) for a in attrs) + _field(15, _field(3, 2))
    request = _field(1, _field(2, _field(1, _field(1, b"s")) + _field(2, raw)))
    (same,) = telemetry.map_requests(spark.createDataFrame([(bytearray(request),)], "value binary"), form="protobuf").collect()
    assert same == r
    assert telemetry.map_requests(spark.createDataFrame([(bytearray(request[:-3]),)], "value binary"), form="protobuf").first()["reject_reason"] == "truncated"
    assert telemetry.has_gap([{"a": None}]) and not telemetry.has_gap("") and not telemetry.has_gap([])
    assert telemetry.render({"b": [1, None, b"\x01"], "a": "x"}) == '{"a":"x","b":[1,null,0x01]}'


def test_ingest(spark):
    rows = spark.createDataFrame([(0, 5_000_000), (0, 5_000_001), (0, 4_000_000), (1, 5_000_000)], "shard int, recorded_at_nanos long")
    minted = ingest.mint(rows).collect()
    for shard in (0, 1):
        ids = [r["record_id"] for r in sorted((r for r in minted if r["shard"] == shard), key=lambda r: r["recorded_at_nanos"])]
        assert ids == sorted(set(ids)) and all(len(i) == 32 for i in ids)
    assert sorted(map(tuple, minted)) == sorted(map(tuple, ingest.mint(rows).collect()))
    spans = spark.createDataFrame([("r1", "run", "s1", "s2", 2), ("r2", "run", "s2", None, 1), ("r3", "run", "s3", "s3", 3), ("r4", "run", "s4", "zz", 4)], "record_id string, run_id string, span_id string, parent_span_id string, recorded_at_nanos long")
    got = {r["record_id"]: (r["caused_by"], r["edge_lost"]) for r in ingest.resolve_edges(spans).collect()}
    assert got == {"r1": (["r2"], False), "r2": ([], False), "r3": ([], True), "r4": ([], True)}
    assert [(r["run_id"], r["tokens_in"], r["verdict"]) for r in ingest.lost_edge_events(ingest.resolve_edges(spans)).collect()] == [("run", 2, "failed")]
    bands = spark.createDataFrame([("low",), ("odd",)], "s string").select(ingest.severity_band(F.col("s")).alias("b")).collect()
    assert [r["b"] for r in bands] == ["notice", None] and ingest.registry(spark).count() == 22
    assert spark.createDataFrame([(bytearray(b"\x0a\xff"),), (bytearray(2),)], "t binary").select(ingest.run_id(F.col("t")).alias("r")).collect()[0]["r"] == "0aff"


def test_streaming(spark, tmp_path):
    source, table, done, rejects = (f"{tmp_path}/{x}" for x in ("in", "table", "done", "rejects"))
    os.makedirs(source)

    def send(name, lines):
        with open(f"{source}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")

    def run(now):
        pipeline.run(pipeline.read_lines(spark, f"file://{source}"), f"file://{table}", f"file://{done}", clock=lambda: now, rejects=f"file://{rejects}").awaitTermination()
        return spark.read.parquet(f"file://{table}")

    send("a.txt", [event(run_id="run-1"), event(run_id="run-2"), event(run_id="run-1"), "broken"])
    assert run(10**18).count() == 2  # the repeated line has one id
    send("b.txt", [event(run_id="run-2"), event(run_id="run-3")])
    found = run(2 * 10**18)
    assert found.count() == 3 and {r["segment_id"] for r in found.select("segment_id").collect()} == {1, 2}
    assert chain.verify_chain(found).count() == 0 and run(3 * 10**18).count() == 3
    assert spark.read.parquet(f"file://{rejects}").agg(F.sum("count")).first()[0] == 1


def test_catalog(spark, sf_dir):
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 80
    assert catalog.flagship(spark, sf_dir).columns
    r = catalog.queries()["r16_approximate"](spark, sf_dir).collect()
    assert all(abs(x["about"] - x["exact"]) <= 0.1 * x["exact"] + 1 for x in r)


def test_entry_without_training_data(tmp_path):
    """The rest works where the optional subpackage is gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/evidenta", tmp_path / "evidenta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})


