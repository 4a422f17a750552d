"""The decision-record schema: columns, enumerations, token rules and schema checks."""

from __future__ import annotations

import json
import re

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

# Names and wire codes of the record model.
EVENT_TYPES = {
    "request_received": 1, "model_call": 2, "tool_call": 3, "policy_decision": 4, "budget_check": 5, "memory_access": 6,
    "delegation": 7, "run_completed": 8, "erasure": 9, "store_event": 10, "notification_dispatched": 11,
}
SEVERITIES = ["debug", "info", "notice", "warning", "error", "critical"]
VERDICTS = ["allowed", "denied", "held", "failed", "not_applicable"]
ERRORS = ["none", "timeout", "rate_limited", "unauthorized", "budget_exceeded", "policy_denied", "upstream_error", "malformed", "internal"]
PAYLOAD_CLASSES = ["prompt", "completion", "tool_arguments", "tool_result", "document", "diagnostic"]
DIMENSIONS = ["record_id", "recorded_at_nanos", "agent_id", "run_id", "event_type"]
UNERASABLE = ["record_id", "shard", "segment_id", "seq", "prev_hash", "recorded_at_nanos", "hash_alg", "sig_alg", "kem_alg"]

#: Token kinds: most bytes and allowed characters.
TOKENS = {
    "agent_id": (255, "a-z0-9._/:-"), "principal": (255, "a-z0-9._/:-"), "run_id": (64, "a-z0-9._-"), "policy_version": (64, "a-z0-9._-"),
    "model": (128, "a-z0-9._/-"), "tool": (64, "a-z0-9._-"), "tenant": (64, "a-z0-9._-"),
}


def token_pattern(kind: str, strict: bool = False) -> str:
    """A full-match pattern of a token kind; ``strict`` asks for the URI form of agents and principals."""
    most, chars = TOKENS[kind]
    if strict and kind == "agent_id":
        return rf"^(?=.{{1,{most}}}$)agent://[a-z0-9._-]+/[{chars}]+$"
    if strict and kind == "principal":
        return rf"^(?=.{{1,{most}}}$)(agent|user)://[{chars}]+$"
    return f"^[{chars}]{{1,{most}}}$"


def is_token(kind: str, value: str | None, strict: bool = False) -> bool:
    return value is not None and re.fullmatch(token_pattern(kind, strict)[1:-1], value) is not None


_S, _L, _I, _A = StringType(), LongType(), IntegerType(), ArrayType(StringType(), False)
# name, type, required, plane kind, provable
_COLUMNS = [
    ("record_id", _S, True, "hash"), ("tenant", _S, True, "token"), ("shard", _I, True, "u16"), ("segment_id", _L, True, "u64"), ("seq", _L, True, "u64"),
    ("chain_link", _S, True, "hash"), ("prev_hash", _S, True, "hash"), ("agent_id", _S, True, "token"), ("run_id", _S, True, "token"),
    ("parent_run_id", _S, False, "token"), ("on_behalf_of", _A, True, "token"), ("occurred_at_nanos", _L, True, "timestamp"),
    ("decided_at_nanos", _L, False, "timestamp"), ("recorded_at_nanos", _L, True, "timestamp"), ("knowledge_as_of_nanos", _L, False, "timestamp"),
    ("clock_skew_nanos", _L, False, "i64"), ("event_type", _S, True, "enum"), ("severity", _S, True, "enum"), ("caused_by", _A, True, "hash"),
    ("policy_version", _S, False, "token"), ("budget_remaining_micros", _L, False, "i64"), ("memory_ref", _S, False, "hash"), ("model", _S, False, "token"),
    ("temperature_milli", _L, False, "u16"), ("max_tokens", _L, False, "u32"), ("prompt_hash", _S, False, "hash"), ("tool_manifest", _A, True, "token"),
    ("identity_chain", _A, True, "token"), ("verdict", _S, False, "enum"), ("error", _S, False, "enum"), ("latency_micros", _L, False, "u64"),
    ("tokens_in", _L, False, "u32"), ("tokens_out", _L, False, "u32"), ("cost_micros", _L, False, "i64"), ("payload_hash", _S, False, "hash"),
    ("payload_size_bytes", _L, False, "u64"), ("payload_class", _S, False, "enum"), ("payload_key_id", _S, False, "token"), ("hash_alg", _S, True, "enum"),
    ("sig_alg", _S, True, "enum"), ("kem_alg", _S, True, "enum"), ("mapper_version", _L, True, "u32"),
]
_PSEUDONYMOUS = {"agent_id", "on_behalf_of", "identity_chain", "tenant"}


def _field(name: str, kind, required: bool, plane_kind: str) -> StructField:
    note = {"plane": "metadata", "kind": plane_kind, "pii": "operator_pseudonymous" if name in _PSEUDONYMOUS else "never", "provable": name in DIMENSIONS}
    if name in _PSEUDONYMOUS:
        note["dpia"] = "identifiers are operator-assigned; a person is named by the operator's directory alone"
    if name == "occurred_at_nanos" or name == "decided_at_nanos":
        note["trust"] = "untrusted"
    return StructField(name, kind, not required, note)


RECORDS = StructType([_field(*c) for c in _COLUMNS])
REQUIRED = [name for name, _, required, _ in _COLUMNS if required]
_BOUNDED = {"bool", "u16", "u32", "u64", "i64", "timestamp", "hash", "enum", "token"}


def violations(schema: StructType) -> list[str]:
    """What breaks the rules of the two planes; empty for ``RECORDS``."""
    found = []
    for f in schema.fields:
        note = f.metadata or {}
        plane, kind, pii = note.get("plane"), note.get("kind"), note.get("pii")
        if plane == "metadata" and kind not in _BOUNDED:
            found.append(f"{f.name}: kind {kind} is not bounded")
        if plane == "metadata" and pii == "possible":
            found.append(f"{f.name}: personal data may not be in the metadata plane")
        if pii == "operator_pseudonymous" and kind != "token":
            found.append(f"{f.name}: an operator value must be a token")
        if pii == "operator_pseudonymous" and not note.get("dpia"):
            found.append(f"{f.name}: an operator value needs an assessment note")
        if note.get("provable") and plane != "metadata":
            found.append(f"{f.name}: only metadata can be provable")
    return found


def to_json(schema: StructType = RECORDS, version: int = 1) -> str:
    """A stable JSON description of the schema."""
    fields = [{"name": f.name, "type": f.dataType.simpleString(), "required": not f.nullable, **(f.metadata or {})} for f in schema.fields]
    return json.dumps({"schema": "record", "version": version, "fields": fields}, indent=1, sort_keys=True)
