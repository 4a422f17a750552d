"""Agent-event lines to records: one strict JSON object a line, mapped by a registry of types."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from evidenta.schema import is_token
from evidenta.sources.instants import rfc3339
from evidenta.sources.strict_json import Rejected, read

#: Schema names: the two published versions under any publisher's host.
SCHEMAS = r"(?:[a-z0-9.-]+/)?agent-event/v0\.[12]"
MAPPER_VERSION = 1
# Event type, verdict, error and severity of each published type.
REGISTRY = {
    "budget_exhausted": ("budget_check", "denied", "budget_exceeded", "critical"),
    "unit_cap_exceeded": ("budget_check", "denied", "budget_exceeded", "error"),
    "budget_threshold": ("budget_check", None, None, "warning"),
    "spend_spike": ("budget_check", None, None, "warning"),
    "policy_allow": ("policy_decision", "allowed", None, "info"),
    "policy_deny": ("policy_decision", "denied", "policy_denied", "error"),
    "breaker_tripped": ("policy_decision", "denied", "policy_denied", "warning"),
    "dlp_block": ("policy_decision", "denied", "policy_denied", "error"),
    "taint_block": ("policy_decision", "denied", "policy_denied", "error"),
    "identity_mismatch": ("policy_decision", "denied", "unauthorized", "error"),
    "approval_requested": ("policy_decision", "held", None, "warning"),
    "approval_granted": ("policy_decision", "allowed", None, "info"),
    "approval_denied": ("policy_decision", "denied", "policy_denied", "error"),
    "approval_timeout": ("policy_decision", "failed", "timeout", "error"),
    "approval_unanswered": ("policy_decision", "failed", "timeout", "error"),
    "tool_call": ("tool_call", None, None, "info"),
    "run_killed": ("run_completed", "failed", "policy_denied", "error"),
    "memory_written": ("memory_access", None, None, "info"),
    "memory_forgotten": ("memory_access", None, None, "info"),
    "reflection_run": ("memory_access", None, None, "info"),
    "contradiction_found": ("memory_access", None, None, "info"),
    "alert_sent": ("notification_dispatched", None, None, "info"),
}
SEVERITY_BANDS = {"info": "info", "low": "notice", "medium": "warning", "high": "error", "critical": "critical"}
CONSUMED = ("schema", "ts", "type", "severity", "agent_id", "run_id", "on_behalf_of")
MAPPED = (
    "tenant string, agent_id string, run_id string, on_behalf_of array<string>, occurred_at_nanos long, event_type string, severity string,"
    " verdict string, error string, payload string, mapper_version long, reject_reason string"
)
COLUMNS = [c.strip().split(" ")[0] for c in MAPPED.split(",")]


def map_line(line: bytes | str, tenant: str = "acme", trust_domain: str = "acme.example", schemas: str = SCHEMAS) -> dict:
    """A mapped row; ``reject_reason`` names the first check that fails, and then nothing else is set.

    Order: line, schema, agent, trust domain, type, run id, time. A principal chain is kept whole or not at all.
    """
    def refuse(why: str) -> dict:
        return dict.fromkeys(COLUMNS) | {"on_behalf_of": [], "reject_reason": why}

    try:
        event = read(line)
    except Rejected as e:
        return refuse(str(e).split(":")[0])
    if not isinstance(event, dict):
        return refuse("not-an-object")
    text = lambda k: event.get(k) if isinstance(event.get(k), str) else None
    if not re.fullmatch(schemas, text("schema") or ""):
        return refuse("unknown-schema")
    if not is_token("agent_id", text("agent_id"), strict=True):
        return refuse("no-agent")
    if not text("agent_id").startswith(f"agent://{trust_domain}/"):
        return refuse("foreign-trust-domain")
    if text("type") not in REGISTRY:
        return refuse("unknown-type")
    if not is_token("run_id", text("run_id")):
        return refuse("no-run-id")
    at = rfc3339(text("ts"))
    if at is None:
        return refuse("bad-time")
    event_type, verdict, error, severity = REGISTRY[text("type")]
    chain = event.get("on_behalf_of")
    chain = chain if isinstance(chain, list) else []
    kept = all(isinstance(p, str) and is_token("principal", p, strict=True) for p in chain)
    rest = {k: v for k, v in event.items() if k not in CONSUMED or (k == "on_behalf_of" and not kept)}
    return {
        "tenant": tenant, "agent_id": text("agent_id"), "run_id": text("run_id"), "on_behalf_of": chain if kept else [], "occurred_at_nanos": at,
        "event_type": event_type, "severity": SEVERITY_BANDS.get(text("severity"), severity), "verdict": verdict, "error": error,
        "payload": json.dumps(rest, sort_keys=True, ensure_ascii=False) if rest else None, "mapper_version": MAPPER_VERSION, "reject_reason": None,
    }


def map_lines(lines: DataFrame, column: str = "value", **config) -> DataFrame:
    """Mapped and refused rows of a text frame, batch or streaming."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame([map_line(x or "", **config) for x in batch[column]], columns=COLUMNS, dtype=object)
            frame[["occurred_at_nanos", "mapper_version"]] = frame[["occurred_at_nanos", "mapper_version"]].astype("Int64")
            yield frame

    return lines.select(column).mapInPandas(mapped, MAPPED)


def rejections(mapped: DataFrame) -> DataFrame:
    return mapped.where("reject_reason is not null").groupBy("reject_reason").count()
