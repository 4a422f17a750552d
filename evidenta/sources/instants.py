"""Instants: nanoseconds since the epoch, exactly."""

from __future__ import annotations

import re
from datetime import datetime, timezone

MOST = (1 << 64) - 1
_UTC = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)Z")
_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)", re.ASCII)


def _seconds(parts) -> int | None:
    try:
        moment = datetime(*map(int, parts), tzinfo=timezone.utc)
    except ValueError:
        return None
    return int(moment.timestamp())


def query_instant(text: str) -> int:
    """``nanoseconds`` or ``YYYY-MM-DDTHH:MM:SSZ``; anything else is refused."""
    if re.fullmatch(r"[0-9]{1,20}", text) and int(text) <= MOST:
        return int(text)
    found = _UTC.fullmatch(text)
    seconds = _seconds(found.groups()) if found else None
    if seconds is None or seconds < 0:
        raise ValueError(f"not an instant: {text!r}; give nanoseconds since the epoch or YYYY-MM-DDTHH:MM:SSZ")
    return seconds * 10**9


def rfc3339(text: str | None) -> int | None:
    """Nanoseconds of an RFC 3339 time with offset and fraction; None if it is none, or before the epoch."""
    found = _RFC3339.fullmatch(text) if text else None
    if not found:
        return None
    *parts, fraction, zone = found.groups()
    seconds = _seconds(parts)
    if seconds is None:
        return None
    if zone not in "Zz":
        hours, minutes = int(zone[1:3]), int(zone[4:6])
        if hours > 23 or minutes > 59:
            return None
        seconds -= (1 if zone[0] == "+" else -1) * (hours * 3600 + minutes * 60)
    nanos = seconds * 10**9 + int((fraction or "0")[:9].ljust(9, "0"))
    return nanos if 0 <= nanos < 1 << 63 else None
