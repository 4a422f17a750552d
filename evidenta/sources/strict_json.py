"""Strict JSON lines: framing at any chunk boundary, and a reader that refuses by name what parsers differ on."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

MOST_LINE, MOST_DEPTH, MOST_MEMBERS, MOST_NUMBER = 16 << 20, 32, 256, 1024
BOM = b"\xef\xbb\xbf"


class Rejected(ValueError):
    """A line that is not read, with the name of why."""


class Framer:
    """Lines out of chunks. A byte-order mark is dropped once; an oversize line is discarded and counted."""

    def __init__(self, most: int = MOST_LINE):
        self.most, self.held, self.skipping, self.started, self.oversize = most, b"", False, False, 0

    def push(self, chunk: bytes) -> Iterator[bytes]:
        self.held += chunk
        if not self.started:
            if len(self.held) < 3 and BOM.startswith(self.held):
                return
            self.started, self.held = True, self.held.removeprefix(BOM)
        *lines, self.held = self.held.split(b"\n")
        for line in lines:
            if self.skipping:
                self.skipping = False
            elif len(line) > self.most:
                self.oversize += 1
            else:
                yield line.removesuffix(b"\r")
        if len(self.held) > self.most:
            self.oversize += not self.skipping
            self.skipping, self.held = True, b""

    def finish(self) -> bytes | None:
        """What is left without a line break, held back by a follower and read at the end of a replay."""
        left, self.held = self.held.removesuffix(b"\r"), b""
        return left if left and not self.skipping else None


def _number(text: str):
    if len(text) > MOST_NUMBER:
        raise Rejected("number-too-long")
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text)


def _refuse(name: str):
    raise Rejected(f"not-json: {name}")


def _members(pairs: list) -> dict:
    if len(pairs) > MOST_MEMBERS:
        raise Rejected("too-many-members")
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Rejected("duplicate-name")
    return out


def _walk(value, depth: int = 1) -> None:
    if isinstance(value, str):
        if any("\ud800" <= c <= "\udfff" for c in value):
            raise Rejected("lone-surrogate")
        return
    if isinstance(value, (list, dict)):
        if depth > MOST_DEPTH:
            raise Rejected("too-deep")
        for x in value if isinstance(value, list) else (y for pair in value.items() for y in pair):
            _walk(x, depth + 1)


def read(line: bytes | str):
    """The value of one line."""
    if isinstance(line, bytes):
        if len(line) > MOST_LINE:
            raise Rejected("oversize")
        try:
            line = line.decode("utf-8")
        except UnicodeDecodeError as e:
            raise Rejected("invalid-utf8") from e
    if not line.strip(" \t\r\n"):
        raise Rejected("empty")
    try:
        value = json.loads(line, object_pairs_hook=_members, parse_int=_number, parse_float=_number, parse_constant=_refuse)
    except Rejected:
        raise
    except RecursionError as e:
        raise Rejected("too-deep") from e
    except ValueError as e:
        raise Rejected("not-json") from e
    _walk(value)
    return value
