"""Tolerant reading of JSON records, one line at a time.

A missing or wrongly typed field is null, never an error. These functions run in
Arrow batches during ingest, because validity (NaN, duplicate keys) and the exact
spelling of re-rendered JSON follow Python's rules.
"""

from __future__ import annotations

import functools
import json
import math
import re
from datetime import datetime, timezone

#: The input field that names what a call is about.
SUMMARY_FIELD = {
    "Bash": "command",
    "PowerShell": "command",
    "Read": "file_path",
    "Write": "file_path",
    "Edit": "file_path",
    "NotebookEdit": "file_path",
    "Glob": "pattern",
    "Grep": "pattern",
    "Skill": "skill",
    "Agent": "description",
    "Task": "description",
    "WebFetch": "url",
    "WebSearch": "query",
}
_FINE = re.compile(r"\.(\d{6})\d+")


def load(raw: str) -> dict | None:
    """The object of a line; None for anything else."""
    try:
        got = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def text(value) -> str | None:
    return value if isinstance(value, str) else None


def some(value) -> str | None:
    """A non-empty string."""
    return value if isinstance(value, str) and value else None


def table(value) -> dict:
    return value if isinstance(value, dict) else {}


def objects(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def flag(value) -> bool:
    return value.strip().lower() in ("true", "1", "yes") if isinstance(value, str) else bool(value)


def number(value) -> int:
    try:
        return int(float(value)) if isinstance(value, str) else int(value) if isinstance(value, (int, float)) else 0
    except (ValueError, OverflowError):
        return 0


def real(value) -> float | None:
    """A finite number that is not a boolean."""
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    return value if ok else None


def moment(value) -> datetime | None:
    """ISO-8601 to UTC without a zone."""
    if not some(value):
        return None
    spelled = _FINE.sub(r".\1", value.strip())
    if spelled[-1:] in ("Z", "z"):
        spelled = spelled[:-1] + "+00:00"
    try:
        at = datetime.fromisoformat(spelled)
    except ValueError:
        return None
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def epoch_ms(value) -> datetime | None:
    n = real(value)
    try:
        return None if n is None else datetime.fromtimestamp(n / 1000, timezone.utc).replace(tzinfo=None)
    except (OverflowError, OSError, ValueError):
        return None


@functools.cache
def _encoder(compact: bool, ordered: bool) -> json.JSONEncoder:
    return json.JSONEncoder(ensure_ascii=False, sort_keys=ordered, separators=(",", ":") if compact else None, default=str)


def dumps(value, compact: bool = False, ordered: bool = False) -> str:
    return _encoder(compact, ordered).encode(value)


def joined(content) -> str:
    """The text of a message: a string, or its text blocks line by line."""
    if isinstance(content, str):
        return content
    if not isinstance(content, list):
        return ""
    pieces = [b if isinstance(b, str) else text(table(b).get("text")) for b in content]
    return "\n".join(p for p in pieces if p is not None)


def flat_result(content) -> str:
    """The text of a tool result; other blocks leave a ``[type]`` mark."""
    if content is None or isinstance(content, str):
        return content or ""
    if isinstance(content, dict):
        own = text(content.get("text"))
        return dumps(content, ordered=True) if own is None else own
    if not isinstance(content, list):
        return str(content)

    def piece(item) -> str:
        if isinstance(item, dict):
            own = text(item.get("text"))
            return f"[{some(item.get('type')) or 'block'}]" if own is None else own
        return item if isinstance(item, str) else str(item)

    return "\n".join(map(piece, content))


def summary(tool: str | None, value, limit: int = 200) -> str | None:
    """One line on what a call asks for; None without an input."""
    if value is None:
        return None
    named = text(table(value).get(SUMMARY_FIELD.get(tool or "", ""))) if tool in SUMMARY_FIELD else None
    line = named if named and named.strip() else dumps(value, compact=True, ordered=True)
    return " ".join(line.split())[:limit] if line.isascii() else re.sub(r"\s+", " ", line).strip()[:limit]
