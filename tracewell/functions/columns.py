"""Row-local column expressions, all of them evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT_LIMIT = 4000
SUMMARY_LIMIT = 200

# Prefixes of a denied call's result, where a classifier's advice begins, and its text without a reason.
USER_DENIAL = "The user doesn't want to proceed with this tool use"
CLASSIFIER_DENIAL = "Permission for this action was denied by the Claude Code auto mode classifier"
ADVICE = "If you have other tasks that don't depend on this action"
NO_REASON = "No reason provided"


def strip(c: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def one_line(c: Column, limit: int = SUMMARY_LIMIT) -> Column:
    return F.substring(strip(F.regexp_replace(c, r"(?U)\s+", " ")), 1, limit)


def tool_kind(name: Column) -> Column:
    return F.when(F.coalesce(name.startswith("mcp__"), F.lit(False)), "mcp").otherwise("builtin")


def mcp_server(name: Column) -> Column:
    parts = F.split(name, "__")
    return F.when(name.startswith("mcp__") & (F.size(parts) > 2), F.nullif(F.get(parts, F.lit(1)), F.lit("")))


def outcome(has_result: Column, text: Column, is_error: Column, denials: tuple[str, ...] = (USER_DENIAL, CLASSIFIER_DENIAL)) -> Column:
    """pending, denied, error or ok, in that order of precedence."""
    head = lstrip(F.coalesce(text, F.lit("")))
    denied = F.lit(False)
    for prefix in denials:
        denied = denied | head.startswith(prefix)
    return F.when(~has_result, "pending").when(denied, "denied").when(is_error, "error").otherwise("ok")


def denied_by(outcome_: Column, text: Column) -> Column:
    head = lstrip(F.coalesce(text, F.lit("")))
    return F.when(outcome_ == "denied", F.when(head.startswith(USER_DENIAL), "user").when(head.startswith(CLASSIFIER_DENIAL), "classifier"))


def denial_reason(outcome_: Column, text: Column) -> Column:
    """What a classifier gave as its reason; null for none."""
    after = F.regexp_extract(lstrip(F.coalesce(text, F.lit(""))), r"(?s)Reason: (.*)$", 1)
    before = F.split_part(after, F.lit(ADVICE), F.lit(1))
    bare = strip(F.regexp_replace(strip(before), r"\.+$", ""))
    return F.when(denied_by(outcome_, text) == "classifier", F.nullif(F.nullif(bare, F.lit("")), F.lit(NO_REASON)))


def truncated(c: Column, limit: int = RESULT_LIMIT) -> tuple[Column, Column]:
    return F.substring(c, 1, limit), F.coalesce(F.length(c) > limit, F.lit(False))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, cut toward zero."""
    return ((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")


def in_window(ts: Column, since=None, until=None) -> Column:
    """Inclusive bounds; a null time is out as soon as there is a bound."""
    ok = F.lit(True)
    if since is not None:
        ok = ok & F.coalesce(ts >= F.lit(since), F.lit(False))
    if until is not None:
        ok = ok & F.coalesce(ts <= F.lit(until), F.lit(False))
    return ok


def round_binary(c: Column, digits: int) -> Column:
    """Round the double's exact value, ties to even (2.675 to 2.67, 0.125 to 0.12)."""
    return F.regexp_replace(F.format_number(c, digits), ",", "").cast("double")


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def excerpt(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and an ellipsis if more follow; 0 keeps all."""
    return text if limit == 0 else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def visible(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n|\n", "↵"), "\r", "↵")


def normalise_result(text: Column, limit: int = 2000) -> Column:
    """Without the working-directory notices a shell appends, without trailing white space, cut."""
    quiet = F.regexp_replace(text, r"(?m)\nShell cwd was reset to .*?$", "")
    return F.substring(F.regexp_replace(quiet, r"(?U)\s+$", ""), 1, limit)


#: Volatile parts of commands and their marks, in the order in which they are replaced.
VOLATILE = (
    ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    ("[0-9a-fA-F]*[a-fA-F][0-9a-fA-F]{6,}|[0-9a-fA-F]{6,}[a-fA-F][0-9a-fA-F]*", "<HEX>"),
    (r"\b\d{4,}\b", "<N>"),
    (r"/tmp/\S+", "/tmp/<...>"),
    (r"\d{4}-\d{2}-\d{2}", "<DATE>"),
    (r"\d{2}:\d{2}(:\d{2})?", "<TIME>"),
)


def normalise_command(line: Column) -> Column:
    out = F.coalesce(line, F.lit(""))
    for pattern, mark in VOLATILE:
        out = F.regexp_replace(out, pattern, mark)
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def memory_key(path: Column) -> Column:
    """``<project>/<file>`` of a Markdown file in a project's memory folder, else null."""
    parts = r"(?:^|/)\.claude/projects/([^/]+)/memory/([^/]+\.md)$"
    slashes = F.translate(path, "\\", "/")
    return F.when(slashes.rlike(parts), F.concat_ws("/", F.regexp_extract(slashes, parts, 1), F.regexp_extract(slashes, parts, 2)))


def model_name(model: Column) -> Column:
    return F.when(model.isNull() | model.startswith("<"), "unknown").otherwise(model)
