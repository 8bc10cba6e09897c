"""Session transcripts, one JSON record a line, to events, tool calls and sessions.

Only the reading of a line is Python. Pairing calls with results, carrying the
permission mode forward, de-duplicating token usage and rolling sessions up are
windows, joins and aggregates by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C
from ..functions import parse as P
from ..operators.order import carried, first_known, first_of, with_depth
from .lines import as_is, parent_name, read_lines, stem

LINE = (
    "uuid string, parent_uuid string, sid string, ts timestamp, type string, role string, is_sidechain boolean, is_meta boolean, permission_mode string, effort string, "
    "request_id string, message_id string, model string, cwd string, git_branch string, version string, entrypoint string, source_call string, text string, "
    "uses array<struct<at:int,id:string,name:string,input:string,summary:string>>, results array<struct<at:int,id:string,text:string,error:boolean>>, "
    "usage struct<input:long,output:long,read:long,made:long>"
)


#: Fields of a record that are taken as they are, if they are strings.
TEXTS = {
    "parent_uuid": "parentUuid",
    "type": "type",
    "permission_mode": "permissionMode",
    "effort": "effort",
    "request_id": "requestId",
    "cwd": "cwd",
    "git_branch": "gitBranch",
    "version": "version",
    "entrypoint": "entrypoint",
    "source_call": "sourceToolAssistantUUID",
}
_SPENT = (("input", "input_tokens"), ("output", "output_tokens"), ("read", "cache_read_input_tokens"), ("made", "cache_creation_input_tokens"))


def parse_line(raw: str) -> dict | None:
    """The fields of ``LINE`` that the record has; others are missing."""
    r = P.load(raw)
    if r is None:
        return None
    m = P.table(r.get("message"))
    content, uses, results = m.get("content"), [], []
    for i, b in enumerate(P.objects(content)):
        kind = b.get("type")
        if kind == "tool_use":
            name, given = P.text(b.get("name")), b.get("input")
            uses.append({"at": i, "id": P.some(b.get("id")), "name": name, "input": None if given is None else P.dumps(given), "summary": P.summary(name, given)})
        elif kind == "tool_result" and P.some(b.get("tool_use_id")):
            results.append({"at": i, "id": b["tool_use_id"], "text": P.flat_result(b.get("content")), "error": P.flag(b.get("is_error"))})
    out = {name: r[field] for name, field in TEXTS.items() if field in r and isinstance(r[field], str)}
    u = P.table(m.get("usage"))
    if u:
        out["usage"] = {name: P.number(u[field]) if field in u else 0 for name, field in _SPENT}
    out["uuid"] = P.some(r.get("uuid"))
    out["sid"] = P.some(r.get("sessionId")) or P.some(r.get("session_id"))
    out["ts"] = P.moment(r.get("timestamp"))
    out["role"] = P.text(m.get("role"))
    out["is_sidechain"] = P.flag(r.get("isSidechain"))
    out["is_meta"] = P.flag(r.get("isMeta"))
    out["message_id"] = P.some(r.get("messageId")) or P.text(m.get("id"))
    out["model"] = P.text(m.get("model"))
    out["text"] = P.joined(content)
    out["uses"], out["results"] = uses, results
    return out


def records(lines: DataFrame) -> DataFrame:
    """Parsed lines with their event and session ids."""
    r = read_lines(lines, parse_line, LINE)
    good = r.where("ok")
    known = first_known(F.col("sid"), ["file_path"], ["seq"])
    return good.withColumns({"event_id": F.coalesce("uuid", F.concat_ws(":", "file_path", "seq")), "session_id": F.coalesce("sid", known, stem(F.col("file_path")))}).withColumn("source", F.lit("claude_code"))


def events(recs: DataFrame) -> DataFrame:
    return schema.conform(with_depth(recs.drop("uses", "results", "usage")), schema.EVENTS)


def call_id(use):
    return F.coalesce(use.id, F.concat_ws(":", F.col("event_id"), use["at"]))


def tool_calls(recs: DataFrame, limit: int = C.RESULT_LIMIT, denials: tuple[str, ...] = (C.USER_DENIAL, C.CLASSIFIER_DENIAL)) -> DataFrame:
    """Each call once in a file, with the first result of its id in that file.

    Calls and results leave a line together and meet in one window, so that lines are parsed once."""
    recs = recs.withColumn("mode", carried(F.col("permission_mode"), ["file_path"], ["seq"]))
    uses = F.transform("uses", lambda u: F.struct(call_id(u).alias("tool_use_id"), F.lit(0).alias("kind"), u["at"].alias("at"), u.alias("u"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("error")))
    results = F.transform("results", lambda r: F.struct(r.id.alias("tool_use_id"), F.lit(1).alias("kind"), r["at"].alias("at"), F.lit(None).cast("struct<at:int,id:string,name:string,input:string,summary:string>").alias("u"), r.text.alias("text"), r.error.alias("error")))
    both = recs.select("session_id", "file_path", "source", "seq", "ts", "event_id", "mode", "cwd", "is_sidechain", "source_call", F.inline(F.concat(uses, results)))
    by = W.partitionBy("file_path", "tool_use_id").orderBy("kind", "seq", "at")
    first = F.first(F.when(F.col("kind") == 1, F.struct("event_id", "ts", "text", "error")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    both = both.withColumns({"__n": F.row_number().over(by), "r": first}).where("__n = 1 and kind = 0")
    both = both.withColumns({"result_event_id": F.col("r.event_id"), "result_ts": F.col("r.ts"), "full": F.col("r.text"), "failed": F.col("r.error")})
    has, name = F.col("result_event_id").isNotNull(), F.col("u.name")
    both = both.withColumn("outcome", C.outcome(has, F.col("full"), F.coalesce("failed", F.lit(False)), denials))
    cut, long_ = C.truncated(F.col("full"), limit)
    made = both.withColumns(
        {
            "call_event_id": F.col("event_id"),
            "tool_name": name,
            "tool_kind": C.tool_kind(name),
            "mcp_server": C.mcp_server(name),
            "input": F.col("u.input"),
            "input_summary": F.col("u.summary"),
            "is_error": F.coalesce("failed", F.lit(False)),
            "result_text": cut,
            "result_truncated": long_,
            "duration_ms": C.elapsed_ms(F.col("ts"), F.col("result_ts")),
            "permission_mode": F.col("mode"),
            "denied_by": C.denied_by(F.col("outcome"), F.col("full")),
            "denial_reason": C.denial_reason(F.col("outcome"), F.col("full")),
            "parent_tool_use_id": F.col("source_call"),
        }
    )
    return schema.conform(made, schema.TOOL_CALLS)


#: Token counts of a line and the columns of their totals.
USAGE = (("input", "input_tokens"), ("output", "output_tokens"), ("read", "cache_read_tokens"), ("made", "cache_creation_tokens"))


def request():
    """What a line's usage counts for once: its request, or the line."""
    return F.coalesce(F.concat(F.lit("r"), "request_id"), F.concat(F.lit("#"), "seq"))


def usage_totals(recs: DataFrame) -> DataFrame:
    """Token totals of each file; a request's usage counts once, where it first appears."""
    used = recs.where("usage is not null").withColumn("request", request())
    once = first_of(used.select("file_path", "request", "seq", "usage"), ["file_path", "request"], ["seq"])
    return once.groupBy("file_path").agg(*[F.sum(f"usage.{a}").alias(b) for a, b in USAGE])


def sessions(recs: DataFrame) -> DataFrame:
    """One row for each file with a record.

    A line leaves itself (kind 0), its calls (1) and its request's usage (2). Grouped by key, a call
    and a request are there once; grouped by file, they add up. So lines are parsed once."""
    null = lambda kind: F.lit(None).cast(kind)
    item = lambda kind, key, usage: F.struct(F.lit(kind).alias("kind"), key.alias("key"), usage.alias("usage"))
    no_usage = null(recs.schema["usage"].dataType)
    used = F.when(F.col("usage").isNotNull(), F.array(item(2, request(), F.col("usage")))).otherwise(F.array())
    items = F.concat(F.array(item(0, null("string"), no_usage)), F.transform("uses", lambda u: item(1, call_id(u), no_usage)), used)
    about = ("sid", "cwd", "git_branch", "version", "entrypoint")
    lines = recs.select("file_path", "seq", "source", "ts", *about, F.explode(items).alias("i"))
    lines = lines.select("file_path", "seq", "source", "i.kind", "i.key", *[F.col(f"i.usage.{a}").alias(f"u_{a}") for a, _ in USAGE], *[F.when(F.col("i.kind") == 0, F.col(c)).alias(c) for c in ("ts", *about)])
    seen = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
    latest = [F.max_by(c, seen(c)).alias(c) for c in about[1:]]  # of kind 0, of which a file has one group
    once = lines.groupBy("file_path", "kind", "key").agg(
        F.count("*").alias("n"), F.first("source").alias("source"), F.min_by("sid", seen("sid")).alias("sid"), F.min("ts").alias("first"), F.max("ts").alias("last"), *latest,
        *[F.min_by(f"u_{a}", "seq").alias(f"u_{a}") for a, _ in USAGE],
    )
    own = once.groupBy("file_path").agg(
        F.first("source").alias("source"),
        F.max("sid").alias("sid"),
        F.min("first").alias("started_at"),
        F.max("last").alias("ended_at"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("n_events"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("n_tool_calls"),
        *[F.max(a).alias(b) for a, b in (("cwd", "cwd"), ("git_branch", "git_branch"), ("version", "cc_version"), ("entrypoint", "entrypoint"))],
        *[F.coalesce(F.sum(f"u_{a}"), F.lit(0)).alias(b) for a, b in USAGE],
    )
    path = F.col("file_path")
    return schema.conform(own.withColumns({"session_id": F.coalesce("sid", stem(path)), "project_dir": parent_name(path)}), schema.SESSIONS)


def ingest(lines: DataFrame, keep=as_is) -> dict[str, DataFrame]:
    """The tables of a format's lines. ``keep`` may write the parsed lines down, since each table reads them again."""
    recs = keep(records(lines))
    return {"sessions": sessions(recs), "events": events(recs), "tool_calls": tool_calls(recs)}
