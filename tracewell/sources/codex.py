"""Sessions of the ``codex`` format: completed items, messages and token records."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C
from ..functions import parse as P
from .lines import as_is, read_lines, stem

LINE = (
    "ts timestamp, sid string, call struct<id:string,tool:string,input:string,summary:string,query:string,output:string,failed:boolean,ms:long,cwd:string>, "
    "said struct<text:string,role:string>, mark struct<id:string,raw:string>, tokens struct<input:long,output:long,read:long>"
)


def folder(value) -> str | None:
    """A plain path or a file URI, decoded; other schemes are no folder."""
    if not P.some(value):
        return None
    uri = urlsplit(value)
    return unquote(uri.path) or None if uri.scheme == "file" else None if uri.scheme else value


def milliseconds(value) -> int | None:
    """Seconds, or seconds and nanoseconds, to whole milliseconds."""
    if isinstance(value, dict):
        whole = P.real(value.get("secs"))
        fine = value.get("nanos", 0)
        if isinstance(fine, float) and P.real(fine) is None:
            return None
        return None if whole is None else int(whole * 1000 + (P.real(fine) or 0) / 1_000_000)
    seconds = P.real(value)
    return None if seconds is None else int(seconds * 1000)


def spoken(message: dict) -> str | None:
    """The text parts of a message, end to end."""
    pieces = [p["text"] for p in P.objects(message.get("content")) if p.get("type") in ("output_text", "input_text") and isinstance(p.get("text"), str) and p["text"].strip()]
    return "".join(pieces) or None


def failed(item: dict, error) -> bool:
    """A status other than completed, an exit code other than 0, or an error that completion doesn't answer."""
    status, code = item.get("status"), item.get("exit_code")
    bad_code = code is not None and (isinstance(code, bool) or not isinstance(code, int) or code != 0)
    return (status is not None and status != "completed") or bad_code or (status != "completed" and bool(P.some(error)))


def _picked(item: dict, *names: str) -> dict:
    return {n: item[n] for n in names if item.get(n) is not None}


def read_item(item: dict) -> tuple[str, dict, object, object] | None:
    """Tool name, input, output and error of a completed item that is a call."""
    kind = item.get("type")
    if kind == "CommandExecution":
        command = item.get("command")
        return "Bash", {"command": command} if isinstance(command, (list, str)) else {}, item.get("stdout") or item.get("aggregated_output"), None
    if kind in ("McpToolCall", "call_mcp_tool"):
        server, tool = item.get("server") or item.get("server_name"), item.get("tool") or item.get("tool_name")
        given = item.get("arguments") or item.get("args") or item.get("input")
        name = f"mcp__{server}__{tool}" if server and tool else str(tool or "McpTool")
        return name, given if isinstance(given, dict) else {}, item.get("result") or item.get("output") or item.get("error"), item.get("error")
    if kind == "FileChange":
        changes = P.table(item.get("changes"))
        return "FileChange", {"files": list(changes), "changes": changes}, item.get("stdout"), item.get("stderr")
    if kind == "CollabAgentToolCall":
        tool = P.some(item.get("tool"))
        return f"collab__{tool}" if tool else kind, _picked(item, "sender_thread_id", "receiver_thread_ids", "receiver_agents", "agents_states"), None, None
    if kind == "SubAgentActivity":
        return "collab__subagent", _picked(item, "kind", "agent_thread_id", "agent_path"), None, None
    return None


def parse_line(raw: str) -> dict | None:
    r = P.load(raw)
    if r is None:
        return None
    p, kind = P.table(r.get("payload")), r.get("type")
    out: dict = {"ts": P.moment(r.get("timestamp"))}
    if kind == "session_meta":
        out["sid"] = P.some(p.get("id") or p.get("session_id"))
    elif kind == "event_msg":
        out["sid"] = P.some(p.get("thread_id") or p.get("session_id"))
        item = P.table(p.get("item")) if p.get("type") == "item_completed" else {}
        call = read_item(item)
        name = str(item["id"]) if item.get("id") else None
        if call:
            tool, given, output, error = call
            out["call"] = {"id": name, "tool": tool, "input": P.dumps(given), "summary": P.summary(tool, given), "query": P.text(given.get("query")), "output": str(output) if output else None, "failed": failed(item, error), "ms": milliseconds(item.get("duration")), "cwd": folder(item.get("cwd")) if item["type"] == "CommandExecution" else None}
        elif item.get("type") in ("AgentResponse", "assistant_message"):
            words = item.get("text") or item.get("content")
            if isinstance(words, str) and words.strip():
                out["said"] = {"text": words}
        elif item.get("type") == "message" and spoken(item):
            out["said"] = {"text": spoken(item)}
        elif item.get("type") == "ContextCompaction":
            out["mark"] = {"id": name, "raw": P.dumps(item)}
    elif kind == "response_item" and p.get("type") == "message" and spoken(p):
        out["said"] = {"text": spoken(p), "role": P.text(p.get("role"))}
    elif kind == "token_usage_record" and isinstance(p.get("thread_token_usage"), dict):
        t = p["thread_token_usage"]
        out["tokens"] = {"input": P.number(t.get("input_tokens")), "output": P.number(t.get("output_tokens")), "read": P.number(t.get("cached_input_tokens"))}
    return out


def records(lines: DataFrame) -> DataFrame:
    """Parsed lines; a row's session is the first id met up to it, so rows before it have none."""
    r = read_lines(lines, parse_line, LINE).where("ok")
    first = F.min_by("sid", F.when(F.col("sid").isNotNull(), F.col("seq"))).over(_so_far())
    return r.withColumns({"session_id": first, "source": F.lit("codex")})


def _so_far():
    from pyspark.sql import Window as W

    return W.partitionBy("file_path").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)


def tool_calls(recs: DataFrame, limit: int = C.RESULT_LIMIT) -> DataFrame:
    c = recs.where("call is not null")
    cut, long_ = C.truncated(F.col("call.output"), limit)
    name = F.col("call.tool")
    has = F.col("call.output").isNotNull() | F.col("call.failed")
    return schema.conform(
        c.withColumns({"tool_use_id": F.coalesce("call.id", F.col("seq").cast("string")), "tool_name": name, "tool_kind": C.tool_kind(name), "mcp_server": C.mcp_server(name), "input": F.col("call.input"), "input_summary": F.col("call.summary"), "outcome": C.outcome(has, F.col("call.output"), F.col("call.failed")), "is_error": F.col("call.failed"), "result_text": cut, "result_truncated": long_, "duration_ms": F.col("call.ms"), "cwd": F.col("call.cwd"), "is_sidechain": F.lit(False)}),
        schema.TOOL_CALLS,
    )


def events(recs: DataFrame) -> DataFrame:
    role = F.coalesce("said.role", F.lit("unknown"))
    talk = recs.where("said is not null").withColumns({"event_id": F.concat_ws(":", F.lit("codex:text"), "file_path", "seq"), "type": F.lit("text"), "role": role, "is_meta": role == "developer", "text": F.col("said.text"), "raw": F.col("said.text")})
    marks = recs.where("mark is not null").withColumns({"event_id": F.concat(F.lit("codex:"), F.coalesce("mark.id", F.col("seq").cast("string"))), "type": F.lit("context_compaction"), "role": F.lit(None).cast("string"), "is_meta": F.lit(False), "text": F.lit(""), "raw": F.col("mark.raw")})
    both = talk.unionByName(marks).withColumns({"depth": F.lit(0), "is_sidechain": F.lit(False)})
    return schema.conform(both, schema.EVENTS)


def sessions(recs: DataFrame, events_: DataFrame, calls_: DataFrame) -> DataFrame:
    """One row for each file; the last token record holds its totals."""
    first = F.min_by("session_id", F.when(F.col("session_id").isNotNull(), F.col("seq")))
    last = F.max_by("tokens", F.when(F.col("tokens").isNotNull(), F.col("seq")))
    own = recs.groupBy("file_path").agg(F.coalesce(first, F.first(stem(F.col("file_path")))).alias("session_id"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), last.alias("t"))
    n = lambda df, name: df.groupBy("file_path").agg(F.count("*").alias(name))
    both = own.join(n(events_, "n_events"), "file_path", "left").join(n(calls_, "n_tool_calls"), "file_path", "left").na.fill(0, ["n_events", "n_tool_calls"])
    tokens = {f"{k}_tokens": F.coalesce(f"t.{v}", F.lit(0)) for k, v in (("input", "input"), ("output", "output"), ("cache_read", "read"))}
    return schema.conform(both.withColumns({**tokens, "cache_creation_tokens": F.lit(0), "source": F.lit("codex")}), schema.SESSIONS)


def ingest(lines: DataFrame, keep=as_is) -> dict[str, DataFrame]:
    """The tables of a format's lines. ``keep`` may write the parsed lines down, since each table reads them again."""
    recs = keep(records(lines))
    e, c = events(recs), tool_calls(recs)
    return {"sessions": sessions(recs, e, c), "events": e, "tool_calls": c}
