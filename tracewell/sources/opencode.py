"""Event streams of the ``opencode`` format: terminal tool parts and coalesced text parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C
from ..functions import parse as P
from ..operators.order import first_of
from .lines import as_is, read_lines

LINE = (
    "sid string, call struct<id:string,ts:timestamp,tool:string,input:string,summary:string,query:string,output:string,error:string,failed:boolean,ms:long>, "
    "piece struct<id:string,delta:string,snapshot:string>"
)


def parse_line(raw: str) -> dict | None:
    r = P.load(raw)
    if r is None:
        return None
    p = P.table(r.get("properties"))
    part = P.table(p.get("part"))
    sid = P.some(p.get("sessionID")) or P.text(part.get("sessionID"))
    if r.get("type") == "message.part.delta":
        return {"sid": P.text(p.get("sessionID")), "piece": {"id": P.text(p.get("partID")), "delta": P.some(p.get("delta"))}} if p.get("field") == "text" else {}
    if r.get("type") != "message.part.updated":
        return {}
    if part.get("type") == "text":
        return {"sid": sid, "piece": {"id": P.text(part.get("id")), "snapshot": P.some(part.get("text"))}}
    state = P.table(part.get("state"))
    if part.get("type") != "tool" or state.get("status") not in ("completed", "error"):
        return {}
    clock, tool = P.table(state.get("time")), P.text(part.get("tool"))
    given, output = state.get("input"), state.get("output")
    given = given if isinstance(given, dict) else None
    start, end = P.real(clock.get("start")), P.real(clock.get("end"))
    call = {
        "id": P.some(part.get("callID")) or P.some(part.get("id")),
        "ts": P.epoch_ms(clock.get("start")) or P.epoch_ms(p.get("time")),
        "tool": tool,
        "input": None if given is None else P.dumps(given),
        "summary": P.summary(tool, given),
        "query": P.text(P.table(given).get("query")),
        "output": output if output is None or isinstance(output, str) else P.dumps(output),
        "error": P.text(state.get("error")),
        "failed": state["status"] == "error",
        "ms": None if start is None or end is None else int(end - start),
    }
    return {"sid": sid, "call": call}


def texts(recs: DataFrame) -> DataFrame:
    """One row for each text part: its last snapshot, or else its deltas in order; at its first line."""
    part = F.coalesce(F.concat(F.lit("p"), "piece.id"), F.concat(F.lit("#"), "seq"))
    pieces = recs.where("piece is not null").select("file_path", F.col("sid").alias("session_id"), part.alias("part"), "seq", "piece.*")
    snapshot = F.max_by("snapshot", F.when(F.col("snapshot").isNotNull(), F.col("seq")))
    deltas = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("seq", "delta")))), lambda x: x["delta"]), "")
    whole = pieces.groupBy("file_path", "session_id", "part").agg(F.coalesce(snapshot, deltas).alias("text"), F.min("seq").alias("seq"))
    return whole.where("text <> ''").select("file_path", "session_id", "seq", "text")


def calls(recs: DataFrame) -> DataFrame:
    """Terminal tool parts, the last state of each (session, call)."""
    got = recs.where("call is not null").select("file_path", F.col("sid").alias("session_id"), "seq", F.coalesce("call.id", F.concat_ws(":", "file_path", "seq")).alias("tool_use_id"), "call")
    return first_of(got, ["file_path", "session_id", "tool_use_id"], [F.desc("seq")])


def tool_calls(recs: DataFrame, limit: int = C.RESULT_LIMIT) -> DataFrame:
    c = calls(recs)
    full = F.coalesce("call.output", "call.error")
    cut, long_ = C.truncated(full, limit)
    name = F.col("call.tool")
    told = F.coalesce(F.nullif(F.col("call.output"), F.lit("")), F.col("call.error"), F.lit(""))
    return schema.conform(
        c.withColumns({"source": F.lit("opencode"), "ts": F.col("call.ts"), "tool_name": name, "tool_kind": C.tool_kind(name), "mcp_server": C.mcp_server(name), "input": F.col("call.input"), "input_summary": F.col("call.summary"), "outcome": C.outcome(F.lit(True), told, F.col("call.failed")), "is_error": F.col("call.failed"), "result_text": cut, "result_truncated": long_, "duration_ms": F.col("call.ms")}),
        schema.TOOL_CALLS,
    )


def events(recs: DataFrame) -> DataFrame:
    t = texts(recs)
    return schema.conform(t.withColumns({"event_id": F.concat_ws(":", F.lit("opencode:text"), "file_path", "seq"), "source": F.lit("opencode"), "type": F.lit("text"), "raw": F.col("text")}), schema.EVENTS)


def sessions(events_: DataFrame, calls_: DataFrame) -> DataFrame:
    """One row for each session id a file carries; none for rows without one."""
    rows = calls_.select("file_path", "session_id", "ts", F.lit(1).alias("c"), F.lit(0).alias("e")).union(events_.select("file_path", "session_id", F.lit(None).cast("timestamp"), F.lit(0), F.lit(1)))
    own = rows.where("session_id is not null").groupBy("file_path", "session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.sum("e").alias("n_events"), F.sum("c").alias("n_tool_calls"))
    return schema.conform(own.withColumn("source", F.lit("opencode")), schema.SESSIONS)


def ingest(lines: DataFrame, keep=as_is) -> dict[str, DataFrame]:
    """The tables of a format's lines. ``keep`` may write the parsed lines down, since each table reads them again."""
    recs = keep(read_lines(lines, parse_line, LINE).where("ok"))
    e, c = events(recs), tool_calls(recs)
    return {"sessions": sessions(e, c), "events": e, "tool_calls": c}
