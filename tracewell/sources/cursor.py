"""Transcripts of the ``cursor`` format, and the chat metas and stores beside them.

A transcript records calls without results or times. A chat's ``meta.json`` adds
folder and times to its session. A chat's ``store.db`` holds the conversation with
results: it replaces a session's events and fills its calls only if its calls
agree with the transcript's in number and, one by one, in name.
"""

from __future__ import annotations

import json
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C
from ..functions import parse as P
from ..operators.order import first_of
from .lines import as_is, parent_name, read_lines, stem

#: Fixed values of the format: blocks that stand for another tool, and failures of stored results.
MCP_BLOCKS = ("CallMcpTool", "CallDynamicTool")
ERROR_PREFIXES = ("Error executing tool", "Error: Tool execution error")
FAILED_STATUS = ("error", "failed", "failure")
EXIT = "Exit code: "
EVENT_TYPES = {"text": "text", "reasoning": "reasoning", "redacted-reasoning": "reasoning"}

LINE = "blocks array<struct<at:int,text:string,call:struct<name:string,input:string,summary:string,server:string,tool:string,mcp:boolean,query:string,activity:string>>>"


def read_call(block: dict) -> dict:
    name, given = P.text(block.get("name")), block.get("input")
    given = given if isinstance(given, dict) else None
    own = given or {}
    server, tool, args = P.text(own.get("server")), P.text(own.get("toolName")), own.get("arguments")
    space = P.text(own.get("namespace"))
    known = name in MCP_BLOCKS
    if name == MCP_BLOCKS[0] and given is not None:
        label = "/".join(x for x in (server, tool) if x is not None) or name
        words = f"{label} {P.dumps(args, compact=True) if args else ''}"
    else:
        words = f"{name or ''} {P.dumps(given, compact=True) if given else ''}"
    return {
        "name": name,
        "input": None if given is None else P.dumps(given),
        "summary": P.summary(name, given),
        "server": (server if server is not None else space) if known else None,
        "tool": tool if known else None,
        "mcp": known and any(x is not None for x in (server, space, tool)),
        "query": P.text(P.table(args).get("query")),
        "activity": words.strip() or None,
    }


def parse_line(raw: str) -> dict | None:
    r = P.load(raw)
    if r is None:
        return None
    content = P.table(r.get("message")).get("content") if r.get("role") == "assistant" else None
    blocks = []
    for i, b in enumerate(content if isinstance(content, list) else []):
        if isinstance(b, dict) and b.get("type") == "text" and P.some(b.get("text")):
            blocks.append({"at": i, "text": b["text"]})
        elif isinstance(b, dict) and b.get("type") == "tool_use":
            blocks.append({"at": i, "call": read_call(b)})
    return {"blocks": blocks}


def blocks(lines: DataFrame) -> DataFrame:
    r = read_lines(lines, parse_line, LINE).where("ok")
    return r.select("file_path", "seq", stem(F.col("file_path")).alias("session_id"), F.explode("blocks").alias("b")).select("file_path", "seq", "session_id", F.col("b.at").alias("at"), F.col("b.text").alias("text"), F.col("b.call").alias("call"))


def events(b: DataFrame) -> DataFrame:
    t = b.where("text is not null")
    return schema.conform(t.withColumns({"event_id": F.concat_ws(":", F.lit("cursor:text"), "file_path", "seq", "at"), "source": F.lit("cursor"), "type": F.lit("text"), "raw": F.col("text")}), schema.EVENTS)


def tool_calls(b: DataFrame) -> DataFrame:
    """Outcomes stay null: the transcript doesn't record them."""
    c = b.where("call is not null")
    return schema.conform(
        c.withColumns({"tool_use_id": F.concat_ws(":", "seq", "at"), "source": F.lit("cursor"), "tool_name": F.col("call.name"), "tool_kind": F.when(F.col("call.mcp"), "mcp").otherwise("builtin"), "mcp_server": F.col("call.server"), "input": F.col("call.input"), "input_summary": F.col("call.summary")}),
        schema.TOOL_CALLS,
    )


def sessions(lines: DataFrame, b: DataFrame) -> DataFrame:
    counts = b.groupBy("file_path").agg(F.count("text").alias("n_events"), F.count("call").alias("n_tool_calls"))
    own = lines.select("file_path").distinct().join(counts, "file_path", "left").na.fill(0, ["n_events", "n_tool_calls"])
    return schema.conform(own.withColumns({"session_id": stem(F.col("file_path")), "source": F.lit("cursor")}), schema.SESSIONS)


def ingest(lines: DataFrame, keep=as_is) -> dict[str, DataFrame]:
    """The tables of a format's lines. ``keep`` may write the parsed lines down, since each table reads them again."""
    b = keep(blocks(lines))
    return {"sessions": sessions(lines, b), "events": events(b), "tool_calls": tool_calls(b)}


# ---- chat metas


def read_meta(raw: bytes | None) -> dict:
    try:
        m = P.table(json.loads(bytes(raw or b"").decode()))
    except (ValueError, UnicodeDecodeError):
        m = {}
    return {"cwd": P.text(m.get("cwd")), "started_at": P.epoch_ms(m.get("createdAtMs")), "ended_at": P.epoch_ms(m.get("updatedAtMs"))}


def metas(files: DataFrame) -> DataFrame:
    """session_id, cwd, started_at, ended_at: for each session the last value that a meta gives, in order of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [read_meta(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m["cwd"] for m in made], pa.string()), *[pa.array([m[k] for m in made], pa.timestamp("us", "UTC")) for k in ("started_at", "ended_at")]], ["file_path", "cwd", "started_at", "ended_at"])

    read = files.select("file_path", "content").mapInArrow(run, "file_path string, cwd string, started_at timestamp, ended_at timestamp").withColumn("session_id", parent_name(F.col("file_path")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("file_path"))).alias(c)
    return read.where("session_id is not null").groupBy("session_id").agg(last("cwd"), last("started_at"), last("ended_at"))


def apply_metas(tables: dict[str, DataFrame], metas_: DataFrame) -> dict[str, DataFrame]:
    """Fill folder and times of the sessions that a meta names; a null in a meta changes nothing."""
    out = dict(tables)
    m = metas_.select("session_id", *[F.col(c).alias(f"__{c}") for c in ("cwd", "started_at", "ended_at")])
    for name, columns in (("sessions", ("cwd", "started_at", "ended_at")), ("events", ("cwd",)), ("tool_calls", ("cwd",))):
        mine = F.col("source") == "cursor"
        joined = out[name].join(m, "session_id", "left")
        out[name] = schema.conform(joined.withColumns({c: F.when(mine, F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in columns}), schema.TABLES[name])
    return out


def meta_match(sessions_: DataFrame, metas_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session ids that a meta changed, and those of this source that none did."""
    mine = sessions_.where("source = 'cursor'").select("session_id").distinct()
    some = metas_.where("coalesce(cwd, cast(started_at as string), cast(ended_at as string)) is not null").select("session_id")
    return mine.join(some, "session_id", "left_semi"), mine.join(some, "session_id", "left_anti")


# ---- chat stores


def judge(result) -> tuple[bool, str]:
    """Whether a stored result is an error, and its outcome."""
    bad = False
    if isinstance(result, dict):
        bad = result.get("error") not in (None, "") or (isinstance(result.get("status"), str) and result["status"] in FAILED_STATUS)
    elif isinstance(result, str):
        head = result.partition("\n")[0].strip()
        code = head[len(EXIT) :].strip() if head.startswith(EXIT) else ""
        bad = result.startswith(ERROR_PREFIXES) or (code.isdigit() and int(code) != 0)
    return bad, "error" if bad else "ok"


def read_store(data: bytes) -> tuple[list[dict], list[dict]]:
    """Calls and parts of a conversation in table order; nothing if the bytes are no such database."""
    rows = []
    with tempfile.NamedTemporaryFile(suffix=".db") as copy:  # SQLite reads files only; the copy goes with the block
        copy.write(data)
        copy.flush()
        try:
            db = sqlite3.connect(f"file:{copy.name}?mode=ro&immutable=1", uri=True)
            try:
                rows = db.execute("SELECT data FROM blobs ORDER BY rowid").fetchall()
            finally:
                db.close()
        except sqlite3.Error:
            return [], []
    calls, parts, results, index = [], [], {}, 0
    for (blob,) in rows:
        try:
            m = json.loads(bytes(blob).decode()) if isinstance(blob, bytes) else None
        except (ValueError, UnicodeDecodeError):
            continue
        if not isinstance(m, dict):
            continue
        content = [{"type": "text", "text": m["content"]}] if isinstance(m.get("content"), str) else P.objects(m.get("content"))
        for at, part in enumerate(content):
            kind = P.text(part.get("type"))
            parts.append({"message": index, "at": at, "role": P.text(m.get("role")), "type": kind, "text": P.text(part.get("text")) if kind != "redacted-reasoning" else None})
            if kind == "tool-call":
                name = part.get("toolName")
                calls.append({"id": P.text(part.get("toolCallId")), "name": P.text(name if isinstance(name, str) else part.get("name"))})
            elif kind == "tool-result" and isinstance(part.get("toolCallId"), str):
                results[part["toolCallId"]] = part.get("result")
        index += 1
    for n, c in enumerate(calls):
        c["n"], c["has"] = n, c["id"] is not None and c["id"] in results
        found = results.get(c["id"])
        c["failed"], c["outcome"] = judge(found)
        c["result"] = found if isinstance(found, str) else P.dumps(found, compact=True, ordered=True)
    return calls, parts


STORE = "file_path string, calls array<struct<n:int,name:string,has:boolean,failed:boolean,outcome:string,result:string>>, parts array<struct<message:int,at:int,role:string,type:string,text:string>>"


def stores(files: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(STORE)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read_store(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in got], arrow.field(1).type), pa.array([p for _, p in got], arrow.field(2).type)], schema=arrow)

    return files.select("file_path", "content").mapInArrow(run, target).withColumn("session_id", parent_name(F.col("file_path")))


def pairing(calls: DataFrame, stores_: DataFrame) -> DataFrame:
    """For each session the first store, in order of paths, whose calls have the transcript's names in order."""
    mine = calls.where("source = 'cursor'").withColumn("n", F.transform(F.split("tool_use_id", ":"), lambda x: x.cast("long")))
    names = mine.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("tool_name").alias("name")))), lambda x: x["name"]).alias("names"))
    both = stores_.join(names, "session_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    same = (F.size("names") == F.size("calls")) & F.forall(F.zip_with("names", F.transform("calls", lambda c: c["name"]), lambda a, b: a.eqNullSafe(b)), lambda x: x)
    return first_of(both.where(same), ["session_id"], ["file_path"])


def apply_stores(tables: dict[str, DataFrame], stores_: DataFrame, limit: int = C.RESULT_LIMIT) -> dict[str, DataFrame]:
    """Replace events and fill outcomes of the sessions whose store pairs; all others stay as ingested."""
    known = tables["sessions"].where("source = 'cursor'").select("session_id", F.col("file_path").alias("transcript"), "cwd")
    paired = pairing(tables["tool_calls"], stores_.join(known.select("session_id").distinct(), "session_id", "left_semi"))
    cut, long_ = C.truncated(F.col("c.result"), limit)
    results = paired.select("session_id", F.explode("calls").alias("c")).where("c.has").select("session_id", F.col("c.n").alias("__n"), F.col("c.outcome").alias("__o"), F.col("c.failed").alias("__e"), cut.alias("__r"), long_.alias("__t"))
    order = F.transform(F.split("tool_use_id", ":"), lambda x: F.try_cast(x, "long") if hasattr(F, "try_cast") else x.cast("long"))
    mine = tables["tool_calls"].where("source = 'cursor'").withColumn("__n", (F.row_number().over(W.partitionBy("session_id").orderBy(order)) - 1).cast("int"))
    filled = mine.join(results, ["session_id", "__n"], "left").withColumns({"outcome": F.coalesce("__o", "outcome"), "is_error": F.coalesce("__e", "is_error"), "result_text": F.coalesce("__r", "result_text"), "result_truncated": F.coalesce("__t", "result_truncated")})
    calls = tables["tool_calls"].where("source is distinct from 'cursor'").unionByName(schema.conform(filled, schema.TOOL_CALLS))
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    parts = paired.select("session_id", F.explode("parts").alias("p")).where(F.col("p.type").isin(*EVENT_TYPES) & ~F.col("p.role").eqNullSafe("tool")).join(known, "session_id")
    made = parts.select("session_id", F.col("transcript").alias("file_path"), "cwd", F.col("p.message").alias("seq"), F.concat_ws(":", F.lit("cursor:store"), "transcript", "p.message", "p.at").alias("event_id"), kinds[F.col("p.type")].alias("type"), F.col("p.role").alias("role"), F.col("p.role").eqNullSafe("system").alias("is_meta"), F.col("p.text").alias("text"), F.col("p.text").alias("raw"), F.lit("cursor").alias("source"))
    keep = tables["events"].where("source is distinct from 'cursor'").unionByName(tables["events"].where("source = 'cursor'").join(paired.select("session_id"), "session_id", "left_anti").select(tables["events"].columns))
    fresh = schema.conform(made, schema.EVENTS)
    counts = paired.select("session_id").join(fresh.groupBy("session_id").agg(F.count("*").alias("__n")), "session_id", "left").na.fill(0, ["__n"])
    own = tables["sessions"].join(counts, "session_id", "left").withColumn("n_events", F.when(F.col("source") == "cursor", F.coalesce("__n", "n_events")).otherwise(F.col("n_events")))
    return {**tables, "tool_calls": calls, "events": keep.unionByName(fresh), "sessions": schema.conform(own, schema.SESSIONS)}
