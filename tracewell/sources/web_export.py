"""Conversation exports of the ``claude_ai`` source: a JSON array, or a ZIP that holds one.

Each conversation keeps the branch of its latest message. The export is one JSON
value, so a file is read by one task; conversations become rows at once.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C
from ..functions import parse as P
from ..operators.order import branch

#: Fixed values of the format: the root's id, and the field that holds a block's text.
ROOT = "00000000-0000-4000-8000-000000000000"
TEXT_FIELD = {"text": "text", "thinking": "thinking", "injected_prompt_block": "prompt"}
SKIPPED = ("token_budget", "flag", "image", "document")

CONVERSATION = (
    "uuid string, name string, created_at timestamp, updated_at timestamp, n_messages int, off_path int, malformed boolean, skipped map<string,long>, unknown map<string,long>, "
    "texts array<struct<seq:int,ts:timestamp,role:string,message:string,meta:boolean,text:string,raw:string>>, "
    "uses array<struct<seq:int,id:string,ts:timestamp,name:string,input:string,summary:string,has:boolean,failed:boolean,result:string>>"
)


def load_export(data: bytes) -> list:
    """The array of an export; ValueError if there is none."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            data = z.read("conversations.json")
    got = json.loads(data.decode("utf-8"))
    if not isinstance(got, list):
        raise ValueError("export root is not an array")
    return got


def _tally(blocks: list) -> tuple[dict, dict]:
    skipped: dict = {}
    unknown: dict = {}
    for b in blocks:
        kind = b.get("type") if isinstance(b, dict) else None
        if not isinstance(b, dict):
            name, into = "<non-object>", unknown
        elif not isinstance(kind, str):
            name, into = "<missing>", unknown
        elif kind in SKIPPED:
            name, into = kind, skipped
        elif kind in ("tool_use", "tool_result", "text"):
            continue
        elif kind not in TEXT_FIELD:
            name, into = kind, unknown
        elif not isinstance(b.get(TEXT_FIELD[kind]), str):
            name, into = f"{kind}:<no {TEXT_FIELD[kind]}>", unknown
        elif not b[TEXT_FIELD[kind]]:
            name, into = f"{kind}:<empty>", skipped
        else:
            continue
        into[name] = into.get(name, 0) + 1
    return skipped, unknown


def read_conversation(item) -> dict:
    given = item.get("chat_messages", []) if isinstance(item, dict) else None
    if not isinstance(item, dict) or not isinstance(item.get("uuid"), str) or not isinstance(given, list):
        return {"malformed": True}
    messages = [m for m in given if isinstance(m, dict)]
    path = branch([{"uuid": P.text(m.get("uuid")), "parent": P.text(m.get("parent_message_uuid")), "at": P.moment(m.get("created_at"))} for m in messages], ROOT)
    texts: list = []
    uses: dict = {}
    results: dict = {}
    blocks: list = []
    for m in (messages[i] for i in path):
        content = m.get("content", [])
        for b in content if isinstance(content, list) else []:
            blocks.append(b)
            if not isinstance(b, dict):
                continue
            kind = b.get("type") if isinstance(b.get("type"), str) else None
            if kind == "tool_use":
                uses[str(b.get("id"))] = (b, len(texts))
            elif kind == "tool_result":
                results[str(b.get("tool_use_id"))] = b
            elif kind in TEXT_FIELD and P.some(b.get(TEXT_FIELD[kind])):
                texts.append({"seq": len(texts), "ts": P.moment(m.get("created_at")), "role": "user" if m.get("sender") == "human" else "assistant", "message": P.text(m.get("uuid")), "meta": kind != "text", "text": b[TEXT_FIELD[kind]], "raw": P.dumps(b)})
    calls = []
    for key, (b, seq) in uses.items():
        r, name, given = results.get(key), P.text(b.get("name")), b.get("input")
        out = r.get("content") if r else None
        calls.append({"seq": seq, "id": key, "ts": P.moment(b.get("start_timestamp")), "name": name, "input": None if given is None else P.dumps(given), "summary": P.summary(name, given), "has": r is not None, "failed": bool(r and r.get("is_error")), "result": out if out is None or isinstance(out, str) else P.dumps(out)})
    skipped, unknown = _tally(blocks)
    return {"uuid": item["uuid"], "name": P.text(item.get("name")) or "", "created_at": P.moment(item.get("created_at")), "updated_at": P.moment(item.get("updated_at")), "n_messages": len(given), "off_path": len(messages) - len(path), "malformed": False, "skipped": skipped, "unknown": unknown, "texts": texts, "uses": calls}


def conversations(files: DataFrame) -> DataFrame:
    """One row for each item of the exports, with the export's path and the item's place in it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL("export string, item int, " + CONVERSATION)
    arrow = to_arrow_schema(target)
    names = target.names[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                made = list(map(read_conversation, load_export(data.as_py())))
                for i in range(0, len(made), 1000):
                    part = made[i : i + 1000]
                    cols = [[m.get(n) for m in part] for n in names]
                    cols = [[list(v.items()) if isinstance(v, dict) else v for v in c] for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(i, i + len(part)), pa.int32()), *[pa.array(c, arrow.field(n).type) for n, c in zip(names, cols)]], schema=arrow)

    return files.select("file_path", "content").mapInArrow(run, target)


def newest(convs: DataFrame) -> DataFrame:
    """The last occurrence of each conversation, in order of exports."""
    w = W.partitionBy("uuid").orderBy(F.desc("export"), F.desc("item"))
    return convs.where("not malformed").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ingest(files: DataFrame, limit: int = C.RESULT_LIMIT) -> dict[str, DataFrame]:
    c = newest(conversations(files)).withColumns({"source": F.lit("claude_ai"), "session_id": F.col("uuid"), "file_path": F.concat(F.lit("claude-ai:"), "uuid"), "depth": F.lit(0), "is_sidechain": F.lit(False)})
    base = ["source", "session_id", "file_path", "depth", "is_sidechain"]
    e = c.select(*base, F.explode("texts").alias("t")).select(*base, F.concat_ws(":", F.lit("claude_ai"), "session_id", "t.seq").alias("event_id"), "t.seq", "t.ts", F.lit("text").alias("type"), "t.role", F.col("t.message").alias("message_id"), F.col("t.meta").alias("is_meta"), "t.text", "t.raw")
    title = c.select(*base, F.concat_ws(":", F.lit("claude_ai"), "session_id", F.lit("title")).alias("event_id"), F.lit(-1).alias("seq"), F.col("created_at").alias("ts"), F.lit("ai-title").alias("type"), F.lit(True).alias("is_meta"), F.lit("").alias("text"), F.to_json(F.struct(F.col("name").alias("title"))).alias("raw"))
    events = schema.conform(e, schema.EVENTS).unionByName(schema.conform(title, schema.EVENTS))
    u = c.select(*base, F.explode("uses").alias("u"))
    name, cut = F.col("u.name"), C.truncated(F.col("u.result"), limit)
    pair = F.regexp_extract(name, r"(?s)^([^:]+):.+$", 1)
    other = (C.tool_kind(name) != "mcp") & F.coalesce(pair != "", F.lit(False))
    calls = u.select(*base, F.col("u.id").alias("tool_use_id"), "u.seq", "u.ts", name.alias("tool_name"), F.when(other, "mcp").otherwise(C.tool_kind(name)).alias("tool_kind"), F.when(other, pair).otherwise(C.mcp_server(name)).alias("mcp_server"), "u.input", F.col("u.summary").alias("input_summary"), F.when(~F.col("u.has"), "pending").when(F.col("u.failed"), "error").otherwise("ok").alias("outcome"), F.col("u.failed").alias("is_error"), cut[0].alias("result_text"), cut[1].alias("result_truncated"))
    zero = F.lit(0)
    own = c.select("source", "session_id", "file_path", F.lit("claude_ai").alias("entrypoint"), F.col("created_at").alias("started_at"), F.col("updated_at").alias("ended_at"), (F.size("texts") + 1).alias("n_events"), F.size("uses").alias("n_tool_calls"), *[zero.alias(n) for n in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])
    return {"sessions": schema.conform(own, schema.SESSIONS), "events": events, "tool_calls": schema.conform(calls, schema.TOOL_CALLS)}
