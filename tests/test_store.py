"""Files to tables: five formats, incremental builds, the command line, the dashboard and streams."""

import io
import json
import os
import shutil
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell import cli
from tracewell.functions.columns import CLASSIFIER_DENIAL, USER_DENIAL
from tracewell.plans.dashboard import Dashboard, host_allowed
from tracewell.plans.engine import Engine
from tracewell.plans.store import StoreError
from tracewell.sources import ledgers
from tracewell.sources.lines import discover, numbered


def line(n, role, content, **more):
    return {"type": role, "uuid": f"u{n}", "sessionId": "s1", "timestamp": f"2026-01-01T00:00:{n:02d}Z", "message": {"role": role, "content": content, **more.pop("message", {})}, **more}


def use(i, name="Bash", **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content, error=False):
    return {"type": "tool_result", "tool_use_id": i, "content": content, "is_error": error}


LOG = [
    {"type": "permission-mode", "permissionMode": "ask", "sessionId": "s1"},
    line(1, "user", "Please fix the frobnicator frobnicator frobnicator", cwd="/w", parentUuid=None),
    line(2, "assistant", [{"type": "text", "text": "ok"}, use("t1", command="ls")], parentUuid="u1", requestId="r1", message={"usage": {"input_tokens": 5, "output_tokens": 1}, "model": "m1"}),
    line(3, "assistant", [use("t2", command="rm x"), use("t3", command="cat y")], parentUuid="u2", requestId="r1", message={"usage": {"input_tokens": 5, "output_tokens": 1}}),
    "not json",
    "[1]",
    line(4, "user", [result("t1", "done"), result("t1", "again", True)], permissionMode="auto"),
    line(5, "user", [result("t2", USER_DENIAL)]),
    line(6, "assistant", [use("t4", command="rm x"), use("t5", "mcp__memory__recall", query="q")]),
    line(7, "user", [result("t4", CLASSIFIER_DENIAL + ". Reason: no. "), result("t5", "see src/main.py#12 and foo")]),
    line(8, "assistant", "now in src/main.py#12"),
    line(9, "assistant", [use("t6", command="x"), use("t1", command="dup")]),
]


def write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("\n\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("logs"))
    write(f"{root}/cc/proj/one.jsonl", LOG)
    write(f"{root}/cc/proj/empty.jsonl", [])
    tool = lambda i, status, **s: {"type": "message.part.updated", "properties": {"sessionID": "o1", "part": {"type": "tool", "tool": "memory_recall", "callID": i, "state": {"status": status, "input": {"query": "w"}, "time": {"start": 1767225601000, "end": 1767225602500}, **s}}}}
    delta = lambda t, p="p1": {"type": "message.part.delta", "properties": {"sessionID": "o1", "field": "text", "partID": p, "delta": t}}
    snap = {"type": "message.part.updated", "properties": {"sessionID": "o1", "part": {"type": "text", "id": "p2", "text": "whole"}}}
    write(f"{root}/oc/a/events.ndjson", [delta("Em"), tool("c1", "running"), delta("it"), delta("half", "p2"), snap, tool("c1", "completed", output={"a": 1}), tool("c2", "error", error="bad"), "{"])
    write(f"{root}/oc/a/deep/never.ndjson", [delta("unseen")])
    cursor = [{"role": "user", "message": {"content": []}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Shell", "input": {"command": "ls"}}, {"type": "tool_use", "name": "CallMcpTool", "input": {"server": "memory", "toolName": "recall", "arguments": {"query": "w"}}}]}}, {"status": "done"}]
    write(f"{root}/cu/c1.jsonl", cursor)
    write(f"{root}/cu/c2.jsonl", cursor)
    item = lambda t, **i: {"timestamp": "2026-01-02T00:00:00Z", "type": "event_msg", "payload": {"type": "item_completed", "item": {"type": t, **i}}}
    write(f"{root}/cx/x.jsonl", [item("CommandExecution", id="i0", command="early", stdout="o"), {"type": "session_meta", "payload": {"id": "x1"}}, item("CommandExecution", id="i1", command=["ls"], stdout="o", exit_code=1, cwd="file:///a%20b", duration={"secs": 1, "nanos": 5e8}), item("McpToolCall", id="i2", server="s", tool="t", error="boom"), item("FileChange", id="i3", changes={"f": {}}, status="completed", stderr="warn", stdout="k"), item("ContextCompaction", id="i4"), item("Unknown", id="i5"), {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "a"}, {"type": "output_text", "text": "b"}]}}, {"type": "token_usage_record", "payload": {"thread_token_usage": {"input_tokens": 3}}}, {"type": "token_usage_record", "payload": {"thread_token_usage": {"input_tokens": 9, "cached_input_tokens": 2}}}])
    chat = f"{root}/chats/h/c1"
    os.makedirs(chat)
    json.dump({"cwd": "/cursor", "createdAtMs": 1767225600000, "updatedAtMs": "bad"}, open(f"{chat}/meta.json", "w"))
    db = sqlite3.connect(f"{chat}/store.db")
    db.execute("CREATE TABLE blobs (id BLOB PRIMARY KEY, data BLOB)")
    say = [{"role": "system", "content": "rules"}, {"role": "assistant", "content": [{"type": "reasoning", "text": "hm"}, {"type": "redacted-reasoning"}, {"type": "tool-call", "toolCallId": "a", "toolName": "Shell"}, {"type": "tool-call", "toolCallId": "b", "toolName": "CallMcpTool"}]}, {"role": "tool", "content": [{"type": "tool-result", "toolCallId": "a", "result": "Exit code: 2\nno"}]}]
    for i, m in enumerate([*map(json.dumps, say), "\x00bin"]):
        db.execute("INSERT INTO blobs VALUES (?, ?)", (str(i).encode(), m.encode()))
    db.commit()
    db.close()
    msg = lambda u, p, t, sender="human", blocks=None: {"uuid": u, "parent_message_uuid": p, "sender": sender, "created_at": f"2026-03-0{t}T00:00:00Z", "content": blocks or [{"type": "text", "text": f"m{u}"}]}
    conv = {"uuid": "k1", "name": "Title", "created_at": "2026-03-01T00:00:00Z", "updated_at": "2026-03-09T00:00:00Z", "chat_messages": [msg("a", None, 1), msg("b", "a", 2), msg("c", "a", 3, "assistant", [{"type": "thinking", "thinking": "t"}, {"type": "tool_use", "id": "z", "name": "srv:tool", "input": {}}, {"type": "text", "text": "end"}, {"type": "tool_result", "tool_use_id": "z", "content": [1], "is_error": True}])]}
    with zipfile.ZipFile(f"{root}/export.zip", "w") as z:
        z.writestr("conversations.json", json.dumps([conv, {"no": "uuid"}]))
    led = sqlite3.connect(f"{root}/ledger.db")
    led.execute("CREATE TABLE recalls (id INTEGER PRIMARY KEY, created_at TEXT, agent TEXT, query TEXT, matches TEXT)")
    led.execute("CREATE TABLE conclusions (id INTEGER PRIMARY KEY, content TEXT)")
    led.execute("CREATE TABLE actions (created_at TEXT, done_at TEXT)")
    led.execute("INSERT INTO recalls VALUES (1, '2026-01-05T00:00:00+00:00', 'cursor', 'w', '[{\"id\": 2}, {\"id\": 1}]')")
    led.executemany("INSERT INTO conclusions VALUES (?, ?)", [(1, "one"), (2, "two")])
    led.execute("INSERT INTO actions VALUES ('2026-01-01T00:00:05', NULL)")
    led.commit()
    led.close()
    return root


@pytest.fixture(scope="module")
def engine(spark, corpus, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")) + "/s")
    e.report = e.build({"claude_code": [f"{corpus}/cc", f"{corpus}/none"], "opencode": [f"{corpus}/oc"], "cursor": [f"{corpus}/cu"], "codex": [f"{corpus}/cx"]}, [f"{corpus}/chats"], [f"{corpus}/export.zip"], f"{corpus}/ledger.db")
    return e


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_lines():
    assert list(numbered(b"\xef\xbb\xbfa\r\n\n b \xff\n")) == [(1, "a"), (3, "b \ufffd")]


def test_discovery(corpus):
    assert [os.path.basename(p) for p in discover([f"{corpus}/oc"], "*.ndjson", True)[0]] == ["events.ndjson"]
    found, missing = discover([f"{corpus}/nope", f"{corpus}/export.zip", f"{corpus}/export.zip"], "*.jsonl")
    assert len(found) == 1 and missing == [f"{corpus}/nope"]


def test_report(engine, corpus):
    assert engine.report["missing"] == [f"{corpus}/none"] and engine.report["parse_errors"] == 3
    assert engine.report["chats"]["matched"] == 1 and engine.report["chats"]["unmatched"] == 1


def test_session_log(engine):
    c = engine.table("tool_calls").where("source = 'claude_code'").orderBy("tool_use_id")
    assert rows(c, "tool_use_id", "outcome", "denied_by", "denial_reason", "permission_mode", "result_text", "seq", "duration_ms") == [
        ("t1", "ok", None, None, "ask", "done", 5, 2000),
        ("t2", "denied", "user", None, "ask", USER_DENIAL, 7, 2000),
        ("t3", "pending", None, None, "ask", None, 7, None),
        ("t4", "denied", "classifier", "no", "auto", CLASSIFIER_DENIAL + ". Reason: no. ", 17, 1000),
        ("t5", "ok", None, None, "auto", "see src/main.py#12 and foo", 17, 1000),
        ("t6", "pending", None, None, "auto", None, 23, None),
    ]
    e = engine.table("events").where("source = 'claude_code'").orderBy("seq")
    assert rows(e, "event_id", "depth")[:4] == [(rows(e, "file_path")[0][0] + ":1", 0), ("u1", 0), ("u2", 1), ("u3", 2)]
    s = engine.table("sessions").where("source = 'claude_code'")
    assert rows(s, "session_id", "project_dir", "cwd", "n_events", "n_tool_calls", "input_tokens", "output_tokens") == [("s1", "proj", "/w", 10, 6, 5, 1)]


def test_opencode(engine):
    e = engine.table("events").where("source = 'opencode'").orderBy("seq")
    assert rows(e, "seq", "text", "role") == [(1, "Emit", None), (7, "whole", None)]
    c = engine.table("tool_calls").where("source = 'opencode'").orderBy("seq")
    assert rows(c, "tool_use_id", "outcome", "result_text", "duration_ms") == [("c1", "ok", '{"a": 1}', 1500), ("c2", "error", "bad", 1500)]
    assert rows(engine.table("sessions").where("source = 'opencode'"), "session_id", "n_events", "n_tool_calls") == [("o1", 2, 2)]


def test_cursor_pairing(engine):
    c = engine.table("tool_calls").where("source = 'cursor'").orderBy("session_id", "tool_use_id")
    assert rows(c, "session_id", "tool_name", "tool_kind", "mcp_server", "outcome", "cwd") == [("c1", "Shell", "builtin", None, "error", "/cursor"), ("c1", "CallMcpTool", "mcp", "memory", None, "/cursor"), ("c2", "Shell", "builtin", None, None, None), ("c2", "CallMcpTool", "mcp", "memory", None, None)]
    e = engine.table("events").where("source = 'cursor'").orderBy("session_id", "event_id")
    assert rows(e, "session_id", "type", "role", "is_meta", "text") == [("c1", "text", "system", True, "rules"), ("c1", "reasoning", "assistant", False, "hm"), ("c1", "reasoning", "assistant", False, None), ("c2", "text", None, None, "hi")]
    assert rows(engine.table("sessions").where("source = 'cursor'").orderBy("session_id"), "session_id", "n_events", "cwd") == [("c1", 3, "/cursor"), ("c2", 1, None)]


def test_codex(engine):
    c = engine.table("tool_calls").where("source = 'codex'").orderBy("seq")
    assert rows(c, "tool_use_id", "session_id", "tool_name", "outcome", "duration_ms", "cwd") == [("i0", None, "Bash", "ok", None, None), ("i1", "x1", "Bash", "error", 1500, "/a b"), ("i2", "x1", "mcp__s__t", "error", None, None), ("i3", "x1", "FileChange", "ok", None, None)]
    e = engine.table("events").where("source = 'codex'").orderBy("seq")
    assert rows(e, "type", "role", "is_meta", "text") == [("context_compaction", None, False, ""), ("text", "developer", True, "ab")]
    assert rows(engine.table("sessions").where("source = 'codex'"), "session_id", "input_tokens", "cache_read_tokens") == [("x1", 9, 2)]


def test_web_export(engine):
    e = engine.table("events").where("source = 'claude_ai'").orderBy("seq")
    assert rows(e, "seq", "type", "role", "is_meta", "text") == [(-1, "ai-title", None, True, ""), (0, "text", "user", False, "ma"), (1, "text", "assistant", True, "t"), (2, "text", "assistant", False, "end")]
    assert rows(engine.table("tool_calls").where("source = 'claude_ai'"), "tool_use_id", "seq", "mcp_server", "outcome", "result_text") == [("z", 2, "srv", "error", "[1]")]


def test_recalls(engine):
    r = engine.recalls(limit=0).orderBy("source", "session_id", "call_id")
    got = rows(r, "source", "session_id", "query", "output", "overlap_tokens", "overlap_count")
    assert got[0] == ("claude_code", "s1", "q", "see src/main.py#12 and foo", '["src/main.py#12"]', 1)
    assert {x[:4] for x in got[1:]} == {("cursor", "c1", "w", "two\none"), ("cursor", "c2", "w", "two\none"), ("opencode", "o1", "w", '{"a": 1}'), ("opencode", "o1", "w", "bad")}


def test_denials_and_sql(engine):
    assert rows(engine.denials(), "seq", "followup_kind", "next_tool_name") == [(17, "other-tool", "Bash"), (7, "verbatim-retry", "Bash")] or rows(engine.denials(), "seq", "followup_kind") == [(17, "same-tool"), (7, "verbatim-retry")]
    assert engine.sql("SELECT count(*) FROM denial_followups").first()[0] == 2
    with pytest.raises(ValueError):
        engine.sql("DROP TABLE x")


def test_reports(engine, corpus):
    t = engine.session_trace("s")
    assert t["coverage"]["total"] == t["timeline"].count() == 9
    recall = t["timeline"].where("is_recall").first()
    assert recall["recall"]["overlap_count"] == 1 and "now in" in recall["recall"]["followup_text"]
    assert engine.topics("s1")["n_exchanges"] == 1
    assert engine.topics("k1")["title"] == "Title"
    info = engine.info()
    assert info["stale"] == 0 and info["tables"]["sessions"] == 6 and info["roots"]["claude_code"][f"{corpus}/cc"] == 2
    assert dict(rows(engine.hygiene()["categories"], "name", "tool_calls"))["pending_tool_call"] == 2
    assert engine.grep("frob").count() == 1 and engine.grep("cat y", tool_calls=True).count() == 1
    assert rows(engine.orphans(min_human_chars=10, min_orphans=1), "session_id", "orphan_terms") == [("s1", ["frobnicator"])]
    open(f"{corpus}/sink.md", "w").write("The FROBNICATOR is known")
    assert engine.orphans([f"{corpus}/sink.md"], min_human_chars=10, min_orphans=1).count() == 0
    salvage = engine.salvage(f"{corpus}/ledger.db", {"any": F.col("outcome") == "ok"}, F.lit(False), limit=0)
    assert "t1" not in [r[0] for r in rows(salvage, "tool_use_id")]
    assert engine.review(zone="UTC")["buckets"].count() == 3
    assert engine.memory_authors()["files"].count() == 0 and engine.pending().count() == 0
    assert set(engine.schema("sessions")) == {"sessions"}
    with pytest.raises(ValueError):
        engine.schema("nope")


def test_incremental_equals_fresh(spark, corpus, tmp_path):
    a, b = Engine(spark, f"{tmp_path}/a"), Engine(spark, f"{tmp_path}/b")
    write(f"{tmp_path}/l/p/x.jsonl", LOG[:4])
    write(f"{tmp_path}/l/p/y.jsonl", LOG[:2])
    a.build({"claude_code": [f"{tmp_path}/l"]})
    assert a.build({"claude_code": [f"{tmp_path}/l"]})["read"] == {"claude_code": 0}
    write(f"{tmp_path}/l/p/x.jsonl", LOG)
    assert a.build({"claude_code": [f"{tmp_path}/l"]})["read"] == {"claude_code": 1}
    b.build({"claude_code": [f"{tmp_path}/l"]})
    for name in ("sessions", "events", "tool_calls", "recall_calls"):
        key = lambda e: sorted(map(str, rows(e.table(name), "*")))  # noqa: E731, B023
        assert key(a) == key(b), name


def test_chats_come_later(spark, corpus, tmp_path):
    a, b = Engine(spark, f"{tmp_path}/a"), Engine(spark, f"{tmp_path}/b")
    shutil.copytree(f"{corpus}/chats", f"{tmp_path}/chats")
    write(f"{tmp_path}/chats/h/meta.json", [{}])  # one folder too high to be a session's
    sources, chats = {"cursor": [f"{corpus}/cu"]}, [f"{tmp_path}/chats"]
    a.build(sources)
    report = a.build(sources, chats)
    assert report["read"] == {"cursor": 0} and report["chats"]["metas"] == 1
    assert (report["chats"]["matched"], report["chats"]["unmatched"]) == (1, 1)
    assert b.build(sources, chats)["chats"] == report["chats"]
    same = lambda: {n: sorted(map(str, rows(a.table(n), "*"))) == sorted(map(str, rows(b.table(n), "*"))) for n in ("sessions", "events", "tool_calls", "recall_calls")}
    assert all(same().values()), same()
    assert rows(a.table("source_files").orderBy("file_path"), "n_events", "n_tool_calls") == [(3, 2), (1, 2)]
    a.build(sources, chats)  # once more changes nothing
    assert all(same().values()), same()
    os.remove(f"{tmp_path}/chats/h/c1/store.db")  # events come back from the transcript; filled calls and the folder stay
    a.build({}, chats)
    e = a.table("events").where("session_id = 'c1'")
    assert rows(e, "type", "text", "cwd") == [("text", "hi", "/cursor")] and rows(e, "event_id")[0][0].startswith("cursor:text:")
    assert rows(a.table("sessions").orderBy("session_id"), "session_id", "n_events", "cwd") == [("c1", 1, "/cursor"), ("c2", 1, None)]
    assert rows(a.table("tool_calls").where("session_id = 'c1' and tool_name = 'Shell'"), "outcome") == [("error",)]
    assert rows(a.table("source_files").orderBy("file_path"), "n_events") == [(1,), (1,)]


def test_store_refusals(spark, tmp_path):
    with pytest.raises(StoreError):
        Engine(spark, f"{tmp_path}/none").denials()
    os.makedirs(f"{tmp_path}/old")
    json.dump({"format": 0, "tables": {}}, open(f"{tmp_path}/old/manifest.json", "w"))
    with pytest.raises(StoreError):
        Engine(spark, f"{tmp_path}/old").info()


@pytest.mark.parametrize(
    "argv, code",
    [(["denials"], 0), (["grep", "frob"], 0), (["grep", "zzzz"], 1), (["grep", "("], 2), (["topics", "nobody"], 1), (["nominate"], 1), (["grep", "x", "--limit", "-1"], 2), (["hygiene", "--format", "json"], 0), (["schema"], 0), (["info"], 0), (["sql", "SELECT 1 AS a", "--format", "csv"], 0), (["sql", "SELEC"], 1), (["compare-periods", "--baseline", "2026-01-01..2026-01-02", "--current", "2026-01-02..2026-01-03"], 0), (["compare-periods", "--baseline", "2026-01-02..2026-01-01", "--current", "2026-01-02..2026-01-03"], 1), (["compare-periods"], 2)],
)
def test_cli(engine, argv, code):
    out = io.StringIO()
    assert cli.main(["--store", "x", *argv], engine, out) == code
    if argv[0] == "sql" and code == 0:
        assert out.getvalue().split() == ["a", "1"]


def test_dashboard(engine, tmp_path):
    board = Dashboard(engine, f"{tmp_path}/reviewed")
    assert board.get("/healthz")[0] == 200 and board.get("/nope")[0] == 404 and board.get("/session/nobody")[0] == 404
    assert json.loads(board.get("/api/denials.json")[2])[0]["session_id"] == "s1"
    assert "<nav>" in board.get("/")[2]
    assert board.post("/orphans/reviewed", "http://evil.example", b"session=s1")[0] == 403
    assert board.post("/orphans/reviewed", "http://127.0.0.1:1", f"token={board.token}&session=s1".encode())[0] == 303
    assert ledgers.reviewed_ids(f"{tmp_path}/reviewed") == ["s1"]
    assert host_allowed("localhost:80") and not host_allowed("example.com") and not host_allowed(None)


def test_reviewed_file(tmp_path):
    path = f"{tmp_path}/r"
    open(path, "w").write("# mine\na\nb # note\n")
    assert ledgers.update_reviewed(path, ["c", "a"], ["b"]) == ["a", "c"]
    assert open(path).read().startswith("# mine\n")
    open(path, "w").write("ok\n(bad\n")
    with pytest.raises(ValueError, match="line 2"):
        ledgers.pattern_list(path)


def test_stream_of_files(spark, tmp_path):
    from tracewell.streaming.watch import counts_by_window, watch

    e = Engine(spark, f"{tmp_path}/s")
    write(f"{tmp_path}/in/p/x.jsonl", LOG[:4])
    q = watch(e, "claude_code", f"{tmp_path}/in", f"{tmp_path}/ck", once=True)
    q.awaitTermination()
    assert e.table("tool_calls").count() == 3
    lines = spark.readStream.text(f"{tmp_path}/in/p")
    q = counts_by_window(spark, lines).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["type"], r["n"]) for r in spark.table("counted").collect()} == {("user", 1), ("assistant", 2)}
