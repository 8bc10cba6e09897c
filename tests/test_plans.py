"""How often plans parse lines and what they move, and that results of odd lines stay."""

import json

from tracewell.plans import registry
from tracewell.plans.store import files_per_root
from tracewell.sources import session_log

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_lines(spark):
    use = lambda i, n: {"type": "tool_use", "id": i, "name": n, "input": {"a": n}}
    res = lambda i, t: {"type": "tool_result", "tool_use_id": i, "content": t}
    rec = lambda blocks, **more: json.dumps({"message": {"content": blocks, **more.pop("message", {})}, **more})
    spent = lambda n: {"usage": {"input_tokens": n, "output_tokens": 1}}
    rows = [
        ("/p/a.jsonl", 1, rec([res("x", "early"), res("x", "later")], cwd="/w", timestamp="2026-01-01T00:00:01Z")),
        ("/p/a.jsonl", 2, rec([use("x", "one"), use("x", "two"), use(None, "bare"), use("", "none")], sessionId="s", permissionMode="m", uuid="u", requestId="q", message=spent(5))),
        ("/p/a.jsonl", 3, rec([use("x", "three"), res("y", "no call")], sessionId="t", cwd="/v", requestId="q", message=spent(7))),
        ("/p/a.jsonl", 4, rec("text", message=spent(2))),
        ("/p/a.jsonl", 5, "not json"),
        ("/p/b.jsonl", 1, rec([use("x", "other")])),
        ("/p/c.jsonl", 1, "[]"),
    ]
    return session_log.records(spark.createDataFrame(rows, "file_path string, seq long, raw string"))


def test_calls_of_odd_lines(spark):
    got = session_log.tool_calls(odd_lines(spark)).select("file_path", "tool_use_id", "tool_name", "result_text", "result_event_id", "outcome", "session_id", "permission_mode").collect()
    assert {tuple(r) for r in got} == {
        ("/p/a.jsonl", "x", "one", "early", "/p/a.jsonl:1", "ok", "s", "m"),
        ("/p/a.jsonl", "u:2", "bare", None, None, "pending", "s", "m"),
        ("/p/a.jsonl", "u:3", "none", None, None, "pending", "s", "m"),
        ("/p/b.jsonl", "x", "other", None, None, "pending", "b", None),
    } and len(got) == 4


def test_sessions_of_odd_lines(spark):
    got = session_log.sessions(odd_lines(spark)).select("file_path", "session_id", "n_events", "n_tool_calls", "input_tokens", "output_tokens", "cwd", "source", "project_dir").collect()
    assert {tuple(r) for r in got} == {("/p/a.jsonl", "s", 4, 3, 7, 2, "/v", "claude_code", "p"), ("/p/b.jsonl", "b", 1, 1, 0, 0, None, "claude_code", "p")} and len(got) == 2


def test_lines_are_parsed_once(spark):
    for name in ("session_rollup", "permission_carry", "ingest_tool_calls", "call_verdicts"):
        got = plan(registry.QUERIES[name](spark, SF))
        assert got.count("MapInArrow") == 1 and "Join" not in got, name


def test_files_per_root_moves_counts_only(spark):
    paths = spark.createDataFrame([(p,) for p in ("/r/a/1", "/r/a/b", "/r/ab", "/r", "/s", "claude-ai:1", "r/x", "/r//y")], "file_path string")
    roots = [("/r/",), ("/r/a",), ("/r/a/b",), ("/none",), (None,), ("/r/a",)]
    for more, top in (([], {}), ([("/",)], {"/": 1})):
        df = files_per_root(paths, spark.createDataFrame(roots + more, "root string"))
        rows = df.collect()
        assert {r["root"]: r["n_files"] for r in rows} == {"/r/": 3, "/r/a": 1, "/r/a/b": 1, "/none": 0, None: 0, **top} and len(rows) == 5 + len(top)
        assert "Generate" not in plan(df) and "Window" not in plan(df)
    assert {r["n_files"] for r in files_per_root(paths, spark.createDataFrame([], "root string")).collect()} == set()
