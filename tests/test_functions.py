"""Row-local functions, by tables of cases."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import parse as P
from tracewell.functions import refs as R
from tracewell.functions import shell as S
from tracewell.operators.order import branch, depths
from tracewell.operators.review import unpasted


@pytest.mark.parametrize(
    "value, at",
    [
        ("2026-01-02T03:04:05Z", datetime(2026, 1, 2, 3, 4, 5)),
        ("2026-01-02T05:04:05.1234567+02:00", datetime(2026, 1, 2, 3, 4, 5, 123456)),
        ("20260810T090000", datetime(2026, 8, 10, 9)),
        (" 2026-01-02 ", datetime(2026, 1, 2)),
        ("09:00", None),
        ("", None),
        (None, None),
        (5, None),
    ],
)
def test_moment(value, at):
    assert P.moment(value) == at


def test_coercions():
    assert [P.flag(x) for x in (True, "yes", " TRUE ", "no", 0, None, 1)] == [True, True, True, False, False, False, True]
    assert [P.number(x) for x in (True, 2.9, "3.7", "x", None, [], "1e400")] == [1, 2, 3, 0, 0, 0, 0]
    assert P.epoch_ms(1_000) == datetime(1970, 1, 1, 0, 0, 1) and P.epoch_ms(True) is None and P.epoch_ms(1e30) is None
    assert P.load('{"a": NaN}') is not None and P.load("[1]") is None and P.load("{") is None


def test_texts():
    assert P.joined("x") == "x" and P.joined(["a", {"type": "text", "text": "b"}, {"type": "image"}, 5]) == "a\nb" and P.joined(None) == ""
    assert P.flat_result([{"type": "image"}, {"text": "t"}, "s", 7, {}]) == "[image]\nt\ns\n7\n[block]"
    assert P.flat_result({"b": 1, "a": 2}) == '{"a": 2, "b": 1}' and P.flat_result({"text": "x"}) == "x" and P.flat_result(None) == ""


def test_summary():
    assert P.summary("Bash", {"command": " a\n  b "}) == "a b"
    assert P.summary("Bash", {"command": " "}) == '{"command":" "}'
    assert P.summary("Other", {"b": 1, "a": [2]}) == '{"a":[2],"b":1}'
    assert P.summary("Read", None) is None and len(P.summary("Bash", {"command": "x" * 300})) == 200


@pytest.mark.parametrize(
    "line, found",
    [
        ("cat a", ["host_file_hunt"]),
        ("cd /x && cd y && grep q f", ["host_file_hunt"]),
        ("cd - && grep q f", []),
        ("echo 'cat a'", []),
        ("echo x; /usr/bin/sed -n 1p f", ["host_file_hunt"]),
        ("echo x | cat", []),
        ("ls\ncat f", ["host_file_hunt"]),
        ("companion --json status", ["companion_status_poll"]),
        ("node --flag /opt/companion.mjs status", ["companion_status_poll"]),
        ("node other.mjs status", []),
        ("companion run status", []),
        ("curl -s http://localhost:8765/x", ["raw_local_mcp_http"]),
        ("curl -d http://localhost:8765 http://example.com", []),
        ("curl --url=http://127.0.0.1:8750", ["raw_local_mcp_http"]),
        ("curl http://localhost:9999", []),
        ("curl -sXPOST http://localhost:8770/", ["raw_local_mcp_http"]),
        ("curl http://localhost:bad", []),
        ("", []),
    ],
)
def test_habits(line, found):
    assert S.habits(S.words(line)) == found
    assert S.habits(["bash", "-lc", line]) == found


def test_words():
    assert S.words("a 'b c' \"d\\\"e\" f\\ g;h") == ["a", "b c", 'd"e', "f g", S.BREAK, "h"]
    assert S.words("'open end") == ["open end"] and S.words(None) == [] and S.words("a\\") == ["a\\"]
    assert S.argv_of('{"command": ["a", "b c"]}', "x") == ["a", "b c"] and S.argv_of('{"command": 5}', "x y") == ["x", "y"] and S.argv_of(None, None) == []


def test_sections_and_items():
    text = "1. Work Done:\n - x\n2. Pending Tasks:\n   - **first** item\n     goes on\n   - second\n   ```\n   - not an item\n   ```\n3. Next Steps Here:\n - y"
    assert R.items(R.section(text)) == ["first item goes on", "second ``` - not an item ```"]
    assert R.section("no heading") is None and R.items([]) == []


@pytest.mark.parametrize(
    "text, got",
    [
        ("https://github.com/o/r/pull/5 and #6", [("o", "r", 5, False, None), ("o", "r", 6, True, "nearest")]),
        ("o/r#5, #5", [("o", "r", 5, False, None)]),
        ("known #7", [("own", "known", 7, False, None)]),
        ("in known we fix it (#8)", [("own", "known", 8, True, "name")]),
        ("PR #9", [(None, None, 9, True, None)]),
        ("nothing", []),
    ],
)
def test_references(text, got):
    assert [(r["owner"], r["repo"], r["number"], r["bare"], r["via"]) for r in R.references(text, "own", ["known"])] == got


def test_reference_default():
    assert R.references("#9", None, [], ("a", "b"))[0]["via"] == "repo_flag"
    assert R.explicit("a/b#1 https://github.com/c/d/issues/2 a/b#1 x #3") == [("a", "b", 1), ("c", "d", 2)]


def test_depths_against_a_naive_walk():
    parents = {"a": None, "b": "a", "c": "b", "x": "lost", "p": "q", "q": "p"}
    assert depths(parents) == {"a": 0, "b": 1, "c": 2, "x": 0, "p": 1, "q": 0}
    chain = {str(i): str(i - 1) if i else None for i in range(3000)}
    assert depths(chain)["2999"] == 2999 and depths({}) == {}


def test_branch():
    t = lambda n: datetime(2026, 1, n)
    m = lambda u, p, at: {"uuid": u, "parent": p, "at": at}
    assert branch([m("a", "R", t(1)), m("b", "a", t(2)), m("c", "a", t(3))], "R") == [0, 2]
    assert branch([m("a", "b", t(1)), m("b", "a", t(2))], "R") == [] and branch([], "R") == []
    assert branch([m("a", None, None), m("b", None, t(1))], "R") == [1]


def test_unpasted():
    assert unpasted("a\n```\ncode\n```\nuser@host:~$ ls\n$ pwd\nb") == "a\nls\npwd\nb"
    assert unpasted("~~~\nopen") == ""


def test_columns(spark):
    rows = [("mcp__files__read", f"  {C.USER_DENIAL} now", False), ("mcp__x", f"{C.CLASSIFIER_DENIAL}. Reason: [A] b. c.. {C.ADVICE}, go", True), ("Bash", f"quotes {C.USER_DENIAL}", True), (None, None, False), ("mcp____t", f"{C.CLASSIFIER_DENIAL}. Reason: No reason provided", False)]
    df = spark.createDataFrame(rows, "n string, t string, e boolean")
    o = C.outcome(F.col("t").isNotNull(), F.col("t"), F.col("e"))
    got = df.select(C.tool_kind(F.col("n")), C.mcp_server(F.col("n")), o, C.denied_by(o, F.col("t")), C.denial_reason(o, F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("mcp", "files", "denied", "user", None), ("mcp", None, "denied", "classifier", "[A] b. c"), ("builtin", None, "error", None, None), ("builtin", None, "pending", None, None), ("mcp", None, "denied", "classifier", None)]


def test_rounding_follows_the_binary_value(spark):
    values = [2.675, 0.125, 1234.565, -0.005, 7.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(C.round_binary(F.col("v"), 2)).collect()]
    assert got == [round(v, 2) for v in values]


def test_normalising(spark):
    df = spark.createDataFrame([("run 0d9f1c2e-aaaa-bbbb-cccc-0123456789ab  at deadbeef1 5555 /tmp/x.y 12:30:01", "out \nShell cwd was reset to /x\nmore  \n\n")], "c string, r string")
    assert tuple(df.select(C.normalise_command(F.col("c")), C.normalise_result(F.col("r"))).first()) == ("run <UUID> at <HEX> <N> /tmp/<...> <TIME>", "out \nmore")


def test_memory_key(spark):
    paths = ["/h/.claude/projects/p/memory/a.md", "C:\\x\\.claude\\projects\\q\\memory\\b.md", "/h/.claude/projects/p/memory/sub/a.md", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(C.memory_key(F.col("p"))).collect()
    assert [r[0] for r in got] == ["p/a.md", "q/b.md", None, None]


def test_depths_in_cycles():
    """A cycle is cut once; what hangs on it is counted from there."""
    assert depths({"a": "b", "b": "c", "c": "a"}) == {"c": 0, "b": 1, "a": 2}
    assert depths({"s": "a", "a": "b", "b": "a", "t": "b", "u": "t"}) == {"b": 0, "a": 1, "s": 2, "t": 1, "u": 2}
    assert depths({"x": "x", "y": "x"}) == {"x": 0, "y": 1}


def test_unpasted_line_ends():
    assert unpasted("~~~\r\nx\r\n  ~~~ end\r\n$ a\rPS C:\\x> b") == "a\rb"
    assert unpasted("a ``` b\n ```\n~~~\n```\n~~~ c") == "a ``` b\n"


def test_only_queries_are_run(spark):
    from pyspark.errors import ParseException

    from tracewell.plans.engine import read_only

    good = ["SELECT 1", "(SELECT 1) UNION (SELECT 2)", "-- note\nWITH x AS (SELECT 1) SELECT * FROM x", "VALUES (1)", "FROM t SELECT *", "TABLE t", "SHOW TABLES", "DESCRIBE t", "EXPLAIN SELECT 1", "SELECT * FROM (WITH y AS (SELECT 2) SELECT * FROM y)"]
    bad = ["WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM (SELECT 1) q INSERT INTO t SELECT *", "INSERT INTO t VALUES (1)", "DROP TABLE t", "CREATE VIEW v AS SELECT 1", "SET a = 1", "CACHE TABLE t", "FROM t INSERT INTO a SELECT * INSERT INTO b SELECT *", "SELECT TRANSFORM(a) USING 'cat' FROM t", "BEGIN SELECT 1; END"]
    assert [q for q in good if not read_only(spark, q)] == [] and [q for q in bad if read_only(spark, q)] == []
    with pytest.raises(ParseException):
        read_only(spark, "(")


def test_mentions_of_names_inside_longer_ones(spark):
    from tracewell.operators.memory import mentions

    said = ["cat x/memory/a.md", "cat x/memory/aa.md x/memory/a.md", "cat x\\memory\\b.md.md b c.md", "ls /memory/", "cat a.md", None]
    calls = spark.createDataFrame([("f", i, f"t{i}", "Bash", json.dumps({"command": c}), None) for i, c in enumerate(said)], "file_path string, seq long, tool_use_id string, tool_name string, input string, ts timestamp")
    keys = spark.createDataFrame([("p/a.md",), ("p/b.md",), ("q/a.md",), ("p/c.md",), ("p/none.md",)], "key string")
    assert {r[0]: r[1] for r in mentions(calls, keys).collect()} == {"p/a.md": 2, "q/a.md": 2, "p/b.md": 1, "p/c.md": 1}
    assert mentions(calls, keys.limit(0)).count() == 0
