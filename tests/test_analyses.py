"""Analyses on hand-made tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions import refs
from tracewell.operators import denials, hygiene, mining, order, pending, recalls, review, salvage, text, topics
from tracewell.sources import lookup

T0 = datetime(2026, 1, 1)


def table(spark, kind, rows):
    """Rows given by some of a table's columns."""
    names = sorted({k for r in rows for k in r})
    types = {f.name: f.dataType.simpleString() for f in kind}
    return schema.conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {types[n]}" for n in names)), kind)


def calls(spark, *rows):
    return table(spark, schema.TOOL_CALLS, [{"tool_use_id": f"t{i}", "session_id": "s", "file_path": "/f", "seq": i, "ts": T0 + timedelta(minutes=i), "tool_name": "Bash", "is_sidechain": False, "source": "x", **r} for i, r in enumerate(rows)])


def events(spark, *rows):
    return table(spark, schema.EVENTS, [{"event_id": f"e{i}", "session_id": "s", "file_path": "/f", "seq": i, "ts": T0 + timedelta(minutes=i), "role": "user", "raw": "{}", "source": "claude_code", **r} for i, r in enumerate(rows)])


def sessions(spark, *rows):
    return table(spark, schema.SESSIONS, [{"session_id": "s", "file_path": "/f", "source": "claude_code", "started_at": T0, **r} for r in rows or [{}]])


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_followups(spark):
    d = {"outcome": "denied"}
    c = calls(
        spark,
        {"session_id": "a", "seq": 1, "input": "1", **d}, {"session_id": "a", "seq": 2, "input": "1"},
        {"session_id": "b", "seq": 1, "input": "1", **d}, {"session_id": "b", "seq": 2, "input": "2"},
        {"session_id": "c", "seq": 1, **d}, {"session_id": "c", "seq": 2, "tool_name": "Read"},
        {"session_id": "d", "seq": 1, **d},
        {"session_id": "e", "seq": 1, **d}, {"session_id": "e", "seq": 1, "tool_name": "Sibling"}, {"session_id": "e", "seq": 2, "input": "z"},
        {"session_id": None, "seq": 1, "tool_name": None, **d}, {"session_id": None, "seq": 2, "tool_name": None},
    )
    got = {(r["session_id"], r["followup_kind"]) for r in denials.denial_followups(c).collect()}
    assert got == {("a", "verbatim-retry"), ("b", "same-tool"), ("c", "other-tool"), ("d", "none"), ("e", "same-tool"), (None, "verbatim-retry")}


def test_compare_rounds_and_divides(spark):
    c = calls(spark, *[{"outcome": "pending", "session_id": f"s{i % 3}", "ts": T0 + timedelta(days=i % 2)} for i in range(8)], {"outcome": "pending", "ts": None, "source": None})
    day = lambda n: (T0 + timedelta(days=n), T0 + timedelta(days=n, hours=1))
    got = {r["name"]: r for r in hygiene.compare(c, day(0), day(1)).collect()}
    assert got["pending_tool_call"]["baseline_calls_per_session"] == round(4 / 3, 2) and got["pending_tool_call"]["tool_calls_percent_change"] == 0.0
    assert got["host_file_hunt"]["baseline_calls_per_session"] is None and got["host_file_hunt"]["tool_calls_percent_change"] is None
    assert values(hygiene.untimed(c, T0), "source", "tool_calls") == [(None, 1)] and hygiene.untimed(c).count() == 0
    assert values(hygiene.asymmetry(c, day(0), day(5)), "source", "baseline_tool_calls", "current_tool_calls") == [("x", 4, 0)]
    assert hygiene.audit(c).where("name = 'pending_tool_call'").first()["tool_calls"] == 9


def test_mining(spark):
    rows = []
    for s in range(4):
        rows += [{"session_id": f"s{s}", "outcome": "error", "result_text": "x: command not found", "input_summary": f"x {1000 + s}"}, {"session_id": f"s{s}", "outcome": "ok", "result_text": "42", "input_summary": f"answer /tmp/{s}"}, {"session_id": f"s{s}", "outcome": "ok", "result_text": "same", "input_summary": "git status"}, {"session_id": f"s{s}", "outcome": "error", "result_text": "Exit code 124"}]
    got = values(mining.nominate(calls(spark, *rows)), "signal", "sessions", "command", "stability", "sample_output")
    assert got == [("negative-fact", 4, "x 1000", None, "x: command not found"), ("stable-output", 4, "x 1000", 1.0, "x: command not found"), ("stable-output", 4, "answer /tmp/0", 1.0, "42")]
    first = mining.nominate(calls(spark, *rows)).first()
    assert first["draft"].startswith('"x 1000" returns the same result in 4 sessions between 2026-01-01T00:00:00 and 2026-01-01T00:12:00: ')
    assert mining.nominate(calls(spark, *rows), min_sessions=5).count() == 0


def test_salvage(spark):
    c = calls(spark, {"outcome": "ok", "session_id": "a"}, {"outcome": "note", "session_id": "a"}, {"outcome": "ok", "session_id": "a"}, {"outcome": "ok", "session_id": None}, {"outcome": "ok", "session_id": "b", "ts": None})
    acts = spark.createDataFrame([(T0 + timedelta(minutes=32, seconds=1),)], "ts timestamp")
    args = ({"k": F.col("outcome") == "ok"}, acts)
    got = salvage.nominations(c, F.col("outcome") == "note", *args, minutes=30)
    assert values(got, "tool_use_id", "failed_checks") == [("t2", ["session", "ledger"])]
    assert values(salvage.nominations(c, F.col("outcome") == "note", args[0], None), "tool_use_id") == [("t3",), ("t2",)]
    assert salvage.nominations(c, F.col("outcome") == "note", args[0], None, limit=1).count() == 1


def test_bounded_followups(spark):
    acts = spark.createDataFrame([("/f", "s", i, 0, f"item{i} tok#{i} " + "x" * (300 if i < 40 else 0)) for i in range(50)], "file_path string, session_id string, seq long, rank int, text string")
    asked = spark.createDataFrame([("r", "/f", "s", 2, "tok#1 tok#3 tok#45 2026-01-01 12345 plain"), ("q", "/f", None, 2, "tok#3")], "recall_id string, file_path string, session_id string, seq long, output string")
    got = {r["recall_id"]: r for r in recalls.followups(asked, acts).collect()}
    assert got["r"]["overlap_tokens"] == '["tok#3", "tok#45"]' and got["r"]["overlap_count"] == 2 and len(got["r"]["followup_text"]) == 8000 and got["r"]["followup_truncated"]
    assert got["q"]["followup_text"] is None and got["q"]["overlap_count"] == 0 and not got["q"]["followup_truncated"]


def test_terms(spark):
    said = "The API of my_var Foo-bar 0123abcdef deadbeef9 12345678-1234-1234-1234-123456789abc カタカナ 漢字 go Go UI xyz the"
    got = spark.createDataFrame([(said,)], "t string").select(text.tokens(F.col("t"))).first()[0]
    assert got == ["api", "foo-bar", "abcdef", "カタカナ", "漢字", "ui", "xyz"]


def test_prose(spark):
    rows = [("<system-reminder a=1>x\ny</system-reminder> hi ", "claude_code"), ("<user_info>i</user_info><user_query> a </user_query>b<user_query>c</user_query>", "cursor"), ("<rules>r</rules> t <rules>open", "cursor"), ("<environment_context>e</environment_context>z", "codex"), (None, None)]
    got = spark.createDataFrame(rows, "t string, s string").select(text.human_prose(F.col("t"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["hi", "a\nc", "t <rules>open", "z", ""]


@pytest.mark.parametrize("raw, yes", [('{"isCompactSummary": true}', True), ('{"isCompactSummary": "true"}', False), ('{"a": {"isCompactSummary": true}}', False), ("{bad isCompactSummary", False), (None, False), ('[{"isCompactSummary": true}]', False)])
def test_compaction(spark, raw, yes):
    assert spark.createDataFrame([(raw,)], "r string").select(text.compaction_summary(F.col("r"))).first()[0] is yes


def test_orphans_keep_document_frequency_global(spark):
    e = events(spark, {"file_path": "/a", "text": "zebra zebra zebra shared shared shared"}, {"file_path": "/b", "text": "shared shared shared quokka quokka quokka", "ts": None})
    s = sessions(spark, {"file_path": "/a", "session_id": "a"}, {"file_path": "/b", "session_id": "b", "started_at": T0 + timedelta(days=9), "entrypoint": "sdk-py"})
    got = text.orphans(e, s, min_human_chars=1, min_orphans=1, until=T0 + timedelta(days=1))
    assert values(got, "session_id", "orphan_terms", "n_unique", "orphan_density") == [("a", ["zebra"], 1, 1 / 6 * 1000)]
    assert text.orphans(e, s, min_human_chars=1, min_orphans=1, include_headless=True).count() == 2
    assert text.orphans(e, s, min_human_chars=1, min_orphans=1, reviewed=["a"]).count() == 0
    assert text.orphans(e, s, min_human_chars=1, min_orphans=1, reviewed=["a"], show_reviewed=True).first()["reviewed"]


def test_topics_turn_where_words_change(spark):
    one, two = "alpha bravo charlie", "delta echoes foxtrot"
    rows = [{"text": (one if i < 6 else two) + f" w{'abcdefghijkl'[i]}xyz", "seq": 2 * i} for i in range(12)] + [{"role": "assistant", "text": "sure", "seq": 2 * i + 1} for i in range(12)]
    others = [{"file_path": f"/o{i}", "session_id": f"o{i}", "text": "unrelated words here"} for i in range(9)]
    e = events(spark, *[{**r, "event_id": f"x{r['seq']}"} for r in rows], *[{**o, "event_id": o["session_id"]} for o in others])
    s = sessions(spark, {}, *[{"file_path": o["file_path"], "session_id": o["session_id"]} for o in others])
    ex = topics.exchanges(e, s, "s")
    v = topics.vectors(ex, text.idf(*text.session_prose(e, s)))
    bounds = topics.boundaries(topics.similarities(ex, v))
    assert values(bounds, "gap") == [(6,)]
    got = topics.segments(ex, v, bounds, 3).orderBy("start")
    assert values(got, "start", "end", "n_exchanges", "terms") == [(0, 5, 6, ["alpha", "bravo", "charlie"]), (6, 11, 6, ["delta", "echoes", "foxtrot"])]


SUMMARY = "1. Work Done Here:\n - a\n2. Pending Tasks:\n - fix own/repo#5\n - do it, deferred (#7)\n - talk\n"


def test_pending_states(spark):
    e = events(spark, {"text": SUMMARY, "raw": '{"isCompactSummary": true}'}, {"text": "old", "raw": '{"isCompactSummary": true}', "ts": T0 - timedelta(days=1)}, {"type": "ai-title", "text": "My title"})
    s = sessions(spark, {"project_dir": "p"})
    got = pending.pending_items(e, s, repo=("d", "e"))
    assert values(got, "item", "deferred", "status", "title") == [("fix own/repo#5", False, "unchecked", "My title"), ("do it, deferred (#7)", True, "unchecked", "My title"), ("talk", False, "unreferenced", "My title")]
    answers = {"repos/own/repo/issues/5": (True, {"state": "closed", "pull_request": {"merged_at": "x"}}, ""), "repos/d/e/issues/7": (False, None, "no")}
    states = lookup.look_up(spark, pending.asked(got), lambda a: answers[a[2]])
    done = pending.pending_items(e, s, repo=("d", "e"), states=states)
    assert values(done, "status") == [("resolved",), ("unknown",), ("unreferenced",)]
    assert values(pending.counts(done), "status", "items") == [("open", 0), ("resolved", 1), ("unreferenced", 1), ("unknown", 1), ("unchecked", 0)]
    assert pending.without_section(e, s, True).count() == 1
    assert lookup.repositories("o", lambda a: (True, [{"name": "r"}], "")) == ["r"] and lookup.repositories("o", lambda a: (False, None, "")) is None
    assert not lookup.gh(["no-such-program"])[0] and set(refs.STATUSES) >= {"open"}


def test_outputs_confirmed(spark):
    link = "https://github.com/Me/Repo/pull/{} https://docs.google.com/document/d/AbC/edit"
    c = calls(spark, {"result_text": link.format(1)}, {"result_text": link.format(2)}, {"result_text": "github.com/other/x/issues/3"}, {"result_text": link.format(1), "ts": None})
    apps = review.appearances(review.links(c))
    assert review.infer_owner(apps) == "me"
    outs = review.outputs(apps, ["me"])
    assert values(outs, "url", "kind") == [("https://docs.google.com/document/d/AbC", "drive_document"), ("https://github.com/me/repo/pull/1", "pr"), ("https://github.com/me/repo/pull/2", "pr")]
    made = {1: "2026-01-01T00:00:30Z", 2: "2025-12-01T00:00:00Z"}
    known = lookup.look_up(spark, [("me", "repo", 1), ("me", "repo", 2)], lambda a: (True, {"created_at": made[int(a[2].rsplit("/", 1)[1])], "user": {"login": "u"}}, ""))
    assert sorted(values(review.confirm(outs, known), "number", "status", "kind"), key=str) == [(1, "confirmed", "issue"), (2, "outside", "issue"), (None, "unchecked", "drive_document")]
    assert values(review.counters(apps, ["me"]), "what", "source", "n") == [("references", "x", 1)]


def test_buckets_have_no_gaps(spark):
    e = events(spark, {"text": "hello there", "ts": datetime(2026, 3, 31, 23, 30)})
    s = sessions(spark, {"started_at": datetime(2026, 1, 15)})
    got = review.buckets(e, s, calls(spark, {"result_text": "none"}), zone="Europe/Berlin")
    assert values(got, "label", "sessions", "human_chars") == [("2026-01", 1, 0), ("2026-02", 0, 0), ("2026-03", 0, 0), ("2026-04", 0, 11)]
    assert review.buckets(e, s, calls(spark, {"result_text": "none"}), bucket="week", zone="UTC").count() == 12
    with pytest.raises(ValueError):
        review.bucket_start(F.lit(T0), "day", "UTC")


def test_depth_by_file(spark):
    e = events(spark, {"event_id": "a"}, {"event_id": "b", "parent_uuid": "a"}, {"event_id": "b", "parent_uuid": None}, {"event_id": "a", "file_path": "/g", "parent_uuid": "b"})
    assert sorted(values(order.with_depth(e), "file_path", "event_id", "depth")) == [("/f", "a", 0), ("/f", "b", 1), ("/f", "b", 1), ("/g", "a", 0)]


def test_contained(spark):
    long_, far = "ab-" * 30, "x" * 1020 + "needle" + "y" * 3000 + "abcd" * 20
    texts = ["the frobnicator's", "Frob-x UPPERcase", "日本語とカタカナー", far, "q" + long_ + "z", None, "", "a_b-c9", "k" * 60]
    terms = ["frob", "nicator", "frobnicators", "per", "case", "upper", "日本", "本語", "カタカ", "タカナー", "needle", "needley", "needleyz", "yabcd", "abcd" * 13, "abcd" * 21, long_, long_ + "z", long_ + "zz", "b-c9", "c9", "kk", "k" * 48, "k" * 49, "k" * 61, "zzzz"]
    got = text.contained(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t, 1) for t in texts + texts], "text string, key int"))
    assert sorted(r[0] for r in got.collect()) == sorted(t for t in terms if any(t in (x or "") for x in texts))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([], "text string")
    assert text.contained(spark.createDataFrame([("abc",)], "term string"), empty).count() == 0
