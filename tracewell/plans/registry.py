"""All queries of the engine, by operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C
from ..operators import denials, hygiene, memory, mining, order, pending, recalls, review, salvage, search, text, topics, trace
from ..sources import codex, cursor, opencode, session_log
from ..sources.lines import read_lines
from . import store
from .proxies import CALLS, TALK, bare_times, calls, log_lines, read, talk, talk_sessions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return bare_times(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FOLLOW = f"""WITH {CALLS},
heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY tool_use_id) AS n FROM tool_calls) WHERE n = 1),
following AS (SELECT session_id, seq, lead(seq) OVER w AS next_seq, lead(tool_name) OVER w AS next_tool_name, lead(input) OVER w AS next_input, lead(input_summary) OVER w AS next_input_summary,
  lead(outcome) OVER w AS next_outcome, lead(ts) OVER w AS next_ts FROM heads WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
denial_followups AS (SELECT d.session_id, d.seq, d.ts, d.tool_name, d.input_summary, f.next_tool_name, f.next_input_summary, f.next_outcome, f.next_ts,
  (floor(epoch_us(f.next_ts) / 1000.0) - floor(epoch_us(d.ts) / 1000.0)) / 1000.0 AS gap_seconds,
  CASE WHEN f.next_seq IS NULL THEN 'none' WHEN d.tool_name = f.next_tool_name AND d.input = f.next_input THEN 'verbatim-retry' WHEN d.tool_name = f.next_tool_name THEN 'same-tool' ELSE 'other-tool' END AS followup_kind
  FROM tool_calls d JOIN following f ON f.session_id = d.session_id AND f.seq = d.seq WHERE d.outcome = 'denied')
"""
_FOLLOW = ("session_id", "seq", "ts", "tool_name", "input_summary", "next_tool_name", "next_input_summary", "next_outcome", "next_ts", "gap_seconds", "followup_kind")


@query(FOLLOW + "SELECT session_id, seq, ts, tool_name, input_summary, next_tool_name, next_input_summary, next_outcome, next_ts, CAST(gap_seconds AS DOUBLE) AS gap_seconds, followup_kind FROM denial_followups")
def denial_followups(spark, d):
    """What followed each denied call."""
    return denials.denial_followups(calls(spark, d)).select(*_FOLLOW)


@query(FOLLOW + "SELECT followup_kind, count(*) AS n FROM denial_followups GROUP BY followup_kind")
def followup_kind_counts(spark, d):
    return denials.denial_followups(calls(spark, d)).groupBy("followup_kind").agg(F.count("*").alias("n"))


@query(FOLLOW + "SELECT session_id, seq, ts, followup_kind FROM denial_followups ORDER BY ts DESC NULLS LAST, session_id, seq DESC LIMIT 50")
def denials_newest(spark, d):
    """The report's order and limit."""
    return denials.newest(denials.denial_followups(calls(spark, d)), limit=50).select("session_id", "seq", "ts", "followup_kind")


@query(f"""WITH {CALLS} SELECT tool_use_id, CASE WHEN event_type LIKE 'mcp__%' THEN 'mcp' ELSE 'builtin' END AS tool_kind, outcome,
 CASE WHEN k < 10 THEN 'user' WHEN k < 20 THEN 'classifier' END AS denied_by, CASE WHEN k >= 10 AND k < 20 THEN 'rule ' || CAST(k % 3 AS VARCHAR) END AS denial_reason FROM tool_calls""")
def call_verdicts(spark, d):
    """Verdicts of calls read from log lines (a pending call has no result)."""
    got = session_log.tool_calls(session_log.records(log_lines(spark, d)))
    return got.select(F.substring("tool_use_id", 2, 20).alias("tool_use_id"), "tool_kind", "outcome", "denied_by", "denial_reason")


@query(f"""WITH {CALLS} SELECT 't' || tool_use_id AS tool_use_id, session_id, file_path, event_id * 2 + 1 AS seq, ts, tool_name, '{{"command": ' || CAST(k AS VARCHAR) || '}}' AS input,
 '{{"command":' || CAST(k AS VARCHAR) || '}}' AS input_summary, outcome = 'error' AS is_error, result_text, CASE WHEN outcome <> 'pending' THEN k * 250 ELSE -1 END AS duration_ms FROM tool_calls""")
def ingest_tool_calls(spark, d):
    """Log lines to tool calls."""
    got = session_log.tool_calls(session_log.records(log_lines(spark, d)))
    return got.select("tool_use_id", "session_id", "file_path", "seq", "ts", "tool_name", "input", "input_summary", "is_error", "result_text", F.coalesce("duration_ms", F.lit(-1).cast("long")).alias("duration_ms"))


@query(f"""WITH {CALLS}, once AS (SELECT file_path, floor(event_id / 3) AS r, min(event_id) AS event_id FROM tool_calls GROUP BY 1, 2)
SELECT o.file_path, CAST(sum(c.k) AS BIGINT) AS input_tokens, CAST(sum(c.k * 2) AS BIGINT) AS output_tokens FROM once o JOIN tool_calls c ON c.event_id = o.event_id GROUP BY o.file_path""")
def ingest_tokens_dedup(spark, d):
    """A1: a request's usage counts once."""
    return session_log.usage_totals(session_log.records(log_lines(spark, d))).select("file_path", "input_tokens", "output_tokens")


@query(f"""WITH {CALLS} SELECT 't' || tool_use_id AS tool_use_id, last_value(CASE WHEN event_id % 5 = 0 THEN 'mode' || CAST(event_id % 3 AS VARCHAR) END IGNORE NULLS)
 OVER (PARTITION BY file_path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS permission_mode FROM tool_calls""")
def permission_carry(spark, d):
    """The mode in force at each call."""
    return session_log.tool_calls(session_log.records(log_lines(spark, d))).select("tool_use_id", "permission_mode")


@query(f"""WITH {CALLS} SELECT 'u' || tool_use_id AS event_id, 0 AS depth FROM tool_calls UNION ALL SELECT 'v' || tool_use_id, 1 FROM tool_calls WHERE outcome <> 'pending'""")
def ingest_depth(spark, d):
    """Depth in the tree of events."""
    return session_log.events(session_log.records(log_lines(spark, d))).select("event_id", "depth")


@query(f"""WITH {CALLS}, lines AS (SELECT file_path, ts, tool_use_id FROM tool_calls UNION ALL SELECT file_path, ts + to_milliseconds(k * 250), NULL FROM tool_calls WHERE outcome <> 'pending')
SELECT file_path, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events, count(tool_use_id) AS n_tool_calls FROM lines GROUP BY file_path""")
def session_rollup(spark, d):
    """A2: sessions of log files."""
    return session_log.sessions(session_log.records(log_lines(spark, d))).select("file_path", "started_at", "ended_at", "n_events", "n_tool_calls")


@query(f"WITH {CALLS} SELECT source, count(*) AS tool_calls, count(DISTINCT session_id) AS sessions FROM tool_calls GROUP BY source")
def coverage_by_source(spark, d):
    """A5."""
    return hygiene.coverage(calls(spark, d))


COMMANDS = ("cd /x && cat notes", "bash -lc 'rg needle src'", "curl -s http://localhost:8765/mcp", "companion status --json", "echo done; sed -n 1p f", "ls -la", "curl -d http://localhost:8765 https://example.com")
CATEGORY = ("host_file_hunt", "host_file_hunt", "raw_local_mcp_http", "companion_status_poll", "host_file_hunt", None, None)


def _shell_calls(spark, d):
    pick = F.array(*map(F.lit, COMMANDS))[(F.col("tool_use_id").cast("long") % len(COMMANDS)).cast("int")]
    c = calls(spark, d).withColumn("tool_name", F.when(F.col("tool_use_id").cast("long") % 2 == 0, "Bash").otherwise("mcp__files__undo_file_edit"))
    return c.withColumn("input", F.to_json(F.struct(pick.alias("command"))))


_CASE = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORY) if c) + " END"
_HABITS = f"""{CALLS}, habits AS (SELECT session_id, ts, {_CASE} AS name FROM tool_calls WHERE event_id % 2 = 0 UNION ALL SELECT session_id, ts, 'undo_file_edit' FROM tool_calls WHERE event_id % 2 = 1
 UNION ALL SELECT session_id, ts, 'pending_tool_call' FROM tool_calls WHERE outcome = 'pending')"""
_NAMES = "(VALUES ('companion_status_poll'), ('host_file_hunt'), ('raw_local_mcp_http'), ('undo_file_edit'), ('pending_tool_call')) AS v(name)"


@query(f"WITH {_HABITS} SELECT v.name, count(h.name) AS tool_calls, count(DISTINCT h.session_id) AS sessions FROM {_NAMES} LEFT JOIN habits h ON h.name = v.name GROUP BY v.name")
def hygiene_counts(spark, d):
    """Habits of shell commands."""
    return hygiene.audit(_shell_calls(spark, d))


def _half(spark, d):
    """The middle of the calls' time, to the whole second."""
    ends = calls(spark, d).agg(F.min("ts"), F.max("ts")).first()
    return ends[0], (ends[0] + (ends[1] - ends[0]) / 2).replace(microsecond=0), ends[1]


@query(f"""WITH {_HABITS}, ends AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM tool_calls), mid AS (SELECT CAST(floor((a + z) / 2 / 1000000.0) AS BIGINT) AS m FROM ends),
b AS (SELECT name, count(*) AS n, count(DISTINCT session_id) AS s FROM habits, mid WHERE epoch_us(ts) <= m * 1000000 GROUP BY name), c AS (SELECT name, count(*) AS n, count(DISTINCT session_id) AS s FROM habits, mid WHERE epoch_us(ts) >= m * 1000000 GROUP BY name)
SELECT v.name, coalesce(b.n, 0) AS baseline_tool_calls, coalesce(c.n, 0) AS current_tool_calls, coalesce(b.s, 0) AS baseline_sessions, coalesce(c.s, 0) AS current_sessions, coalesce(c.n, 0) - coalesce(b.n, 0) AS tool_calls_change, coalesce(c.s, 0) - coalesce(b.s, 0) AS sessions_change
FROM {_NAMES} LEFT JOIN b ON b.name = v.name LEFT JOIN c ON c.name = v.name""")
def compare_periods(spark, d):
    """Two periods side by side (ratios are tested apart, as engines round apart)."""
    a, m, z = _half(spark, d)
    got = hygiene.compare(_shell_calls(spark, d), (a, m), (m, z))
    return got.select("name", "baseline_tool_calls", "current_tool_calls", "baseline_sessions", "current_sessions", "tool_calls_change", "sessions_change")


_RATE = "CASE WHEN {d} <> 0 THEN CAST(format('{{:.2f}}', {n} / CAST({d} AS DOUBLE){x}) AS DOUBLE) END"


@query(f"""WITH {_HABITS}, ends AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM tool_calls), mid AS (SELECT CAST(floor((a + z) / 2 / 1000000.0) AS BIGINT) AS m FROM ends),
b AS (SELECT name, count(*) AS n, count(DISTINCT session_id) AS s FROM habits, mid WHERE epoch_us(ts) <= m * 1000000 GROUP BY name), c AS (SELECT name, count(*) AS n, count(DISTINCT session_id) AS s FROM habits, mid WHERE epoch_us(ts) >= m * 1000000 GROUP BY name),
r AS (SELECT v.name, coalesce(b.n, 0) AS bn, coalesce(c.n, 0) AS cn, coalesce(b.s, 0) AS bs, coalesce(c.s, 0) AS cs FROM {_NAMES} LEFT JOIN b ON b.name = v.name LEFT JOIN c ON c.name = v.name)
SELECT name, {_RATE.format(n="bn", d="bs", x="")} AS baseline_calls_per_session, {_RATE.format(n="cn", d="cs", x="")} AS current_calls_per_session, {_RATE.format(n="(cn - bn)", d="bn", x=" * 100")} AS tool_calls_percent_change FROM r""")
def period_ratios(spark, d):
    """Ratios of the two periods, rounded by their binary values."""
    a, m, z = _half(spark, d)
    got = hygiene.compare(_shell_calls(spark, d), (a, m), (m, z))
    return got.select("name", "baseline_calls_per_session", "current_calls_per_session", "tool_calls_percent_change")


@query(f"""WITH {CALLS}, ends AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM tool_calls), mid AS (SELECT CAST(floor((a + z) / 2 / 1000000.0) AS BIGINT) * 1000000 AS m FROM ends),
days AS (SELECT strftime(ts, '%Y-%m-%d') AS source, count(*) FILTER (epoch_us(ts) <= m) AS b, count(*) FILTER (epoch_us(ts) >= m) AS c FROM tool_calls, mid GROUP BY 1)
SELECT source, b AS baseline_tool_calls, c AS current_tool_calls FROM days WHERE b = 0 OR c = 0""")
def period_asymmetry(spark, d):
    """Sources with calls in one period only; days stand in for sources."""
    a, m, z = _half(spark, d)
    return hygiene.asymmetry(calls(spark, d).withColumn("source", F.date_format("ts", "yyyy-MM-dd")), (a, m), (m, z))


@query(f"WITH {CALLS} SELECT source, count(*) AS tool_calls FROM tool_calls WHERE outcome = 'error' GROUP BY source")
def untimed_calls(spark, d):
    """Calls without a time that a window drops; failed calls have none here."""
    c = calls(spark, d)
    return hygiene.untimed(c.withColumn("ts", F.when(F.col("outcome") != "error", F.col("ts"))), since=_half(spark, d)[1])


@query(f"""WITH {CALLS}, ev AS (SELECT 'failed' AS kind, * FROM tool_calls WHERE outcome = 'error' UNION ALL SELECT 'shell', * FROM tool_calls WHERE tool_name = 'Bash'),
notes AS (SELECT session_id, max(ts) AS t FROM tool_calls WHERE outcome = 'pending' GROUP BY session_id)
SELECT kind, tool_use_id, session_id, ts, substr(input_summary, 1, 200) AS snippet FROM ev e WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.session_id = e.session_id AND n.t >= e.ts) ORDER BY ts DESC, kind, tool_use_id LIMIT 50""")
def salvage_newest(spark, d):
    """The report's order and limit, with two signals that may meet in one call."""
    signals = {"failed": F.col("outcome") == "error", "shell": F.col("tool_name") == "Bash"}
    return salvage.nominations(calls(spark, d), F.col("outcome") == "pending", signals).select("kind", "tool_use_id", "session_id", "ts", "snippet")


@query(f"""WITH {CALLS}, ev AS (SELECT * FROM tool_calls WHERE outcome = 'error'), notes AS (SELECT session_id, max(ts) AS t FROM tool_calls WHERE outcome = 'pending' GROUP BY session_id),
acts AS (SELECT epoch_us(ts) AS a FROM tool_calls WHERE outcome = 'denied' AND tool_name = 'Bash')
SELECT e.tool_use_id, e.session_id, e.ts FROM ev e WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.session_id = e.session_id AND n.t >= e.ts)
 AND NOT EXISTS (SELECT 1 FROM acts WHERE a >= epoch_us(e.ts) AND a <= epoch_us(e.ts) + 1800000000)""")
def salvage_uncovered(spark, d):
    """Evidence without a note, by a range join on slices of time."""
    c = calls(spark, d)
    acts = c.where("outcome = 'denied' AND tool_name = 'Bash'").select("ts")
    ev = salvage.evidence(c, {"failed": F.col("outcome") == "error"})
    return salvage.uncovered(ev, c.where("outcome = 'pending'"), acts).select("tool_use_id", "session_id", "ts")


@query(f"WITH {CALLS} SELECT 'tool_calls' AS name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM tool_calls UNION ALL SELECT 'sessions', count(DISTINCT session_id), NULL, NULL FROM tool_calls")
def table_counts(spark, d):
    """A25, U1."""
    c = calls(spark, d)
    ids = trace.session_ids(c.select("session_id"), c).agg(F.lit("sessions").alias("name"), F.count("*").alias("n"), F.lit(None).cast("timestamp").alias("first_ts"), F.lit(None).cast("timestamp").alias("last_ts"))
    return c.agg(F.lit("tool_calls").alias("name"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).unionByName(ids)


@query("WITH " + TALK + ", u AS (SELECT file_path, seq, text FROM talk WHERE role = 'user') SELECT file_path, seq, text AS prose FROM u")
def human_prose(spark, d):
    """Blocks that tools put around a person's words go."""
    t = talk(spark, d).where("role = 'user'")
    wrapped = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("<system-reminder>skip\nthis</system-reminder>\n"), "text")).otherwise(F.concat(F.lit("<user_info>x</user_info><user_query>"), "text", F.lit("</user_query>")))
    source = F.when(F.col("seq") % 2 == 0, "claude_code").otherwise("cursor")
    return t.select("file_path", "seq", text.human_prose(wrapped, source).alias("prose"))


@query()
def term_df(spark, d):
    """Document frequency of terms (the tokenizer's lookarounds have no SQL twin)."""
    _, terms = text.session_prose(talk(spark, d), talk_sessions(spark, d))
    return text.document_frequency(terms)


@query()
def term_idf(spark, d):
    """A12."""
    return text.idf(*text.session_prose(talk(spark, d), talk_sessions(spark, d)))


@query()
def orphans(spark, d):
    """Sessions with terms of their own, against a sink."""
    sink = read(spark, d, "benchmark").select(F.lower("text").alias("text"))
    return text.orphans(talk(spark, d), talk_sessions(spark, d), sink, min_tf=1, min_human_chars=0, min_orphans=1, limit=0)


@query("WITH " + TALK + """, r AS (SELECT * FROM talk WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0),
n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS x FROM r)
SELECT session_id, CAST(x AS BIGINT) AS exchange, min(seq) AS seq, string_agg(text, chr(10) ORDER BY seq) AS text FROM n WHERE x >= 0 GROUP BY session_id, x""")
def exchanges(spark, d):
    """R6, J3."""
    return topics.exchanges(talk(spark, d), talk_sessions(spark, d)).select("session_id", "exchange", "seq", "text")


def _topics(spark, d, window=1):
    t, s = talk(spark, d), talk_sessions(spark, d)
    ex = topics.exchanges(t, s)
    v = topics.vectors(ex, text.idf(*text.session_prose(t, s)))
    return ex, v, topics.similarities(ex, v, window)


@query()
def topic_similarity(spark, d):
    """A13, W4."""
    return _topics(spark, d)[2]


@query()
def topic_segments(spark, d):
    """R9, W5, T6, J18."""
    ex, v, sims = _topics(spark, d)
    return topics.segments(ex, v, topics.boundaries(sims, 1))


@query()
def themes_by_bucket(spark, d):
    """A22, P46, R10."""
    return review.theme_report(talk(spark, d), talk_sessions(spark, d), bucket="month", top=10)


@query("WITH " + TALK + """, u AS (SELECT date_trunc('month', ts) AS m, length(text) AS n FROM talk WHERE role = 'user'), s AS (SELECT session_id, date_trunc('month', min(ts)) AS m FROM talk GROUP BY session_id),
a AS (SELECT unnest(generate_series((SELECT min(m) FROM s), (SELECT max(m) FROM s), INTERVAL 1 MONTH)) AS m)
SELECT CAST(a.m AS TIMESTAMP) AS start, (SELECT count(*) FROM s WHERE s.m = a.m) AS sessions, CAST(coalesce((SELECT sum(n) FROM u WHERE u.m = a.m), 0) AS BIGINT) AS human_chars FROM a""")
def review_buckets(spark, d):
    """Months without gaps."""
    none = schema.empty(spark, "tool_calls")
    return review.buckets(talk(spark, d), talk_sessions(spark, d), none, owners=[]).select("start", "sessions", "human_chars")


def _linked_calls(spark, d):
    e = F.col("tool_use_id").cast("long")
    link = F.concat(F.lit("see https://GitHub.com/Own"), (e % 3).cast("string"), F.lit("/Repo/"), F.when(e % 4 == 0, "pull").otherwise("issues"), F.lit("/"), (e % 40).cast("string"), F.lit(" done"))
    return calls(spark, d).withColumn("result_text", F.when(e % 2 == 0, link).otherwise(F.col("result_text")))


_LINKS = f"""{CALLS}, links AS (SELECT 'own' || CAST(event_id % 3 AS VARCHAR) AS owner, event_id % 40 AS number, event_id % 4 = 0 AS pull, ts, tool_use_id, session_id, source FROM tool_calls WHERE event_id % 2 = 0)"""


@query(f"""WITH {_LINKS}, n AS (SELECT *, row_number() OVER (PARTITION BY owner, number ORDER BY ts, tool_use_id) AS r, bool_or(pull) OVER (PARTITION BY owner, number) AS pr FROM links WHERE owner = 'own0')
SELECT 'https://github.com/' || owner || '/repo/' || CASE WHEN pr THEN 'pull/' ELSE 'issues/' END || CAST(number AS VARCHAR) AS url, number, ts AS first_seen, session_id, source FROM n WHERE r = 1""")
def outputs_first_seen(spark, d):
    """The first call that shows each output."""
    apps = review.appearances(review.links(_linked_calls(spark, d)))
    return review.outputs(apps, ["own0"]).select("url", "number", "first_seen", "session_id", "source")


@query(f"""WITH {_LINKS}, n AS (SELECT *, row_number() OVER (PARTITION BY owner, number ORDER BY ts, tool_use_id) AS r FROM links)
SELECT 'references' AS what, source, count(*) AS n FROM n WHERE r = 1 AND owner <> 'own0' GROUP BY source""")
def reference_counts(spark, d):
    """A20."""
    return review.counters(review.appearances(review.links(_linked_calls(spark, d))), ["own0"])


_NEG = f"""{CALLS}, rows AS (SELECT *, CASE WHEN outcome = 'error' THEN result_text END AS result FROM tool_calls WHERE tool_name = 'Bash' AND NOT is_sidechain)"""


@query(f"""WITH {_NEG}, f AS (SELECT *, row_number() OVER (PARTITION BY result, session_id ORDER BY ts, file_path, seq, tool_use_id) AS n FROM rows WHERE result IS NOT NULL)
SELECT result AS sample_output, count(*) AS sessions, min(ts) AS first_seen, max(ts) AS last_seen FROM f WHERE n = 1 GROUP BY result HAVING count(*) >= 3""")
def negative_facts(spark, d):
    """A8, P37, P39."""
    return mining.negative_facts(calls(spark, d)).select("sample_output", "sessions", "first_seen", "last_seen")


@query(f"""WITH {CALLS}, f AS (SELECT *, coalesce(rtrim(result_text), '') AS result, row_number() OVER (PARTITION BY input_summary, session_id ORDER BY ts, file_path, seq, tool_use_id) AS n FROM tool_calls WHERE tool_name = 'Bash' AND NOT is_sidechain),
g AS (SELECT input_summary, result, count(*) AS c, min(ts) AS t FROM f WHERE n = 1 GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY input_summary ORDER BY c DESC, t) AS r, sum(c) OVER (PARTITION BY input_summary) AS s FROM g)
SELECT input_summary AS command, CAST(s AS BIGINT) AS sessions, CAST(c / s AS DOUBLE) AS stability, result AS sample_output FROM m WHERE r = 1 AND s >= 3 AND c / s >= 0.1 AND result <> ''""")
def stable_outputs(spark, d):
    """A9, P38."""
    return mining.stable_outputs(calls(spark, d), min_stability=0.1).select("command", "sessions", "stability", "sample_output")


@query(f"""WITH {_NEG}, nf AS (SELECT *, row_number() OVER (PARTITION BY result, session_id ORDER BY ts, file_path, seq, tool_use_id) AS n FROM rows WHERE result IS NOT NULL),
f AS (SELECT *, coalesce(rtrim(result_text), '') AS answer, row_number() OVER (PARTITION BY input_summary, session_id ORDER BY ts, file_path, seq, tool_use_id) AS n FROM tool_calls WHERE tool_name = 'Bash' AND NOT is_sidechain),
g AS (SELECT input_summary, answer, count(*) AS c, min(ts) AS t FROM f WHERE n = 1 GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY input_summary ORDER BY c DESC, t) AS r, sum(c) OVER (PARTITION BY input_summary) AS s, min(t) OVER (PARTITION BY input_summary) AS first_seen FROM g),
u AS (SELECT 'negative-fact' AS signal, count(*) AS sessions, result AS sample_output, first(input_summary ORDER BY ts, file_path, seq, tool_use_id) AS command, min(ts) AS first_seen FROM nf WHERE n = 1 GROUP BY result HAVING count(*) >= 3
 UNION ALL SELECT 'stable-output', CAST(s AS BIGINT), answer, input_summary, first_seen FROM m WHERE r = 1 AND s >= 3 AND c / s >= 0.1 AND answer <> '')
SELECT CAST(row_number() OVER (ORDER BY signal, sessions DESC, first_seen NULLS LAST, sample_output, command) AS INTEGER) AS place, signal, sessions, command, sample_output FROM u""")
def nominated(spark, d):
    """Both kinds of signals in the report's order, which ``place`` tells."""
    got = mining.nominate(calls(spark, d), min_stability=0.1)
    got = got.withColumn("at", F.monotonically_increasing_id())
    return got.select(F.row_number().over(W.orderBy("at")).alias("place"), "signal", "sessions", "command", "sample_output")


@query(f"WITH {_LINKS}, kept AS (SELECT * FROM links WHERE owner <> 'own0' OR number >= 10) SELECT owner FROM kept GROUP BY owner ORDER BY count(DISTINCT number) DESC, owner LIMIT 1")
def owner_inferred(spark, d):
    """The owner of most keys; two of three tie, and the first by name has fewer."""
    e = F.col("tool_use_id").cast("long")
    kept = _linked_calls(spark, d).where((e % 3 != 0) | (e % 40 >= 10))
    return spark.createDataFrame([(review.infer_owner(review.appearances(review.links(kept))),)], "owner string")


def _memory_calls(spark, d):
    e = F.col("tool_use_id").cast("long")
    path = F.concat(F.lit("/home/x/.claude/projects/p"), (e % 4).cast("string"), F.lit("/memory/note"), (e % 30).cast("string"), F.lit(".md"))
    return calls(spark, d).withColumns({"tool_name": F.when(e % 3 == 0, "Write").otherwise("Edit"), "input": F.to_json(F.struct(path.alias("file_path")))})


def _memory_events(spark, d):
    e = F.col("tool_use_id").cast("long")
    made = calls(spark, d).select(F.col("tool_use_id").alias("event_id"), "file_path", F.when(e % 7 == 0, F.lit("<synthetic>")).otherwise(F.concat(F.lit("m"), (e % 3).cast("string"))).alias("model"))
    return schema.conform(made, schema.EVENTS)


_MEM = f"""{CALLS}, w AS (SELECT 'p' || CAST(event_id % 4 AS VARCHAR) || '/note' || CAST(event_id % 30 AS VARCHAR) || '.md' AS key, event_id % 3 = 0 AS made, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'm' || CAST(event_id % 3 AS VARCHAR) END AS model, ts,
 row_number() OVER (PARTITION BY event_id % 4, event_id % 30 ORDER BY ts, file_path, seq, tool_use_id) AS n FROM tool_calls WHERE outcome = 'ok')"""


@query(f"WITH {_MEM} SELECT key, max(CASE WHEN n = 1 THEN CASE WHEN made THEN model ELSE 'unknown' END END) AS created_by, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_writes FROM w GROUP BY key")
def memory_files(spark, d):
    """P40, P41, J5, A16."""
    return memory.files(_memory_calls(spark, d), _memory_events(spark, d)).select("key", "created_by", "first_ts", "last_ts", "n_writes")


@query(f"""WITH {_MEM}, c AS (SELECT CASE WHEN made THEN model ELSE 'unknown' END AS model, count(*) AS n FROM w WHERE n = 1 GROUP BY 1), t AS (SELECT model, count(*) AS n, count(DISTINCT key) AS k FROM w GROUP BY model)
SELECT coalesce(c.model, t.model) AS model, coalesce(c.n, 0) AS files_created, coalesce(t.n, 0) AS writes, coalesce(t.k, 0) AS files_touched FROM c FULL JOIN t ON c.model = t.model""")
def memory_models(spark, d):
    """A17."""
    return memory.models(_memory_calls(spark, d), _memory_events(spark, d))


@query(f"""WITH {_MEM}, scanned AS (SELECT DISTINCT 'p' || CAST(event_id % 5 AS VARCHAR) || '/note' || CAST(event_id % 30 AS VARCHAR) || '.md' AS key FROM tool_calls)
SELECT key FROM scanned WHERE key NOT IN (SELECT key FROM w)""")
def memory_unattributed(spark, d):
    """Files on disk that no successful write explains."""
    e = F.col("tool_use_id").cast("long")
    scanned = calls(spark, d).select(F.concat(F.lit("p"), (e % 5).cast("string"), F.lit("/note"), (e % 30).cast("string"), F.lit(".md")).alias("key")).distinct()
    return memory.unattributed(_memory_calls(spark, d), scanned)


@query()
def recall_overlap(spark, d):
    """What a recall's answer left in the talk after it."""
    t = talk(spark, d)
    acts = t.select("file_path", "session_id", "seq", F.struct(F.lit(0).alias("k"), F.col("event_id").alias("id")).alias("rank"), "text")
    asked = t.where("seq = 1").select(F.col("event_id").alias("recall_id"), "file_path", "session_id", "seq", F.concat("text", F.lit(" ref#12 a/b.py")).alias("output"))
    return recalls.followups(asked, acts).drop("output")


@query("WITH " + TALK + r""" SELECT session_id, seq, CAST(strpos(text, 'th') - 1 AS BIGINT) AS first FROM talk WHERE role = 'user' AND contains(text, 'th')""")
def grep_events(spark, d):
    """The place of the first match."""
    t = talk(spark, d).where("role = 'user'")
    hits = t.withColumn("offsets", search.matches(F.col("text"), "t(?=h)h")).where("size(offsets) > 0")
    return hits.select("session_id", "seq", F.col("offsets")[0]["start"].cast("long").alias("first"))


@query("WITH " + TALK + " SELECT session_id || ':' || CAST(seq AS VARCHAR) AS id, text FROM talk ORDER BY ts DESC, session_id DESC, id DESC LIMIT 20")
def grep_newest(spark, d):
    """The newest hits."""
    return search.search(talk(spark, d), None, ".", include_meta=True).select("id", "text")


@query("WITH " + TALK + " SELECT session_id, seq, role, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS excerpt, length(text) > 40 AS truncated, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM talk WHERE text <> ''")
def session_trace(spark, d):
    """Timelines of all sessions."""
    none = schema.empty(spark, "tool_calls")
    rows = trace.timeline(talk(spark, d), none, schema.empty(spark, "recall_calls"), None, 0, 40)
    return rows.select("session_id", "seq", "role", "excerpt", "truncated", "ts")


def _summary_events(spark, d):
    c = calls(spark, d).where("outcome = 'error'")
    e = F.col("tool_use_id").cast("long")
    item = lambda n, s: F.concat(F.lit(f"   - item {n} "), s, F.lit("\n"))
    body = F.concat(F.lit("1. Work Done So Far:\n   - x\n2. Pending Tasks:\n"), item(1, F.concat(F.lit("own/repo#"), (e % 9).cast("string"), F.lit(" and #"), (e % 9 + 20).cast("string"))), item(2, F.lit("deferred for now")), F.lit("3. Current Work Here:\n   - own/repo#5\n"))
    made = c.select(F.col("tool_use_id").alias("event_id"), "session_id", "file_path", "source", e.alias("seq"), "ts", F.lit("user").alias("role"), body.alias("text"), F.lit('{"isCompactSummary": true}').alias("raw"))
    return schema.conform(made, schema.EVENTS)


@query(f"""WITH {CALLS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, event_id DESC) AS n FROM tool_calls WHERE outcome = 'error') WHERE n = 1)
SELECT file_path, 0 AS position, false AS deferred, 'unchecked' AS status, 'own/repo#' || CAST(event_id % 9 AS VARCHAR) || ',own/repo#' || CAST(event_id % 9 + 20 AS VARCHAR) AS refs FROM s
UNION ALL SELECT file_path, 1, true, 'unreferenced', '' FROM s""")
def pending_refs(spark, d):
    """Open items of the last summary of each file."""
    none = schema.empty(spark, "sessions")
    got = pending.pending_items(_summary_events(spark, d), none)
    refs = F.array_join(F.transform("references", lambda r: F.concat(r["owner"], F.lit("/"), r["repo"], F.lit("#"), r["number"].cast("string"))), ",")
    return got.select("file_path", "position", "deferred", "status", refs.alias("refs"))


@query("""SELECT CAST(user_id AS VARCHAR) AS session_id, string_agg(event_type, '' ORDER BY event_id) AS text, min(event_id) AS seq FROM events GROUP BY user_id""")
def opencode_coalesce(spark, d):
    """A part's deltas become one text."""
    e = read(spark, d, "events")
    props = F.struct(e.user_id.cast("string").alias("sessionID"), F.lit("text").alias("field"), F.lit("p").alias("partID"), F.col("event_type").alias("delta"))
    raw = F.to_json(F.struct(F.lit("message.part.delta").alias("type"), props.alias("properties")))
    rows = e.select(F.lit("/f.ndjson").alias("file_path"), F.col("event_id").alias("seq"), raw.alias("raw"))
    return opencode.texts(read_lines(rows, opencode.parse_line, opencode.LINE)).select("session_id", "text", "seq")


@query("""SELECT event_id AS seq, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN 'ok' ELSE 'error' END AS outcome FROM events""")
def codex_outcome(spark, d):
    """Exit codes of commands."""
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    item = F.struct(F.lit("CommandExecution").alias("type"), F.concat(F.lit("c"), e.event_id.cast("string")).alias("id"), F.array(F.lit("ls")).alias("command"), F.lit("out").alias("stdout"), F.lit("completed").alias("status"), (F.col("k") % 3).alias("exit_code"))
    raw = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("item_completed").alias("type"), item.alias("item")).alias("payload")))
    rows = e.select(F.concat(F.lit("/c"), (e.user_id % 20).cast("string"), F.lit(".jsonl")).alias("file_path"), F.col("event_id").alias("seq"), raw.alias("raw"))
    return codex.tool_calls(codex.records(rows)).select("seq", "outcome")


@query("""WITH n AS (SELECT CAST(user_id AS VARCHAR) AS session_id, user_id, count(*) AS c FROM events GROUP BY user_id) SELECT session_id, CASE WHEN user_id % 2 = 0 THEN '/chats/a/' ELSE '/chats/b/' END || session_id || '/store.db' AS file_path FROM n""")
def cursor_pairing(spark, d):
    """The first store with the transcript's calls."""
    e = read(spark, d, "events")
    own = schema.conform(e.select(F.concat_ws(":", "event_id", F.lit("0")).alias("tool_use_id"), e.user_id.cast("string").alias("session_id"), F.lit("cursor").alias("source"), F.col("event_type").alias("tool_name")), schema.TOOL_CALLS)
    names = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_type"].alias("name"))).alias("all"))
    short = F.when(F.col("user_id") % 2 == 0, F.col("all")).otherwise(F.slice("all", 2, 1_000_000))
    path = lambda f: F.concat(F.lit(f"/chats/{f}/"), F.col("user_id").cast("string"), F.lit("/store.db"))
    sid = F.col("user_id").cast("string").alias("session_id")
    stores_ = names.select(sid, path("a").alias("file_path"), short.alias("calls")).unionByName(names.select(sid, path("b").alias("file_path"), F.col("all").alias("calls")))
    return cursor.pairing(own, stores_).select("session_id", "file_path")


@query("""SELECT CAST(event_id AS VARCHAR) AS file_path FROM events WHERE event_id % 10 = 0 OR event_id % 7 = 0""")
def changed_files(spark, d):
    """New and changed files."""
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("file_path"), F.col("event_id").alias("n"))
    now = e.select("file_path", F.col("n").alias("size_bytes"), (F.col("n") + F.when(F.col("n") % 7 == 0, 1.0).otherwise(1e-8)).alias("mtime"))
    known = e.where("n % 10 <> 0").select("file_path", F.col("n").alias("size_bytes"), F.col("n").cast("double").alias("mtime"))
    return store.changed_files(now, known).select("file_path")


@query("""SELECT CASE WHEN user_id % 4 = 0 THEN '/r/a/b' WHEN user_id % 4 = 1 THEN '/r/a' ELSE '/r' END AS root, count(*) AS n_files FROM events GROUP BY 1 UNION ALL SELECT '/none', 0""")
def files_per_root(spark, d):
    """The longest root that holds a file."""
    e = read(spark, d, "events")
    folder = F.when(F.col("user_id") % 4 == 0, "/r/a/b/x").when(F.col("user_id") % 4 == 1, "/r/a/bc").otherwise("/r/z")
    paths = e.select(F.concat_ws("/", folder, e.event_id.cast("string")).alias("file_path"))
    return store.files_per_root(paths, spark.createDataFrame([("/r",), ("/r/a",), ("/r/a/b",), ("/none",)], "root string"))


@query(f"""WITH {CALLS} SELECT source, outcome, count(*) AS n, count(DISTINCT session_id) AS sessions FROM tool_calls WHERE ts >= (SELECT min(ts) FROM tool_calls) GROUP BY GROUPING SETS ((source, outcome), (source), ())""")
def sql_passthrough(spark, d):
    """Any SQL over the registered views."""
    calls(spark, d).createOrReplaceTempView("tool_calls")
    return spark.sql("SELECT source, outcome, count(*) AS n, count(DISTINCT session_id) AS sessions FROM tool_calls WHERE ts >= (SELECT min(ts) FROM tool_calls) GROUP BY GROUPING SETS ((source, outcome), (source), ())")
