"""Transcript-shaped views of the driver's tables, in Spark and in SQL.

The driver has no transcripts, so its ``events`` stand in for tool calls and its
``conversations`` for spoken text. Each view here has a twin in SQL under the same
name, of which the oracles are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.columns import CLASSIFIER_DENIAL, USER_DENIAL


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bare_times(df: DataFrame) -> DataFrame:
    """Times without a zone, as the oracle has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def text_of(c: str) -> Column:
    return F.col(c).cast("string")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as tool calls: users are sessions, hours are lines."""
    return calls_of(read(spark, sf_dir, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    e = events.withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("long")})
    k, u = F.col("k"), F.col("user_id")
    outcome = F.when(k < 20, "denied").when(k < 30, "error").when(k < 33, "pending").otherwise("ok")
    result = (
        F.when(k < 10, F.lit(USER_DENIAL))
        .when(k < 20, F.concat(F.lit(CLASSIFIER_DENIAL + ". Reason: rule "), (k % 3).cast("string"), F.lit(". ")))
        .when(k < 30, F.concat(F.lit("tool"), (k % 4).cast("string"), F.lit(": command not found")))
        .when(k >= 33, F.concat(F.lit("answer "), (k % 5).cast("string")))
    )
    tool = F.when(k % 5 == 4, "Bash").otherwise(F.col("event_type"))
    made = e.select(
        text_of("event_id").alias("tool_use_id"),
        text_of("user_id").alias("session_id"),
        F.concat(F.lit("/logs/f"), (u % 50).cast("string"), F.lit(".jsonl")).alias("file_path"),
        F.when(u % 3 == 0, "claude_code").when(u % 3 == 1, "codex").otherwise("opencode").alias("source"),
        F.floor(F.unix_micros("ts") / F.lit(3_600_000_000)).cast("long").alias("seq"),
        "ts",
        tool.alias("tool_name"),
        F.col("props").alias("input"),
        F.concat(F.lit("run "), F.col("event_type"), F.lit(" "), (k % 7).cast("string")).alias("input_summary"),
        outcome.alias("outcome"),
        (outcome == "error").alias("is_error"),
        result.alias("result_text"),
        (F.col("event_id") % 11 == 0).alias("is_sidechain"),
        text_of("event_id").alias("call_event_id"),
    )
    return schema.conform(made, schema.TOOL_CALLS)


CALLS = f"""raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
tool_calls AS (SELECT CAST(event_id AS VARCHAR) AS tool_use_id, CAST(user_id AS VARCHAR) AS session_id, '/logs/f' || CAST(user_id % 50 AS VARCHAR) || '.jsonl' AS file_path,
 CASE WHEN user_id % 3 = 0 THEN 'claude_code' WHEN user_id % 3 = 1 THEN 'codex' ELSE 'opencode' END AS source,
 CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS seq, ts, CASE WHEN k % 5 = 4 THEN 'Bash' ELSE event_type END AS tool_name, props AS input,
 'run ' || event_type || ' ' || CAST(k % 7 AS VARCHAR) AS input_summary,
 CASE WHEN k < 20 THEN 'denied' WHEN k < 30 THEN 'error' WHEN k < 33 THEN 'pending' ELSE 'ok' END AS outcome,
 CASE WHEN k < 10 THEN '{USER_DENIAL.replace("'", "''")}' WHEN k < 20 THEN '{CLASSIFIER_DENIAL}. Reason: rule ' || CAST(k % 3 AS VARCHAR) || '. '
      WHEN k < 30 THEN 'tool' || CAST(k % 4 AS VARCHAR) || ': command not found' WHEN k >= 33 THEN 'answer ' || CAST(k % 5 AS VARCHAR) END AS result_text,
 event_id % 11 = 0 AS is_sidechain, event_id, user_id, event_type, k FROM raw)"""


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as events: conversations are sessions and files, turns are lines."""
    c = read(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 86_400 + F.col("turn"))
    made = c.select(
        F.concat_ws(":", "conv_id", "turn").alias("event_id"),
        text_of("conv_id").alias("session_id"),
        F.concat(F.lit("/talk/"), text_of("conv_id"), F.lit(".jsonl")).alias("file_path"),
        F.lit("claude_code").alias("source"),
        F.col("turn").alias("seq"),
        at.alias("ts"),
        F.lit("message").alias("type"),
        "role",
        "text",
        F.lit("{}").alias("raw"),
    )
    return schema.conform(made, schema.EVENTS)


TALK = """talk AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, '/talk/' || CAST(conv_id AS VARCHAR) || '.jsonl' AS file_path, turn AS seq, conv_id, role, text,
 to_timestamp(1700000000 + conv_id * 86400 + turn) AT TIME ZONE 'UTC' AS ts FROM conversations)"""


def talk_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talk(spark, sf_dir)
    own = t.groupBy("session_id", "file_path", "source").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n_events"))
    return schema.conform(own.withColumn("n_tool_calls", F.lit(0)), schema.SESSIONS)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` written as a session log: a call and, unless it is pending, its result on the next line.

    Events are dealt over tasks before, as files have few pieces and reading lines takes long."""
    both = calls_of(read(spark, sf_dir, "events").repartition("event_id")).withColumns({"event_id": F.col("tool_use_id").cast("long"), "k": F.get_json_object("input", "$.k").cast("long")})
    iso = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    uid = F.concat(F.lit("u"), text_of("event_id"))
    usage = F.struct(F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("output_tokens"))
    mode = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("mode"), (F.col("event_id") % 3).cast("string")))
    use = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), text_of("event_id")).alias("id"), F.col("tool_name").alias("name"), F.struct(F.col("k").alias("command")).alias("input"))
    call = F.to_json(F.struct(F.lit("assistant").alias("type"), uid.alias("uuid"), F.col("session_id").alias("sessionId"), iso("ts").alias("timestamp"), mode.alias("permissionMode"), F.concat(F.lit("r"), F.floor(F.col("event_id") / 3).cast("string")).alias("requestId"), F.struct(F.lit("assistant").alias("role"), F.array(use).alias("content"), usage.alias("usage")).alias("message")))
    answer = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), text_of("event_id")).alias("tool_use_id"), F.col("result_text").alias("content"), F.col("is_error").alias("is_error"))
    later = F.col("ts") + F.make_dt_interval(secs=F.col("k") * F.lit(0.25))
    result = F.to_json(F.struct(F.lit("user").alias("type"), F.concat(F.lit("v"), text_of("event_id")).alias("uuid"), uid.alias("parentUuid"), F.col("session_id").alias("sessionId"), iso(later).alias("timestamp"), F.struct(F.lit("user").alias("role"), F.array(answer).alias("content")).alias("message")))
    first = F.struct((F.col("event_id") * 2 + 1).alias("seq"), call.alias("raw"))
    second = F.struct((F.col("event_id") * 2 + 2).alias("seq"), result.alias("raw"))
    return both.select("file_path", F.inline(F.when(F.col("outcome") == "pending", F.array(first)).otherwise(F.array(first, second))))
