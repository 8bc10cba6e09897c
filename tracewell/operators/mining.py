"""Facts that sessions find out again and again: repeated failures and commands with one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_window, normalise_command, normalise_result, strip
from .order import first_of

# Commands that are routine, results that tell of a failure, and ends that tell nothing.
RITUAL = (r"--help\b", r"\bgit\s+(pull|fetch|status|log|diff)\b", r"\bsleep\b", r"^\s*(ls|cd|pwd|rm|mkdir|echo)\s*$", r"^\s*cat\s*$", r"/usage\b")
FAILURE = r"(?i)command not found|No such file or directory|Permission denied|ModuleNotFoundError|not recognized"
DEATH = r"(?i)Exit code (?:124|137|143|144)\b"
DEATH_PHRASES = ("Command timed out", "temporarily unavailable, so auto mode cannot determine")
SILENT = "(Bash completed with no output)"

#: Rows come in no order of their own; the first of a session is by these.
ORDER = ["__t", "file_path", "seq", "tool_use_id"]


def _bash(calls: DataFrame, since, until) -> DataFrame:
    rows = calls.where((F.col("tool_name") == "Bash") & ~F.col("is_sidechain") & in_window(F.col("ts"), since, until))
    return rows.withColumn("__t", F.coalesce("ts", F.lit("9999-12-31").cast("timestamp")))


def _report(firsts: DataFrame, key: str, signal: str, sample, fallback) -> DataFrame:
    """One candidate for each key from its sessions' first rows."""
    early = F.min_by("input_summary", F.when(F.col("input_summary") != "", F.struct(*ORDER)))
    g = firsts.groupBy(key).agg(F.count("*").alias("sessions"), F.array_sort(F.collect_list("session_id")).alias("session_ids"), F.coalesce(early, fallback).alias("command"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    iso = lambda c: F.coalesce(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("?"))
    text = F.concat(F.lit('"'), "command", F.lit('" returns the same result in '), F.col("sessions").cast("string"), F.lit(" sessions between "), iso("first_seen"), F.lit(" and "), iso("last_seen"), F.lit(": "), sample)
    return g.withColumns({"signal": F.lit(signal), "sample_output": sample, "draft": text})


COLUMNS = ("signal", "sessions", "session_ids", "command", "stability", "sample_output", "draft", "first_seen", "last_seen")


def negative_facts(calls: DataFrame, since=None, until=None, min_sessions: int = 3, max_chars: int = 2000) -> DataFrame:
    """Failures whose text is the same in at least ``min_sessions`` sessions."""
    rows = _bash(calls, since, until).withColumn("result", normalise_result(F.coalesce("result_text", F.lit("")), max_chars))
    dead = F.col("result").rlike(DEATH)
    for phrase in DEATH_PHRASES:
        dead = dead | F.col("result").contains(phrase)
    rows = rows.where((F.col("result") != "") & ((F.col("outcome") == "error") | F.col("result").rlike(FAILURE)) & ~dead)
    firsts = first_of(rows, ["result", "session_id"], ORDER)
    out = _report(firsts, "result", "negative-fact", F.substring("result", 1, 200), F.lit(""))
    return out.where(F.col("sessions") >= min_sessions).withColumn("stability", F.lit(None).cast("double")).select(*COLUMNS)


def stable_outputs(calls: DataFrame, since=None, until=None, min_sessions: int = 3, min_stability: float = 1.0, max_chars: int = 2000, rituals: tuple[str, ...] = RITUAL) -> DataFrame:
    """Commands that sessions run and that answer alike; the most frequent answer, the earliest of equals, must have the share asked for."""
    rows = _bash(calls, since, until).withColumns({"cmd": normalise_command(F.col("input_summary")), "result": normalise_result(F.coalesce("result_text", F.lit("")), max_chars)})
    routine = F.lit(False)
    for pattern in rituals:
        routine = routine | F.col("cmd").rlike(pattern)
    firsts = first_of(rows.where((F.col("cmd") != "") & ~routine), ["cmd", "session_id"], ORDER)
    answers = firsts.groupBy("cmd", "result").agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("at"))
    modal = first_of(answers, ["cmd"], [F.desc("n"), "at"]).select(F.col("cmd").alias("c"), F.col("result").alias("modal"), "n")
    out = _report(firsts.join(modal, F.col("cmd") == F.col("c")).withColumn("key", F.struct("cmd", "modal", "n")), "key", "stable-output", F.substring(F.col("key.modal"), 1, 200), F.first("cmd"))
    told = strip(F.col("key.modal"))
    out = out.withColumn("stability", F.col("key.n") / F.col("sessions"))
    return out.where((F.col("sessions") >= min_sessions) & (told != "") & (told != SILENT) & (F.col("stability") >= min_stability)).select(*COLUMNS)


def nominate(calls: DataFrame, since=None, until=None, min_sessions: int = 3, min_stability: float = 1.0, max_chars: int = 2000, rituals: tuple[str, ...] = RITUAL) -> DataFrame:
    """Both kinds, failures first, most sessions first; ties by first time and text."""
    a = negative_facts(calls, since, until, min_sessions, max_chars)
    b = stable_outputs(calls, since, until, min_sessions, min_stability, max_chars, rituals)
    return a.unionByName(b).orderBy("signal", F.desc("sessions"), F.asc_nulls_last("first_seen"), "sample_output", "command")
