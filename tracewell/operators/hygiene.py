"""Session hygiene: how often calls show wasteful habits, and how two periods compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_window, round_binary
from ..functions.shell import CATEGORIES, Rules, categories


def category_rows(calls: DataFrame, rules: Rules = Rules()) -> DataFrame:
    c = categories(F.col("tool_name"), F.col("input"), F.col("input_summary"), F.col("outcome"), rules)
    return calls.select("session_id", "source", "ts", F.explode(c).alias("name"))


def audit(calls: DataFrame, since=None, until=None, rules: Rules = Rules()) -> DataFrame:
    """(name, tool_calls, sessions) of all five categories in their order; calls without a session count as calls only."""
    rows = category_rows(calls.where(in_window(F.col("ts"), since, until)), rules)
    counts = rows.groupBy("name").agg(F.count("*").alias("tool_calls"), F.countDistinct("session_id").alias("sessions"))
    names = calls.sparkSession.createDataFrame(list(enumerate(CATEGORIES)), "position int, name string")
    return names.join(counts, "name", "left").na.fill(0, ["tool_calls", "sessions"]).orderBy("position").select("name", "tool_calls", "sessions")


def coverage(calls: DataFrame, since=None, until=None) -> DataFrame:
    """(source, tool_calls, sessions), most calls first; a null source is a source."""
    rows = calls.where(in_window(F.col("ts"), since, until)).groupBy("source").agg(F.count("*").alias("tool_calls"), F.countDistinct("session_id").alias("sessions"))
    return rows.orderBy(F.desc("tool_calls"), F.coalesce("source", F.lit("")))


def untimed(calls: DataFrame, since=None, until=None) -> DataFrame:
    """(source, tool_calls) of calls that a window drops because they have no time."""
    rows = calls.where(F.col("ts").isNull() & F.lit(since is not None or until is not None)).groupBy("source").agg(F.count("*").alias("tool_calls"))
    return rows.orderBy(F.desc("tool_calls"), F.coalesce("source", F.lit("")))


def per_session(calls, sessions):
    return F.when(sessions != 0, round_binary(calls / sessions, 2))


def change(now, before):
    return F.when(before != 0, round_binary((now - before) / before * 100, 2))


def compare(calls: DataFrame, baseline: tuple, current: tuple, rules: Rules = Rules()) -> DataFrame:
    """Both periods' counts for each category, and how they changed."""
    side = lambda p, period: audit(calls, *period, rules).withColumnsRenamed({"tool_calls": f"{p}_tool_calls", "sessions": f"{p}_sessions"})
    both = side("baseline", baseline).join(side("current", current), "name", "full")
    b, c, bs, cs = (F.col(x) for x in ("baseline_tool_calls", "current_tool_calls", "baseline_sessions", "current_sessions"))
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("name"))
    out = both.select("name", b, c, bs, cs, per_session(b, bs).alias("baseline_calls_per_session"), per_session(c, cs).alias("current_calls_per_session"), (c - b).alias("tool_calls_change"), change(c, b).alias("tool_calls_percent_change"), (cs - bs).alias("sessions_change"))
    return out.orderBy(place)


def asymmetry(calls: DataFrame, baseline: tuple, current: tuple) -> DataFrame:
    """Sources with calls in one period only."""
    side = lambda p, period: coverage(calls, *period).select(F.col("source").alias(f"{p}_source"), F.col("tool_calls").alias(f"{p}_tool_calls"))
    both = side("b", baseline).join(side("c", current), F.col("b_source").eqNullSafe(F.col("c_source")), "full")
    rows = both.where("b_tool_calls is null or c_tool_calls is null")
    out = rows.select(F.when(F.col("b_tool_calls").isNull(), F.col("c_source")).otherwise(F.col("b_source")).alias("source"), F.coalesce("b_tool_calls", F.lit(0)).alias("baseline_tool_calls"), F.coalesce("c_tool_calls", F.lit(0)).alias("current_tool_calls"))
    return out.orderBy(F.asc_nulls_last("source"))
