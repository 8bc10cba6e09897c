"""Work that was done and never written down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_MINUTES, LIMIT, SNIPPET = 30, 50, 200


def default_signals(publish: tuple[str, ...] = ("mcp__sandbox__publish",), wait: str = "wait-for-chain") -> dict[str, Column]:
    """What counts as evidence of work: published results, and commands that wait for a chain of jobs."""
    return {
        "publish": F.col("tool_name").isin(*publish) & (F.col("outcome") == "ok"),
        "chain-wait": (F.col("tool_name") == "Bash") & F.col("input_summary").contains(wait),
    }


def evidence(calls: DataFrame, signals: dict[str, Column], since=None) -> DataFrame:
    """One row for each call and signal that fits it."""
    kinds = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in signals.items()]))
    rows = calls.where(F.col("ts") >= F.lit(since)) if since is not None else calls
    return rows.select(F.explode(kinds).alias("kind"), "tool_use_id", "session_id", "ts", "input_summary", "result_text")


def uncovered(events: DataFrame, bookkeeping: DataFrame, actions: DataFrame | None = None, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Evidence with neither a later note in its session nor a ledger action in the window after it.

    The ledger knows no sessions, so this is a range join; it meets on slices of
    the window's length, each action in its own slice and each event in two.
    """
    notes = bookkeeping.select(F.col("session_id").alias("__s"), F.col("ts").alias("__t")).groupBy("__s").agg(F.max("__t").alias("__t"))
    left = events.where("ts is not null").join(notes, F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("__t") >= F.col("ts")), "left_anti")
    if actions is None:
        return left.withColumn("failed_checks", F.array(F.lit("session")))
    width = minutes * 60 * 1_000_000
    slot = lambda c: F.floor(F.unix_micros(c) / width)
    acts = actions.select(F.col("ts").alias("__a"), slot(F.col("ts")).alias("__k")).where("__a is not null")
    slots = F.array(slot(F.col("ts")), slot(F.col("ts")) + 1)
    span = left.withColumn("__e", F.monotonically_increasing_id()).withColumn("k", F.explode(slots))
    near = (F.col("__a") >= F.col("ts")) & (F.unix_micros("__a") <= F.unix_micros("ts") + width)
    open_ = span.join(acts, (F.col("k") == F.col("__k")) & near, "left_anti")
    return open_.groupBy("__e").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in left.columns]).where("n = 2").select(*left.columns).withColumn("failed_checks", F.array(F.lit("session"), F.lit("ledger")))


def nominations(calls: DataFrame, notes: Column, signals: dict[str, Column] | None = None, actions: DataFrame | None = None, minutes: int = WINDOW_MINUTES, since=None, limit: int = LIMIT) -> DataFrame:
    """Newest uncovered evidence; ``notes`` tells which calls write things down. 0 is no limit."""
    signals = signals or default_signals()
    got = uncovered(evidence(calls, signals, since), calls.where(notes), actions, minutes)
    text = F.coalesce(F.nullif(F.col("input_summary"), F.lit("")), F.nullif(F.col("result_text"), F.lit("")), F.lit(""))
    out = got.select("kind", "tool_use_id", "session_id", "ts", F.substring(text, 1, SNIPPET).alias("snippet"), "failed_checks")
    out = out.orderBy(F.desc("ts"), "kind", "tool_use_id")
    return out.limit(limit) if limit else out
