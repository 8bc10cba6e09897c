"""What followed a denied call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("verbatim-retry", "same-tool", "other-tool", "none")
_NEXT = ("seq", "tool_name", "input", "input_summary", "outcome", "ts")


def denial_followups(calls: DataFrame) -> DataFrame:
    """One row for each denied call with the first call of the session's next line that has one.

    Calls of one line were issued together, so a line is represented by its
    smallest call id and never follows itself. Equal tools are compared null-safe,
    inputs byte by byte.
    """
    line = W.partitionBy("session_id", "seq").orderBy(F.asc_nulls_last("tool_use_id"))
    later = W.partitionBy("session_id").orderBy(F.asc_nulls_last("seq"))
    heads = calls.select("session_id", "tool_use_id", *_NEXT).withColumn("__n", F.row_number().over(line)).where("__n = 1")
    following = heads.select(F.col("session_id").alias("__session"), F.col("seq").alias("__seq"), *[F.lead(c).over(later).alias(f"next_{c}") for c in _NEXT])
    denied = calls.where("outcome = 'denied'")
    both = denied.join(following, denied["session_id"].eqNullSafe(following["__session"]) & (denied["seq"] == following["__seq"]))
    same = F.col("tool_name").eqNullSafe(F.col("next_tool_name"))
    kind = F.when(F.col("next_seq").isNull(), "none").when(same & F.col("input").eqNullSafe(F.col("next_input")), "verbatim-retry").when(same, "same-tool").otherwise("other-tool")
    gap = (F.unix_millis("next_ts") - F.unix_millis("ts")) / F.lit(1000.0)
    own = ("session_id", "seq", "ts", "tool_name", "input_summary", "permission_mode", "denied_by", "denial_reason", "cwd", "next_tool_name", "next_input_summary", "next_outcome", "next_ts")
    return both.select(*own, gap.alias("gap_seconds"), kind.alias("followup_kind"))


def newest(rows: DataFrame, session: str | None = None, limit: int = 0) -> DataFrame:
    """Newest first; ties and null times by session and line. 0 is no limit."""
    out = rows.where(F.col("session_id") == session) if session else rows
    out = out.orderBy(F.desc_nulls_last("ts"), F.asc_nulls_last("session_id"), F.desc_nulls_last("seq"))
    return out.limit(limit) if limit else out
