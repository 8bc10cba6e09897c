"""A session from its first line to its last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import excerpt, format_ts
from .denials import denial_followups

ITEMS, CHARS = 30, 8000


class SessionNotFound(ValueError):
    """No session, or several, fit a prefix; ``candidates`` holds the several."""

    def __init__(self, prefix: str, candidates: list[str]):
        self.prefix, self.candidates = prefix, candidates
        super().__init__(f"session prefix '{prefix}' matches {len(candidates)} sessions: {', '.join(candidates)} (use a longer prefix)" if candidates else f"no session matching prefix '{prefix}'")


def session_ids(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    return sessions.select("session_id").union(calls.select("session_id")).where("session_id is not null").distinct()


def resolve(sessions: DataFrame, calls: DataFrame, prefix: str) -> str:
    """The id itself, or the only id with this prefix."""
    found = sorted(r[0] for r in session_ids(sessions, calls).where(F.col("session_id").startswith(prefix)).collect())
    if prefix in found or len(found) == 1:
        return prefix if prefix in found else found[0]
    raise SessionNotFound(prefix, found)


def timeline(events: DataFrame, calls: DataFrame, recalls: DataFrame, session: str | None = None, limit: int = 200, max_chars: int = 500) -> DataFrame:
    """Texts and calls of one session (or all) in order of lines, texts first, with what recalls and denials led to."""
    pick = (lambda df: df.where(F.col("session_id") == session)) if session else (lambda df: df.where("session_id is not null"))
    e = pick(events).where((F.col("text") != "") & ~F.coalesce("is_meta", F.lit(False)))
    c = pick(calls)
    long_ = lambda t: F.coalesce(F.length(t) > max_chars, F.lit(False)) if max_chars else F.lit(False)
    texts = e.select("session_id", F.lit("text").alias("kind"), F.col("event_id").alias("id"), "seq", format_ts(F.col("ts")).alias("ts"), "role", excerpt(F.col("text"), max_chars).alias("excerpt"), long_(F.col("text")).alias("truncated"))
    r = recalls.groupBy("session_id", F.col("call_id").alias("id")).agg(F.max(F.struct("seq", "query", "overlap_count")).alias("r"))
    follow = denial_followups(c).groupBy("session_id", "seq").agg(F.max(F.struct("followup_kind", "next_tool_name", "next_input_summary", "next_outcome", format_ts(F.col("next_ts")).alias("next_ts"), "gap_seconds")).alias("followup"))
    tools = c.select("session_id", F.lit("tool").alias("kind"), F.col("tool_use_id").alias("id"), "seq", format_ts(F.col("ts")).alias("ts"), "tool_name", "input_summary", "outcome", excerpt(F.col("result_text"), max_chars).alias("excerpt"), long_(F.col("result_text")).alias("truncated"))
    tools = tools.join(r, ["session_id", "id"], "left").join(follow, ["session_id", "seq"], "left")
    words = F.array_join(F.filter(F.array("tool_name", "input_summary", "result_text"), lambda p: p.isNotNull() & (p != "")), " ")
    spoken = e.select("session_id", "seq", F.lit(0).alias("k"), F.col("event_id").alias("i"), "text")
    acts = spoken.union(c.select("session_id", "seq", F.lit(1).alias("k"), F.col("tool_use_id").alias("i"), words.alias("text")).where("text <> ''"))
    asked = tools.where("r is not null").select("session_id", "id", F.col("seq").alias("__q"))
    after = asked.join(acts, "session_id").where("seq > __q").withColumn("n", F.row_number().over(W.partitionBy("session_id", "id").orderBy("seq", "k", "i")))
    later = after.groupBy("session_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= ITEMS, F.struct("n", "text")))), lambda x: x["text"]), "\n").alias("t"), F.max("n").alias("m"))
    cut = (F.coalesce("m", F.lit(0)) > ITEMS) | (F.coalesce(F.length("t"), F.lit(0)) > CHARS)
    told = F.struct(F.col("r.query").alias("query"), F.col("r.overlap_count").alias("overlap_count"), F.nullif(F.substring("t", 1, CHARS), F.lit("")).alias("followup_text"), cut.alias("followup_truncated"))
    tools = tools.join(later, ["session_id", "id"], "left").withColumn("recall", F.when(F.col("r").isNotNull(), told))
    tools = tools.withColumn("followup", F.when(F.col("outcome") == "denied", F.col("followup"))).drop("r", "t", "m")
    out = texts.unionByName(tools, allowMissingColumns=True).withColumn("is_recall", F.col("recall").isNotNull())
    out = out.orderBy("session_id", "seq", F.col("kind") == "tool", "id")
    return out.limit(limit) if limit and session else out
