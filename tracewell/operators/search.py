"""Regular-expression search over texts, with the places of matches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_window, visible

SPANS = "array<struct<start:int,end:int>>"


class InvalidPattern(ValueError):
    """The pattern doesn't compile."""


def matches(text: Column, pattern: str, ignore_case: bool = False, every: bool = False) -> Column:
    """Places of the first or all matches in code points, in Python's dialect; empty for null and for none."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise InvalidPattern(str(e)) from e
    flags = re.IGNORECASE if ignore_case else 0

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, flags)

        def spans(t):
            if not t:
                return []
            found = compiled.finditer(t) if every else filter(None, [compiled.search(t)])
            return [{"start": m.start(), "end": m.end()} for m in found]

        return pd.Series([spans(t) for t in texts])

    return find(text)


def window(text: Column, start: Column, end: Column, context: int) -> Column:
    low = F.greatest(start - context, F.lit(0))
    return visible(F.substr(text, low + 1, end + context - low))


def search(events: DataFrame, calls: DataFrame | None, pattern: str, role: str | None = None, since=None, until=None, session: str | None = None, ignore_case: bool = False, include_meta: bool = False, every: bool = False, limit: int = 20, context: int = 200) -> DataFrame:
    """Hits, newest first: where, id, session_id, ts, label, field, text, offsets, windows.

    Conditions that Spark can evaluate come first, so only their rows reach Python.
    ``calls`` adds summaries and results of tool calls. 0 is no limit.
    """

    def narrow(df: DataFrame) -> DataFrame:
        df = df.where(in_window(F.col("ts"), since, until))
        return df.where(F.col("session_id").startswith(session)) if session else df

    e = narrow(events).where(F.lit(include_meta) | ~F.coalesce("is_meta", F.lit(False)))
    e = e.where(F.col("role") == role) if role else e
    rows = e.select(F.lit("event").alias("where"), F.col("event_id").alias("id"), "session_id", "ts", F.col("role").alias("label"), F.lit("text").alias("field"), "text")
    if calls is not None:
        parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("input_summary", "result_text")]))
        c = narrow(calls).select(F.lit("tool_call").alias("where"), F.col("tool_use_id").alias("id"), "session_id", "ts", F.col("tool_name").alias("label"), parts.alias("p"))
        rows = rows.unionByName(c.select("where", "id", "session_id", "ts", "label", "p.field", "p.text"))
    hits = rows.where("text <> ''").withColumn("offsets", matches(F.col("text"), pattern, ignore_case, every)).where("size(offsets) > 0")
    hits = hits.withColumn("windows", F.transform("offsets", lambda o: window(F.col("text"), o["start"], o["end"], context)))
    hits = hits.orderBy(F.desc_nulls_last("ts"), F.desc(F.coalesce("session_id", F.lit(""))), F.desc(F.coalesce("id", F.lit(""))), F.desc("field"))
    return hits.limit(limit) if limit else hits
