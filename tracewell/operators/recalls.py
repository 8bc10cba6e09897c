"""Memory recalls and the traces they left in what came after.

``server`` names the memory server whose ``recall`` tool is meant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C

ITEMS, CHARS, SAMPLE = 30, 8000, 20
TOKEN = r"[A-Za-z0-9_#./-]{4,}"
DATE = r"^\d{4}-\d{2}-\d{2}(T\d{2}(:\d{2}(:\d{2})?)?)?Z?\.*$"


def distinctive(token):
    """Tokens with a digit, a mark or a hump that are neither a number nor a date."""
    return ~token.rlike(DATE) & ~token.rlike(r"^\d+$") & (token.rlike("[0-9#_/.-]") | token.rlike("[a-z][A-Z]"))


def followups(recalls: DataFrame, activity: DataFrame) -> DataFrame:
    """Add followup_text, followup_truncated, overlap_tokens and overlap_count.

    ``recalls(recall_id, file_path, session_id, seq, output)`` and
    ``activity(file_path, session_id, seq, rank, text)``, of which items on later
    lines are the follow-up and items on earlier lines the context. A token counts
    if it is in the output and later, and not earlier.
    """
    r = recalls.select("recall_id", F.col("file_path").alias("__f"), F.col("session_id").alias("__s"), F.col("seq").alias("__q"), "output")
    both = r.join(activity, (r["__f"] == activity["file_path"]) & r["__s"].eqNullSafe(activity["session_id"]) & (r["__q"] != activity["seq"]))
    w = W.partitionBy("recall_id").orderBy("seq", "rank")
    after = both.where("seq > __q").withColumns({"n": F.row_number().over(w), "so_far": F.sum(F.length("text") + 1).over(w)})
    kept = after.where((F.col("n") <= ITEMS) & (F.col("so_far") - F.length("text") - 1 <= CHARS))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    texts = kept.groupBy("recall_id").agg(text.alias("__t"), F.max("so_far").alias("__c"))
    many = after.groupBy("recall_id").agg(F.max("n").alias("__n"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)))
    own = r.select("recall_id", F.explode(words(F.col("output"))).alias("token")).where(distinctive(F.col("token")))
    seen = both.select("recall_id", (F.col("seq") > F.col("__q")).alias("later"), F.explode(words(F.col("text"))).alias("token"))
    found = seen.join(own, ["recall_id", "token"], "left_semi").groupBy("recall_id", "token").agg(F.bool_and("later").alias("fresh")).where("fresh")
    overlap = found.groupBy("recall_id").agg(F.slice(F.array_sort(F.collect_list("token")), 1, SAMPLE).alias("__o"), F.count("*").alias("__k"))
    out = recalls.join(texts, "recall_id", "left").join(many, "recall_id", "left").join(overlap, "recall_id", "left")
    json = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("__o", F.array().cast("array<string>")), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]"))
    cut = (F.coalesce("__n", F.lit(0)) > ITEMS) | (F.coalesce("__c", F.lit(0)) > CHARS) | (F.coalesce(F.length("__t"), F.lit(0)) > CHARS)
    return out.withColumns({"followup_text": F.nullif(F.substring("__t", 1, CHARS), F.lit("")), "followup_truncated": cut, "overlap_tokens": json, "overlap_count": F.coalesce("__k", F.lit(0))}).drop("__t", "__c", "__n", "__o", "__k")


def _words(*parts):
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")


def activity(events: DataFrame, calls: DataFrame) -> DataFrame:
    """What a session shows: assistant texts (all texts, where roles aren't recorded) and finished calls."""
    told = F.when(F.col("source") == "claude_code", F.col("role") == "assistant").otherwise(True)
    texts = events.where(told & (F.col("text") != "")).select("file_path", "session_id", "seq", F.struct(F.lit(0).alias("k"), F.col("event_id").alias("id")).alias("rank"), "text")
    second = F.when(F.col("source") == "claude_code", F.col("input_summary")).otherwise(F.nullif(F.nullif(F.col("input"), F.lit("{}")), F.lit("null")))
    line = _words(F.col("tool_name"), second, F.col("result_text"))
    line = F.when(F.col("source").isin("opencode", "cursor"), F.substring(line, 1, C.RESULT_LIMIT)).otherwise(line)
    acts = calls.where(~F.col("outcome").eqNullSafe("pending") | (F.col("source") == "codex")).select("file_path", "session_id", "seq", F.struct(F.lit(1).alias("k"), F.col("tool_use_id").alias("id")).alias("rank"), line.alias("text"))
    return texts.unionByName(acts.where("text <> ''"))


def recall_calls(events: DataFrame, calls: DataFrame, server: str = "memory", ledger: DataFrame | None = None) -> DataFrame:
    """All sources' recalls, with what followed them.

    Calls of the ``cursor`` source record no output; the n-th call of a query in a
    file takes the ledger's n-th recall of that query.
    """
    name, source = F.col("tool_name"), F.col("source")
    wanted = ((source == "claude_code") & (name == f"mcp__{server}__recall") & (F.col("outcome") != "pending")) | ((source == "opencode") & (name == f"{server}_recall")) | ((source == "codex") & (name == f"mcp__{server}__recall"))
    asked = F.when(source == "cursor", F.get_json_object("input", "$.arguments.query")).otherwise(F.get_json_object("input", "$.query"))
    chosen = wanted | ((source == "cursor") & name.isin("CallMcpTool", "CallDynamicTool") & (F.col("mcp_server") == server) & (F.get_json_object("input", "$.toolName") == "recall"))
    got = calls.where(chosen).withColumns({"query": asked, "output": F.when(source.isin("claude_code", "codex", "opencode"), F.nullif(F.col("result_text"), F.lit(""))), "output_truncated": F.coalesce("result_truncated", F.lit(False))})
    if ledger is not None:
        nth = F.row_number().over(W.partitionBy("source", "file_path", "query").orderBy("seq", F.length("tool_use_id"), "tool_use_id"))
        led = ledger.select(F.col("query").alias("__q"), F.col("nth").alias("__n"), F.col("ts").alias("__ts"), F.nullif(F.col("output"), F.lit("")).alias("__o"))
        got = got.withColumn("nth", nth).join(led, (F.col("query") == F.col("__q")) & (F.col("nth") == F.col("__n")) & (F.col("source") == "cursor"), "left")
        full, long_ = C.truncated(F.col("__o"))
        got = got.withColumns({"ts": F.coalesce("ts", "__ts"), "output": F.coalesce("output", full), "output_truncated": F.col("output_truncated") | long_})
    got = got.withColumns({"recall_id": F.concat_ws(":", "file_path", "tool_use_id"), "call_id": F.col("tool_use_id")})
    base = got.select("recall_id", "session_id", "file_path", "source", "seq", "ts", "call_id", "query", "output", "output_truncated")
    return schema.conform(followups(base, activity(events, calls)), schema.RECALL_CALLS)
