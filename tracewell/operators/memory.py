"""Who wrote which memory file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import in_window, memory_key, model_name

WRITERS = ("Write", "Edit", "MultiEdit")


def writes(calls: DataFrame, events: DataFrame | None = None, since=None, until=None) -> DataFrame:
    """Successful writes of memory files in order, with the model of the call's event (by id and file: replays repeat ids)."""
    rows = calls.where(F.col("tool_name").isin(*WRITERS) & (F.col("outcome") == "ok") & in_window(F.col("ts"), since, until))
    rows = rows.withColumn("path", F.get_json_object("input", "$.file_path")).withColumn("key", memory_key(F.col("path"))).where("key is not null")
    if events is not None:
        e = events.select(F.col("event_id").alias("call_event_id"), "file_path", "model")
        rows = rows.join(e, ["call_event_id", "file_path"], "left")
    else:
        rows = rows.withColumn("model", F.lit(None).cast("string"))
    order = W.partitionBy("key").orderBy(F.asc_nulls_last("ts"), "file_path", "seq", "tool_use_id")
    return rows.select("key", "path", "tool_name", "ts", "file_path", "seq", "tool_use_id", model_name(F.col("model")).alias("model"), F.row_number().over(order).alias("n"))


def mentions(calls: DataFrame, keys: DataFrame, since=None, until=None) -> DataFrame:
    """(key, bash_mentions): shell commands on a memory folder that name the file.

    File names are cut out of the commands, so they meet by equality; a name met
    inside a longer one counts as well, for each command once. A command is told by file, place and id.
    """
    rows = calls.where((F.col("tool_name") == "Bash") & in_window(F.col("ts"), since, until))
    rows = rows.withColumn("command", F.translate(F.get_json_object("input", "$.command"), "\\", "/")).where(F.contains("command", F.lit("/memory/")))
    files = keys.select("key", F.element_at(F.split("key", "/"), -1).alias("name"))
    longest = files.agg(F.max(F.length("name")).alias("longest")).where("longest is not null")  # one row
    # A name ends in .md and holds no slash, so it is the end of a command's part up to some .md.
    parts = rows.select(F.struct("file_path", "seq", "tool_use_id").alias("call"), F.explode(F.split("command", "/")).alias("part")).withColumn("cut", F.split("part", r"\.md"))
    upto = parts.where(F.size("cut") > 1).select("call", F.explode(F.transform(F.sequence(F.lit(1), F.size("cut") - 1), lambda k: F.concat(F.concat_ws(".md", F.slice("cut", 1, k)), F.lit(".md")))).alias("head"))
    tail = upto.crossJoin(F.broadcast(longest)).select("call", F.expr("right(head, longest)").alias("tail"))
    names = tail.select("call", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail")), lambda i: F.substring("tail", i, F.length("tail")))).alias("name"))
    return names.join(files, "name").groupBy("key").agg(F.countDistinct("call").alias("bash_mentions"))


def files(calls: DataFrame, events: DataFrame, since=None, until=None, existing: list[str] | None = None) -> DataFrame:
    """One row for each memory file: its maker (if its first write is a Write), edits by model, times and counts."""
    w = writes(calls, events, since, until)
    maker = F.max(F.when((F.col("n") == 1) & (F.col("tool_name") == "Write"), F.col("model")))
    own = w.groupBy("key").agg(F.max_by("path", "n").alias("path"), F.coalesce(maker, F.lit("unknown")).alias("created_by"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_writes"))
    made = (F.col("n") == 1) & (F.col("tool_name") == "Write")
    edits = w.where(~made).groupBy("key", "model").agg(F.count("*").alias("count")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "model", "count"))).alias("e"))
    out = own.join(edits.select("key", F.transform("e", lambda x: F.struct(x["model"].alias("model"), x["count"].alias("count"))).alias("edits")), "key", "left")
    out = out.join(mentions(calls, own.select("key"), since, until), "key", "left").na.fill(0, ["bash_mentions"])
    there = F.col("path").isin(*existing) if existing else F.lit(False)
    none = F.array().cast("array<struct<model:string,count:bigint>>")
    return out.select("key", "path", "created_by", F.coalesce("edits", none).alias("edits"), "first_ts", "last_ts", "n_writes", there.alias("exists"), "bash_mentions").orderBy(F.desc_nulls_last("last_ts"), F.desc("key"))


def models(calls: DataFrame, events: DataFrame, since=None, until=None, keys: DataFrame | None = None) -> DataFrame:
    """(model, files_created, writes, files_touched)."""
    w = writes(calls, events, since, until)
    w = w.join(keys, "key", "left_semi") if keys is not None else w
    wrote = w.groupBy("model").agg(F.count("*").alias("writes"), F.countDistinct("key").alias("files_touched"))
    made = w.where("n = 1").select(F.when(F.col("tool_name") == "Write", F.col("model")).otherwise("unknown").alias("model")).groupBy("model").agg(F.count("*").alias("files_created"))
    return made.join(wrote, "model", "full").na.fill(0).select("model", "files_created", "writes", "files_touched").orderBy("model")


def unattributed(calls: DataFrame, scanned: DataFrame) -> DataFrame:
    """Keys on disk that no successful write explains, whatever the window."""
    return scanned.select("key").join(writes(calls).select("key").distinct(), "key", "left_anti").orderBy("key")
