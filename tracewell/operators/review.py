"""Reviews of a period: sessions, words, themes and outputs by month or week."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import in_window, round_binary
from .text import compaction_summary, headless, human_prose, idf, session_prose, spoken_rows, tokens

# Links to outputs, and prompts of shells.
GITHUB = r"(?i)(?<![A-Za-z0-9.-])(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)/(pull|issues)/(\d+)"
DRIVE = r"(?i)(?<![A-Za-z0-9.-])https?://docs\.google\.com/(document|spreadsheets|presentation)/(?:u/\d+/)?d/([A-Za-z0-9_-]+)"
DRIVE_KIND = {"document": "drive_document", "spreadsheets": "drive_spreadsheet", "presentation": "drive_presentation"}
PROMPT = re.compile(r"^(?:PS [A-Za-z]:\\[^>\r\n]*> ?|PS /[^>\r\n]*> ?|[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:[^\s$#]*[$#](?: |(?=\r?\n|$))|\$ )")


#: Line ends, as Python's ``splitlines`` has them, where a line begins, and white space inside it.
ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
BEGIN = rf"(?:\A|(?<=[{ENDS}])(?<!\r(?=\n)))"
INDENT = rf"(?:(?![{ENDS}])\s)*"
FENCE = rf"{BEGIN}{INDENT}(?P<mark>```|~~~)(?s:.*?){BEGIN}{INDENT}(?P=mark)[^{ENDS}]*(?:\r\n|[{ENDS}]|\Z)"
PASTED = re.compile(rf"{FENCE}|{BEGIN}{INDENT}(?:```|~~~)(?s:.*)|{BEGIN}{PROMPT.pattern[1:]}")


def unpasted(text: str) -> str:
    """Without fenced blocks (an open fence runs to the end) and without shell prompts at line starts."""
    return PASTED.sub("", text)


def strip_pasted(text: Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(unpasted, na_action="ignore")

    return of(text)


def bucket_start(ts: Column, bucket: str, zone: str) -> Column:
    """The local midnight at which a month or a week (from Monday) begins, as a local time."""
    if bucket not in ("month", "week"):
        raise ValueError("bucket must be 'week' or 'month'")
    return F.date_trunc(bucket, F.from_utc_timestamp(ts, zone))


def human_rows(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(file_path, session_id, source, ts, text): what people wrote in sessions with a person, at its time or else the session's."""
    rows = spoken_rows(events, sessions).where((F.col("role") == "user") & ~headless(F.col("entrypoint")) & ~compaction_summary(F.col("raw")))
    rows = rows.select("file_path", F.col("sid").alias("session_id"), F.col("src").alias("source"), F.coalesce("ts", "started_at").alias("ts"), human_prose(F.col("text"), F.col("src")).alias("text"))
    return rows.where("text <> '' and ts is not null")


def session_groups(sessions: DataFrame) -> DataFrame:
    """(source, session_id, file_path, ts, non_headless): files of one session id and source count once, at their earliest."""
    source = F.coalesce("source", F.lit("unknown"))
    key = F.struct(F.col("session_id").isNull().alias("n"), F.coalesce("session_id", "file_path").alias("k"))
    s = sessions.select(source.alias("source"), key.alias("key"), "session_id", "file_path", F.col("started_at").alias("ts"), (~headless(F.col("entrypoint"))).alias("h"))
    first = F.min(F.struct(F.col("ts").isNull().alias("z"), "ts", "file_path", "session_id"))
    return s.groupBy("source", "key").agg(first.alias("f"), F.bool_or("h").alias("non_headless")).select("source", "f.session_id", "f.file_path", "f.ts", "non_headless")


def links(calls: DataFrame) -> DataFrame:
    """One row for each link in a result: its key (kind, owner, repo, number, doc_id), form, and the call."""
    rows = calls.where(F.lower("result_text").contains("github.com/") | F.lower("result_text").contains("docs.google.com/"))
    base = [F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"), "session_id", "file_path", F.coalesce("source", F.lit("unknown")).alias("source"), "ts"]
    groups = lambda p, n: F.arrays_zip(*[F.regexp_extract_all("result_text", F.lit(p), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)])
    g = rows.select(*base, F.explode(groups(GITHUB, 4)).alias("m")).select(*base[1:], "tool_use_id", F.lit("github").alias("kind"), F.lower("m.g1").alias("owner"), F.lower("m.g2").alias("repo"), F.col("m.g4").cast("long").alias("number"), F.lit(None).cast("string").alias("doc_id"), F.lower("m.g3").alias("form"))
    d = rows.select(*base, F.explode(groups(DRIVE, 2)).alias("m")).select(*base[1:], "tool_use_id", F.lit("drive").alias("kind"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("long").alias("number"), F.col("m.g2").alias("doc_id"), F.lower("m.g1").alias("form"))
    return g.unionByName(d)


KEY = ["kind", "owner", "repo", "number", "doc_id"]


def appearances(links_: DataFrame) -> DataFrame:
    """One row for each key: its first dated appearance, if any, the first undated one, and whether any form says pull."""
    first = F.min(F.when(F.col("ts").isNotNull(), F.struct("ts", "tool_use_id", "session_id", "file_path", "source", "form")))
    undated = F.min(F.when(F.col("ts").isNull(), F.struct("tool_use_id", "source")))
    return links_.groupBy(*KEY).agg(first.alias("f"), undated.alias("u"), F.bool_or(F.col("form") == "pull").alias("is_pr"))


def infer_owner(apps: DataFrame) -> str | None:
    """The owner of most keys; of equals the first by name."""
    top = apps.where("kind = 'github'").groupBy("owner").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owner").first()
    return top["owner"] if top else None


def outputs(apps: DataFrame, owners: list[str], since=None, until=None) -> DataFrame:
    """Own pull requests, issues and documents by first appearance."""
    own = (F.col("kind") == "drive") | F.col("owner").isin(*[o.lower() for o in owners] or [""])
    rows = apps.where(own & F.col("f").isNotNull() & in_window(F.col("f.ts"), since, until))
    github = F.col("kind") == "github"
    drive = F.create_map(*[F.lit(x) for kv in DRIVE_KIND.items() for x in kv])
    kind = F.when(github, F.when(F.col("is_pr"), "pr").otherwise("issue")).otherwise(drive[F.col("f.form")])
    repo = F.when(github, F.concat_ws("/", "owner", "repo"))
    url = F.when(github, F.concat(F.lit("https://github.com/"), repo, F.when(F.col("is_pr"), "/pull/").otherwise("/issues/"), F.col("number").cast("string"))).otherwise(F.concat(F.lit("https://docs.google.com/"), F.col("f.form"), F.lit("/d/"), F.col("doc_id")))
    out = rows.select(url.alias("url"), kind.alias("kind"), repo.alias("repo"), "number", "doc_id", F.col("f.ts").alias("first_seen"), "f.session_id", "f.file_path", "f.source", F.lit("unchecked").alias("status"), F.col("f.tool_use_id").alias("__id"))
    return out.orderBy("first_seen", "url", "__id").drop("__id")


def confirm(outputs_: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Outputs with what was looked up: ``confirmed`` if first seen from two minutes before to ten after it was
    made, ``outside`` if later, ``unknown`` with an error if earlier or not known, ``unchecked`` for documents."""
    own = F.split("repo", "/")
    k = looked_up.select(F.lower("owner").alias("__o"), F.lower("repo").alias("__r"), F.col("number").alias("__n"), "created_at", "author", "is_pr", F.col("error").alias("__e"))
    both = outputs_.join(k, (own[0] == F.col("__o")) & (own[1] == F.col("__r")) & (F.col("number") == F.col("__n")), "left")
    delta = (F.unix_micros("first_seen") - F.unix_micros("created_at")) / 60_000_000
    repo, made = F.col("repo").isNotNull(), F.col("created_at").isNotNull()
    early = made & (delta < -2)
    status = F.when(~repo, "unchecked").when(~made | early, "unknown").when(delta <= 10, "confirmed").otherwise("outside")
    error = F.when(repo & early, "first seen before created_at").when(repo & ~made, F.coalesce("__e", F.lit("missing or invalid created_at")))
    kind = F.when(repo & made, F.when(F.col("is_pr"), "pr").otherwise("issue")).otherwise(F.col("kind"))
    url = F.when(repo, F.concat(F.lit("https://github.com/"), "repo", F.when(kind == "pr", "/pull/").otherwise("/issues/"), F.col("number").cast("string"))).otherwise(F.col("url"))
    return both.withColumns({"status": status, "error": error, "kind": kind, "url": url}).drop("__o", "__r", "__n", "__e", "is_pr")


def counters(apps: DataFrame, owners: list[str], since=None, until=None) -> DataFrame:
    """(what, source, n): ``undated`` own links, and ``references`` to others' repositories."""
    own = (F.col("kind") == "drive") | F.col("owner").isin(*[o.lower() for o in owners] or [""])
    dated = F.col("f").isNotNull()
    what = F.when(own & ~dated, "undated").when(~own & (~dated | in_window(F.col("f.ts"), since, until)), "references")
    return apps.select(what.alias("what"), F.coalesce("f.source", "u.source").alias("source")).where("what is not null").groupBy("what", "source").agg(F.count("*").alias("n")).orderBy("what", "source")


def with_gaps(starts: DataFrame, bucket: str) -> DataFrame:
    """Every bucket from the first to the last of ``start``."""
    step = F.expr("interval 1 month") if bucket == "month" else F.expr("interval 7 days")
    ends = starts.agg(F.min("start").alias("a"), F.max("start").alias("z")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "z", step)).alias("start"))


def themes(rows: DataFrame, weights: DataFrame, bucket: str, zone: str, top: int = 10) -> DataFrame:
    """(start, rank, term, count, weight): the heaviest terms of what people wrote, by bucket."""
    words = rows.select(bucket_start(F.col("ts"), bucket, zone).alias("start"), F.explode(tokens(strip_pasted(F.col("text")))).alias("term"))
    counts = words.groupBy("start", "term").agg(F.count("*").alias("count")).join(weights, "term").withColumn("w", F.col("count") * F.col("idf"))
    rank = F.row_number().over(W.partitionBy("start").orderBy(F.desc("w"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("start", "rank", "term", "count", round_binary(F.col("w"), 3).alias("weight"))


def buckets(events: DataFrame, sessions: DataFrame, calls: DataFrame, since=None, until=None, bucket: str = "month", zone: str = "UTC", owners: list[str] | None = None) -> DataFrame:
    """(start, label, sessions, non_headless, human_chars, outputs), without gaps."""
    groups = session_groups(sessions).where(F.col("ts").isNotNull() & in_window(F.col("ts"), since, until))
    rows = human_rows(events, sessions).where(in_window(F.col("ts"), since, until))
    apps = appearances(links(calls))
    who = owners if owners is not None else [o for o in [infer_owner(apps)] if o]
    outs = outputs(apps, who, since, until)
    at = lambda c: bucket_start(F.col(c), bucket, zone).alias("start")
    zero = lambda: F.lit(0).cast("long")
    all_ = groups.select(at("ts"), F.lit(1).cast("long").alias("sessions"), F.col("non_headless").cast("long").alias("non_headless"), zero().alias("human_chars"), zero().alias("outputs"))
    all_ = all_.union(rows.select(at("ts"), zero(), zero(), F.length("text").cast("long"), zero())).union(outs.select(at("first_seen"), zero(), zero(), zero(), F.lit(1).cast("long")))
    sums = all_.groupBy("start").agg(*[F.sum(c).alias(c) for c in ("sessions", "non_headless", "human_chars", "outputs")])
    label = F.date_format("start", "yyyy-MM" if bucket == "month" else "yyyy-MM-dd")
    return with_gaps(sums, bucket).join(sums, "start", "left").na.fill(0).withColumn("label", label).orderBy("start")


def theme_report(events: DataFrame, sessions: DataFrame, since=None, until=None, bucket: str = "month", zone: str = "UTC", top: int = 10) -> DataFrame:
    own, terms = session_prose(events, sessions)
    rows = human_rows(events, sessions).where(in_window(F.col("ts"), since, until))
    return themes(rows, idf(own, terms), bucket, zone, top).orderBy("start", "rank")
