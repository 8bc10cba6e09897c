"""Open items of compaction summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions.columns import in_window
from .text import compaction_summary

REFERENCES = "array<struct<owner:string,repo:string,number:long,state:string,bare:boolean,via:string>>"


def summaries(events: DataFrame, sessions: DataFrame, every: bool = False) -> DataFrame:
    """(file_path, session_id, ts, seq, text, project_dir, title): the last summary of each file, or every one."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rows = events.where(no("is_meta") & no("is_sidechain"))
    order = F.struct(F.col("ts").isNull().alias("z"), "ts", "seq")
    titles = rows.where(F.col("type").isin("ai-title", "custom-title") & (F.col("text") != "")).groupBy("file_path").agg(F.max_by("text", order).alias("title"))
    own = rows.where((F.col("role") == "user") & ~F.coalesce(F.col("type").isin("ai-title", "custom-title"), F.lit(False)) & compaction_summary(F.col("raw")))
    own = own.select("file_path", "session_id", "ts", "seq", F.coalesce("text", F.lit("")).alias("text"), order.alias("__o"))
    if not every:
        last = own.groupBy("file_path").agg(F.max_by(F.struct("session_id", "ts", "seq", "text"), "__o").alias("s"))
        own = last.select("file_path", "s.*")
    project = sessions.groupBy("file_path").agg(F.min("project_dir").alias("project_dir"))
    return own.drop("__o").join(project, "file_path", "left").join(titles, "file_path", "left")


def explicit_refs(text: Column) -> Column:
    @F.pandas_udf("array<struct<owner:string,repo:string,number:long>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"owner": o, "repo": r, "number": n} for o, r, n in R.explicit(t or "")] for t in texts])

    return of(text)


def repositories(all_summaries: DataFrame) -> DataFrame:
    """(owner, repo): repositories that any summary names in full."""
    return all_summaries.select(F.explode(explicit_refs(F.col("text"))).alias("r")).select("r.owner", "r.repo").distinct()


def default_owner(repos: DataFrame) -> str | None:
    """The owner of most repositories; of equals the last by name."""
    top = repos.groupBy("owner").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("owner")).first()
    return top["owner"] if top else None


def sections(text: Column) -> Column:
    """Items of the pending section; null without a section."""

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        found = [R.section(t or "") for t in texts]
        return pd.Series([None if s is None else R.items(s) for s in found])

    return of(text)


def status(references: Column) -> Column:
    state = lambda *names: lambda r: r["state"].isin(*names)
    return (
        F.when(F.size(references) == 0, "unreferenced")
        .when(F.exists(references, state("open")), "open")
        .when(F.forall(references, state("closed", "merged")), "resolved")
        .when(F.exists(references, state("unknown")), "unknown")
        .otherwise("unchecked")
    )


def pending_items(events: DataFrame, sessions: DataFrame, owner: str | None = None, repo: tuple[str, str] | None = None, since=None, until=None, every: bool = False, states: DataFrame | None = None, names_of: list[str] | None = None) -> DataFrame:
    """One row for each item: where it stands, its text, whether deferred, references and status.

    Repositories are learned from all summaries, whatever the window; there are as
    many as people named, and they come to the driver. ``states(owner, repo, number,
    state)`` answers for references that were looked up; ``names_of`` are the owner's
    repositories, where they are known from elsewhere.
    """
    all_ = summaries(events, sessions, True)
    known = repositories(all_)
    names = known.collect()
    who = owner or max(((sum(r["owner"] == o for r in names), o) for o in {r["owner"] for r in names}), default=(0, None))[1]
    repos = sorted({r["repo"] for r in names}) if names_of is None else names_of

    @F.pandas_udf(REFERENCES)
    def refs(texts: pd.Series) -> pd.Series:
        return pd.Series([R.references(t, who, repos, repo) for t in texts])

    rows = summaries(events, sessions, every).where(in_window(F.col("ts"), since, until)).withColumn("items", sections(F.col("text")))
    flat = rows.select("file_path", "session_id", "ts", "seq", "project_dir", "title", F.posexplode("items").alias("position", "item"))
    out = flat.withColumns({"deferred": F.col("item").rlike(R.DEFERRED), "references": refs(F.col("item"))})
    if states is not None:
        keys = ["file_path", "seq", "position"]
        each = out.select(*keys, F.posexplode("references").alias("k", "r")).select(*keys, "k", "r", F.col("r.owner").alias("owner"), F.col("r.repo").alias("repo"), F.col("r.number").alias("number"))
        each = each.join(states.select("owner", "repo", "number", F.col("state").alias("__s")), ["owner", "repo", "number"], "left")
        told = each.select(*keys, F.struct("k", F.col("r").withField("state", F.coalesce("__s", "r.state")).alias("r")).alias("x")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("__r"))
        out = out.join(told, keys, "left").withColumn("references", F.coalesce("__r", "references")).drop("__r")
    return out.withColumn("status", status(F.col("references"))).orderBy(F.desc_nulls_last("ts"), F.desc("file_path"), "seq", "position")


def asked(items: DataFrame) -> list[tuple[str, str, int]]:
    """Resolved references, each once: what there is to look up, a command for each."""
    rows = items.select(F.explode("references").alias("r")).where("r.owner is not null").select("r.owner", "r.repo", "r.number").distinct()
    return [tuple(r) for r in rows.collect()]


def counts(items: DataFrame) -> DataFrame:
    """(status, items) of all five statuses."""
    names = items.sparkSession.createDataFrame(list(enumerate(R.STATUSES)), "position int, status string")
    return names.join(items.groupBy("status").agg(F.count("*").alias("items")), "status", "left").na.fill(0, ["items"]).orderBy("position").select("status", "items")


def without_section(events: DataFrame, sessions: DataFrame, every: bool = False) -> DataFrame:
    return summaries(events, sessions, every).where(sections(F.col("text")).isNull())
