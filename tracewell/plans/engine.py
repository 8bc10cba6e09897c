"""The engine: build a store, ask it questions."""

from __future__ import annotations

import os
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C
from ..functions import parse as P
from ..functions.shell import Rules
from ..operators import denials as D
from ..operators import hygiene as H
from ..operators import memory as M
from ..operators import mining, pending, recalls, review, salvage, search, text, topics, trace
from ..sources import codex, cursor, ledgers, lookup, opencode, session_log, web_export
from ..sources.lines import discover, files, lines, parent_name
from .store import Store, changed_files, files_named, files_per_root, ledger_rows, recounted, stat

PATTERNS = {"claude_code": "*.jsonl", "opencode": "*.ndjson", "cursor": "*.jsonl", "codex": "*.jsonl"}
READERS = {"claude_code": session_log, "opencode": opencode, "cursor": cursor, "codex": codex}
INFO_TABLES = ("sessions", "events", "tool_calls", "source_files")


def read_only(spark: SparkSession, query: str) -> bool:
    """Whether a statement, as Spark parses it, holds no command and no statement that writes or runs scripts, at any depth.

    Commands that show, describe or explain are let through at the top. What can't be parsed raises Spark's ParseException.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    load = spark.sparkContext._jvm.Thread.currentThread().getContextClassLoader().loadClass
    kinds = [load(f"org.apache.spark.sql.catalyst.plans.logical.{name}") for name in ("Command", "ParsedStatement")]
    name = plan.getClass().getSimpleName()
    if name.startswith(("Show", "Describe", "Explain")):
        return True
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if any(k.isInstance(node) for k in kinds) or name.startswith("Compound") or "ScriptTransformation" in name:
            return False
        inner = node.innerChildren() if name in ("UnresolvedWith", "SubqueryAlias") else ()
        todo += [seq.apply(i) for seq in (node.children(), *([inner] if inner else [])) for i in range(seq.length())]
    return True


class Engine:
    """``server`` names the memory server whose recalls are followed."""

    def __init__(self, spark: SparkSession, path: str, server: str = "memory"):
        self.spark, self.store, self.server = spark, Store(spark, path), server

    # ---- building

    def build(self, sources: dict[str, list[str]], chats: list[str] = (), exports: list[str] = (), ledger: str | None = None) -> dict:
        """Read what is new or changed under ``sources`` (by source name) into the store.

        A file is read whole or not at all. ``chats`` hold metas and stores beside
        ``cursor`` transcripts, and are applied at each build to whatever sessions the
        store holds; ``exports`` are conversation exports; ``ledger`` is
        the memory server's database. Returns counts and what was missing.
        """
        try:
            return self._build(sources, list(chats), list(exports), ledger)
        finally:
            self.store.unstage()

    def _build(self, sources: dict[str, list[str]], chats: list[str], exports: list[str], ledger: str | None) -> dict:
        report: dict = {"missing": [], "read": {}, "unchanged": {}}
        known = self.store.table("source_files") if self.store.exists() else schema.empty(self.spark, "source_files")
        parts: list[dict[str, DataFrame]] = []
        changed, errors = [], []
        for name, reader in READERS.items():
            paths, missing = discover(sources.get(name, ()), PATTERNS[name], prune=name == "opencode")
            report["missing"] += missing
            if not paths:
                continue
            new = changed_files(stat(self.spark, paths), known).select("file_path")
            todo = sorted(r[0] for r in new.collect())  # names of changed files, which the driver has listed itself
            report["read"][name], report["unchanged"][name] = len(todo), len(paths) - len(todo)
            if todo:
                got = files(self.spark, todo)
                numbered = lines(got)
                parts.append(reader.ingest(numbered, self.store.staged))
                changed.append(got)
                errors.append(numbered.where(_broken(F.col("raw"))).groupBy("file_path").agg(F.count("*").alias("n_parse_errors")))
        if exports:
            found, missing = discover(exports, "*")
            report["missing"] += missing
            if found:
                parts.append(web_export.ingest(files(self.spark, found)))
        metas, missing = discover(chats, "meta.json", depth=2)
        report["missing"] += missing
        held = self._held(metas, changed) if metas and self.store.exists() else None
        if not parts and held is None:
            return report | {"tables": {}}
        names = ("sessions", "events", "tool_calls")
        tables = {n: _union([p[n] for p in parts]) if parts else schema.empty(self.spark, n) for n in names}
        known_recalls = ledgers.recall_ledger(self.spark, ledger) if ledger else None
        told = recalls.recall_calls(tables["events"], tables["tool_calls"], self.server, known_recalls)  # what transcripts alone say
        none = self.spark.createDataFrame([], "file_path string, n_parse_errors long")
        got = _union(changed) if changed else files(self.spark, [])
        keys = got.select("file_path").union(tables["sessions"].where("source = 'claude_ai'").select("file_path"))
        if held is not None:
            tables = {n: tables[n].unionByName(held[n]) for n in names}
            told, keys = told.unionByName(held["recall_calls"]), keys.union(held["sessions"].select("file_path"))
        if chats:
            tables, report["chats"] = self._chats(tables, metas, missing)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        tables["recall_calls"] = told
        tables["source_files"] = ledger_rows(got, tables, _union(errors) if errors else none, now)
        if held is not None:
            tables["source_files"] = tables["source_files"].unionByName(recounted(held["source_files"], tables["events"]))
        self.store.replace(keys.distinct(), tables, {k: [os.path.abspath(os.path.expanduser(p)) for p in v] for k, v in {**sources, "chats": chats}.items()})
        fresh = {n: self.store.table(n) for n in INFO_TABLES}
        return report | {"tables": {n: t.count() for n, t in fresh.items()}, "parse_errors": fresh["source_files"].agg(F.sum("n_parse_errors")).first()[0] or 0}

    def _held(self, metas: list[str], changed: list[DataFrame]) -> dict[str, DataFrame] | None:
        """Stored rows of the transcripts that chats belong to and that this build doesn't read; None without such.

        Where an earlier chat store took the place of a transcript's events, these are
        read from the transcript again, if it is still there: the chat store may have gone.
        """
        named = files_named(self.spark, metas).select(parent_name(F.col("file_path")).alias("session_id")).distinct()
        mine = self.store.table("sessions").where("source = 'cursor'").join(named, "session_id", "left_semi").select("file_path").distinct()
        if changed:
            mine = mine.join(_union(changed).select("file_path"), "file_path", "left_anti")
        if mine.isEmpty():
            return None
        held = {n: self.store.table(n).join(mine, "file_path", "left_semi").select(self.store.table(n).columns) for n in schema.TABLES}
        own = held["events"].groupBy("file_path").agg(F.bool_and(F.col("event_id").startswith("cursor:text:")).alias("own"))
        lost = mine.join(own.where("own"), "file_path", "left_anti").collect()  # at most a path for each meta, which the driver has listed
        back = sorted(p for (p,) in lost if os.path.isfile(p))
        if back:
            of = held["sessions"].select("file_path", "cwd")
            read = cursor.events(cursor.blocks(lines(files(self.spark, back)))).drop("cwd").join(of, "file_path", "left")
            rest = held["events"].join(files_named(self.spark, back), "file_path", "left_anti").select(held["events"].columns)
            held["events"] = rest.unionByName(schema.conform(read, schema.EVENTS))
            held["sessions"] = recounted(held["sessions"], held["events"])
        return held

    def _chats(self, tables: dict[str, DataFrame], metas: list[str], missing: list[str]) -> tuple[dict[str, DataFrame], dict]:
        """Metas and chat stores applied to ``tables``; counts are of all sessions, stored ones included."""
        told = {"metas": len(metas), "missing": missing}
        if metas:
            read = cursor.metas(files(self.spark, metas))
            known = self.store.table("sessions").select("session_id", "source") if self.store.exists() else schema.empty(self.spark, "sessions").select("session_id", "source")
            matched, unmatched = cursor.meta_match(known.union(tables["sessions"].select("session_id", "source")), read)
            told |= {"matched": matched.count(), "unmatched": unmatched.count()}
            tables = {**tables, **cursor.apply_metas(tables, read)}
        beside = [p for m in metas if os.path.isfile(p := os.path.join(os.path.dirname(m), "store.db"))]
        if beside:
            tables = cursor.apply_stores(tables, cursor.stores(files(self.spark, beside)))
        return tables, told

    # ---- asking

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    def views(self) -> None:
        """Register the tables and both views under their names."""
        for name, df in self.store.tables().items():
            df.createOrReplaceTempView(name)
        D.denial_followups(self.table("tool_calls")).createOrReplaceTempView("denial_followups")
        self.table("recall_calls").createOrReplaceTempView("recall_followups")

    def sql(self, query: str) -> DataFrame:
        """Spark SQL over the tables and views. What is parsed must be a query, or show, describe or explain one."""
        if not read_only(self.spark, query):
            raise ValueError("only queries are run")
        self.views()
        return self.spark.sql(query)

    def denials(self, session: str | None = None, limit: int = 50) -> DataFrame:
        return D.newest(D.denial_followups(self.table("tool_calls")), session, limit)

    def recalls(self, session: str | None = None, limit: int = 50) -> DataFrame:
        return D.newest(self.table("recall_calls"), session, limit)

    def resolve(self, prefix: str) -> str:
        return trace.resolve(self.table("sessions"), self.table("tool_calls"), prefix)

    def session_trace(self, prefix: str, limit: int = 200, max_chars: int = 500) -> dict:
        sid = self.resolve(prefix)
        e, c, r = (self.table(n) for n in ("events", "tool_calls", "recall_calls"))
        rows = trace.timeline(e, c, r, sid, 0, max_chars)
        total = rows.count()
        s = self.table("sessions").where(F.col("session_id") == sid).orderBy(F.asc_nulls_last("started_at"), "file_path").limit(1)
        own = s.select("session_id", C.format_ts(F.col("started_at")).alias("started_at"), C.format_ts(F.col("ended_at")).alias("ended_at"), "n_events", "n_tool_calls").collect()
        has = {f"has_{n}": not self.table(n).where(F.col("session_id") == sid).isEmpty() for n in ("sessions", "events", "tool_calls", "recall_calls")}
        shown = min(total, limit) if limit else total
        return {"session": own[0].asDict() if own else {"session_id": sid}, "coverage": {"total": total, "returned": shown, "truncated": shown < total, **has}, "timeline": rows.limit(limit) if limit else rows}

    def topics(self, prefix: str, window: int = 3, terms: int = 8) -> dict:
        if window < 1:
            raise ValueError(f"window must be at least 1, got {window}")
        sid = self.resolve(prefix)
        e, s = self.table("events"), self.table("sessions")
        own, all_terms = text.session_prose(e, s)
        ex = topics.exchanges(e, s, sid)
        v = topics.vectors(ex, text.idf(own, all_terms))
        bounds = topics.boundaries(topics.similarities(ex, v, window), window)
        title = topics.titles(e.where(F.col("session_id") == sid)).first()
        project = s.where(F.col("session_id") == sid).orderBy(F.asc_nulls_last("started_at"), "file_path").select("project_dir").first()
        return {"session_id": sid, "project_dir": project[0] if project else None, "title": title["title"] if title else None, "title_kind": title["title_kind"] if title else None, "n_exchanges": ex.count(), "segments": topics.segments(ex, v, bounds, terms).orderBy("start")}

    def info(self) -> dict:
        counts = {n: self.table(n).count() for n in INFO_TABLES}
        span = self.table("sessions").agg(F.min("started_at").alias("a"), F.max("ended_at").alias("z")).first()
        known, roots = self.table("source_files"), self.store.manifest()["roots"]
        out = {"path": self.store.path, "tables": counts, "started_at": span["a"], "ended_at": span["z"], "roots": {}, "stale": 0}
        for name, paths in roots.items():
            if paths:
                r = files_per_root(known, self.spark.createDataFrame([(p,) for p in paths], "root string"))
                out["roots"][name] = {x["root"]: x["n_files"] for x in r.collect()}
            if name in PATTERNS and paths:
                found, _ = discover(paths, PATTERNS[name], prune=name == "opencode")
                out["stale"] += changed_files(stat(self.spark, found), known).count()
        return out

    def schema(self, table: str | None = None) -> dict[str, list[tuple[str, str]]]:
        kinds = {n: [(f.name, f.dataType.simpleString()) for f in t] for n, t in schema.TABLES.items()}
        kinds["denial_followups"] = D.denial_followups(schema.empty(self.spark, "tool_calls")).dtypes
        kinds["recall_followups"] = kinds["recall_calls"]
        if table is not None and table not in kinds:
            raise ValueError(f"no table {table!r}")
        return kinds if table is None else {table: kinds[table]}

    def salvage(self, ledger: str | None = None, signals: dict[str, Column] | None = None, notes: Column | None = None, minutes: int = 30, since=None, limit: int = 50) -> DataFrame:
        notes = (F.col("tool_name") == f"mcp__{self.server}__agenda_edit") & (F.col("outcome") == "ok") if notes is None else notes
        actions = ledgers.action_times(self.spark, ledger) if ledger else None
        return salvage.nominations(self.table("tool_calls"), notes, signals, actions, minutes, since, limit)

    def nominate(self, since=None, until=None, min_sessions: int = 3, min_stability: float = 1.0, max_chars: int = 2000, exclude_file: str | None = None) -> DataFrame:
        rituals = (*mining.RITUAL, *(ledgers.pattern_list(exclude_file) if exclude_file else ()))
        return mining.nominate(self.table("tool_calls"), since, until, min_sessions, min_stability, max_chars, rituals)

    def orphans(self, sinks: list[str] = (), reviewed: str | None = None, **options) -> DataFrame:
        held, _ = ledgers.sinks(self.spark, sinks) if sinks else (None, [])
        ids = ledgers.reviewed_ids(reviewed) if reviewed else None
        return text.orphans(self.table("events"), self.table("sessions"), held, reviewed=ids, **options)

    def mark_reviewed(self, path: str, add: list[str] = (), remove: list[str] = ()) -> list[str]:
        return ledgers.update_reviewed(path, [self.resolve(p) for p in add], [self.resolve(p) for p in remove])

    def memory_authors(self, dirs: list[str] = (), since=None, until=None, model: str | None = None) -> dict[str, DataFrame]:
        e, c = self.table("events"), self.table("tool_calls")
        disk = ledgers.memory_files(dirs)
        rows = M.files(c, e, since, until, sorted(disk.values()))
        if model is not None:
            rows = rows.where((F.col("created_by") == model) | F.exists("edits", lambda x: x["model"] == model))
        scanned = self.spark.createDataFrame([(k,) for k in disk], "key string")
        return {"files": rows, "summary": M.models(c, e, since, until, rows.select("key")), "unattributed": M.unattributed(c, scanned)}

    def review(self, since=None, until=None, bucket: str = "month", zone: str | None = None, themes: int = 10, owners: list[str] | None = None, gh: bool = False, call: lookup.Call = lookup.gh) -> dict:
        if since is not None and until is not None and since > until:
            raise ValueError("since must not be after until")
        zone = zone or local_zone()
        e, s, c = self.table("events"), self.table("sessions"), self.table("tool_calls")
        apps = review.appearances(review.links(c))
        who = sorted({o.lower() for o in owners}) if owners is not None else [o for o in [review.infer_owner(apps)] if o]
        outs = review.outputs(apps, who, since, until)
        if gh:
            keys = [(*r["repo"].split("/", 1), r["number"]) for r in outs.where("repo is not null").collect()]
            outs = review.confirm(outs, lookup.look_up(self.spark, keys, call))
        return {"zone": zone, "bucket": bucket, "owners": who, "owners_inferred": owners is None, "buckets": review.buckets(e, s, c, since, until, bucket, zone, who), "outputs": outs, "counters": review.counters(apps, who, since, until), "themes": review.theme_report(e, s, since, until, bucket, zone, themes) if themes else None}

    def pending(self, gh: bool = False, call: lookup.Call = lookup.gh, **options) -> DataFrame:
        """Open items; with ``gh`` the states of their references are looked up."""
        e, s = self.table("events"), self.table("sessions")
        if gh:
            who = options.get("owner") or pending.default_owner(pending.repositories(pending.summaries(e, s, True)))
            options["names_of"] = lookup.repositories(who, call) if who else None
        items = pending.pending_items(e, s, **options)
        return pending.pending_items(e, s, **options, states=lookup.look_up(self.spark, pending.asked(items), call)) if gh else items

    def hygiene(self, since=None, until=None, rules: Rules = Rules()) -> dict[str, DataFrame]:
        c = self.table("tool_calls")
        return {"categories": H.audit(c, since, until, rules), "sources": H.coverage(c, since, until), "untimed": H.untimed(c, since, until)}

    def compare_periods(self, baseline: tuple, current: tuple, rules: Rules = Rules()) -> dict[str, DataFrame]:
        for a, z in (baseline, current):
            if a > z:
                raise ValueError("a period must not end before it begins")
        c = self.table("tool_calls")
        return {"categories": H.compare(c, baseline, current, rules), "asymmetry": H.asymmetry(c, baseline, current)}

    def grep(self, pattern: str, tool_calls: bool = False, **options) -> DataFrame:
        return search.search(self.table("events"), self.table("tool_calls") if tool_calls else None, pattern, **options)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _broken(raw: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: P.load(r) is None)

    return of(raw)


def local_zone() -> str:
    """The machine's zone by name: ``$TZ``, else where /etc/localtime leads, else UTC."""
    from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

    spelled = [os.environ.get("TZ", ""), os.path.realpath("/etc/localtime").partition("/zoneinfo/")[2]]
    for name in filter(None, spelled):
        try:
            ZoneInfo(name)
            return name
        except (ZoneInfoNotFoundError, ValueError):
            continue
    return "UTC"
