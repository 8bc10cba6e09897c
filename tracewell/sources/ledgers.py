"""Side inputs: SQLite ledgers, memory folders, text sinks and lists in files.

Ledgers are small and local to the machine that builds, so the driver reads them.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from .lines import files

SKIPPED_FOLDERS = (".git", "node_modules", ".venv", "__pycache__")
SINK_LIMIT, SINK_PROBE = 1024 * 1024, 8192


def ledger(path: str, table: str) -> sqlite3.Connection | None:
    """A read-only connection; None if the file or the table can't be read."""
    path = os.path.expanduser(path)
    if not os.path.exists(path):
        return None
    db = None
    try:
        db = sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro", uri=True)
        db.execute(f'SELECT 1 FROM "{table}" LIMIT 1')
        return db
    except sqlite3.Error:
        if db is not None:
            db.close()
        return None


def action_times(spark: SparkSession, path: str) -> DataFrame | None:
    """``ts`` of all actions, made and done; None without a readable ledger."""
    db = ledger(path, "actions")
    if db is None:
        return None
    try:
        rows = db.execute("SELECT created_at, done_at FROM actions").fetchall()
    finally:
        db.close()
    wide = spark.createDataFrame([(P.moment(a), P.moment(b)) for a, b in rows], "created_at timestamp, done_at timestamp")
    return wide.select(F.explode(F.array("created_at", "done_at")).alias("ts")).where("ts is not null")


def recall_ledger(spark: SparkSession, path: str, agent: str = "cursor") -> DataFrame | None:
    """query, nth (from 1), ts, output: each recall of the agent in order of time, its output the
    contents of its matches, in their order."""
    db = ledger(path, "recalls")
    if db is None:
        return None
    try:
        recalls = db.execute("SELECT rowid, created_at, query, matches FROM recalls WHERE agent = ?", (agent,)).fetchall()
        known = db.execute("SELECT id, content FROM conclusions").fetchall()
    finally:
        db.close()
    rows = []
    for n, at, query, matches in recalls:
        try:
            found = json.loads(matches) if matches else []
        except ValueError:
            found = []
        if isinstance(query, str):
            rows.append((n, at, P.moment(at), query, [m.get("id") for m in P.objects(found) if isinstance(m.get("id"), int)]))
    r = spark.createDataFrame(rows, "n long, at string, ts timestamp, query string, ids array<long>")
    c = spark.createDataFrame([(i, t) for i, t in known if isinstance(i, int)], "id long, content string")
    pieces = r.select("n", F.posexplode("ids").alias("pos", "id")).join(c, "id").groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("output"))
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("query").orderBy("at", "n"))
    return r.join(pieces, "n", "left").select("query", nth.alias("nth"), "ts", F.coalesce("output", F.lit("")).alias("output"))


def memory_files(dirs: Iterable[str]) -> dict[str, str]:
    """``<project>/<file>`` to path of the Markdown files directly in memory folders."""
    found = {}
    for d in dirs:
        if os.path.isdir(d):
            project = os.path.basename(os.path.dirname(os.path.abspath(d)))
            for name in sorted(os.listdir(d)):
                if name.endswith(".md") and os.path.isfile(os.path.join(d, name)):
                    found[f"{project}/{name}"] = os.path.join(d, name)
    return found


def sinks(spark: SparkSession, paths: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Lower-cased text of each sink file, and the paths that don't exist. Large and binary files are left out."""
    found, missing = set(), []
    for path in map(os.path.expanduser, paths):
        if os.path.isfile(path):
            found.add(os.path.realpath(path))
        elif not os.path.isdir(path):
            missing.append(path)
        for folder, below, names in os.walk(path):
            below[:] = [b for b in below if b not in SKIPPED_FOLDERS]
            found.update(os.path.realpath(os.path.join(folder, n)) for n in names)
    raw = files(spark, sorted(p for p in found if os.path.isfile(p)))
    plain = raw.where((F.col("size_bytes") <= SINK_LIMIT) & ~F.contains(F.substring("content", 1, SINK_PROBE), F.lit(b"\0")))
    return plain.select("file_path", F.lower(F.regexp_replace(F.decode("content", "UTF-8"), "�", "")).alias("text")), missing


def pattern_list(path: str) -> list[str]:
    """Patterns of a file, one a line; ``#`` begins a comment. A bad pattern is named with its line."""
    out = []
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            line = line.strip()
            if line and not line.startswith("#"):
                try:
                    re.compile(line)
                except re.error as e:
                    raise ValueError(f"invalid regex on line {n}: {line}") from e
                out.append(line)
    return out


def reviewed_ids(path: str) -> list[str]:
    """Ids of a reviewed-sessions file; blank lines and comments are skipped, a missing file is empty."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [x.split("#")[0].strip() for x in f if x.split("#")[0].strip()]


def update_reviewed(path: str, add: Iterable[str] = (), remove: Iterable[str] = ()) -> list[str]:
    """Add and remove ids under a lock; comments and order stay. The file is replaced in one step."""
    import fcntl

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    add, remove = list(add), set(remove)
    with open(path + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        old = open(path, encoding="utf-8").read().splitlines() if os.path.exists(path) else []
        kept = [x for x in old if x.split("#")[0].strip() not in remove or not x.split("#")[0].strip()]
        have = {x.split("#")[0].strip() for x in kept}
        kept += [x for x in dict.fromkeys(add) if x not in have and x not in remove]
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            f.write("".join(x + "\n" for x in kept))
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".tmp", path)
    return reviewed_ids(path)
