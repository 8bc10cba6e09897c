"""Command line: ``python -m tracewell.cli --store PATH COMMAND``.

0: done (search commands: something found); 1: nothing found or an error; 2: bad arguments.
"""

from __future__ import annotations

import argparse
import csv
import json
import sys
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from .functions.parse import moment
from .operators.search import InvalidPattern
from .operators.trace import SessionNotFound
from .plans.engine import READERS, Engine
from .plans.store import StoreError
from .session import session


def when(value: str) -> datetime:
    at = moment(value)
    if at is None:
        raise argparse.ArgumentTypeError(f"not a time: {value}")
    return at


def period(value: str) -> tuple[datetime, datetime]:
    a, sep, z = value.partition("..")
    if not sep:
        raise argparse.ArgumentTypeError("a period is FROM..TO")
    return when(a), when(z)


def count(value: str) -> int:
    if not value.isdigit():
        raise argparse.ArgumentTypeError(f"not a whole number: {value}")
    return int(value)


def repo(value: str) -> tuple[str, str]:
    owner, _, name = value.partition("/")
    if not owner or not name or "/" in name:
        raise argparse.ArgumentTypeError("a repository is OWNER/NAME")
    return owner, name


def cell(value) -> str:
    return "NULL" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (list, dict)) else str(value)


def show(df: DataFrame, form: str, out) -> int:
    """Print rows as a table, JSON or CSV; how many there were."""
    rows = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    if form == "json":
        print(json.dumps(rows, ensure_ascii=False, indent=2, default=str), file=out)
    elif form == "csv":
        w = csv.writer(out)
        w.writerow(df.columns)
        w.writerows([["" if r[c] is None else cell(r[c]) for c in df.columns] for r in rows])
    else:
        body = [[cell(r[c]) for c in df.columns] for r in rows]
        width = [max(map(len, col)) for col in zip(df.columns, *body)]
        line = lambda cells: "  ".join(x.ljust(w) for x, w in zip(cells, width)).rstrip()
        print("\n".join([line(df.columns), line(["-" * w for w in width]), *map(line, body)]), file=out)
        print(f"({len(rows)} row{'s' * (len(rows) != 1)})", file=out)
    return len(rows)


def report(found: dict, form: str, out) -> None:
    """Print a report of several tables and values."""
    if form == "json":
        print(json.dumps({k: [r.asDict(recursive=True) for r in v.toLocalIterator()] if isinstance(v, DataFrame) else v for k, v in found.items()}, ensure_ascii=False, indent=2, default=str), file=out)
        return
    for name, v in found.items():
        if isinstance(v, DataFrame):
            print(f"\n{name}:", file=out)
            show(v, form, out)
        elif isinstance(v, dict):
            print(f"{name}: " + ", ".join(f"{k}={cell(x)}" for k, x in v.items()), file=out)
        else:
            print(f"{name}: {cell(v)}", file=out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell", description="Analytics over agent transcripts.")
    p.add_argument("--store", required=True, help="folder of the store")
    p.add_argument("--server", default="memory", help="name of the memory server")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, windowed: bool = False, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=options.get("help"))
        c.add_argument("--format", choices=("table", "json", "csv"), default="table")
        if windowed:
            c.add_argument("--since", type=when)
            c.add_argument("--until", type=when)
        return c

    b = command("build", help="read transcripts into the store")
    for name in READERS:
        b.add_argument(f"--{name.replace('_', '-')}", nargs="*", default=[], dest=name)
    b.add_argument("--chats", nargs="*", default=[])
    b.add_argument("--exports", nargs="*", default=[])
    b.add_argument("--ledger")
    command("sql", help="Spark SQL over the tables").add_argument("query")
    for name in ("denials", "recalls"):
        c = command(name)
        c.add_argument("--session")
        c.add_argument("--limit", type=count, default=50)
    c = command("session-trace")
    c.add_argument("session")
    c.add_argument("--limit", type=count, default=200)
    c.add_argument("--max-chars", type=count, default=500)
    c = command("topics")
    c.add_argument("session")
    c.add_argument("--window", type=count, default=3)
    c.add_argument("--terms", type=count, default=8)
    command("info")
    command("schema").add_argument("table", nargs="?")
    c = command("salvage")
    c.add_argument("--since", type=when)
    c.add_argument("--ledger")
    c.add_argument("--window", type=count, default=30)
    c.add_argument("--limit", type=count, default=50)
    c = command("nominate", True)
    c.add_argument("--min-sessions", type=count, default=3)
    c.add_argument("--min-stability", type=float, default=1.0)
    c.add_argument("--max-chars", type=count, default=2000)
    c.add_argument("--exclude-file")
    c = command("orphans", True)
    c.add_argument("--sinks", nargs="*", default=[])
    c.add_argument("--reviewed")
    for name, value in (("min-tf", 3), ("min-human-chars", 800), ("min-orphans", 3), ("limit", 20)):
        c.add_argument(f"--{name}", type=count, default=value)
    c.add_argument("--include-headless", action="store_true")
    c.add_argument("--show-reviewed", action="store_true")
    c.add_argument("--mark", nargs="*", default=[])
    c.add_argument("--unmark", nargs="*", default=[])
    c = command("memory-authors", True)
    c.add_argument("--dirs", nargs="*", default=[])
    c.add_argument("--model")
    c = command("review", True)
    c.add_argument("--bucket", choices=("month", "week"), default="month")
    c.add_argument("--zone")
    c.add_argument("--themes", type=count, default=10)
    c.add_argument("--owners", nargs="*")
    c.add_argument("--gh", action="store_true")
    c = command("pending", True)
    c.add_argument("--owner")
    c.add_argument("--repo", type=repo)
    c.add_argument("--all", action="store_true", dest="every")
    c.add_argument("--gh", action="store_true")
    command("hygiene", True)
    c = command("compare-periods")
    c.add_argument("--baseline", type=period, required=True)
    c.add_argument("--current", type=period, required=True)
    c = command("grep", True)
    c.add_argument("pattern")
    c.add_argument("--role")
    c.add_argument("--session")
    c.add_argument("--ignore-case", action="store_true")
    c.add_argument("--include-meta", action="store_true")
    c.add_argument("--tool-calls", action="store_true")
    c.add_argument("--all-matches", action="store_true", dest="every")
    c.add_argument("--context", type=count, default=200)
    c.add_argument("--limit", type=count, default=20)
    c = command("serve")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=count, default=8787)
    c.add_argument("--reviewed")
    return p


def run(engine: Engine, a: argparse.Namespace, out) -> int:
    span = {"since": getattr(a, "since", None), "until": getattr(a, "until", None)}
    name = a.command
    if name == "build":
        got = engine.build({n: getattr(a, n) for n in READERS}, a.chats, a.exports, a.ledger)
        report(got, a.format, out)
        return int(bool(got["missing"]) and not got["tables"])
    if name == "sql":
        show(engine.sql(a.query), a.format, out)
    elif name in ("denials", "recalls"):
        show(getattr(engine, name)(a.session, a.limit), a.format, out)
    elif name == "session-trace":
        report(engine.session_trace(a.session, a.limit, a.max_chars), a.format, out)
    elif name == "topics":
        report(engine.topics(a.session, a.window, a.terms), a.format, out)
    elif name == "info":
        report(engine.info(), a.format, out)
    elif name == "schema":
        report({k: dict(v) for k, v in engine.schema(a.table).items()}, a.format, out)
    elif name == "salvage":
        show(engine.salvage(a.ledger, minutes=a.window, since=a.since, limit=a.limit), a.format, out)
    elif name == "nominate":
        return int(not show(engine.nominate(**span, min_sessions=a.min_sessions, min_stability=a.min_stability, max_chars=a.max_chars, exclude_file=a.exclude_file), a.format, out))
    elif name == "orphans":
        if a.mark or a.unmark:
            if not a.reviewed:
                raise ValueError("--mark and --unmark need --reviewed")
            print("\n".join(engine.mark_reviewed(a.reviewed, a.mark, a.unmark)), file=out)
            return 0
        show(engine.orphans(a.sinks, a.reviewed, **span, min_tf=a.min_tf, min_human_chars=a.min_human_chars, min_orphans=a.min_orphans, include_headless=a.include_headless, show_reviewed=a.show_reviewed, limit=a.limit), a.format, out)
    elif name == "memory-authors":
        report(engine.memory_authors(a.dirs, **span, model=a.model), a.format, out)
    elif name == "review":
        report({k: v for k, v in engine.review(**span, bucket=a.bucket, zone=a.zone, themes=a.themes, owners=a.owners, gh=a.gh).items() if v is not None}, a.format, out)
    elif name == "pending":
        from .operators.pending import counts

        got = engine.pending(a.gh, **span, owner=a.owner, repo=a.repo, every=a.every)
        report({"items": got, "counts": counts(got)}, a.format, out)
    elif name == "hygiene":
        report(engine.hygiene(**span), a.format, out)
    elif name == "compare-periods":
        report(engine.compare_periods(a.baseline, a.current), a.format, out)
    elif name == "grep":
        got = engine.grep(a.pattern, a.tool_calls, **span, role=a.role, session=a.session, ignore_case=a.ignore_case, include_meta=a.include_meta, every=a.every, limit=a.limit, context=a.context)
        return int(not show(got.drop("text"), a.format, out))
    elif name == "serve":
        from .plans.dashboard import serve

        serve(engine, a.host, a.port, a.reviewed)
    return 0


def main(argv: list[str] | None = None, engine: Engine | None = None, out=None) -> int:
    out = out or sys.stdout
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        engine = engine or Engine(session(), a.store, a.server)
        return run(engine, a, out)
    except InvalidPattern as e:
        print(f"error: invalid pattern: {e}", file=sys.stderr)
        return 2
    except (StoreError, SessionNotFound, ValueError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
