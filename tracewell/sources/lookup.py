"""States of issues and pull requests, asked of GitHub's command line tool on request.

Nothing is asked unless a caller wants it. ``call`` takes the arguments of a command
and returns (worked, parsed answer, error); tests pass their own.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions import parse as P

TIMEOUT = 30
Call = Callable[[list[str]], tuple[bool, object, str]]


def gh(arguments: list[str]) -> tuple[bool, object, str]:
    """Run the tool; a missing tool, a timeout and a bad answer are errors, not exceptions."""
    try:
        done = subprocess.run(arguments, capture_output=True, text=True, timeout=TIMEOUT)
    except subprocess.TimeoutExpired:
        return False, None, f"gh api timed out after {TIMEOUT}s"
    except OSError as e:
        return False, None, str(e)
    if done.returncode:
        return False, None, done.stderr.strip() or "gh api failed"
    try:
        return True, json.loads(done.stdout), ""
    except ValueError:
        return False, None, "gh api returned no JSON"


def state(answer) -> tuple[str, str | None]:
    """open, closed, merged or unknown, and why it is unknown."""
    a = P.table(answer)
    if P.table(a.get("pull_request")).get("merged_at"):
        return "merged", None
    return (a["state"], None) if a.get("state") in ("open", "closed") else ("unknown", "no state in the answer")


def look_up(spark: SparkSession, keys: Iterable[tuple[str, str, int]], call: Call = gh) -> DataFrame:
    """(owner, repo, number, state, error, created_at, author, is_pr); each key is asked once."""
    rows = []
    for owner, repo, number in sorted(set(keys)):
        worked, answer, error = call(["gh", "api", f"repos/{owner}/{repo}/issues/{number}"])
        a = P.table(answer)
        told, why = state(answer) if worked else ("unknown", error or "gh api failed")
        rows.append((owner, repo, number, told, why, P.moment(a.get("created_at")), P.text(P.table(a.get("user")).get("login")), "pull_request" in a))
    return spark.createDataFrame(rows, "owner string, repo string, number long, state string, error string, created_at timestamp, author string, is_pr boolean")


def repositories(owner: str, call: Call = gh) -> list[str] | None:
    """Names of an owner's repositories; None if they can't be had."""
    worked, answer, _ = call(["gh", "repo", "list", owner, "--limit", "200", "--json", "name"])
    return [r["name"] for r in P.objects(answer) if isinstance(r.get("name"), str)] if worked and isinstance(answer, list) else None
