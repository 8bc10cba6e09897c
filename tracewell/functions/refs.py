"""Open items in summaries and the issues they refer to.

Which repository a bare ``#12`` means depends on what came before it in the item,
so items are read one after the other in Python, in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left

ITEM_CHARS = 300
STATUSES = ("open", "resolved", "unreferenced", "unknown", "unchecked")
DEFERRED = r"(?i)discussed[- ]but[- ]not[- ]started|not (yet )?started|deferred|future work|do not (start|begin)"

# Headings of a numbered summary, and the four spellings of a reference in order of precedence.
HEADING = re.compile(r"^\s*\d+\.\s+[A-Z][^:\n]{2,60}:\s*$")
PENDING = re.compile(r"^\s*\d+\.\s+pending tasks:\s*$", re.IGNORECASE)
BULLET = re.compile(r"^\s*-\s+")
REFERENCE = re.compile(
    r"https://github\.com/(?P<o1>[A-Za-z0-9_.-]+)/(?P<r1>[A-Za-z0-9_.-]+)/(?:issues|pull)/(?P<n1>\d+)"
    r"|(?<![A-Za-z0-9_.-])(?P<o2>[A-Za-z][A-Za-z0-9_.-]*)/(?P<r2>[A-Za-z0-9_.-]+)#(?P<n2>\d+)"
    r"|(?<![A-Za-z0-9_.-])(?P<r3>[A-Za-z0-9_.-]+)(?:\s+(?:PR|issue)\s*)?\s*#(?P<n3>\d+)"
    r"|(?<![A-Za-z0-9_.-])(?:(?:PR|issue)\s*)?#(?P<n4>\d+)",
    re.IGNORECASE,
)
NAME = re.compile(r"(?<![A-Za-z0-9_/.-])([A-Za-z0-9_.-]+)(?![A-Za-z0-9_./-])")


def section(summary: str) -> list[str] | None:
    """The lines under the pending-tasks heading, up to the next heading; None without one."""
    lines = summary.splitlines()
    for i, line in enumerate(lines):
        if PENDING.match(line):
            rest = lines[i + 1 :]
            end = next((k for k, x in enumerate(rest) if HEADING.match(x)), len(rest))
            return rest[:end]
    return None


def items(lines: list[str]) -> list[str]:
    """Top-level bullets with what belongs to them, on one line each."""
    filled = [x for x in lines if x.strip()]
    margin = min((len(x) - len(x.lstrip()) for x in filled), default=0)
    found: list[list[str]] = []
    fenced = False
    for x in filled:
        mark = x.strip().startswith("```")
        fenced ^= mark
        if not fenced and not mark and len(x) - len(x.lstrip()) == margin and BULLET.match(x):
            found.append([BULLET.sub("", x, count=1)])
        elif found:
            found[-1].append(x)
    return [" ".join(" ".join(p.strip() for p in parts).replace("**", "").split()) for parts in found]


def explicit(text: str) -> list[tuple[str, str, int]]:
    """References that name their repository, each once, in order."""
    out = {}
    for m in REFERENCE.finditer(text):
        if m["n1"] or m["n2"]:
            out.setdefault((m["o1"] or m["o2"], m["r1"] or m["r2"], int(m["n1"] or m["n2"])))
    return list(out)


def references(text: str, owner: str | None, repos: list[str], default: tuple[str, str] | None = None) -> list[dict]:
    """All references of an item, each once.

    A bare number takes the repository that the same number has elsewhere in the
    item, if it is one; else the nearest before it, of a reference or of a known
    name in the text; else the default; else it stays unresolved.
    """
    names, lower = set(repos), {r.lower() for r in repos}
    marks = [(m.start(), m[1]) for m in NAME.finditer(text) if m[1] in names]
    read = []
    for m in REFERENCE.finditer(text):
        number = int(m["n1"] or m["n2"] or m["n3"] or m["n4"])
        if m["n1"] or m["n2"]:
            known = (m["o1"] or m["o2"], m["r1"] or m["r2"])
        else:
            known = (owner, m["r3"]) if m["r3"] and owner is not None and m["r3"].lower() in lower else None
        read.append((m.start(), number, known))
    same: dict[int, set] = {}
    for _, number, known in read:
        if known:
            same.setdefault(number, set()).add(known)
    out: dict[tuple, dict] = {}
    before: tuple[int, tuple[str, str]] | None = None
    for at, number, known in read:
        via, place = None, known
        if known is None and len(same.get(number, ())) == 1:
            known = place = next(iter(same[number]))
        elif known is None:
            k = bisect_left(marks, (at,)) - 1
            named = marks[k] if k >= 0 else None
            if before and (named is None or before[0] >= named[0]):
                place, via = before[1], "nearest"
            elif named:
                place, via = (owner, named[1]), "name"
            elif default:
                place, via = default, "repo_flag"
        if place is None or None in place:
            place = (None, None)
        bare = known is None
        state = "unresolved" if place == (None, None) else "unchecked"
        out.setdefault((*place, number), {"owner": place[0], "repo": place[1], "number": number, "state": state, "bare": bare, "via": via})
        if known and None not in known:
            before = (at, known)
    return list(out.values())
