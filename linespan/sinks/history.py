"""Tables, CSV and JSON of history reports."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from datetime import datetime

from linespan.sinks.render import sparkline, trim_left

#: Heads of the CSV files and the columns under them.
COLUMNS = {
    "hotspots": {"File": "path", "Language": "language", "Complexity": "complexity", "Commits": "commits", "LinesChanged": "lines_changed", "Authors": "authors", "CodeChurn": "code_churn", "CommentChurn": "comment_churn", "Score": "score"},
    "coupling": {"FileA": "a", "FileB": "b", "Shared": "shared", "CommitsA": "commits_a", "CommitsB": "commits_b", "Degree": "degree"},
    "coupling-for": {"Partner": "partner", "Shared": "shared", "TargetCommits": "target_commits", "PartnerCommits": "partner_commits", "Degree": "degree", "Couple": "couple", "Reverse": "reverse"},
    "authors": {"Author": "author", "Email": "email", "Code": "code", "Complexity": "complexity", "Comment": "comment", "Files": "files", "OwnsPercent": "owns_percent", "LastCommit": "last_commit"},
}


def _cell(x: object) -> object:
    if isinstance(x, float):
        return int(x * 10 + 0.5) / 10
    if isinstance(x, datetime):
        return x.strftime("%Y-%m-%d")
    return "" if x is None else x


def table(kind: str, report: str, rows: list[dict]) -> str:
    heads = COLUMNS[report]
    cells = [[_cell(r.get(c)) for c in heads.values()] for r in rows]
    if kind == "json":
        return json.dumps([dict(zip(heads, r, strict=True)) for r in cells], ensure_ascii=False)
    if kind == "csv":
        f = io.StringIO()
        csv.writer(f, lineterminator="\n").writerows([list(heads), *cells])
        return f.getvalue()
    text = [[trim_left(str(x), 40) for x in r] for r in ([list(heads), *cells])]
    widths = [max(len(r[i]) for r in text) for i in range(len(heads))]
    rule = "─" * (sum(widths) + 2 * len(widths)) + "\n"
    line = lambda r: "  ".join(x.ljust(w) if i == 0 else x.rjust(w) for i, (x, w) in enumerate(zip(r, widths, strict=True))) + "\n"
    return rule + line(text[0]) + rule + "".join(map(line, text[1:])) + rule


def _csv(row: Iterable) -> str:
    f = io.StringIO()
    csv.writer(f, lineterminator="\n").writerow(row)
    return f.getvalue()


def pieces(kind: str, report: str, rows: Iterable[dict]) -> Iterator[str]:
    """``table`` bit by bit: CSV and JSON hold one row at a time."""
    if kind not in ("csv", "json"):
        yield table(kind, report, list(rows))
        return
    heads = COLUMNS[report]
    cells = ([_cell(r.get(c)) for c in heads.values()] for r in rows)
    if kind == "csv":
        yield _csv(heads)
        yield from map(_csv, cells)
    else:
        yield "["
        yield from (", " * (i > 0) + json.dumps(dict(zip(heads, r, strict=True)), ensure_ascii=False) for i, r in enumerate(cells))
        yield "]"


def tag(commits: list[int], last_share: float = 0.8) -> str:
    """'quiet N' for buckets without a commit at the end, 'rising' if the last is near the peak."""
    quiet = len(commits) - 1 - max((i for i, n in enumerate(commits) if n), default=-1)
    return f"quiet {quiet}" if quiet else "rising" if commits and commits[-1] >= last_share * max(commits) else ""


def series(kind: str, who: str, rows: list[dict], ascii_only: bool = False, cells: int = 30) -> str:
    """Timelines: a row for each bucket as CSV or JSON, a sparkline for each series as a table."""
    rows = sorted(rows, key=lambda r: (str(r[who]), r["bucket"]))
    value = "code" if rows and "code" in rows[0] else "delta"
    if kind == "json":
        return json.dumps(rows, ensure_ascii=False, default=str)
    if kind == "csv":
        f = io.StringIO()
        heads = [who, "bucket", "commits", "delta"] + ["code"] * (value == "code")
        csv.writer(f, lineterminator="\n").writerows([[h.capitalize() for h in heads], *([r[h] for h in heads] for r in rows)])
        return f.getvalue()
    by: dict[str, list[dict]] = {}
    for r in rows:
        by.setdefault(str(r[who]), []).append(r)
    order = sorted(by, key=lambda k: (-sum(r["commits"] for r in by[k]), k))
    return "".join(f"{k[:24]:<24} {sum(r['commits'] for r in by[k]):>8d} {sparkline([r['commits'] if value == 'delta' else r['code'] for r in by[k]], cells, ascii_only)} {tag([r['commits'] for r in by[k]])}".rstrip() + "\n" for k in order)
