"""The history of a git repository as tables.

The driver asks git for the list of commits; diffs and contents are read by the executors, a range of commits each, so
the repository lies where all of them can read it.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linespan.plans.history import DEPTH
from linespan.sources.ignore import Ignore, parse

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
_HUNK = re.compile(rb"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_SPANS = "array<struct<start:int,count:int>>"


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *args], capture_output=True, check=True).stdout


def commits(spark: SparkSession, repo: str, depth: int = DEPTH) -> DataFrame:
    """seq (0: the oldest), hash, parent (the first one, or ''), author, email, when: the newest ``depth`` commits of HEAD
    (0: all), by the committer's time."""
    out = git(repo, "log", "--date-order", *([f"-n{depth}"] if depth else []), "--format=%H%x00%P%x00%an%x00%ae%x00%at").decode(errors="replace")
    rows = [line.split("\0") for line in out.splitlines()][::-1]
    data = [(i, h, p.split(" ")[0], a, e, datetime.fromtimestamp(int(t), UTC)) for i, (h, p, a, e, t) in enumerate(rows)]
    return spark.createDataFrame(data, "seq bigint, hash string, parent string, author string, email string, when timestamp")


def _blob(repo: str, commit: str, path: str) -> bytes | None:
    try:
        return git(repo, "cat-file", "blob", f"{commit}:{path}")
    except subprocess.CalledProcessError:
        return None


def _changed(repo: str, parent: str, commit: str) -> Iterator[tuple[str, str]]:
    """(path, former path or '') of added, changed and renamed files; deletions, links and submodules are left out."""
    raw = git(repo, "diff-tree", "-r", "-M", "-z", "--raw", "--no-commit-id", parent or EMPTY_TREE, commit).decode(errors="surrogateescape").split("\0")
    i = 0
    while i < len(raw) and raw[i].startswith(":"):
        mode, status = raw[i].split(" ")[1], raw[i].split(" ")[4]
        old, path = (raw[i + 1], raw[i + 2]) if status[0] in "RC" else ("", raw[i + 1])
        i += 3 if status[0] in "RC" else 2
        if status[0] != "D" and mode not in ("120000", "160000"):
            yield path, old if status[0] == "R" else ""


def _spans(repo: str, parent: str, commit: str, path: str, old: str) -> tuple[list, list]:
    diff = git(repo, "diff", "-U0", "-M", "--no-color", "--no-ext-diff", parent or EMPTY_TREE, commit, "--", *([old] if old else []), path)
    added, removed = [], []
    for m in filter(None, map(_HUNK.match, diff.split(b"\n"))):
        a, n, b, k = (int(x) if x is not None else 1 for x in m.groups())
        removed += [(a, n)] if n else []
        added += [(b, k)] if k else []
    return added, removed


def file_changes(log: DataFrame, repo: str) -> DataFrame:
    """seq, change_idx, path, from_path, added, removed, content, old_content of every changed file of every commit; a
    commit whose parent isn't there (a shallow clone) or whose diff fails has none."""
    schema = f"seq bigint, change_idx int, path string, from_path string, added {_SPANS}, removed {_SPANS}, content binary, old_content binary"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for c in pdf.itertuples():
                try:
                    found = list(_changed(repo, c.parent, c.hash))
                except subprocess.CalledProcessError:
                    continue
                rows = []
                for i, (path, old) in enumerate(found):
                    data = _blob(repo, c.hash, path)
                    if data is None or b"\0" in data[:8000]:
                        continue
                    added, removed = _spans(repo, c.parent, c.hash, path, old)
                    before = _blob(repo, c.parent, old or path) if c.parent else None
                    dicts = lambda x: [{"start": a, "count": n} for a, n in x]
                    rows.append((c.seq, i, path, old, dicts(added), dicts(removed), data, before))
                if rows:
                    yield pd.DataFrame(rows, columns=["seq", "change_idx", "path", "from_path", "added", "removed", "content", "old_content"])

    return log.select("seq", "hash", "parent").repartition("hash").mapInPandas(run, schema)


def tree(spark: SparkSession, repo: str, commit: str = "HEAD") -> DataFrame:
    """path, filename, content of the files of a commit."""
    names = [n for n in git(repo, "ls-tree", "-r", "-z", "--format=%(objecttype) %(objectmode) %(path)", commit).decode(errors="surrogateescape").split("\0") if n.startswith("blob ") and not n.startswith("blob 120000")]
    listed = spark.createDataFrame([(n.split(" ", 2)[2],) for n in names], "path string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(content=[_blob(repo, commit, p) for p in pdf.path])

    return listed.mapInPandas(run, "path string, content binary").where(F.col("content").isNotNull()).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "content")


def ignore_rules(repo: str, names: tuple[str, ...] = (".ignore", ".locignore")) -> Ignore:
    """The rules of ignore files in HEAD, each for its folder, outer folders first."""
    found = [n for n in git(repo, "ls-tree", "-r", "-z", "--name-only", "HEAD").decode(errors="surrogateescape").split("\0") if n.rsplit("/", 1)[-1] in names]
    out = Ignore()
    for path in sorted(found, key=lambda n: (n.count("/"), n)):
        out = out.extended(path.rpartition("/")[0], parse((_blob(repo, "HEAD", path) or b"").decode(errors="replace")))
    return out


def baseline_commit(log: DataFrame) -> str | None:
    """The commit before the window, None where history begins in it."""
    first = log.orderBy("seq").limit(1).collect()
    return first[0].parent or None if first else None


_MAIL = re.compile(r"^\s*([^<#]*?)\s*<([^>]*)>(?:\s*([^<]*?)\s*<([^>]*)>)?\s*(?:#.*)?$")


def parse_mailmap(text: str) -> list[tuple[str | None, str, str, str]]:
    """(commit_name or None, commit_email, proper_name, proper_email) of a mailmap's lines."""
    out = []
    for line in text.splitlines():
        if line.lstrip().startswith("#") or not (m := _MAIL.match(line)):
            continue
        name, mail, old_name, old_mail = m.groups()
        out.append((None, mail.lower(), name, "") if old_mail is None else (old_name or None, old_mail.lower(), name, mail))
    return out


def mailmap(spark: SparkSession, repo: str) -> DataFrame | None:
    data = _blob(repo, "HEAD", ".mailmap")
    rows = parse_mailmap(data.decode(errors="replace")) if data else []
    return spark.createDataFrame(rows, "commit_name string, commit_email string, proper_name string, proper_email string") if rows else None


def remote_name(repo: str) -> str:
    """The repository's name by its remote 'origin': the last part of the address without '.git'; '' if there is none."""
    out = subprocess.run(["git", "-C", repo, "config", "--get", "remote.origin.url"], capture_output=True, text=True, check=False)
    return out.stdout.strip().removesuffix("/").rsplit("/", 1)[-1].rsplit(":", 1)[-1].removesuffix(".git")
