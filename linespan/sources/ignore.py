"""Rules of ignore files, as git reads them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    regex: re.Pattern
    negated: bool
    folders_only: bool


def translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            own = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + own[1:] if own[0] in "!^" else own) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parse(text: str) -> list[Pattern]:
    found = []
    for line in text.splitlines():
        line = line.rstrip("\r")
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\") if line.startswith(("\\#", "\\!")) else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        line = line.removeprefix("/")
        found.append(Pattern(re.compile(f"^{'' if anchored else '(?:.*/)?'}{translate(line)}$"), negated, folders))
    return found


class Ignore:
    """Layers of patterns, each for a folder ('' is the root); the last match decides, later layers first."""

    def __init__(self, layers: list[tuple[str, list[Pattern]]] | None = None):
        self.layers = layers or []

    def extended(self, folder: str, patterns: list[Pattern]) -> Ignore:
        return Ignore([*self.layers, (folder.strip("/"), patterns)]) if patterns else self

    def ignored(self, path: str, folder: bool = False) -> bool:
        for base, patterns in reversed(self.layers):
            if base and not path.startswith(base + "/"):
                continue
            rest = path[len(base) + 1 :] if base else path
            for p in reversed(patterns):
                if (folder or not p.folders_only) and p.regex.match(rest):
                    return not p.negated
        return False


def ignored(path: Column, rules: Ignore) -> Column:
    """Whether a path is ignored, itself or with a folder it is in, as one expression."""
    out = F.lit(False)
    for base, patterns in rules.layers:
        rest = F.substring(path, F.lit(len(base) + 2), F.length(path)) if base else path
        here = F.startswith(path, F.lit(base + "/")) if base else F.lit(True)
        for p in patterns:
            below = p.regex.pattern.removesuffix("$") + ("/.*$" if p.folders_only else "(?:/.*)?$")
            out = F.when(here & rest.rlike(below), F.lit(not p.negated)).otherwise(out)
    return out


def submodules(text: str) -> list[str]:
    """Folders named in a .gitmodules file."""
    return [m.strip() for m in re.findall(r"(?m)^\s*path\s*=\s*(.+?)\s*$", text)]
