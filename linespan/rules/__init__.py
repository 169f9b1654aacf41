"""Rules of languages: how their comments, strings and branches look and which files they are found in.

The rules that come with the package are the values in ``languages.jsonl``. ``load`` reads further ones, or all of them,
from a JSON file: an object by language name with the keys of ``Rule`` (lists of strings; quotes and heuristics as objects;
multi_line as pairs), so the table isn't bound to what stands there.
"""

from __future__ import annotations

import json
import pkgutil
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Quote:
    start: str
    end: str
    ignore_escape: bool = False
    doc_string: bool = False


@dataclass(frozen=True)
class Heuristic:
    """``literals``: one of them must be there for the pattern to match; ``anchored``: first on its line."""

    pattern: str
    literals: tuple[str, ...] = ()
    anchored: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    shebangs: tuple[str, ...] = ()
    line_comment: tuple[str, ...] = ()
    multi_line: tuple[tuple[str, str], ...] = ()
    nested_multi_line: bool = False
    quotes: tuple[Quote, ...] = ()
    complexity_checks: tuple[str, ...] = ()
    complexity_checks_postfix: tuple[str, ...] = ()
    complexity_checks_postfix_excludes: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    heuristics: tuple[Heuristic, ...] = ()


def _rule(name: str, own: dict) -> Rule:
    """A rule from an object whose keys are those of ``Rule``, in either spelling (nestedmultiline, ignoreEscape)."""
    own = {re.sub(r"(?<=[a-z])(?=[A-Z])", "_", k).lower(): v for k, v in own.items()}
    other = {"complexity_checks": "complexitychecks", "complexity_checks_postfix": "complexitychecks_postfix", "complexity_checks_postfix_excludes": "complexitychecks_postfix_excludes"}
    lists = {k: tuple(own.get(k) or own.get(other.get(k, k)) or ()) for k in ("extensions", "filenames", "shebangs", "line_comment", "keywords", *other)}
    either = lambda q, a, b: bool(q.get(a) or q.get(b))
    quotes = tuple(Quote(q["start"], q["end"], either(q, "ignore_escape", "ignoreEscape"), either(q, "doc_string", "docString")) for q in own.get("quotes") or ())
    found = tuple(Heuristic(h["pattern"], tuple(h.get("literals") or ()), bool(h.get("anchored"))) for h in own.get("heuristics") or ())
    return Rule(name, multi_line=tuple((a, b) for a, b in own.get("multi_line") or ()), nested_multi_line=either(own, "nested_multi_line", "nestedmultiline"), quotes=quotes, heuristics=found, **lists)


def _built_in() -> tuple[Rule, ...]:
    rows = pkgutil.get_data(__name__, "languages.jsonl").decode().splitlines()
    return tuple(_rule(own.pop("name"), own) for own in (json.loads(r) for r in rows if r and not r.startswith("#")))


BUILT_IN = _built_in()
UNKNOWN = Rule("Unknown")
SHEBANG = "#!"


def table(rules: tuple[Rule, ...] = BUILT_IN) -> dict[str, Rule]:
    return {r.name: r for r in rules}


def load(path: str, onto: dict[str, Rule] | None = None) -> dict[str, Rule]:
    """Rules from a JSON file, added to ``onto`` (or alone)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return dict(onto or {}) | {name: _rule(name, own) for name, own in data.items()}
