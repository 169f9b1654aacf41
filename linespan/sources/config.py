"""Options, and where they come from: files with flags, the project's file, the command line."""

from __future__ import annotations

import argparse
import logging
import os
import shlex
from dataclasses import dataclass, field, replace

from linespan.functions.text import GENERATED_MARKERS
from linespan.plans.history import DEPTH
from linespan.sources.files import EXCLUDED_FOLDERS, EXCLUDED_NAMES, LARGE_BYTES, LARGE_LINES

log = logging.getLogger("linespan")
CONFIG_ENV, PROJECT_FILE = "LINESPAN_CONFIG_PATH", ".linespanconfig"
#: What a file of flags may not set, so that a project can't make its reader write files.
WRITES = ("output", "format_multi", "report")
TRUE = ("uloc", "dryness", "character", "percent", "cognitive", "binary", "by_file", "ci", "wide", "no_hborder", "no_ignore", "no_own_ignore", "no_gitignore", "no_gitmodule", "count_ignore", "count_unsupported", "languages", "sloccount_format", "no_cocomo", "no_size", "no_complexity", "no_duplicates", "min_gen", "min", "gen", "no_min_gen", "no_min", "no_gen", "no_large", "include_symlinks", "locomo", "cost_comparison", "hotspots", "coupling", "coupling_weighted", "by_author", "timeline", "no_fold_authors", "mcp", "verbose", "debug", "trace", "no_config")


@dataclass(frozen=True)
class Options:
    paths: tuple[str, ...] = (".",)
    flags: frozenset[str] = frozenset()
    format: str = "tabular"
    format_multi: str = ""
    output: str = ""
    report: str = ""
    report_skip: tuple[str, ...] = ()
    report_title: str = ""
    sort: str = "files"
    include_ext: tuple[str, ...] = ()
    exclude_ext: tuple[str, ...] = ()
    exclude_dir: tuple[str, ...] = EXCLUDED_FOLDERS
    exclude_file: tuple[str, ...] = EXCLUDED_NAMES
    not_match: tuple[str, ...] = ()
    ignore_file: str = ""
    generated_markers: tuple[str, ...] = tuple(GENERATED_MARKERS)
    min_gen_line_length: int = 255
    large_byte_count: int = LARGE_BYTES
    large_line_count: int = LARGE_LINES
    count_as: dict = field(default_factory=dict)
    count_as_pattern: tuple[str, ...] = ()
    remap_all: tuple[tuple[str, str], ...] = ()
    remap_unknown: tuple[tuple[str, str], ...] = ()
    avg_wage: float = 56_286
    overhead: float = 2.4
    eaf: float = 1.0
    cocomo_project_type: str = "organic"
    currency_symbol: str = "$"
    size_unit: str = "si"
    sql_project: str = ""
    locomo_preset: str = "medium"
    locomo_config: str = ""
    locomo_review: float = 0.01
    locomo_input_price: float = 0.0
    locomo_output_price: float = 0.0
    locomo_tps: float = 0.0
    locomo_cycles: float = 0.0
    completion: str = ""
    coupling_for: str = ""
    depth: int = DEPTH
    buckets: int = 60
    rules: str = ""

    def has(self, *names: str) -> bool:
        return any(n in self.flags for n in names)


def union(default: tuple[str, ...], more: list[str]) -> tuple[str, ...]:
    """Both in order, each once, final slashes off."""
    return tuple(dict.fromkeys(x.rstrip("/") for x in (*default, *more) if x))


def _pairs(values: list[str]) -> list[tuple[str, str]]:
    """'a:x,b:y' as pairs; quotes around a part are taken off."""
    out = []
    for value in values:
        for item in value.split(","):
            left, sep, right = item.strip().rpartition(":")
            if sep:
                out.append((left.strip("\"'"), right.strip("\"'")))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linespan", description="Counts lines of code on Spark.")
    p.add_argument("paths", nargs="*")
    short = {"uloc": "-u", "dryness": "-a", "character": "-m", "percent": "-p", "wide": "-w", "languages": "-l", "no_complexity": "-c", "no_duplicates": "-d", "min_gen": "-z", "verbose": "-v", "trace": "-t"}
    for name in TRUE:
        p.add_argument(*([short[name]] if name in short else []), f"--{name.replace('_', '-')}", action="store_true")
    d = Options()
    for name, s in (("format", "-f"), ("format_multi", ""), ("output", "-o"), ("report", ""), ("report_title", ""), ("sort", "-s"), ("ignore_file", ""), ("cocomo_project_type", ""), ("currency_symbol", ""), ("size_unit", ""), ("sql_project", ""), ("locomo_preset", ""), ("coupling_for", ""), ("rules", ""), ("locomo_config", ""), ("completion", ""), ("config", "")):
        p.add_argument(*([s] if s else []), f"--{name.replace('_', '-')}", default=getattr(d, name, ""))
    for name in ("min_gen_line_length", "large_byte_count", "large_line_count", "depth", "buckets"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(d, name))
    for name in ("avg_wage", "overhead", "eaf", "locomo_review", "locomo_input_price", "locomo_output_price", "locomo_tps", "locomo_cycles"):
        p.add_argument(f"--{name.replace('_', '-')}", type=float, default=getattr(d, name))
    for name, s in (("include_ext", "-i"), ("exclude_ext", "-x"), ("exclude_dir", ""), ("exclude_file", "-n"), ("not_match", "-M"), ("generated_markers", ""), ("count_as", ""), ("count_as_pattern", ""), ("remap_all", ""), ("remap_unknown", ""), ("report_skip", "")):
        p.add_argument(*([s] if s else []), f"--{name.replace('_', '-')}", action="append", default=[])
    return p


def flags_of(p: argparse.ArgumentParser) -> list[str]:
    return sorted(s[2:] for action in p._actions for s in action.option_strings if s.startswith("--"))


#: A line for each shell; {flags} are all flags, {words} the same without dashes.
COMPLETIONS = {
    "bash": "complete -o default -W '{flags}' linespan\n",
    "zsh": "#compdef linespan\n_arguments {flags} '*:file:_files'\n",
    "fish": "for f in {words}\n  complete -c linespan -l $f\nend\n",
    "powershell": "Register-ArgumentCompleter -Native -CommandName linespan -ScriptBlock {{ param($word) '{flags}'.Split(' ') | Where-Object {{ $_ -like \"$word*\" }} }}\n",
}


def completion(shell: str) -> str:
    """A script that completes flags in a shell."""
    if shell not in COMPLETIONS:
        raise ValueError(f"Unknown shell: {shell}")
    words = flags_of(parser())
    return COMPLETIONS[shell].format(flags=" ".join(f"--{w}" for w in words), words=" ".join(words))


def tokens(text: str) -> list[str]:
    """Flags of a file: any number on a line, quotes as in a shell, comments after '#'."""
    return [t for line in text.splitlines() for t in shlex.split(line, comments=True)]


def _from_file(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        found = tokens(f.read())
    kept, skip = [], False
    for t in found:
        name = t.lstrip("-").partition("=")[0].replace("-", "_")
        if skip:
            skip = False
        elif name in WRITES or t == "-o":
            skip = "=" not in t
        elif t.startswith("-"):
            kept.append(t)
        else:
            kept.append(t)
    return kept


def discover(argv: list[str], environ: dict[str, str] | None = None, folder: str = ".") -> list[str]:
    """Flags of the global file, of the project's and of the command line, the last having the last word. An argument
    '@file' stands for the flags of a file."""
    env = os.environ if environ is None else environ
    own: list[str] = []
    for a in argv:
        own += _from_file(a[1:]) if a.startswith("@") and os.path.isfile(a[1:]) else [a]
    known, _ = parser().parse_known_args(own)
    if known.no_config:
        return own
    out: list[str] = []
    if (path := known.config or env.get(CONFIG_ENV, "")) and os.path.isfile(path):
        out += _from_file(path)
    if os.path.isfile(project := os.path.join(folder, PROJECT_FILE)):
        out += _from_file(project)
    return out + own


def options(argv: list[str], environ: dict[str, str] | None = None, folder: str = ".") -> Options:
    p = parser()
    a, unknown = p.parse_known_args(discover(argv, environ, folder))
    if unknown:
        name = unknown[0].lstrip("-").partition("=")[0]
        near = similar(name, flags_of(p))
        hint = f"; did you mean {', '.join('--' + x for x in near)}?" if near else ""
        raise ValueError(f"unknown flag: {unknown[0]}{hint}")
    split = lambda v: [x.strip() for i in v for x in i.split(",") if x.strip()]
    o = Options()
    plain = {n: getattr(a, n) for n in ("format", "format_multi", "output", "report", "report_title", "sort", "ignore_file", "min_gen_line_length", "large_byte_count", "large_line_count", "avg_wage", "overhead", "eaf", "cocomo_project_type", "currency_symbol", "size_unit", "sql_project", "locomo_preset", "locomo_config", "locomo_review", "locomo_input_price", "locomo_output_price", "locomo_tps", "locomo_cycles", "completion", "coupling_for", "depth", "buckets", "rules")}
    return normalise(replace(
        o, paths=tuple(a.paths) or (".",), flags=frozenset(n for n in TRUE if getattr(a, n)), **plain, include_ext=tuple(split(a.include_ext)), exclude_ext=tuple(split(a.exclude_ext)), exclude_dir=union(o.exclude_dir, split(a.exclude_dir)), exclude_file=union(o.exclude_file, split(a.exclude_file)), not_match=tuple(a.not_match),
        generated_markers=tuple(split(a.generated_markers)) or o.generated_markers, count_as=dict(_pairs(a.count_as)), count_as_pattern=tuple(a.count_as_pattern), remap_all=tuple(_pairs(a.remap_all)), remap_unknown=tuple(_pairs(a.remap_unknown)), report_skip=tuple(split(a.report_skip)),
    ))


#: Flags of the counter that mean nothing to a history report.
COUNTER_ONLY = ("by_file", "uloc", "dryness", "character", "no_duplicates", "min_gen", "min", "gen", "no_min_gen", "no_min", "no_gen", "no_cocomo", "locomo", "cost_comparison", "sloccount_format", "no_large")


def _check_history(o: Options, flags: set[str]) -> None:
    """One history report at a time (authors and timeline go together); what it can't use is named in a warning. Depth
    and buckets are checked for hotspots, authors and timelines; a page needs its buckets too."""
    if o.coupling_for or "coupling_weighted" in flags:
        flags.add("coupling")
    asked = [x for x in ("hotspots", "coupling") if x in flags] + ["by_author or timeline"] * bool(flags & {"by_author", "timeline"})
    if len(asked) > 1:
        raise ValueError(f"one report at a time: {', '.join(asked)}")
    if o.report and o.buckets < 1:
        raise ValueError("a timeline has a bucket at least")
    if not flags & {"hotspots", "by_author", "timeline"}:
        return
    if o.depth < 0:
        raise ValueError("depth is a number of commits, 0 for all")
    if "timeline" in flags and o.buckets < 1:
        raise ValueError("a timeline has a bucket at least")
    if len(o.paths) > 1:
        log.warning("history reports read one repository; left out: %s", ", ".join(o.paths[1:]))
    unused = [f"--{f.replace('_', '-')}" for f in COUNTER_ONLY if f in flags] + ["--sort"] * (o.sort.strip().lower() not in ("", "files"))
    if unused:
        log.warning("history reports have no use for %s", ", ".join(unused))


def normalise(o: Options) -> Options:
    """What flags imply, and checks."""
    flags = set(o.flags)
    _check_history(o, flags)
    if "cost_comparison" in flags:
        flags |= {"locomo"}
        flags -= {"no_cocomo"}
    if flags & {"wide", "locomo", "cognitive"} or o.format == "wide":
        flags -= {"no_complexity"}
    if "no_min_gen" in flags:
        flags |= {"no_min", "no_gen"}
    if "min_gen" in flags:
        flags |= {"min", "gen"}
    if "no_min" in flags:
        flags |= {"min"}
    if "no_gen" in flags:
        flags |= {"gen"}
    if "dryness" in flags:
        flags |= {"uloc"}
    return replace(o, flags=frozenset(flags), format="wide" if "wide" in flags and o.format == "tabular" else o.format)


def similar(name: str, known: list[str], least: float = 0.75) -> list[str]:
    """Known flags that are nearly this one, the nearest first."""
    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    scored = [(1 - distance(name, k) / max(len(name), len(k), 1), k) for k in known]
    return [k for r, k in sorted((s for s in scored if s[0] >= least), key=lambda s: (-s[0], s[1]))]
