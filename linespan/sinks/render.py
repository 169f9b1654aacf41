"""Text formats of a count.

``languages``: dicts with language, files, lines, code, comment, blank, complexity, cognitive, bytes and, if counted, uloc,
longest, mean. ``files``: an iterable of dicts with location, filename, language and the same figures; it is read once, so it
may come from ``DataFrame.toLocalIterator``.
"""

from __future__ import annotations

import csv
import html
import io
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from linespan.functions.cost import COCOMO, LOCOMO, megabyte, project_type, Locomo

Row = dict
FIGURES = ("files", "lines", "blank", "comment", "code", "complexity", "cognitive", "bytes")


@dataclass(frozen=True)
class Style:
    complexity: bool = True
    cognitive: bool = False
    percent: bool = False
    uloc: bool = False
    dryness: bool = False
    lengths: bool = False
    ascii: bool = False
    border: bool = True
    cocomo: bool = True
    size: bool = True
    locomo: bool = False
    size_unit: str = "si"
    wage: float = 56_286
    overhead: float = 2.4
    eaf: float = 1.0
    project: str = "organic"
    preset: str = "medium"
    currency: str = "$"
    sloccount: bool = False
    prefix: str = "loc"
    title: str = ""
    model: Locomo | None = None


def width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def trim_left(text: str, most: int) -> str:
    """The end of a text that fits, behind a tilde if something had to go."""
    if width(text) <= most:
        return text
    while text and width(text) > most - 1:
        text = text[1:]
    return "~" + text


def pad(text: str, to: int) -> str:
    return text + " " * max(0, to - width(text))


def total(rows: Iterable[Row]) -> Row:
    out = dict.fromkeys(FIGURES, 0)
    for r in rows:
        for f in FIGURES:
            out[f] += r.get(f) or 0
    return out


def cocomo(code: int, s: Style) -> tuple[float, float, float]:
    """(cost, months, people)."""
    a, b, c, d = project_type(s.project)[1] if s.project else COCOMO["organic"]
    effort = a * (code / 1000) ** b * s.eaf if code else 0.0
    months = c * effort**d if effort else 0.0
    return effort * s.wage / 12 * s.overhead, months, effort / months if months else 0.0


def locomo(code: int, complexity: int, s: Style) -> Row:
    return (s.model or Locomo(s.preset)).figures(code, complexity)


_SHORT = (("files", 9), ("lines", 11), ("blank", 9), ("comment", 9), ("code", 10), ("complexity", 10))
_PLAIN = (("files", 11), ("lines", 11), ("blank", 10), ("comment", 11), ("code", 10))
_WIDE = (("files", 8), ("lines", 12), ("blank", 10), ("comment", 10), ("code", 12), ("complexity", 10))
_HEADS = {"files": "Files", "lines": "Lines", "blank": "Blanks", "comment": "Comments", "code": "Code", "complexity": "Complexity", "cognitive": "Cognitive"}


def tabular(languages: list[Row], s: Style = Style(), files: Iterable[Row] = (), wide: bool = False, unique: int | None = None) -> str:
    """A table of 79 columns, or 109 (120 with cognitive complexity) if ``wide``."""
    columns = list(_WIDE if wide else _SHORT if s.complexity else _PLAIN)
    if wide and s.cognitive:
        columns.append(("cognitive", 10))
    first = 24 if wide else 15 if s.complexity else 21
    across = first + sum(w + 1 for _, w in columns) + (17 if wide else 0)
    rule = ("-" if s.ascii else "─") * across + "\n" if s.border else ""
    weigh = lambda r: r["complexity"] / r["code"] * 100 if r["code"] else 0.0

    def figure(r: Row, c: str) -> int:
        return r["cognitive"] if c == "complexity" and s.cognitive and not wide else r.get(c) or 0

    def line(name: str, r: Row) -> str:
        cells = "".join(f" {figure(r, c):>{w}d}" for c, w in columns)
        return f"{pad(name, first)}{cells}" + (f" {weigh(r):>16.2f}" if wide else "") + "\n"

    whole = total(languages)
    out = [rule, f"{'Language':<{first}}" + "".join(f" {('Cognitive' if c == 'complexity' and s.cognitive and not wide else _HEADS[c]):>{w}}" for c, w in columns) + (f" {'Complexity/Lines':>16}" if wide else "") + "\n", rule]
    by: dict[str, list[Row]] = {}
    for f in files:
        by.setdefault(f["language"], []).append(f)
    for r in languages:
        if by and out[-1] != rule:
            out.append(rule)
        out.append(line(trim_left(r["language"], first), r))
        if s.percent:
            cells = [f"{(figure(r, c) / figure(whole, c) * 100 if figure(whole, c) else 0):.1f}%" for c, _ in columns]
            out.append(f"{'Percentage':<{first}}" + "".join(f" {x:>{w}}" for x, (_, w) in zip(cells, columns, strict=True)) + "\n")
        if s.lengths:
            out.append(f"MaxLine / MeanLine {r.get('longest', 0):>{first + columns[0][1] - 18}d} {r.get('mean', 0):>{columns[1][1]}d}\n")
        if s.uloc:
            out.append(f"{'(ULOC)':<{first}} {r.get('uloc', 0):>{columns[0][1] + 1 + columns[1][1]}d}\n")
        if by:
            out.append(rule)
            name = first + columns[0][1] + 1
            for f in by.get(r["language"], ()):
                cells = "".join(f" {figure(f, c):>{w}d}" for c, w in columns[1:])
                out.append(pad(trim_left(f["location"], name), name) + cells + (f" {weigh(f):>16.2f}" if wide else "") + "\n")
    out += [rule, line("Total", whole), rule]
    if s.uloc and unique is not None:
        out.append(f"Unique Lines of Code (ULOC) {unique:>9d}\n")
        if s.dryness and whole["lines"]:
            out.append(f"DRYness % {unique / whole['lines']:>27.2f}\n")
        out.append(rule)
    out.append(_costs(whole, s, rule))
    return "".join(out)


def _costs(whole: Row, s: Style, rule: str) -> str:
    out = []
    if s.cocomo:
        cost, months, people = cocomo(whole["code"], s)
        if s.sloccount:
            out += [f"Total Physical Source Lines of Code (SLOC)                     = {whole['code']:,d}\n", f"Development Effort Estimate, Person-Years (Person-Months)      = {people * months / 12:,.2f} ({people * months:,.2f})\n", f"Schedule Estimate, Years (Months)                              = {months / 12:,.2f} ({months:,.2f})\n", f"Estimated Average Number of Developers (Effort/Schedule)       = {people:,.2f}\n", f"Total Estimated Cost to Develop                                = {s.currency}{cost:,.0f}\n"]
        else:
            out += [f"Estimated Cost to Develop ({s.project}) {s.currency}{cost:,.0f}\n", f"Estimated Schedule Effort ({s.project}) {months:.2f} months\n", f"Estimated People Required ({s.project}) {people:.2f}\n"]
        out.append(rule)
    if s.locomo:
        e = locomo(whole["code"], whole["complexity"], s)
        out += [f"LLM cost estimate ({e['preset']})\n", f"  Tokens in {e['input_tokens']:,.0f}, out {e['output_tokens']:,.0f}\n", f"  Cost {s.currency}{e['cost']:,.2f}, cycles {e['cycles']:.2f}\n", f"  Generation {e['seconds'] / 3600:,.1f} hours, review {e['review_hours']:,.1f} hours\n", rule]
    if s.size:
        divisor = megabyte(s.size_unit, datetime.now(UTC).year)
        size = "¯\\_(ツ)_/¯" if divisor is None else f"{whole['bytes'] / divisor:.3f}"
        out += [f"Processed {whole['bytes']} bytes, {size} megabytes ({s.size_unit.upper()})\n", rule]
    return "".join(out)


def _summary_json(r: Row, s: Style, whole: Row, files: list[Row] | None) -> Row:
    out = {"Name": r["language"], "Bytes": r["bytes"], "CodeBytes": 0, "Lines": r["lines"], "Code": r["code"], "Comment": r["comment"], "Blank": r["blank"], "Complexity": r["complexity"]}
    out |= {"Cognitive": r.get("cognitive") or 0} if s.cognitive else {}
    out |= {"Count": r["files"], "WeightedComplexity": r["complexity"] / r["code"] * 100 if r["code"] and s.complexity else 0, "Files": [_file_json(f, s) for f in files or ()], "LineLength": None, "ULOC": r.get("uloc") or 0}
    if s.percent:
        names = {"code": "CodePercent", "comment": "CommentPercent", "blank": "BlankPercent", "lines": "LinePercent", "complexity": "ComplexityPercent", "bytes": "BytePercent", "files": "FilePercent"}
        out |= {n: r[k] / whole[k] * 100 if whole[k] else 0.0 for k, n in names.items()}
    return out


def _file_json(f: Row, s: Style) -> Row:
    out = {"Language": f["language"], "PossibleLanguages": f.get("candidates") or [f["language"]], "Filename": f["filename"], "Extension": f.get("extension") or "", "Location": f["location"], "Symlocation": f.get("sym_location") or "", "Bytes": f["bytes"], "Lines": f["lines"], "Code": f["code"], "Comment": f["comment"], "Blank": f["blank"], "Complexity": f["complexity"]}
    out |= {"Cognitive": f.get("cognitive") or 0} if s.cognitive else {}
    return out | {"WeightedComplexity": f["complexity"] / f["code"] * 100 if f["code"] else 0, "Hash": None, "Binary": bool(f.get("binary")), "Minified": bool(f.get("minified")), "Generated": bool(f.get("generated")), "EndPoint": 0, "Uloc": f.get("uloc") or 0}


def json_text(languages: list[Row], s: Style = Style(), files: Iterable[Row] = ()) -> str:
    return json.dumps(_json_rows(languages, s, files), ensure_ascii=False, separators=(",", ":"))


def _json_rows(languages: list[Row], s: Style, files: Iterable[Row]) -> list[Row]:
    by: dict[str, list[Row]] = {}
    for f in files:
        by.setdefault(f["language"], []).append(f)
    whole = total(languages)
    return [_summary_json(r, s, whole, by.get(r["language"])) for r in languages]


def json2_text(languages: list[Row], s: Style = Style(), files: Iterable[Row] = ()) -> str:
    whole = total(languages)
    cost, months, people = cocomo(whole["code"], s)
    out = {"languageSummary": _json_rows(languages, s, files), "estimatedCost": cost, "estimatedScheduleMonths": months, "estimatedPeople": people}
    if s.locomo:
        e = locomo(whole["code"], whole["complexity"], s)
        out |= {"estimatedLLMCost": e["cost"], "estimatedLLMInputTokens": e["input_tokens"], "estimatedLLMOutputTokens": e["output_tokens"], "estimatedLLMGenerationSeconds": e["seconds"], "estimatedLLMReviewHours": e["review_hours"], "estimatedLLMPreset": e["preset"], "estimatedLLMAverageComplexityMultiplier": e["multiplier"], "estimatedLLMCycles": e["cycles"]}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def _csv(rows: Iterable[list]) -> Iterator[str]:
    for r in rows:
        f = io.StringIO()
        csv.writer(f, lineterminator="\n").writerow(r)
        yield f.getvalue()


def csv_text(languages: list[Row], s: Style = Style()) -> str:
    head = ["Language", "Lines", "Code", "Comments", "Blanks", "Complexity", "Bytes", "Files", "ULOC"] + ["Cognitive"] * s.cognitive
    rows = ([r["language"], r["lines"], r["code"], r["comment"], r["blank"], r["complexity"], r["bytes"], r["files"], r.get("uloc") or 0] + [r.get("cognitive") or 0] * s.cognitive for r in languages)
    return "".join(_csv([head, *rows]))


def csv_files(files: Iterable[Row], s: Style = Style(), stream: bool = False) -> Iterator[str]:
    """A line at a time; ``stream`` only changes the spelling of the last head."""
    yield from _csv([["Language", "Provider", "Filename", "Lines", "Code", "Comments", "Blanks", "Complexity", "Bytes", "Uloc" if stream else "ULOC"] + ["Cognitive"] * s.cognitive])
    for f in files:
        yield from _csv([[f["language"], f["location"], f["filename"], f["lines"], f["code"], f["comment"], f["blank"], f["complexity"], f["bytes"], f.get("uloc") or 0] + [f.get("cognitive") or 0] * s.cognitive])


def cloc_yaml(languages: list[Row], s: Style = Style(), seconds: float = 0.0, version: str = "1") -> str:
    whole = total(languages)
    rate = lambda n: n / seconds if seconds else 0.0
    quote = lambda n: n if n.replace(" ", "").isalnum() else json.dumps(n, ensure_ascii=False)
    out = [f"header:\n  url: \"\"\n  version: \"{version}\"\n  elapsed_seconds: {seconds:g}\n  n_files: {whole['files']}\n  n_lines: {whole['lines']}\n  files_per_second: {rate(whole['files']):g}\n  lines_per_second: {rate(whole['lines']):g}\n"]
    out += [f"{quote(r['language'])}:\n  name: {quote(r['language'])}\n  code: {r['code']}\n  comment: {r['comment']}\n  blank: {r['blank']}\n  nFiles: {r['files']}\n" for r in sorted(languages, key=lambda r: r["language"])]
    return "".join(out) + f"SUM:\n  code: {whole['code']}\n  comment: {whole['comment']}\n  blank: {whole['blank']}\n  nFiles: {whole['files']}\n"


def html_table(languages: list[Row], s: Style = Style(), files: Iterable[Row] = ()) -> str:
    by: dict[str, list[Row]] = {}
    for f in files:
        by.setdefault(f["language"], []).append(f)
    cells = ("lines", "blank", "comment", "code", "complexity", "bytes")
    heads = ["Language", "Files", "Lines", "Blank", "Comment", "Code", "Complexity", "Bytes", "Uloc"]
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    body = []
    for r in languages:
        body.append(row("th", [r["language"], r["files"], *(r[c] for c in cells), r.get("uloc") or 0]))
        body += [row("td", [f["location"], "", *(f[c] for c in cells), f.get("uloc") or 0]) for f in by.get(r["language"], ())]
    whole = total(languages)
    foot = row("th", ["Total", whole["files"], *(whole[c] for c in cells), ""])
    cost = ""
    if s.cocomo:
        money, months, people = cocomo(whole["code"], s)
        cost = f'<tr><th colspan="9">Estimated Cost to Develop ({html.escape(s.project)}) {s.currency}{money:,.0f}<br>Estimated Schedule Effort ({html.escape(s.project)}) {months:.2f} months<br>Estimated People Required ({html.escape(s.project)}) {people:.2f}</th></tr>'
    return f'<table id="{s.prefix}-table"><thead>{row("th", heads)}</thead><tbody>{"".join(body)}</tbody><tfoot>{foot}{cost}</tfoot></table>'


def html_page(languages: list[Row], s: Style = Style(), files: Iterable[Row] = ()) -> str:
    style = "table{border-collapse:collapse}td,th{border:1px solid #999;padding:.4rem}td{text-align:right}"
    return f'<html lang="en"><head><meta charset="utf-8"><title>{html.escape(s.title or "lines of code")}</title><style>{style}</style></head><body>{html_table(languages, s, files)}</body></html>'


def openmetrics(languages: list[Row], s: Style = Style(), files: Iterable[Row] | None = None) -> Iterator[str]:
    """Gauges by language, or by file (then all but the number of files)."""
    escape = lambda t: t.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    helps = {"files": "Number of sourcecode files.", "lines": "Number of lines.", "code": "Number of lines of actual code.", "comments": "Number of comments.", "blanks": "Number of blank lines.", "complexity": "Code complexity.", "bytes": "Size in bytes."}
    kept = None if files is None else list(files)
    for name, says in helps.items():
        yield f"# TYPE {s.prefix}_{name} gauge\n" + f"# UNIT {s.prefix}_bytes bytes\n" * (name == "bytes") + f"# HELP {s.prefix}_{name} {says}\n"
        key = name.removesuffix("s") if name in ("comments", "blanks") else name
        for r in languages if kept is None else () if name == "files" else kept:
            where = f'language="{escape(r["language"])}"' + ("" if kept is None else f',file="{escape(r["location"])}"')
            yield f"{s.prefix}_{name}{{{where}}} {r[key]}\n"
    yield "# EOF\n"


def sql_escape(text: str) -> str:
    return text.replace("\0", "").replace("'", "''")


def sql_insert(files: Iterable[Row], s: Style = Style(), project: str = "", now: str = "", seconds: float = 0.0) -> Iterator[str]:
    """Inserts, a thousand files to a transaction."""
    code = complexity = n = 0
    e = sql_escape
    yield "\nbegin transaction;"
    for f in files:
        n, code, complexity = n + 1, code + f["code"], complexity + f["complexity"]
        folder = f["location"][: f["location"].rfind("/") + 1]
        figures = [f["bytes"], f["blank"], f["comment"], f["code"], f["complexity"], f.get("uloc") or 0] + [f.get("cognitive") or 0] * s.cognitive
        yield "\ninsert into t values(" + ", ".join([f"'{e(x)}'" for x in (project, f["language"], f["location"], folder, f["filename"])] + [str(x) for x in figures]) + ");"
        if n == 1000:
            n = 0
            yield "\ncommit;\nbegin transaction;"
    cost, months, people = cocomo(code, s)
    yield f"\ncommit;\nbegin transaction;\ninsert into metadata values('{now}', '{e(project)}', {seconds:f}, {cost:f}, {months:f}, {people:f});\ncommit;"
    if s.locomo:
        m = locomo(code, complexity, s)
        yield f"\nbegin transaction;\ninsert into locomo_metadata values('{now}', '{e(project)}', {m['cost']:f}, {m['input_tokens']:f}, {m['output_tokens']:f}, {m['seconds']:f}, {m['review_hours']:f}, '{e(m['preset'])}', {m['cycles']:f});\ncommit;"


def sql(files: Iterable[Row], s: Style = Style(), project: str = "", now: str = "", seconds: float = 0.0) -> Iterator[str]:
    """The tables and then the inserts."""
    table = lambda name, columns: f"create table {name} (\n" + ",\n".join(f"    {c}" for c in columns) + ");\n"
    yield table("metadata", ["timestamp text", "Project text", "elapsed_s real", "estimated_cost real", "estimated_schedule_months real", "estimated_people real"])
    yield table("t", ["Project text", "Language text", "File text", "File_dirname text", "File_basename text", "nByte integer", "nBlank integer", "nComment integer", "nCode integer", "nComplexity integer", "nUloc integer"] + ["nCognitive integer"] * s.cognitive)
    if s.locomo:
        yield table("locomo_metadata", ["timestamp text", "Project text", "estimated_llm_cost real", "estimated_llm_input_tokens real", "estimated_llm_output_tokens real", "estimated_llm_generation_seconds real", "estimated_llm_review_hours real", "estimated_llm_preset text", "estimated_llm_cycles real"])
    yield from sql_insert(files, s, project, now, seconds)


FORMATS = ("tabular", "wide", "json", "json2", "csv", "csv-stream", "cloc-yaml", "cloc-yml", "html", "html-table", "sql", "sql-insert", "openmetrics")


def parts(kind: str, languages: list[Row], s: Style = Style(), files: Iterable[Row] | None = None, by_file: bool = False, **more) -> Iterator[str]:
    """A format by name, piece by piece; an unknown one is tabular. Formats that go by file always read ``files``, and
    those with a line for each file don't hold more than one."""
    kind = kind.lower()
    each = files if by_file and files is not None else ()
    if kind == "wide":
        yield tabular(languages, s, each, wide=True, unique=more.get("unique"))
    elif kind == "json":
        yield json_text(languages, s, each)
    elif kind == "json2":
        yield json2_text(languages, s, each)
    elif kind == "csv" and not by_file:
        yield csv_text(languages, s)
    elif kind in ("csv", "csv-stream"):
        yield from csv_files(files or (), s, stream=kind == "csv-stream")
    elif kind in ("cloc-yaml", "cloc-yml"):
        yield cloc_yaml(languages, s, more.get("seconds", 0.0))
    elif kind == "html":
        yield html_page(languages, s, each)
    elif kind == "html-table":
        yield html_table(languages, s, each)
    elif kind in ("sql", "sql-insert"):
        yield from (sql if kind == "sql" else sql_insert)(files or (), s, more.get("project", ""), more.get("now", ""), more.get("seconds", 0.0))
    elif kind == "openmetrics":
        yield from openmetrics(languages, s, files if by_file else None)
    else:
        yield tabular(languages, s, each, unique=more.get("unique"))


def render(kind: str, languages: list[Row], s: Style = Style(), files: Iterable[Row] | None = None, by_file: bool = False, **more) -> str:
    """All of ``parts``, for results that are known to be small."""
    return "".join(parts(kind, languages, s, files, by_file, **more))


BARS, ASCII_BARS = " ▁▂▃▄▅▆▇█", " .:-=+*#@"


def downsample(values: list[float], n: int) -> list[float]:
    """``n`` cells of a series: means of its parts, or the last value again where it is too short."""
    if len(values) <= n:
        return list(values) + [values[-1] if values else 0.0] * (n - len(values))
    cuts = [len(values) * i // n for i in range(n + 1)]
    return [sum(values[a:b]) / max(1, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def sparkline(values: list[float], n: int, ascii_only: bool = False) -> str:
    ramp = ASCII_BARS if ascii_only else BARS
    cells = downsample(values, n)
    most = max(cells, default=0)
    return "".join(ramp[0] if v <= 0 or most <= 0 else ramp[max(1, min(8, round(v / most * 8)))] for v in cells)


def bar(share: float, n: int, ascii_only: bool = False) -> str:
    full = max(0, min(n, round(share * n)))
    return ("#" if ascii_only else "█") * full + ("." if ascii_only else "░") * (n - full)
