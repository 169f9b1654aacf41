"""The HTML report: all sections on one page that needs nothing else."""

from __future__ import annotations

import html
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linespan import api
from linespan.functions import text
from linespan.operators import rollup
from linespan.serve import card
from linespan.sinks import render
from linespan.sources.config import Options
from linespan.sources.git import remote_name

SECTIONS = ("card", "languages", "files", "uloc", "lengths", "cost", "hotspots", "coupling", "authors", "timeline")
#: Rows of the page's tables.
ROWS = {"files": 12, "hotspots": 12, "coupling": 20, "authors": 12, "outliers": 10}


def collect(spark: SparkSession, o: Options) -> dict[str, list[dict]]:
    """The sections that aren't skipped, each a short list. Counts and history are read once."""
    want = [s for s in SECTIONS if s not in o.report_skip]
    files = api.count(spark, o).cache()
    body = files.withColumn("content", F.col("content").cast("string"))
    out: dict[str, list[dict]] = {"languages": [r.asDict() for r in api.summary(files, o).collect()]}
    take = lambda df, n=None: [r.asDict() for r in (df if n is None else df.limit(n)).collect()]
    if "files" in want:
        out["files"] = take(files.select("location", "language", "lines", "code", "complexity").orderBy(F.desc("lines"), "location"), ROWS["files"])
    if "uloc" in want:
        out["uloc"] = take(rollup.unique_lines(body, ["language"]).orderBy(F.desc("uloc"), "language"))
        out["unique"] = take(rollup.unique_lines(body, []))
    if "lengths" in want:
        lengths = body.select("location", F.explode(text.line_lengths(F.col("content"))).alias("length"))
        out["lengths"] = take(rollup.length_histogram(lengths).orderBy("bucket"))
        out["outliers"] = take(lengths.groupBy("location").agg(F.max("length").alias("longest")).orderBy(F.desc("longest"), "location"), ROWS["outliers"])
    if "cost" in want:
        whole, s = render.total(out["languages"]), api.style(o)
        cost, months, people = render.cocomo(whole["code"], s)
        out["cost"] = [{"cost": cost, "months": months, "people": people} | {f"llm_{k}": v for k, v in render.locomo(whole["code"], whole["complexity"], s).items() if k in ("cost", "cycles")}]
    if os.path.isdir(os.path.join(o.paths[0], ".git")) and {"hotspots", "coupling", "authors", "timeline"} & {*want}:
        h = api.GitHistory(spark, o.paths[0], o.depth)
        out |= {"hotspots": take(h.hotspots(), ROWS["hotspots"])} if "hotspots" in want else {}
        out |= {"coupling": take(h.coupling(), ROWS["coupling"])} if "coupling" in want else {}
        out |= {"authors": take(h.authors(), ROWS["authors"])} if "authors" in want else {}
        out |= {"timeline": take(h.language_timeline(o.buckets))} if "timeline" in want else {}
    files.unpersist()
    return out


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    show = lambda v: f"{v:,.1f}" if isinstance(v, float) else f"{v:,d}" if isinstance(v, int) and not isinstance(v, bool) else html.escape("" if v is None else str(v))
    return "<table><tr>" + "".join(f"<th>{html.escape(k)}</th>" for k in rows[0]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{show(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def _lines(rows: list[dict]) -> str:
    """Timelines as paths of a picture each."""
    by: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: r["bucket"]):
        by.setdefault(str(r["language"]), []).append(r["code"])
    out = []
    for name, values in sorted(by.items(), key=lambda x: (-x[1][-1], x[0])):
        most = max(*values, 1)
        points = " ".join(f"{i * 300 / max(1, len(values) - 1):.1f},{40 - 38 * v / most:.1f}" for i, v in enumerate(values))
        out.append(f'<p>{html.escape(name)} ({values[-1]:,d})<br><svg width="300" height="40"><polyline fill="none" stroke="#27c" points="{points}"/></svg></p>')
    return "".join(out)


def page(data: dict[str, list[dict]], o: Options) -> str:
    title = html.escape(o.report_title or remote_name(o.paths[0]) or os.path.basename(os.path.abspath(o.paths[0])))
    pictures = {"languages": lambda rows: card.ring(card.parts(rows)), "lengths": card.bars}
    parts = [f"<h2>{name.capitalize()}</h2>" + (_lines(rows) if name == "timeline" else pictures.get(name, lambda rows: "")(rows) + _table(rows)) for name, rows in data.items()]
    share = ""
    if "card" not in o.report_skip:
        cost = f"{o.currency_symbol}{data['cost'][0]['cost']:,.0f}" if data.get("cost") else ""
        picture = card.card(o.report_title or remote_name(o.paths[0]) or os.path.basename(os.path.abspath(o.paths[0])), data["languages"], cost)
        share = f'<meta property="og:title" content="{title}"><meta property="og:image" content="{card.data_url(picture)}">'
        parts.insert(0, picture.replace("<svg ", '<svg style="max-width:100%;height:auto" ', 1))
    style = "body{font:15px sans-serif;max-width:70rem;margin:2rem auto}table{border-collapse:collapse}td,th{padding:.2rem .6rem;border-bottom:1px solid #ddd;text-align:right}td:first-child,th:first-child{text-align:left}"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{title}</title>{share}<style>{style}</style></head><body><h1>{title}</h1>{"".join(parts)}</body></html>'
