"""Tools ``analyze``, ``hotspots`` and ``coupling`` over JSON-RPC lines."""

from __future__ import annotations

import json
from dataclasses import replace
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linespan import api
from linespan.operators import rollup
from linespan.sinks import render
from linespan.sources.config import Options, normalise

LIMITS = {"files": 10, "hotspots": 50, "coupling": 50}


def _options(a: dict) -> Options:
    flags = {n for n in ("uloc", "cognitive", "no_duplicates", "no_min_gen", "by_file", "locomo") if a.get(n)}
    split = lambda k: tuple(x for x in str(a.get(k, "")).split(",") if x)
    return normalise(replace(Options(), paths=(a.get("path") or ".",), flags=frozenset(flags), include_ext=split("include_ext"), exclude_ext=split("exclude_ext"), sort=a.get("sort") or "code", locomo_preset=a.get("locomo_preset") or "medium"))


def analyze(spark: SparkSession, a: dict) -> dict:
    o = _options(a)
    files = api.count(spark, o).drop("content_hash").cache()
    languages = [r.asDict() for r in api.summary(files, o).collect()]
    whole, s = render.total(languages), api.style(o)
    cost, months, people = render.cocomo(whole["code"], s)
    out = {"path": o.paths[0], "languages": languages, "totals": whole, "cocomo": {"cost": cost, "scheduleMonths": months, "people": people}, "totalFiles": whole["files"], "totalLines": whole["lines"], "totalCode": whole["code"]}
    if o.has("locomo"):
        out["locomo"] = render.locomo(whole["code"], whole["complexity"], s)
    if o.has("by_file"):
        top = rollup.top_files(files.select("language", "location", "lines", "code", "comment", "blank", "complexity", "bytes"), int(a.get("limit") or LIMITS["files"]), o.sort)
        for r in top.orderBy("language", "rank").collect():
            next(x for x in languages if x["language"] == r["language"]).setdefault("top", []).append(r.asDict())
    files.unpersist()
    return out


def _history(spark: SparkSession, a: dict) -> api.GitHistory:
    return api.GitHistory(spark, a.get("path") or ".", int(a.get("depth", api.history.DEPTH)))


def _first(found: DataFrame, a: dict, kind: str) -> list[dict]:
    """As many rows as asked for; -1: all."""
    most = int(a.get("limit") or LIMITS[kind])
    return [r.asDict() for r in (found if most < 0 else found.limit(most)).toLocalIterator()]


def hotspots(spark: SparkSession, a: dict) -> dict:
    return {"hotspots": _first(_history(spark, a).hotspots().where(F.col("score") > 0), a, "hotspots")}


def coupling(spark: SparkSession, a: dict) -> dict:
    h = _history(spark, a)
    found = h.coupling_for(a["file"]) if a.get("file") else h.coupling(bool(a.get("weighted")))
    return {"coupling": _first(found, a, "coupling")}


_S, _N, _B = ({"type": t} for t in ("string", "number", "boolean"))
INPUTS = {
    "analyze": {"path": _S, "sort": _S, "by_file": _B, "limit": _N, "include_ext": _S, "exclude_ext": _S, "no_duplicates": _B, "no_min_gen": _B, "uloc": _B, "cognitive": _B, "locomo": _B, "locomo_preset": _S},
    "hotspots": {"path": _S, "depth": _N, "limit": _N},
    "coupling": {"file": _S, "weighted": _B, "path": _S, "depth": _N, "limit": _N},
}
TOOLS = {"analyze": analyze, "hotspots": hotspots, "coupling": coupling}


def answer(spark: SparkSession, request: dict) -> dict | None:
    """The reply to one request; notifications have none."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "linespan", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": f"{n} of a folder", "inputSchema": {"type": "object", "properties": INPUTS[n]}} for n in TOOLS]}}
    if method == "tools/call" and params.get("name") in TOOLS:
        try:
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(TOOLS[params["name"]](spark, params.get("arguments") or {}), default=str)}]}}
        except Exception as e:  # noqa: BLE001  the caller is told, and the server goes on
            return reply | {"result": {"isError": True, "content": [{"type": "text", "text": str(e)}]}}
    return reply | {"error": {"code": -32601, "message": f"unknown: {method}"}}


def serve(spark: SparkSession, lines: IO[str], out: IO[str]) -> int:
    for line in lines:
        if line.strip() and (reply := answer(spark, json.loads(line))) is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()
    return 0
