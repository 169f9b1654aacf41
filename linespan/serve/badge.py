"""Badges: one figure of a count as a small picture."""

from __future__ import annotations

import html
import math
import re
import time
from collections import OrderedDict
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

NAMED = {"blue": "#007ec6", "green": "#97ca00", "red": "#e05d44", "orange": "#fe7d37", "yellow": "#dfb317", "grey": "#555", "black": "#000", "white": "#fff"}
JUNK = (".php", "wp-", "cgi-bin", ".env", "admin", "login", "..", "%00")


def colour(text: str, default: str = "#007ec6") -> str:
    text = text.strip().lower()
    if text in NAMED:
        return NAMED[text]
    return f"#{text.removeprefix('#')}" if re.fullmatch(r"#?([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})", text) else default


#: Units of large figures.
UNITS = ((1e18, "E"), (1e15, "P"), (1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "k"))


def short(n: float) -> str:
    """Three characters and a unit, rounded up to a tenth; no tenths from ten on."""
    for size, unit in UNITS:
        if n >= size:
            text = f"{math.ceil(n / size * 10) / 10:.1f}"
            return (text if len(text) <= 3 else text.partition(".")[0]) + unit
    return f"{round(n)}"


def junk(path: str) -> bool:
    """Two or more parts that no repository's address has."""
    return sum(x in path for x in JUNK) >= 2


def value(category: str, languages: list[dict], wage: float = 56_286) -> tuple[str, str]:
    """(title, text) for a category: code, blanks, comments, lines, cocomo or effort."""
    whole = {k: sum(r[k] for r in languages) for k in ("code", "blank", "comment", "lines")}
    effort = 3.2 * (whole["code"] / 1000) ** 1.05 if whole["code"] else 0.0
    if category == "cocomo":
        return "COCOMO $", short(effort * (wage / 12) * 1.8)
    if category == "effort":
        months = round(2.5 * effort**0.38) if effort else 0
        return "Effort", f"{months // 12} years {months % 12} months" if months >= 12 else f"{months} months"
    key = {"blanks": "blank", "blank": "blank", "comments": "comment", "comment": "comment", "lines": "lines"}.get(category, "code")
    return {"blank": "Blank lines", "comment": "Comments", "lines": "Total lines", "code": "Code lines"}[key], short(whole[key])


def svg(title: str, text: str, left: str = "#555", right: str = "#007ec6") -> str:
    a, b = 10 + 7 * len(title), 10 + 7 * len(text)
    cell = lambda x, w, t, c: f'<rect x="{x}" width="{w}" height="20" fill="{colour(c)}"/><text x="{x + w / 2}" y="14" text-anchor="middle">{html.escape(t)}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{a + b}" height="20" role="img"><g fill="#fff" font-family="sans-serif" font-size="11">{cell(0, a, title, left)}{cell(a, b, text, right)}</g></svg>'


class Badges:
    """Answers /host/owner/repository?category=... with a badge. ``count`` makes the languages of an address (it clones
    and counts); what it made is remembered for ``keep`` seconds, for the ``most`` addresses that were asked for last."""

    def __init__(self, count: Callable[[str], list[dict]], keep: float = 86_400, most: int = 10_000, now: Callable[[], float] = time.time):
        self.count, self.keep, self.most, self.now = count, keep, most, now
        self.known: OrderedDict[str, tuple[float, list[dict]]] = OrderedDict()

    def languages(self, address: str) -> list[dict]:
        if (found := self.known.get(address)) and self.now() - found[0] < self.keep:
            self.known.move_to_end(address)
            return found[1]
        out = self.count(address)
        self.known[address] = self.now(), out
        self.known.move_to_end(address)
        while len(self.known) > self.most:
            self.known.popitem(last=False)
        return out

    def answer(self, url: str) -> tuple[int, str, str]:
        """(status, type, body) of a request."""
        at = urlsplit(url)
        path, asked = at.path.strip("/").split("/"), {k: v[-1] for k, v in parse_qs(at.query).items()}
        if at.path == "/health-check/":
            return 200, "text/plain", "ok"
        if len(path) != 3 or not all(path) or junk(at.path):
            return 400, "text/plain", "an address is /host/owner/repository"
        host = path[0] if "." in path[0] else f"{path[0]}.org" if path[0] == "bitbucket" else f"{path[0]}.com"
        try:
            languages = self.languages(f"https://{host}/{path[1]}/{path[2]}.git")
        except (OSError, ValueError) as e:
            return 400, "text/plain", str(e)
        title, text = value(asked.get("category", "code").lower(), languages, float(asked.get("avg-wage") or 56_286))
        if asked.get("lower") == "true":
            title = title.lower()
        return 200, "image/svg+xml;charset=utf-8", svg(asked.get("title") or title, text, asked.get("title-bg-color") or "#555", asked.get("badge-bg-color") or "#007ec6")

    def server(self, port: int) -> ThreadingHTTPServer:
        badges = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                status, kind, body = badges.answer(self.path)
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.end_headers()
                self.wfile.write(body.encode())

        return ThreadingHTTPServer(("127.0.0.1", port), Handler)
