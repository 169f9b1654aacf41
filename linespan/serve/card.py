"""Pictures of the HTML report as SVG: the share card, the ring of languages, bars of line lengths."""

from __future__ import annotations

import base64
import html
import math
import zlib

WIDTH, HEIGHT = 1200, 630
#: Languages that get a part of their own; the others share one.
PARTS = 6
REST = "#999999"


def colour(language: str) -> str:
    """A hue from the language's name, the same on every page."""
    return f"hsl({zlib.crc32(language.encode()) % 360},60%,50%)"


def parts(languages: list[dict], most: int = PARTS) -> list[tuple[str, int, str]]:
    """(name, code, colour) of the languages with most code, then of all others together. Languages without code have
    no part; ties go by name."""
    rows = sorted(((r["language"], r["code"]) for r in languages if r["code"] > 0), key=lambda x: (-x[1], x[0]))
    out = [(name, code, colour(name)) for name, code in rows[:most]]
    rest = sum(code for _, code in rows[most:])
    return [*out, ("other", rest, REST)] if rest else out


def ring(shares: list[tuple[str, int, str]], radius: float = 60, thick: float = 24) -> str:
    """A ring whose arcs are as long as the shares; '' if there is nothing to share."""
    whole, round_ = sum(n for _, n, _ in shares), 2 * math.pi * radius
    if not whole:
        return ""
    side, out, at = 2 * radius + thick, [], 0.0
    for name, n, fill in shares:
        long = round_ * n / whole
        out.append(f'<circle cx="{side / 2}" cy="{side / 2}" r="{radius}" fill="none" stroke="{fill}" stroke-width="{thick}" stroke-dasharray="{long:.2f} {round_ - long:.2f}" stroke-dashoffset="{-at:.2f}"><title>{html.escape(name)} {n / whole:.1%}</title></circle>')
        at += long
    return f'<svg width="{side}" height="{side}">{"".join(out)}</svg>'


def bars(lengths: list[dict], width: int = 420, height: int = 120) -> str:
    """A bar for each bucket of line lengths, the highest as high as the picture."""
    most, each = max((r["lines"] for r in lengths), default=0), width / max(len(lengths), 1)
    if not most:
        return ""
    out = []
    for i, r in enumerate(lengths):
        high = height * r["lines"] / most
        out.append(f'<rect x="{i * each:.1f}" y="{height - high:.1f}" width="{each - 4:.1f}" height="{high:.1f}" fill="#27c"><title>{r["low"]}: {r["lines"]:,d}</title></rect><text x="{i * each:.1f}" y="{height + 14}" font-size="11">{r["low"]}</text>')
    return f'<svg width="{width}" height="{height + 18}">{"".join(out)}</svg>'


def card(title: str, languages: list[dict], cost: str = "") -> str:
    """The picture that links to the report show: title, totals, cost if there is one, and a bar of the languages."""
    total = {k: sum(r[k] for r in languages) for k in ("files", "lines", "code", "complexity")}
    out = [f'<rect width="{WIDTH}" height="{HEIGHT}" fill="#fff"/><text x="60" y="120" font-size="64">{html.escape(title)}</text>']
    figures = [(f"{n:,d}", name) for name, n in total.items()] + ([(cost, "cost")] if cost else [])
    step = (WIDTH - 120) / len(figures)
    for i, (figure, name) in enumerate(figures):
        out.append(f'<text x="{60 + i * step:.0f}" y="280" font-size="44">{html.escape(figure)}</text><text x="{60 + i * step:.0f}" y="320" font-size="24" fill="#666">{name}</text>')
    shares = parts(languages)
    whole, at = sum(n for _, n, _ in shares), 60.0
    for i, (name, n, fill) in enumerate(shares):
        long = (WIDTH - 120) * n / whole
        out.append(f'<rect x="{at:.1f}" y="420" width="{long:.1f}" height="40" fill="{fill}"/><text x="{60 + i % 4 * 280}" y="{510 + i // 4 * 40}" font-size="24" fill="{fill}">{html.escape(name)} {n / whole:.1%}</text>')
        at += long
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif">{"".join(out)}</svg>'


def data_url(svg: str) -> str:
    return "data:image/svg+xml;base64," + base64.b64encode(svg.encode()).decode()
