"""``python -m linespan.cli``: counts, history reports, the HTML report, and the tools for other programs."""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linespan import api, session
from linespan.plans import blame
from linespan.plans import history as plans
from linespan.serve import report, tools
from linespan.sinks import history as views
from linespan.sources.config import Options, completion, options


#: Fixed value: pairs that the table of all couplings shows.
OVERVIEW = 15


def timeline(series: DataFrame, who: str, by: str, kind: str) -> list[dict]:
    """All timelines for CSV and JSON; for a table the first ones, the others added up."""
    if kind in ("csv", "json"):
        return [r.asDict() for r in series.drop("author_key").toLocalIterator()]
    sums = [c for c in ("commits", "delta", "code") if c in series.columns]
    return [r.asDict() for r in plans.fold_series(series, who, [F.desc(by)], sums).collect()]


def authors(h: api.GitHistory, o: Options) -> str:
    """All authors for CSV and JSON; as a table the first ones, the others in one row, what was there before the window,
    and the bus factor."""
    rows = h.authors()
    if o.format in ("csv", "json"):
        return views.table(o.format, "authors", [r.asDict() for r in rows.toLocalIterator()])
    own = rows.where(F.col("author_id") != blame.BEFORE)
    sums = ["code", "comment", "complexity", "owns_percent"]
    first = [r.asDict() for r in own.orderBy(F.desc("code"), "author").limit(plans.LISTED).collect()]
    others = [r.asDict() for r in plans.fold_tail(own, "author", [F.desc("code"), F.col("author")], sums).where(F.col("author").startswith("others (")).collect()] if len(first) == plans.LISTED else []
    before = [r.asDict() for r in rows.where((F.col("author_id") == blame.BEFORE) & (F.col("code") + F.col("comment") + F.col("complexity") > 0)).collect()]
    factor = h.bus_factor().first()[0]
    return views.table(o.format, "authors", first + others + before) + f"Bus factor: {factor}\n"


def history(spark, o: Options) -> Iterator[str]:
    """A history report piece by piece. The table of all couplings is a glance of ``OVERVIEW`` rows; all else is whole."""
    h = api.GitHistory(spark, o.paths[0], o.depth, not o.has("no_fold_authors"), api.rules_of(o))
    if o.coupling_for:
        return views.pieces(o.format, "coupling-for", api.rows(h.coupling_for(o.coupling_for)))
    if o.has("coupling", "coupling_weighted"):
        pairs = h.coupling(o.has("coupling_weighted"))
        if o.format in ("csv", "json"):
            return views.pieces(o.format, "coupling", api.rows(pairs))
        first, n = api.rows(pairs.limit(OVERVIEW)), pairs.count()
        return iter([*views.pieces(o.format, "coupling", first), f"top {OVERVIEW} of {n} pairs\n" if n > OVERVIEW else ""])
    if o.has("hotspots"):
        return views.pieces(o.format, "hotspots", api.rows(h.hotspots().where("score > 0")))
    if o.has("by_author") and o.has("timeline"):
        return iter([views.series(o.format, "author", timeline(h.author_timeline(o.buckets), "author", "commits", o.format), o.has("ci"))])
    if o.has("by_author"):
        return iter([authors(h, o)])
    return iter([views.series(o.format, "language", [r.asDict() for r in h.language_timeline(o.buckets).collect()], o.has("ci"))])


def main(argv: list[str]) -> int:
    try:
        o = options(argv)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if o.completion:
        try:
            print(completion(o.completion), end="")
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    level = logging.DEBUG if o.has("trace", "debug") else logging.INFO if o.has("verbose") else logging.WARNING
    logging.basicConfig(level=logging.WARNING, stream=sys.stderr, format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("linespan").setLevel(level)
    if o.has("languages"):
        for name, r in sorted(api.rules_of(o).items(), key=lambda x: x[0].lower()):
            print(f"{name} ({','.join((*r.extensions, *r.filenames))})")
        return 0
    spark = session.build()
    try:
        if o.has("mcp"):
            return tools.serve(spark, sys.stdin, sys.stdout)
        if o.report:
            out = [(o.report, iter([report.page(report.collect(spark, o), o)]))]
        elif o.has("hotspots", "coupling", "coupling_weighted", "by_author", "timeline") or o.coupling_for:
            out = [(o.output, history(spark, o))]
        else:
            out = api.outputs(api.count(spark, o), o)
        for target, pieces in out:
            if target:
                with open(target, "w", encoding="utf-8") as f:
                    f.writelines(pieces)
                print(f"results written to {target}")
            else:
                last = ""
                for last in pieces:
                    sys.stdout.write(last)
                print("", end="" if last.endswith("\n") else "\n")
    except (OSError, ValueError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
