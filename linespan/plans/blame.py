"""Who touched each line last: the replay of diffs along a path's lineage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for all authors before the window.
BEFORE = -1


def apply_diff(previous: list[int], lines: int, added: Iterable[tuple[int, int]], removed: Iterable[tuple[int, int]], author: int, before: int = BEFORE) -> list[int]:
    """Authors of the lines after a commit. Ranges are (first line from 1, count): added ones in the new file, removed
    ones in the old; lines in neither keep their authors in order, and what is missing is ``before``'s."""
    gone = set()
    for start, n in removed:
        gone.update(range(start - 1, start - 1 + n))
    kept = iter([a for i, a in enumerate(previous) if i not in gone])
    new = set()
    for start, n in added:
        new.update(range(start - 1, start - 1 + n))
    return [author if i in new else next(kept, before) for i in range(lines)]


def lineages(changes: DataFrame, renames: DataFrame | None) -> DataFrame:
    """``changes`` with lineage: the path that a path ended up as."""
    if renames is None:
        return changes.withColumn("lineage", F.col("path"))
    r = renames.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return changes.join(r, F.col("path") == F.col("_old"), "left").withColumn("lineage", F.coalesce("_new", "path")).drop("_old", "_new")


def replay(changes: DataFrame, baseline: DataFrame | None = None, renames: DataFrame | None = None) -> DataFrame:
    """(path, line_no, author_id, line_type, complexity) at the end of the window.

    ``changes``: seq, path, author_id, added and removed (arrays of start and count), line_types and complexity (arrays
    by line of the file after the commit). ``baseline``: path, line_types at the start of the window; its lines are
    ``BEFORE``'s. Commits come sorted by lineage and seq in Arrow batches, and what is held of a file is the owner of each
    of its lines, so a file's history may be of any length. Equal seqs go by path, and rows of a null path are one file.
    """
    own = lineages(changes, renames).select("lineage", "seq", "path", "author_id", "added", "removed", "line_types", "complexity")
    if baseline is not None:
        start = lineages(baseline.withColumn("seq", F.lit(-1).cast("long")), renames)
        empty = F.array().cast("array<struct<start:int,count:int>>")
        own = own.unionByName(start.select("lineage", "seq", "path", F.lit(BEFORE).cast("long").alias("author_id"), empty.alias("added"), empty.alias("removed"), "line_types", F.transform("line_types", lambda x: x * 0).alias("complexity")))

    def lines_of(r: tuple, owners: list[int]) -> Iterator[pd.DataFrame]:
        if not (n := len(owners)):
            return  # an empty file has no rows
        weight = list(r.complexity)[:n] + [0] * (n - len(r.complexity))
        yield pd.DataFrame({"path": [r.lineage] * n, "line_no": range(1, n + 1), "author_id": owners, "line_type": list(r.line_types), "complexity": weight})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = lambda x: [(int(p["start"]), int(p["count"])) for p in x]
        owners: list[int] = []
        last = None
        for pdf in batches:
            for r in pdf.itertuples():
                if last is not None and r.lineage != last.lineage:
                    yield from lines_of(last, owners)
                    owners = []
                owners = apply_diff(owners, len(r.line_types), pairs(r.added), pairs(r.removed), int(r.author_id))
                last = r
        if last is not None:
            yield from lines_of(last, owners)

    ordered = own.repartition("lineage").sortWithinPartitions("lineage", "seq", "path")
    return ordered.mapInPandas(run, "path string, line_no int, author_id bigint, line_type int, complexity int")


def owned_lines(blame: DataFrame) -> DataFrame:
    """(path, author_id, code, comment, complexity), as ``history.ownership`` takes it."""
    kind = lambda k: F.sum((F.col("line_type") == k).cast("long"))
    return blame.groupBy("path", "author_id").agg(kind(1).alias("code"), kind(2).alias("comment"), F.sum("complexity").cast("long").alias("complexity"))
