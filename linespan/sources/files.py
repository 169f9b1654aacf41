"""Files of folders as a table.

Folders are listed by the driver, with ignored ones pruned, and names and sizes become rows; contents are read by the
executors, after all filters on names and sizes. Spark's own binary source would leave out hidden and empty files. Paths must
be readable on all executors, so on a cluster folders lie in a shared mount; for object stores use ``table``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linespan.sources.ignore import Ignore, parse, submodules

#: Folders of version control, lock files left out by name, and sizes of what counts as large.
EXCLUDED_FOLDERS = (".git", ".hg", ".svn")
EXCLUDED_NAMES = ("package-lock.json", "Cargo.lock", "yarn.lock", "pubspec.lock", "Podfile.lock", "pnpm-lock.yaml")
LARGE_BYTES, LARGE_LINES = 1_000_000, 40_000
COLUMNS = "location string, filename string, sym_location string, bytes bigint"


@dataclass(frozen=True)
class Listing:
    """What is listed. ``ignore_files``: names whose rules hold for their folder; ``base_rules``: rules that all others
    overrule; ``not_match``: expressions that no name, folder or path may match."""

    ignore_files: tuple[str, ...] = (".gitignore", ".ignore", ".locignore")
    base_rules: str = ""
    git_modules: bool = True
    exclude_dirs: tuple[str, ...] = EXCLUDED_FOLDERS
    exclude_names: tuple[str, ...] = EXCLUDED_NAMES
    not_match: tuple[str, ...] = ()
    symlinks: bool = False
    max_bytes: int | None = None


def walk(root: str, o: Listing = Listing()) -> Iterator[tuple[str, str, str, int]]:
    """(location, filename, sym_location, bytes) of files below ``root`` or of the file it is."""
    shut = [re.compile(x) for x in o.not_match]
    seen: set[str] = set()

    def one(path: str, name: str) -> Iterator[tuple[str, str, str, int]]:
        link = os.path.islink(path)
        if link and not o.symlinks:
            return
        real = os.path.realpath(path)
        if not os.path.isfile(real) or real in seen:
            return
        seen.add(real)
        size = os.path.getsize(real)
        if o.max_bytes is not None and size >= o.max_bytes:
            return
        if any(x in name for x in o.exclude_names):
            return
        yield path, name, real if link else "", size

    def rules(folder: str, at: str, ignore: Ignore) -> Ignore:
        for name in o.ignore_files:
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    ignore = ignore.extended(at, parse(f.read()))
            except OSError:
                continue
        return ignore

    def below(folder: str, at: str, ignore: Ignore) -> Iterator[tuple[str, str, str, int]]:
        ignore = rules(folder, at, ignore)
        skipped: set[str] = set()
        if o.git_modules and os.path.isfile(os.path.join(folder, ".gitmodules")):
            with open(os.path.join(folder, ".gitmodules"), encoding="utf-8", errors="replace") as f:
                skipped = {os.path.normpath(os.path.join(folder, p)) for p in submodules(f.read())}
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path, rel = os.path.join(folder, e.name), f"{at}/{e.name}" if at else e.name
            folder_here = e.is_dir(follow_symlinks=False)
            if any(x.search(e.name) or x.search(path) for x in shut) or ignore.ignored(rel, folder_here):
                continue
            if folder_here:
                if e.name not in {d.rstrip("/") for d in o.exclude_dirs} and os.path.normpath(path) not in skipped:
                    yield from below(path, rel, ignore)
            else:
                yield from one(path, e.name)

    if os.path.isfile(root):
        yield from one(root, root)
    elif os.path.isdir(root):
        yield from below(root, "", Ignore().extended("", parse(o.base_rules)))
    else:
        raise FileNotFoundError(root)


def list_files(spark: SparkSession, roots: list[str], o: Listing = Listing()) -> DataFrame:
    """Names and sizes; a file that several roots hold is there once."""
    found = {os.path.realpath(r[0]): r for root in roots for r in walk(root, o)}
    return spark.createDataFrame(list(found.values()), COLUMNS)


def read(listed: DataFrame) -> DataFrame:
    """``listed`` with content binary; filter by name and size before. A file that has gone meanwhile has none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema) + ", content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                b = whole.slice(k, 64)
                data = []
                for path in b.column("location").to_pylist():
                    try:
                        with open(path, "rb") as f:
                            data.append(f.read())
                    except OSError:
                        data.append(None)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, "content"])

    return listed.mapInArrow(run, schema).where(F.col("content").isNotNull())


def table(df: DataFrame, location: str, content: str, filename: str | None = None) -> DataFrame:
    """Any table with a text or binary column as files."""
    name = F.col(filename) if filename else F.regexp_extract(F.col(location).cast("string"), "([^/]*)$", 1)
    data = F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))
    return df.select(F.col(location).cast("string").alias("location"), name.alias("filename"), F.lit("").alias("sym_location"), F.octet_length(data).cast("long").alias("bytes"), data.alias("content"))


def from_store(spark: SparkSession, path: str) -> DataFrame:
    """Files of any store that Spark reads; hidden and empty files are not among them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.col("path").alias("location"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), F.lit("").alias("sym_location"), F.col("length").alias("bytes"), "content")


def reread_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON output as a table of languages."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.col("Name").alias("language"), F.col("Count").alias("files"), *[F.col(c).alias(c.lower()) for c in ("Lines", "Code", "Comment", "Blank", "Complexity", "Bytes")])
