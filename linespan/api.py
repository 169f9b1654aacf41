"""The engine as a library: a count, its history reports, and what serves other programs."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linespan.functions import text
from linespan.functions.cost import Locomo
from linespan.operators import classify, detect, rollup
from linespan.plans import blame, history
from linespan.rules import BUILT_IN, UNKNOWN, Rule, load, table
from linespan.sinks import render
from linespan.sources import files as sources
from linespan.sources import git
from linespan.sources.config import Options
from linespan.sources.ignore import ignored

log = logging.getLogger("linespan")


def rules_of(o: Options) -> dict[str, Rule]:
    """Built-in rules, those of a file, and categories made by patterns, which count like their base."""
    out = load(o.rules, table(BUILT_IN)) if o.rules else table(BUILT_IN)
    for p in o.count_as_pattern:
        _, name, base = detect.parse_pattern(p)
        by_name = {n.lower(): r for n, r in out.items()}
        out[name] = by_name.get(base.lower(), UNKNOWN)
    return out


def listing(o: Options) -> sources.Listing:
    names = [n for n, off in ((".gitignore", "no_gitignore"), (".ignore", "no_ignore"), (".locignore", "no_own_ignore")) if not o.has(off)]
    base = ""
    if o.ignore_file:
        with open(o.ignore_file, encoding="utf-8") as f:
            base = f.read()
    return sources.Listing(tuple(names), base, not o.has("no_gitmodule"), o.exclude_dir, o.exclude_file, o.not_match, o.has("include_symlinks"), o.large_byte_count if o.has("no_large") else None)


def count(spark: SparkSession, o: Options, given: DataFrame | None = None) -> DataFrame:
    """Counted files (see ``counted``) of the folders of ``o``, or of a table with location, filename, bytes, content."""
    raw = given if given is not None else sources.read(sources.list_files(spark, list(o.paths), listing(o)))
    return counted(raw, o)


def counted(raw: DataFrame, o: Options) -> DataFrame:
    """Detects, counts, marks and drops, in the order that decides what a dropped file still takes with it."""
    rules = rules_of(o)
    found = detect.detect(raw, rules, dict(o.count_as), list(o.count_as_pattern), list(o.remap_all), list(o.remap_unknown), o.has("count_unsupported"), list(o.include_ext) or None)
    if o.exclude_ext:
        found = found.where(~F.col("extension").isin(*o.exclude_ext))
    if not o.has("count_ignore"):
        found = found.where(~F.col("language").isin("gitignore", "ignore"))
    out = classify.count_files(found, rules, complexity=not o.has("no_complexity"), most=o.large_line_count if o.has("no_large") else None)
    body = F.col("content").cast("string")
    out = out.withColumn("generated", text.generated(body, list(o.generated_markers)) if o.has("gen") else F.lit(False))
    out = out.withColumn("minified", text.minified(F.col("bytes"), F.col("lines"), F.col("generated"), o.min_gen_line_length) if o.has("min") else F.lit(False))
    out = out.withColumn("content_hash", F.sha2("content", 256))
    out = rollup.drop_in_order(out, o.has("no_duplicates"), o.has("no_min"), o.has("no_gen"), o.large_line_count if o.has("no_large") else None, o.has("binary"))
    label = F.concat("language", F.when(F.col("minified"), " (min)").otherwise(""), F.when(F.col("generated"), " (gen)").otherwise(""))
    return out.withColumns({"language": label, "uloc": F.size(text.unique_line_array(body)).cast("long")})


def summary(files: DataFrame, o: Options) -> DataFrame:
    out = rollup.by_language(files)
    if o.has("uloc"):
        out = out.join(rollup.unique_lines(files.withColumn("content", F.col("content").cast("string")), ["language"]), "language", "left")
    if o.has("character"):
        lengths = files.select("language", F.explode(text.line_lengths(F.col("content").cast("string"))).alias("length"))
        out = out.join(lengths.groupBy("language").agg(F.max("length").alias("longest"), F.floor(F.sum("length") / F.count(F.lit(1))).alias("mean")), "language", "left")
    return rollup.sort_languages(out, o.sort)


def style(o: Options) -> render.Style:
    return render.Style(not o.has("no_complexity"), o.has("cognitive"), o.has("percent"), o.has("uloc"), o.has("dryness"), o.has("character"), o.has("ci"), not o.has("no_hborder"), not o.has("no_cocomo"), not o.has("no_size"), o.has("locomo"), o.size_unit, o.avg_wage, o.overhead, o.eaf, o.cocomo_project_type, o.locomo_preset, o.currency_symbol, o.has("sloccount_format"), title=o.report_title, model=Locomo.of(o.locomo_preset, o.locomo_input_price, o.locomo_output_price, o.locomo_tps, o.locomo_cycles, o.locomo_review, o.locomo_config))


def rows(df: DataFrame) -> Iterator[dict]:
    """Rows one partition after the other."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def outputs(files: DataFrame, o: Options) -> Iterator[tuple[str, Iterator[str]]]:
    """(target, pieces of text) for each format asked for; '' is the standard output. Languages are few and come to the
    driver; files are streamed in order of language, one partition after the other."""
    began = time.time()
    files = files.persist(StorageLevel.DISK_ONLY)  # every part of the output reads the count
    languages = [r.asDict() for r in summary(files, o).collect()]
    log.debug("%d languages in %.2f s", len(languages), time.time() - began)
    unique = rollup.unique_lines(files.withColumn("content", F.col("content").cast("string")), []).first()[0] if o.has("uloc") else None
    pairs = [p.partition(":")[::2] for p in o.format_multi.split(",") if p] or [(o.format, o.output)]
    slim = files.drop("content", "content_hash")
    by_figure = rollup.sort_files(slim, o.sort if o.sort not in ("files", "count") else "lines")
    by_name = rollup.sort_csv_files(slim, o.sort, o.has("cognitive"))
    for kind, target in pairs:
        log.debug("format %s to %s", kind, target or "the standard output")
        more = {"unique": unique, "project": o.sql_project or ",".join(o.paths), "now": datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), "seconds": time.time() - began}
        yield "" if target in ("", "stdout") else target, render.parts(kind, languages, style(o), rows(by_name if kind.lower() == "csv" else by_figure), o.has("by_file"), **more)
    files.unpersist()
    log.debug("done in %.2f s", time.time() - began)


def write(files: DataFrame, o: Options) -> list[tuple[str, str]]:
    """``outputs`` as whole texts."""
    return [(target, "".join(pieces)) for target, pieces in outputs(files, o)]


class GitHistory:
    """A window of a repository's history, read once and shared by its reports."""

    def __init__(self, spark: SparkSession, repo: str, depth: int = history.DEPTH, fold: bool = True, rules: dict[str, Rule] | None = None):
        self.spark, self.repo, self.rules = spark, repo, rules or table(BUILT_IN)
        log = git.commits(spark, repo, depth)
        self.base = git.baseline_commit(log)
        self.log = history.identities(log, git.mailmap(spark, repo), fold).cache()
        self.ignore = git.ignore_rules(repo)
        raw = self._classified(git.file_changes(log, repo), "content")
        self.changes = self._old(raw).cache()
        head = self._classified(git.tree(spark, repo), "content")
        self.head = head.select("path", "language", F.aggregate("complexity_line", F.lit(0).cast("long"), lambda a, x: a + x).alias("complexity")).cache()
        self.renames = history.rename_map(self.changes)

    def _classified(self, df: DataFrame, content: str) -> DataFrame:
        named = df.where(~ignored(F.col("path"), self.ignore)).withColumns({"filename": F.regexp_extract("path", "([^/]*)$", 1), "location": F.col("path"), "content": F.col(content)})
        found = detect.detect(named, self.rules)
        return classify.count_files(found, self.rules, per_line=True)

    def _old(self, changes: DataFrame) -> DataFrame:
        """With the classes of the lines before each commit, for what it removed."""
        own = changes.drop("content", "code", "comment", "blank", "lines", "complexity", "cognitive", "cognitive_line").withColumn("content", F.coalesce("old_content", F.lit("").cast("binary"))).withColumnsRenamed({"line_types": "new_types", "complexity_line": "new_complexity"})
        counted_ = classify.count_files(own.drop("binary"), self.rules, per_line=True)
        return counted_.select("seq", "change_idx", "path", "from_path", "language", "added", "removed", "new_types", "new_complexity", F.col("line_types").alias("old_types"))

    def _with_authors(self) -> DataFrame:
        return self.changes.join(self.log.select("seq", "author_key", "author_id", "author", "email", "when"), "seq")

    def hotspots(self) -> DataFrame:
        moved = history.follow(self._with_authors(), self.renames, "path")
        code, comment = (history.lines_of_type(F.col("added"), F.col("new_types"), k) for k in (1, 2))
        flat = moved.select("seq", "path", "author_key", (history.range_lines(F.col("added")) + history.range_lines(F.col("removed"))).alias("lines_changed"), code.alias("code_churn"), comment.alias("comment_churn"))
        return history.hotspots(flat, self.head).orderBy(F.desc("score"), "path")

    def coupling(self, weighted: bool = False) -> DataFrame:
        return history.order_coupling(history.coupling(self.changes, self.head, renames=self.renames), weighted)

    def coupling_for(self, path: str) -> DataFrame:
        return history.coupling_for(self.coupling(), path).orderBy(F.desc("degree"), F.desc("shared"), "partner")

    def authors(self) -> DataFrame:
        base = None
        if self.base:
            base = self._classified(git.tree(self.spark, self.repo, self.base), "content").select("path", "line_types")
        lines = self._with_authors().select("seq", "path", "author_id", "added", "removed", F.col("new_types").alias("line_types"), F.col("new_complexity").alias("complexity"))
        owned = history.survivors(blame.owned_lines(blame.replay(lines, base, self.renames)), self.head)
        who = self.log.groupBy("author_id").agg(F.first("author").alias("author"), F.first("email").alias("email"), F.max("when").alias("last_commit"))
        out = history.disambiguate(history.ownership(owned, blame.BEFORE).join(who, "author_id", "left"))
        return out.withColumn("author", F.coalesce("author", F.lit("(before window)"))).orderBy(F.col("author_id") == blame.BEFORE, F.desc("code"), "author")

    def report(self, observer: history.Observer) -> DataFrame:
        """A report of one's own over the same tables."""
        return observer.report(self.log, self._with_authors(), self.head)

    def author_timeline(self, buckets: int = 60) -> DataFrame:
        """author (told apart where several have one name), author_key, bucket, commits, delta."""
        delta = history.lines_of_type(F.col("added"), F.col("new_types"), 1) - history.lines_of_type(F.col("removed"), F.col("old_types"), 1)
        each = self._with_authors().groupBy("seq", "author_key", "when").agg(F.sum(delta).alias("delta"))
        series = history.dense(history.timeline(each, "author_key", "when", F.col("delta"), buckets), "author_key", buckets)
        who = history.disambiguate(self.log.groupBy("author_key").agg(F.first("author").alias("author"), F.first("email").alias("email")))
        return series.join(who.select("author_key", F.col("display").alias("author")), "author_key").select("author", "author_key", "bucket", "commits", "delta")

    def bus_factor(self) -> DataFrame:
        """One row: the fewest authors who have over half of the window's code."""
        return history.bus_factor(self.authors().where(F.col("author_id") != blame.BEFORE))

    def close(self) -> None:
        """Frees the tables that are kept."""
        for df in (self.log, self.changes, self.head):
            df.unpersist()

    def language_timeline(self, buckets: int = 60) -> DataFrame:
        delta = history.lines_of_type(F.col("added"), F.col("new_types"), 1) - history.lines_of_type(F.col("removed"), F.col("old_types"), 1)
        series = history.dense(history.timeline(self._with_authors(), "language", "when", delta, buckets), "language", buckets)
        base = None
        if self.base:
            tree_ = self._classified(git.tree(self.spark, self.repo, self.base), "content")
            base = tree_.groupBy("language").agg(F.sum("code").cast("long").alias("code"))
        return history.trajectory(series, "language", base)
