"""Rollups of counted files: by language, in all, as shares, sorted, and the largest files of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ["bytes", "lines", "code", "comment", "blank", "complexity", "cognitive"]
#: Names that sort orders go by; name and language are ascending, all others descending.
SORTS = {"name": "language", "names": "language", "language": "language", "line": "lines", "lines": "lines", "blank": "blank", "blanks": "blank", "code": "code", "codes": "code", "comment": "comment", "comments": "comment", "complexity": "complexity", "complexitys": "complexity", "comp": "complexity", "cognitive": "cognitive", "cog": "cognitive", "byte": "bytes", "bytes": "bytes", "count": "files", "files": "files"}


def _sums(df: DataFrame) -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in SUMS if c in df.columns]


def by_language(files: DataFrame, keep_files: bool = False) -> DataFrame:
    """A row for each language: files and the sums of what is counted. ``keep_files`` adds the list of its locations, for
    outputs that are known to be small."""
    more = [F.sort_array(F.collect_list("location")).alias("locations")] if keep_files else []
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), *_sums(files), *more)


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(_sums(files), [c for c in SUMS if c in files.columns], strict=True)])


def share(x: Column, of: Column) -> Column:
    return F.when(of != 0, x / of * 100).otherwise(0.0)


def percentages(summary: DataFrame) -> DataFrame:
    """Each figure of a summary with its share of the total in per cent. Summaries have a row for each language, so one
    task may add them up."""
    figures = [c for c in ["files", *SUMS] if c in summary.columns]
    whole = Window.partitionBy()
    return summary.select("*", *[share(F.col(c), F.sum(c).over(whole)).alias(f"{c}_percent") for c in figures])


def weighted_complexity(complexity: Column, code: Column) -> Column:
    return F.when(code != 0, complexity / code * 100).otherwise(0.0)


def sort_languages(summary: DataFrame, by: str = "count") -> DataFrame:
    key = SORTS.get(by, "files") if by != "comp" else "files"
    return summary.orderBy("language") if key == "language" else summary.orderBy(F.desc(key), "language")


def sort_files(files: DataFrame, by: str = "lines") -> DataFrame:
    """By location, or by a figure with location to break ties."""
    key = SORTS.get(by, "lines")
    if by in ("name", "names"):
        return files.orderBy("location")
    return files.orderBy("language", "location") if key == "language" else files.orderBy(F.desc("lines" if key == "files" else key), "location")


#: Sort orders of the CSV of files that go by a figure, the largest first; languages go by name, all others by filename.
CSV_SORTS = {"line": "lines", "lines": "lines", "blank": "blank", "blanks": "blank", "code": "code", "codes": "code", "comment": "comment", "comments": "comment", "complexity": "complexity", "complexitys": "complexity", "cognitive": "cognitive", "cognitives": "cognitive", "byte": "bytes", "bytes": "bytes"}


def sort_csv_files(files: DataFrame, by: str = "files", cognitive: bool = False) -> DataFrame:
    """By filename unless something else is asked for; ties go by location. Complexity is the cognitive one where that
    is shown, and there is no order by it where it isn't."""
    key = CSV_SORTS.get(by)
    if by in ("language", "languages", "lang", "langs"):
        return files.orderBy("language", "location")
    if key is None or (key == "cognitive" and not cognitive):
        return files.orderBy("filename", "location")
    return files.orderBy(F.desc("cognitive" if key == "complexity" and cognitive else key), "location")


def top_files(files: DataFrame, each: int = 10, by: str = "lines") -> DataFrame:
    """The first ``each`` files of every language, with their rank. A rank with a limit is cut in every partition before
    the shuffle, so a large language costs no more than ``each`` rows of each partition."""
    key = SORTS.get(by, "lines")
    order = Window.partitionBy("language").orderBy(F.desc(key), "location")
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)


def drop_in_order(files: DataFrame, dedup: bool = False, no_min: bool = False, no_gen: bool = False, max_lines: int | None = None, keep_binary: bool = False) -> DataFrame:
    """Drops in a fixed order: duplicates, then minified, generated, long and binary files; so a file that is dropped
    later still takes its place among duplicates."""
    if dedup:
        files = drop_duplicates(files)
    if no_min:
        files = files.where(~F.col("minified"))
    if no_gen:
        files = files.where(~F.col("generated"))
    if max_lines is not None:
        files = files.where(F.col("lines") < max_lines)
    return files if keep_binary else files.where(~F.col("binary"))


def drop_duplicates(files: DataFrame, key: str = "content_hash") -> DataFrame:
    """Of files with equal size and hash the one of the smallest location. The smallest is found by an aggregate, which
    is reduced before the shuffle, and joined back: no group of copies has to fit into a task."""
    first = files.groupBy(F.col("bytes").alias("_bytes"), F.col(key).alias("_key")).agg(F.min("location").alias("_first"))
    return files.join(first, (F.col("bytes") == F.col("_bytes")) & F.col(key).eqNullSafe(F.col("_key")) & (F.col("location") == F.col("_first")), "left_semi")


def unique_lines(files: DataFrame, by: list[str]) -> DataFrame:
    """How many different lines there are in each group (none: in all). Lines are made unique in each file and counted
    by a 128-bit hash, so no line is shuffled whole."""
    from linespan.functions.text import unique_line_array

    lines = files.select(*by, F.explode(unique_line_array(F.col("content"))).alias("line"))
    marks = lines.select(*by, F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b"))
    unique = marks.distinct()
    return (unique.groupBy(*by) if by else unique.groupBy()).agg(F.count(F.lit(1)).alias("uloc"))


#: Where the buckets of line lengths begin.
LENGTH_EDGES = (0, 20, 40, 60, 80, 100, 120)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Lines in each bucket of length; buckets without lines are there too. ``lengths`` has a column length."""
    last = len(LENGTH_EDGES) - 1
    counted = lengths.groupBy(F.least(F.floor(F.col("length") / 20), F.lit(last)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = lengths.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bucket"), (F.col("id") * 20).cast("int").alias("low"))
    return every.join(F.broadcast(counted), "bucket", "left").select("bucket", "low", F.coalesce("n", F.lit(0)).alias("lines"))
