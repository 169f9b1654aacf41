"""The same rollups over streams of files and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linespan.functions import text
from linespan.operators import rollup
from linespan.plans import history


def with_counts(files: DataFrame) -> DataFrame:
    """A stream of text files (language, content) with lines, code, blank and bytes; no state is kept."""
    body = F.coalesce(F.col("content"), F.lit(""))
    return files.withColumns({"bytes": F.octet_length(body).cast("long"), "lines": text.line_count(body), "blank": text.blank_count(body), "comment": F.lit(0).cast("long"), "complexity": F.lit(0).cast("long")}).withColumn("code", F.col("lines") - F.col("blank"))


def summary(files: DataFrame, sink: str, name: str) -> StreamingQuery:
    """A running summary by language: its state is a row for each language."""
    return rollup.by_language(with_counts(files)).writeStream.outputMode("complete").format(sink).queryName(name).start()


def each_batch(files: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Counted files handed on batch by batch, row by row as a report that is streamed would have them."""
    return with_counts(files).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def activity(events: DataFrame, ts: str, who: str, slice_: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Commits of each author in slices of time; slices are given out once nothing as late as ``late`` can change them."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(F.window("_ts", slice_).alias("slice"), F.col(who)).agg(F.count(F.lit(1)).alias("commits"))


def observe(changes: DataFrame, sink: str, name: str, checkpoint: str = "") -> StreamingQuery:
    """Takes in a stream of changes (seq, path, author_key, lines_changed, code_churn, comment_churn) as commits come. Its
    state is a row for each path and author, sums alone, so authors need not be gathered to be counted."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("lines_changed", "code_churn", "comment_churn")]
    seen = changes.groupBy("path", "author_key").agg(F.count(F.lit(1)).alias("commits"), *sums)
    out = seen.writeStream.outputMode("complete").format(sink).queryName(name)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def finalise(observed: DataFrame, head: DataFrame) -> DataFrame:
    """The hotspots of what was observed so far, as ``history.hotspots`` has them of all changes at once."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("commits", "lines_changed", "code_churn", "comment_churn")]
    return history.scored(observed.groupBy("path").agg(*sums, F.count("author_key").alias("authors")), head)
