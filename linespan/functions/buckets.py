"""A fixed number of equal slices of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bucket(ts: Column, start: Column, end: Column, n: int) -> Column:
    """The slice of a time in [start, end], from 0 to n - 1; times outside go to the first or last; all to 0 if the
    window is shorter than n microseconds. start and end are microseconds."""
    width = F.floor((end - start) / n).cast("long")
    at = F.floor((micros(ts) - start) / F.when(width > 0, width))
    return F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(n - 1), at))).otherwise(0).cast("int")


def bucket_start(i: Column, start: Column, end: Column, n: int) -> Column:
    return start + i * F.floor((end - start) / n).cast("long")
