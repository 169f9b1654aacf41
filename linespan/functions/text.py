"""Column functions over file contents. Sizes are bytes, never characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r"


def lines(content: Column) -> Column:
    """The lines of a text without their newlines; a final newline ends the last line, so '' has none and 'a\\n' one."""
    content = F.coalesce(content, F.lit(""))
    parts = F.split(content, "\n", -1)
    ended = (content == "") | F.endswith(content, F.lit("\n"))
    return F.slice(parts, 1, F.size(parts) - F.when(ended, 1).otherwise(0))


def line_count(content: Column) -> Column:
    content = F.coalesce(content, F.lit(""))
    newlines = F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit("")))
    return (newlines + F.when((content == "") | F.endswith(content, F.lit("\n")), 0).otherwise(1)).cast("long")


def blank_count(content: Column) -> Column:
    """Lines of nothing but spaces, tabs and carriage returns."""
    return F.size(F.filter(lines(content), lambda x: F.btrim(x, F.lit(BLANKS)) == "")).cast("long")


def unique_line_array(content: Column) -> Column:
    """Different lines of a file as counted by ULOC: final newlines go first, an empty file has one empty line, and
    blank lines, comments and carriage returns count."""
    return F.array_distinct(F.split(F.rtrim(F.coalesce(content, F.lit("")), F.lit("\n")), "\n", -1))


def line_lengths(content: Column) -> Column:
    """Bytes of each line, final newlines removed."""
    return F.transform(F.split(F.rtrim(F.coalesce(content, F.lit("")), F.lit("\n")), "\n", -1), lambda x: F.octet_length(x))


def extension(filename: Column) -> Column:
    """Lower case; the last two dotted parts if there are two (a.d.ts: d.ts), the whole name without a dot or with a
    leading one only."""
    name = F.lower(filename)
    stem = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    last, two = F.regexp_extract(name, r"\.([^.]*)$", 1), F.regexp_extract(name, r"([^.]*\.[^.]*)$", 1)
    return F.when(stem == "", name).when(F.contains(stem, F.lit(".")), two).otherwise(last)


def directory(location: Column) -> Column:
    """Everything up to and with the last slash."""
    return F.regexp_extract(location, r"^(.*/)", 1)


def minified(size: Column, line_total: Column, generated: Column, limit: int = 255) -> Column:
    """Whole bytes for each line reach ``limit``; never for generated files or files without lines."""
    return F.coalesce((line_total > 0) & ~generated & (F.floor(size / line_total) >= limit), F.lit(False))


#: What marks a generated file if no other markers are given.
GENERATED_MARKERS = ["do not edit", "<auto-generated />"]


def generated(content: Column, markers: list[str] | None = None) -> Column:
    """A marker stands in the first 1000 bytes, in any case."""
    head = F.lower(F.substring(F.coalesce(content, F.lit("")).cast("binary"), 1, 1000).cast("string"))
    out = F.lit(False)
    for m in GENERATED_MARKERS if markers is None else markers:
        out = out | F.contains(head, F.lit(m.lower()))
    return out


def email_domain(email: Column) -> Column:
    """Lower case, '' without an at sign."""
    return F.when(F.contains(email, F.lit("@")), F.lower(F.substring_index(email, "@", -1))).otherwise("")


def registrable_domain(domain: Column) -> Column:
    """The last two labels."""
    return F.substring_index(domain, ".", -2)


def sql_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\0"), F.lit("")), F.lit("'"), F.lit("''"))


def label_escape(text: Column) -> Column:
    """For labels of OpenMetrics."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def round1(x: Column) -> Column:
    """One decimal, halves up (for numbers from 0 up)."""
    return F.floor(x * 10 + 0.5) / 10
