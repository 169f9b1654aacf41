"""Which language a file is in: by name, by first line, by content."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linespan.functions.text import extension
from linespan.rules import BUILT_IN, SHEBANG, Rule, table

#: How much of a content is looked at.
HEURISTIC_BYTES, SHEBANG_BYTES, REMAP_BYTES = 20_000, 200, 1_000


def extension_of(name: str) -> str:
    """The last two dotted parts, or the whole name without a dot or with none but a leading one."""
    name = name.lower()
    last = name.rfind(".")
    if last <= 0:
        return name
    stem = name[:last]
    second = stem.rfind(".")
    return (stem[second:] + name[last:] if second >= 0 else name[last:]).removeprefix(".")


class Names:
    """Look-ups by name, made from rules; ``count_as`` maps extensions to a language or to another extension's."""

    def __init__(self, rules: dict[str, Rule] | None = None, count_as: dict[str, str] | None = None):
        self.rules = dict(rules or table(BUILT_IN))
        self.extensions: dict[str, list[str]] = {}
        self.filenames: dict[str, str] = {}
        for r in self.rules.values():
            for e in r.extensions:
                self.extensions.setdefault(e, []).append(r.name)
            for f in r.filenames:
                self.filenames[f] = r.name
        for own in self.extensions.values():
            own.sort()
        by_name = {n.lower(): n for n in self.rules}
        for e, target in (count_as or {}).items():
            if target.lower() in by_name:
                self.extensions[e.lower()] = [by_name[target.lower()]]
            elif target.lower() in self.extensions:
                self.extensions[e.lower()] = self.extensions[target.lower()]

    def candidates(self, name: str, only_extensions: bool = False) -> tuple[list[str], str]:
        """Possible languages of a file name and the extension that decided; ['#!'] if its first line has to."""
        low = name.lower()
        if not only_extensions:
            if low in self.filenames:
                return [self.filenames[low]], name
            if "." not in name or (name.startswith(".") and name.count(".") == 1):
                return [SHEBANG], name
        if low in self.extensions:
            return self.extensions[low], ""
        ext = extension_of(name)
        if ext in self.extensions:
            return self.extensions[ext], ext
        ext = extension_of(ext)
        return self.extensions.get(ext, []), ext


def shebang_command(line: Column) -> Column:
    """The command of a first line ``#! /path/command`` or ``#! /path/env command``; '' if there is none."""
    path = F.regexp_extract(line, r"^#![^/\n]*(/\S*)", 1)
    first = F.regexp_extract(path, r"([^/]*)$", 1)
    second = F.regexp_extract(line, r"^#![^/\n]*/\S*[ \t\r]+(\S+)", 1)
    return F.when(first == "env", second).otherwise(first)


def shebang_languages(rules: dict[str, Rule]) -> dict[str, str]:
    return {c: r.name for r in rules.values() for c in r.shebangs}


def _any_of(literals: tuple[str, ...], anchored: bool) -> str:
    either = "|".join(re.escape(x) for x in literals)
    return rf"(?m)^[ \t]*(?:{either})" if anchored else either


def _scored(rule: Rule, content: Column) -> Column:
    """How many heuristics of a rule match; a pattern is only tried if one of its literals is there."""
    score = F.lit(0)
    for h in rule.heuristics:
        hit = content.rlike(h.pattern)
        if h.literals:
            hit = F.when(content.rlike(_any_of(h.literals, h.anchored)), hit).otherwise(F.lit(False))
        score = score + hit.cast("int")
    return score


def _best(scored: list[tuple[str, Column]]) -> Column:
    """struct(score, turn, name) of the highest score, of equal ones the first; each score stands in it once."""
    return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("turn"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scored)]))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def resolve(candidates: Iterable[str], rules: dict[str, Rule], content: Column) -> Column:
    """The language of a content among several: the one most of whose heuristics match, if any does; else by keywords.
    A language with neither is what the rest has to beat, by three keywords at least. Ties go by name."""
    names = sorted(candidates)
    if len(names) < 2:
        return F.lit(names[0] if names else None).cast("string")
    head = F.left(content, F.lit(HEURISTIC_BYTES))
    smart = [n for n in names if rules[n].heuristics]
    plain = [n for n in names if not rules[n].heuristics]
    primary = min((n for n in plain if not rules[n].keywords), default=None)

    def by_words(text: Column) -> Column:
        if not plain:
            return F.lit(names[0])
        keyed = _best([(n, sum((F.contains(text, F.lit(k)).cast("int") for k in dict.fromkeys(rules[n].keywords)), F.lit(0))) for n in plain])
        return _let(keyed, lambda x: F.when(x["score"] < 3, F.lit(primary)).otherwise(x["name"]) if primary is not None else x["name"])

    def judged(text: Column) -> Column:
        if not smart:
            return by_words(text)
        return _let(_best([(n, _scored(rules[n], text)) for n in smart]), lambda x: F.when(x["score"] > 0, x["name"]).otherwise(by_words(text)))

    return _let(head, judged)


def remap(language: Column, content: Column, rules: list[tuple[str, str]]) -> Column:
    """The language of the last rule (text, language) whose text is in the first 1000 bytes."""
    head = F.left(content, F.lit(REMAP_BYTES))
    for text, to in rules:
        language = F.when(F.contains(head, F.lit(text)), F.lit(to)).otherwise(language)
    return language


def glob_regex(glob: str) -> str:
    """An anchored expression: ** is anything, * anything but slashes, ? one character but a slash."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def parse_pattern(rule: str) -> tuple[str, str, str]:
    """(expression, name, base) of '[glob:|re:]pattern:name:base'."""
    engine, _, rest = rule.partition(":")
    if engine not in ("glob", "re"):
        engine, rest = "glob", rule
    pattern, name, base = rest.rsplit(":", 2)
    return (pattern if engine == "re" else glob_regex(pattern)), name, base


def detect(files: DataFrame, rules: dict[str, Rule] | None = None, count_as: dict[str, str] | None = None, patterns: list[str] | None = None, remap_all: list[tuple[str, str]] | None = None, remap_unknown: list[tuple[str, str]] | None = None, keep_unknown: bool = False, only_extensions: list[str] | None = None) -> DataFrame:
    """``files`` (location, filename, content) with language; those of no language are dropped, or kept as 'Unknown'.

    The tables of names come from the rules and are small; they are joined by broadcast. Contents are only looked at where
    a name leaves several languages, or none but a first line.
    """
    names = Names(rules, count_as)
    spark = files.sparkSession
    text = F.col("content").cast("string")
    files = with_candidates(spark, files, names, bool(only_extensions))
    if only_extensions:
        files = files.where(F.col("extension").isin(*only_extensions))
    commands = shebang_languages(names.rules)
    command = shebang_command(F.left(text, F.lit(SHEBANG_BYTES)))
    known = F.create_map(*[F.lit(x) for pair in sorted(commands.items()) for x in pair]) if commands else F.create_map().cast("map<string,string>")
    by_command = F.try_element_at(known, command)
    if remap_unknown:
        by_command = F.coalesce(remap(F.lit(None).cast("string"), text, remap_unknown), by_command)
    language = F.when(F.array_contains("candidates", SHEBANG), by_command)
    for several in sorted({tuple(v) for v in names.extensions.values() if len(v) > 1}):
        language = F.when(F.col("candidates") == F.array(*map(F.lit, several)), resolve(several, names.rules, text)).otherwise(language)
    language = F.when((F.size("candidates") == 1) & ~F.array_contains("candidates", SHEBANG), F.get("candidates", F.lit(0))).otherwise(language)
    if remap_all:
        language = remap(language, text, remap_all)
    for rule in reversed(patterns or []):
        expression, name, _ = parse_pattern(rule)
        language = F.when(F.col("location").rlike(expression), F.lit(name)).otherwise(language)
    out = files.withColumn("language", language).drop("candidates")
    return out.withColumn("language", F.coalesce("language", F.lit("Unknown"))) if keep_unknown else out.where(F.col("language").isNotNull())


def with_candidates(spark: SparkSession, files: DataFrame, names: Names, only_extensions: bool = False) -> DataFrame:
    """``files`` with candidates and extension, by joins with the tables of names."""
    low, ext = F.lower("filename"), extension(F.col("filename"))
    known = F.broadcast(spark.createDataFrame([(e, v) for e, v in names.extensions.items()], "_e string, _c array<string>"))
    special = F.broadcast(spark.createDataFrame([(f, [v]) for f, v in names.filenames.items()] or [("", [""])], "_f string, _c array<string>"))
    join = lambda df, key, out: df.join(known.select(F.col("_e").alias(f"_{out}"), F.col("_c").alias(out)), key == F.col(f"_{out}"), "left").drop(f"_{out}")
    df = files.withColumns({"_low": low, "_ext": ext, "_one": extension(ext)})
    df = df.join(special.select("_f", F.col("_c").alias("_special")), F.col("_low") == F.col("_f"), "left").drop("_f")
    for key, out in (("_low", "_c0"), ("_ext", "_c1"), ("_one", "_c2")):
        df = join(df, F.col(key), out)
    dotless = ~F.contains("_low", F.lit(".")) | (F.startswith("_low", F.lit(".")) & (F.length("_low") - F.length(F.replace("_low", F.lit("."), F.lit(""))) == 1))
    none = F.array().cast("array<string>")
    named = F.coalesce("_c0", "_c1", "_c2", none)
    whole = F.when(F.col("_special").isNotNull(), F.col("_special")).when(dotless, F.array(F.lit(SHEBANG))).otherwise(named)
    by = F.when(F.col("_c0").isNotNull(), F.lit("")).when(F.col("_c1").isNotNull(), F.col("_ext")).otherwise(F.col("_one"))
    decided = by if only_extensions else F.when(F.col("_special").isNotNull() | dotless, F.col("filename")).otherwise(by)
    return df.withColumns({"candidates": named if only_extensions else whole, "extension": decided}).drop("_low", "_ext", "_one", "_special", "_c0", "_c1", "_c2")
