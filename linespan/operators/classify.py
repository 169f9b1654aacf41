"""Counts lines of code, comment and blank of a file, its branches, and how deep they are nested.

Spark hands contents over in Arrow batches. In each file a regular expression made from the language's rules jumps from
one token that matters to the next, so plain stretches cost nothing, and Python only handles tokens and line ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linespan.rules import BUILT_IN, UNKNOWN, Rule, table

BLANK, CODE, COMMENT = 0, 1, 2
#: Bytes in which a NUL makes a file binary.
BINARY_BYTES = 10_000
_WHITE = b" \t\n\r"
_NAME = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


@dataclass
class Stats:
    lines: int = 0
    code: int = 0
    comment: int = 0
    blank: int = 0
    complexity: int = 0
    cognitive: int = 0
    binary: bool = False
    line_types: list[int] = field(default_factory=list)
    complexity_line: list[int] = field(default_factory=list)
    cognitive_line: list[int] = field(default_factory=list)
    #: A class for each byte (blank, code, comment, or 3 for a string), if asked for.
    byte_types: bytearray | None = None


class Matcher:
    """The tokens of a language.

    A token is looked up by following bytes as far as any token goes. Where that ends inside a longer token, a shorter
    one that was passed counts only if it has a closing delimiter. So the expression holds all tokens, and those
    beginnings of tokens that hide a shorter one.
    """

    def __init__(self, rule: Rule, complexity: bool = True):
        self.rule = rule
        tokens: dict[bytes, tuple[str, bytes, object]] = {}
        if complexity:
            tokens |= {t.encode(): ("branch", b"", None) for t in rule.complexity_checks}
            tokens |= {t.encode(): ("postfix", b"", None) for t in rule.complexity_checks_postfix}
        tokens |= {t.encode(): ("line", b"", None) for t in rule.line_comment}
        tokens |= {a.encode(): ("multi", b.encode(), None) for a, b in rule.multi_line}
        tokens |= {q.start.encode(): ("quote", q.end.encode(), q) for q in rule.quotes}
        self.found: dict[bytes, tuple[bytes, tuple[str, bytes, object]] | None] = {t: (t, v) for t, v in tokens.items()}
        for t in tokens:
            for n in range(1, len(t)):
                if t[:n] not in tokens and (shorter := [t[:k] for k in range(1, n) if t[:k] in tokens]):
                    closing = [s for s in shorter if tokens[s][1]]
                    self.found[t[:n]] = (closing[-1], tokens[closing[-1]]) if closing else None
        either = lambda parts: b"|".join(re.escape(p) for p in sorted(parts, key=len, reverse=True))
        self.code = re.compile(b"\n|\0" + (b"|" + either(self.found) if self.found else b""))
        self.excludes = [re.compile(rb"\s*".join(re.escape(bytes([c])) for c in x.encode()) + rb"(?![A-Za-z0-9_])") for x in rule.complexity_checks_postfix_excludes]
        opens = [a.encode() for a, _ in rule.multi_line] if rule.nested_multi_line else []
        self.closers = {b.encode(): a.encode() for a, b in rule.multi_line}
        self.comments = {end: re.compile(b"\n|" + either([end, *opens])) for end in self.closers}
        self.opens = {a.encode(): b.encode() for a, b in rule.multi_line}
        self.strings = {(q.end, q.ignore_escape): re.compile((b"" if q.ignore_escape else rb"\\[^\n]|") + b"\n|" + re.escape(q.end.encode())) for q in rule.quotes}


@lru_cache(maxsize=512)
def matcher(rule: Rule, complexity: bool) -> Matcher:
    return Matcher(rule, complexity)


class _Count:
    """One pass over one file."""

    def __init__(self, data: bytes, m: Matcher, bytes_too: bool, on_line: Callable[[int, int], bool] | None, most: int | None):
        self.data, self.m, self.on_line, self.most = data, m, on_line, most
        self.out = Stats(byte_types=bytearray(len(data)) if bytes_too else None)
        self.code = self.comment = self.inside = self.text = False
        self.ticks = self.deep = 0
        self.start = 0
        self.indents: list[int] = []
        self.stop = False

    def end_line(self, at: int) -> None:
        """Closes the line that ends before ``at``."""
        kind = CODE if self.code else COMMENT if self.comment or self.inside else BLANK
        o = self.out
        o.lines += 1
        o.code += kind == CODE
        o.comment += kind == COMMENT
        o.blank += kind == BLANK
        o.line_types.append(kind)
        o.complexity_line.append(self.ticks)
        o.cognitive_line.append(self.deep)
        self.code, self.comment, self.ticks, self.deep, self.start = self.text, False, 0, 0, at + 1
        if (self.on_line and not self.on_line(o.lines, kind)) or (self.most is not None and o.lines >= self.most):
            self.stop = True

    def mark(self, a: int, b: int, kind: int) -> None:
        if self.out.byte_types is not None:
            self.out.byte_types[a:b] = bytes([kind]) * (b - a)

    def first_code(self, at: int) -> None:
        """The first code of a line tells how deep it stands."""
        if not self.code:
            self.code = True
            indent = at - self.start
            while self.indents and indent < self.indents[-1]:
                self.indents.pop()
            if not self.indents or indent > self.indents[-1]:
                self.indents.append(indent)

    def tick(self) -> None:
        n = 1 + max(0, len(self.indents) - 1)
        self.out.complexity += 1
        self.out.cognitive += n
        self.ticks += 1
        self.deep += n

    def plain(self, a: int, b: int) -> None:
        part = self.data[a:b]
        if rest := part.lstrip(_WHITE):
            self.first_code(b - len(rest))
            self.mark(a, b, CODE)

    def run(self) -> Stats:
        data, end = self.data, len(self.data)
        at = 3 if data[:3] == b"\xef\xbb\xbf" else 0
        self.start = at
        while at < end and not self.stop:
            m = self.m.code.search(data, at)
            if m is None:
                self.plain(at, end)
                at = end
                break
            self.plain(at, m.start())
            token, here = m.group(), m.start()
            at = m.end()
            if token == b"\n":
                self.end_line(here)
                continue
            if token == b"\0":
                if here < BINARY_BYTES:
                    self.out.binary = True
                    return self.out
                self.plain(here, at)
                continue
            found = self.m.found[token]
            if found is None:
                self.first_code(here)
                at = here + 1
                continue
            token, (kind, close, more) = found
            at = here + len(token)
            if kind == "line":
                self.comment = True
                at = data.find(b"\n", at)
                at = end if at < 0 else at
                self.mark(here, at, COMMENT)
            elif kind == "multi":
                at = self.in_comment(here, at, close)
            elif kind == "quote":
                at = self.in_quote(here, at, close, more)
            elif kind == "branch":
                if not self.code or here == 0 or data[here - 1] not in _NAME:
                    self.first_code(here)
                    self.tick()
                else:
                    at = here + 1
                self.mark(here, at, CODE)
            else:
                at = here + 1
                if self.code and not any(x.match(data, here) for x in self.m.excludes):
                    self.tick()
                    at = here + len(token)
                self.first_code(here)
                self.mark(here, at, CODE)
        if self.start < end and not self.stop:
            self.end_line(end)
        return self.out

    def in_comment(self, here: int, at: int, close: bytes) -> int:
        """From an opened comment to behind its end."""
        self.comment = self.inside = True
        open_ = [close]
        while open_ and not self.stop:
            m = self.m.comments[open_[-1]].search(self.data, at)
            if m is None:
                at = len(self.data)
                break
            at = m.end()
            if m.group() == b"\n":
                self.end_line(m.start())
                self.comment = True if self.stop else self.comment
            elif m.group() == open_[-1]:
                open_.pop()
                self.comment = True
            else:
                open_.append(self.m.opens[m.group()])
        self.inside = bool(open_)
        self.mark(here, at, COMMENT)
        return at

    def in_quote(self, here: int, at: int, close: bytes, quote) -> int:
        """From an opened string to behind its end; a docstring is one if its line has no code before it."""
        data = self.data
        if self.code and here and data[here - 1] == 0x5C:
            return here + 1
        doc = quote.doc_string and not self.code
        if doc:
            self.inside = True
        else:
            self.first_code(here)
            self.text = True
        while not self.stop:
            m = self.m.strings[quote.end, quote.ignore_escape].search(data, at)
            if m is None:
                at = len(data)
                break
            at = m.end()
            if m.group() == b"\n":
                self.end_line(m.start())
            elif m.group() == close:
                if doc:
                    self.inside, self.comment = False, True
                    rest = data.find(b"\n", at)
                    # at the very end of a file it is a comment, with blanks behind it there it is code
                    if (rest < 0 and at < len(data)) or data[at : max(rest, at)].strip(_WHITE):
                        self.code = True
                break
        if not self.stop and m is not None:
            self.text = False
        self.mark(here, at, COMMENT if doc else 3)
        return at


def count(content: bytes, rule: Rule, complexity: bool = True, bytes_too: bool = False, on_line: Callable[[int, int], bool] | None = None, most: int | None = None) -> Stats:
    """Counts one file. ``on_line(number, class)`` is called for each line and ends the count by returning False;
    ``most`` ends it at so many lines."""
    return _Count(content, matcher(rule, complexity), bytes_too, on_line, most).run()


def mask(content: bytes, types: bytes, keep: set[int]) -> bytes:
    """``content`` with all bytes but newlines and those of the classes to keep turned into blanks."""
    data, kind = np.frombuffer(content, np.uint8), np.frombuffer(types, np.uint8)
    return np.where((data == 10) | np.isin(kind, list(keep)), data, 32).astype(np.uint8).tobytes()


def code_bytes(content: bytes, types: bytes) -> bytes:
    """The bytes of code alone."""
    return np.frombuffer(content, np.uint8)[np.frombuffer(types, np.uint8) == CODE].tobytes()


_COLUMNS = (
    ("lines", pa.int64()), ("code", pa.int64()), ("comment", pa.int64()), ("blank", pa.int64()), ("complexity", pa.int64()), ("cognitive", pa.int64()), ("binary", pa.bool_()),
    ("line_types", pa.list_(pa.int32())), ("complexity_line", pa.list_(pa.int32())), ("cognitive_line", pa.list_(pa.int32())),
)
_SQL = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>"}


def count_files(files: DataFrame, rules: dict[str, Rule] | None = None, complexity: bool = True, per_line: bool = False, code_hash: bool = False, most: int | None = None) -> DataFrame:
    """``files`` (language and content, a string or binary) with the counts of each file.

    ``per_line`` adds a class and branches for every line, ``code_hash`` the hash over the bytes of code. Null content is
    the empty file; a language without rules is counted as text. Filter by name and size first: nothing is pushed below
    a Python stage.
    """
    rules = dict(rules or table(BUILT_IN))
    columns = [c for c in _COLUMNS if per_line or not c[0].endswith(("line", "types"))] + [("code_hash", pa.binary())] * code_hash
    keep = files.drop(*[c for c, _ in columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + "".join(f", {n} {_SQL.get(t, 'binary')}" for n, t in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n, _ in columns}
            for language, content in zip(b.column("language").to_pylist(), b.column("content").to_pylist(), strict=True):
                data = content.encode() if isinstance(content, str) else content or b""
                s = count(data, rules.get(language, UNKNOWN), complexity, bytes_too=code_hash, most=most)
                for n in out:
                    if n == "code_hash":
                        out[n].append(hashlib.blake2b(code_bytes(data, s.byte_types or b""), digest_size=32).digest())
                    else:
                        out[n].append(getattr(s, n))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(out[n], t) for n, t in columns)], names=[*b.schema.names, *out])

    return keep.mapInArrow(run, schema)


def classify_lines(files: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """A row for each line: the columns of ``files`` but content, line_no from 1, line_type (0 blank, 1 code, 2 comment)."""
    counted = count_files(files, rules, per_line=True)
    own = [c for c in files.columns if c != "content"]
    return counted.select(*own, F.posexplode("line_types").alias("_at", "line_type")).select(*own, (F.col("_at") + 1).alias("line_no"), "line_type")
