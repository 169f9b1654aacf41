import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linespan.operators.classify import CODE, COMMENT, count, count_files, classify_lines, mask
from linespan.rules import Quote, Rule, table

R = table()


def figures(text, language):
    s = count(text.encode(), R[language])
    return s.lines, s.code, s.comment, s.blank


@pytest.mark.parametrize(("text", "lines"), [("", 0), ("a", 1), ("a\n", 1), ("1\n2\n", 2), ("1\n2\n3", 3), ("\n", 1), ("\n\n", 2)])
def test_lines(text, lines):
    assert count(text.encode(), R["Plain Text"]).lines == lines


@pytest.mark.parametrize(
    ("language", "text", "expected"),
    [
        ("Java", "/* a\n\n b */\nclass A { // x\n  // y\n\n  String s = \"/* no */\";\n}\n", (8, 3, 4, 1)),
        ("Python", '"""doc\n\nmore"""\nx = """a\n\nb"""\n# c\n', (7, 3, 4, 0)),
        ("Python", '"""doc""" + x\n', (1, 1, 0, 0)),
        ("Rust", "/* a /* b */ c\nd */\nfn x() {}\n", (3, 1, 2, 0)),
        ("Java", "/* a /* b */ c();\n", (1, 1, 0, 0)),
        ("HTML", "<p>\n<!-- a\nb -->\n</p>\n", (4, 2, 2, 0)),
        ("Go", "x := `a\n// b\n`\n", (3, 3, 0, 0)),
        ("C", 'char *a = "\\"// no";\n// yes\n', (2, 1, 1, 0)),
        ("Lua", "--[ x\n-- y\n--[[ z\n\n]]\n", (5, 1, 4, 0)),
        ("C", "a = 1; /* x\n*/ b\n", (2, 2, 0, 0)),
        ("Plain Text", "a\r\n \t\r\n", (2, 1, 0, 1)),
    ],
)
def test_figures(language, text, expected):
    assert figures(text, language) == expected


def test_complexity_flat_and_nested():
    flat = "func a() {\n\tif a {\n\t}\n\tif b {\n\t}\n\tif c {\n\t}\n}\n"
    deep = "func a() {\n\tif a {\n\t\tif b {\n\t\t\tif c {\n\t\t\t}\n\t\t}\n\t}\n}\n"
    assert [(s.complexity, s.cognitive) for s in (count(x.encode(), R["Go"]) for x in (flat, deep))] == [(3, 6), (3, 9)]
    assert count(b"xif (a) {}\n", R["Go"]).complexity == 0
    assert count(flat.encode(), R["Go"], complexity=False).complexity == 0


def test_postfix_and_its_excludes():
    assert count(b"let a = b()?;\n", R["Rust"]).complexity == 1
    assert count(b"fn f<T: ?Sized>() {}\n", R["Rust"]).complexity == 0
    assert count(b"let a = b?.c ?? d;\n", R["TypeScript"]).complexity == 2


def test_binary_only_in_code():
    assert count(b"a\0b", R["C"]).binary
    assert not count(b"/* a\0b */", R["C"]).binary
    assert not count(b"x" * 10_000 + b"\0", R["C"]).binary


def test_bom_early_stop_and_callback():
    assert count(b"\xef\xbb\xbf// a\n", R["C"]).comment == 1
    assert count(b"a\n" * 50, R["C"], most=10).lines == 10
    seen = []
    count(b"a\n\nb\n", R["C"], on_line=lambda n, kind: seen.append((n, kind)) or n < 2)
    assert seen == [(1, 1), (2, 0)]


def test_mask_keeps_what_is_asked_for():
    data = b"a /* b */\n// c\n"
    s = count(data, R["C"], bytes_too=True)
    assert mask(data, bytes(s.byte_types), {CODE}).split() == [b"a"]
    assert mask(data, bytes(s.byte_types), {COMMENT}).split() == [b"/*", b"b", b"*/", b"//", b"c"]
    assert mask(data, bytes(s.byte_types), {CODE}).count(b"\n") == 2


def naive(data: bytes, rule: Rule):
    """Line classes by looking at every byte in turn."""
    out, state, code, comment, i = [], None, False, False, 0
    while i <= len(data):
        if i == len(data) or data[i : i + 1] == b"\n":
            if i < len(data) or (data and not data.endswith(b"\n")):
                out.append(1 if code else 2 if comment or state == "*/" else 0)
            code, comment = state == '"', False
            state = None if state == "line" else state
            i += 1
        elif state == "line":
            i += 1
        elif state == "*/":
            comment = True
            if data[i : i + 2] == b"*/":
                state, i = None, i + 2
            else:
                i += 1
        elif state == '"':
            if data[i : i + 1] == b"\\" and data[i + 1 : i + 2] not in (b"\n", b""):
                i += 2
            else:
                state = None if data[i : i + 1] == b'"' else state
                i += 1
        elif data[i : i + 2] == b"//":
            state, comment = "line", True
        elif data[i : i + 2] == b"/*":
            state, comment, i = "*/", True, i + 2
        else:
            if data[i : i + 1] == b'"' and not (code and i and data[i - 1 : i] == b"\\"):
                state = '"'
            if data[i : i + 1].strip():
                code = True
            i += 1
    return out


SIMPLE = Rule("Simple", line_comment=("//",), multi_line=(("/*", "*/"),), quotes=(Quote('"', '"'),))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='ab/*" \n\\', max_size=40))
def test_against_byte_by_byte(text):
    assert count(text.encode(), SIMPLE).line_types == naive(text.encode(), SIMPLE)


def test_tables(spark):
    rows = [("a", "C", "a;\n// b\n"), ("b", "nothing", "x\n\n"), ("c", "C", None)]
    df = spark.createDataFrame(rows, "location string, language string, content string")
    got = {r.location: (r.lines, r.code, r.comment, r.blank) for r in count_files(df).collect()}
    assert got == {"a": (2, 1, 1, 0), "b": (2, 1, 0, 1), "c": (0, 0, 0, 0)}
    assert [(r.location, r.line_no, r.line_type) for r in classify_lines(df).orderBy("location", "line_no").collect()] == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 0)]
    hashes = {r.location: r.code_hash for r in count_files(df, code_hash=True).collect()}
    assert hashes["a"] != hashes["b"] and len(hashes["a"]) == 32
