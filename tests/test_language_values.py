"""Small files in many languages: how their lines are classed by the values of the package."""

import pytest

from linespan.operators import classify
from linespan.rules import BUILT_IN, table

RULES = table()
#: language, content, lines, code, comment, blank
CASES = [
    ("Python", '"""\nsays hello\n"""', 3, 0, 3, 0),
    ("Python", '"""\nsays hello\n"""  ', 3, 1, 2, 0),
    ("Python", '"""\nsays hello\n"""\nx = 1\n', 4, 1, 3, 0),
    ("Python", "y = 2\n'''", 2, 1, 1, 0),
    ("Python", 'x = """not a docstring\n# nor a comment\n"""\n', 3, 3, 0, 0),
    ("C++", 'int f() {\n  auto s = R"(a " quote)";\n\n  // said\n}', 5, 3, 1, 1),
    ("Rust", 'fn f() {\n  let s = r#"a " and /* open"#;\n  // said\n}', 4, 3, 1, 0),
    ("Rust", "/* a /* b */ still\n*/ fn f() {}\n", 2, 1, 1, 0),
    ("Go", "func f() {\n\tc := '\"'\n\t/* one\n\t   two */\n}", 5, 3, 2, 0),
    ("Java", "class A {\n  char c = '\"';\n  /* one\n  two */\n}", 5, 3, 2, 0),
    ("C#", "class A {\n  char c = '\"';\n  // said\n}", 4, 3, 1, 0),
    ("Lua", "s = [[\n-- text\n]]\n-- said\n", 4, 3, 1, 0),
    ("Lua", "--[[\nsaid\n]]\nx = 1", 4, 1, 3, 0),
    ("Protocol Buffers", 'option (d) = "a /* b";\nmessage A {\n}', 3, 3, 0, 0),
    ("Terraform", 'a {\n  b = "x/*"\n}\n# said\n', 4, 3, 1, 0),
    ("MATLAB", "%{\nsaid\n%}\nx = 1;", 4, 1, 3, 0),
    ("Racket", "#|\nouter #| inner |# outer\n|#\n(f 1)", 4, 1, 3, 0),
    ("Pascal", "{ said }\nbegin\nend.", 3, 2, 1, 0),
    ("Haskell", "{- a -}\nmain = f\n-- said", 3, 1, 2, 0),
    ("SQL", "-- said\nSELECT 1;\n", 2, 1, 1, 0),
    ("CSS", "/* said */\na { }\n", 2, 1, 1, 0),
    ("HTML", "<!-- said\n-->\n<p>\n", 3, 1, 2, 0),
    ("YAML", "# said\na: 1\n", 2, 1, 1, 0),
    ("Elm", "-- said\nx = 1\n", 2, 1, 1, 0),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_lines(case):
    language, content, *want = case
    s = classify.count(content.encode(), RULES[language])
    assert [s.lines, s.code, s.comment, s.blank] == want


@pytest.mark.parametrize(
    ("language", "content", "want"),
    [("Java", "try {\n} finally {\n}\n", 2), ("C", "if (a) {\n}else{\n}\n", 2), ("Python", "if a:\n  pass\nelse:\n  pass\n", 2), ("Go", "for {\n if a && b {\n }\n}\n", 3), ("JavaScript", "x = a ? b : c;\nif (x) {}\n", 1)],
)
def test_branches(language, content, want):
    assert classify.count(content.encode(), RULES[language]).complexity == want


def test_masks():
    content = b"x = 1 // a\n\ny"
    types = bytes([1] * 6 + [2] * 4 + [0, 0, 1])
    assert classify.mask(content, types, {1}) == b"x = 1     \n\ny" and classify.code_bytes(content, types) == b"x = 1 y" and classify.mask(b"", b"", {1}) == b""


def test_table():
    assert len(BUILT_IN) == len(RULES) >= 149 and [r.name for r in BUILT_IN] == sorted(RULES)
    assert all(r.extensions or r.filenames for r in BUILT_IN) and not RULES["TypeScript"].keywords
