from pyspark.sql import functions as F

from linespan.operators import detect
from linespan.rules import Heuristic, Rule, load, table


def test_names():
    n = detect.Names()
    assert n.candidates("a.go")[0] == ["Go"]
    assert n.candidates("Makefile")[0] == ["Makefile"]
    assert n.candidates("run") == ([detect.SHEBANG], "run")
    assert n.candidates("a.h")[0] == ["C Header", "C++ Header", "Objective C"]
    assert n.candidates("x.d.ts") == (["TypeScript Typings"], "d.ts")
    assert n.candidates("x.nothing")[0] == []
    assert detect.Names(count_as={"jsp": "html"}).candidates("a.jsp")[0] == ["HTML"]
    assert [detect.extension_of(x) for x in ("a.d.ts", "a.b.c.d", ".gitignore", "A", "a.", ".a.b")] == ["d.ts", "c.d", ".gitignore", "a", "", "a.b"]


def test_whole_files(spark):
    rows = [
        ("a.py", "x"), ("b.h", "int a;"), ("c.h", "template <class T>\nclass A {\npublic:\n};"), ("d.h", "@interface A\n@end"), ("e.json", "{}"),
        ("f.json", '"AWSTemplateFormatVersion" "AWS::S3" "Fn::Join"'), ("run", "#!/usr/bin/env  python3\n"), ("go", "#! /bin/bash -e\n"), ("nope", "text"), ("q.unknown", "x"), ("x.d.ts", "x"), (".gitignore", "*"), ("RAKEFILE", ""),
    ]
    df = spark.createDataFrame([(f"src/{n}", n, c) for n, c in rows], "location string, filename string, content string")
    got = {r.filename: r.language for r in detect.detect(df, keep_unknown=True).collect()}
    want = dict(zip([n for n, _ in rows], ["Python", "C Header", "C++ Header", "Objective C", "JSON", "CloudFormation (JSON)", "Python", "BASH", "Unknown", "Unknown", "TypeScript Typings", "gitignore", "Rakefile"], strict=True))
    assert got == want
    assert {r.filename for r in detect.detect(df).collect()} == {n for n, v in want.items() if v != "Unknown"}
    exts = {r.filename: r.extension for r in detect.detect(df).collect()}
    assert exts["a.py"] == "py" and exts["x.d.ts"] == "d.ts" and exts["run"] == "run"
    one = detect.detect(df, patterns=["re:^src/a:Mine:Python"], remap_all=[("template", "Go")], remap_unknown=[("text", "Plain Text")])
    got = {r.filename: r.language for r in one.collect()}
    assert (got["a.py"], got["c.h"], got["nope"]) == ("Mine", "Go", "Plain Text")
    assert {r.language for r in detect.detect(df, only_extensions=["py"]).collect()} == {"Python"}


def test_names_and_tables_agree(spark):
    names = detect.Names()
    files = ["a.go", "b.d.ts", "c", ".x", ".a.b", "a.b.c", "Dockerfile", "x.tar.gz", "Gemfile", "q.H", "a.", ".gitignore", "json", "x.json.txt"]
    df = spark.createDataFrame([(f,) for f in files], "filename string")
    for only in (False, True):
        got = {r.filename: (r.candidates, r.extension) for r in detect.with_candidates(spark, df, names, only).collect()}
        assert got == {f: names.candidates(f, only) for f in files}


def test_ties_go_by_name(spark):
    rules = {r.name: r for r in (Rule("B", ("q",), heuristics=(Heuristic("x", ("x",)),)), Rule("A", ("q",), heuristics=(Heuristic("x"),)), Rule("C", ("q",), keywords=("k",)))}
    df = spark.createDataFrame([("x",), ("k",), ("",)], "t string")
    got = [r[0] for r in df.select(detect.resolve(["A", "B", "C"], rules, F.col("t"))).collect()]
    assert got == ["A", "C", "C"]


def test_globs_and_rule_files(tmp_path):
    import re

    assert re.match(detect.glob_regex("**/*.tpl.*"), "a/b/x.tpl.js") and not re.match(detect.glob_regex("*.js"), "a/x.js")
    assert detect.parse_pattern("glob:**/a_*:New: Base".replace(" ", "")) == (detect.glob_regex("**/a_*"), "New", "Base")
    p = tmp_path / "r.json"
    p.write_text('{"Q": {"extensions": ["q"], "line_comment": ["%"], "multi_line": [["<", ">"]], "quotes": [{"start": "\'", "end": "\'", "ignoreEscape": true}]}}')
    r = load(str(p), table())["Q"]
    assert r.line_comment == ("%",) and r.multi_line == (("<", ">"),) and r.quotes[0].ignore_escape
