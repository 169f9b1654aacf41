import os
import subprocess

import pytest

from linespan import api
from linespan.sources import config, files, git
from linespan.sources.config import Options, normalise, options
from linespan.sources.ignore import Ignore, parse


def test_ignore():
    i = Ignore().extended("", parse("*.log\n!keep.log\n/build\nsub/\n# no\n\\#x\na/**/b\n")).extended("deep", parse("!x.log\n"))
    assert i.ignored("a.log") and i.ignored("q/a.log") and not i.ignored("keep.log")
    assert i.ignored("build") and not i.ignored("q/build")
    assert i.ignored("q/sub", True) and not i.ignored("q/sub", False)
    assert i.ignored("#x") and i.ignored("a/b") and i.ignored("a/q/r/b") and not i.ignored("deep/x.log")


def test_ignored_as_a_column(spark):
    from pyspark.sql import functions as F

    from linespan.sources.ignore import ignored

    rules = Ignore().extended("", parse("*.log\n!keep.log\n/build\nsub/\n")).extended("deep", parse("!x.log\n"))
    paths = {"a.log": True, "q/a.log": True, "keep.log": False, "build/x/y": True, "q/build": False, "q/sub/z": True, "q/sub": False, "deep/x.log": False, "deep/y.log": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.i for r in df.select("p", ignored(F.col("p"), rules).alias("i")).collect()} == paths


@pytest.fixture
def folder(tmp_path):
    make = lambda name, body="x\n": ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(body))
    make("a.py", "x = 1\n# c\n\n")
    make("b/c.go", "package b\n// do not edit\n")
    make("b/copy.py", "x = 1\n# c\n\n")
    make("empty.py", "")
    make(".hidden.py")
    make(".gitignore", "skip\n*.tmp\n")
    make("skip/x.py")
    make("q.tmp")
    make(".git/x.py")
    make("yarn.lock")
    make("run", "#!/bin/sh\nif x\n")
    make("min.js", "a" * 600 + "\n")
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    return tmp_path


def test_listing(folder):
    names = lambda o: {os.path.relpath(r[0], folder) for r in files.walk(str(folder), o)}
    base = {"a.py", "b/c.go", "b/copy.py", "empty.py", ".hidden.py", ".gitignore", "run", "min.js"}
    assert names(files.Listing()) == base
    assert "skip/x.py" in names(files.Listing(ignore_files=()))
    assert names(files.Listing(not_match=("^b$",))) == base - {"b/c.go", "b/copy.py"}
    assert "link.py" not in names(files.Listing(symlinks=True)) or "a.py" not in names(files.Listing(symlinks=True))
    assert "min.js" not in names(files.Listing(max_bytes=100))
    assert "b/c.go" not in names(files.Listing(base_rules="*.go\n"))
    with pytest.raises(FileNotFoundError):
        list(files.walk(str(folder / "nothing")))


def test_count_folder(spark, folder):
    got = {os.path.relpath(r.location, folder): r for r in api.count(spark, Options(paths=(str(folder),))).collect()}
    assert set(got) == {"a.py", "b/c.go", "b/copy.py", "empty.py", ".hidden.py", "run", "min.js"}
    assert (got["a.py"].lines, got["a.py"].code, got["a.py"].comment, got["a.py"].blank) == (3, 1, 1, 1)
    assert got["empty.py"].lines == 0 and got["run"].language == "Shell"
    few = api.count(spark, normalise(Options(paths=(str(folder),), flags=frozenset({"no_duplicates", "no_min", "gen"}))))
    got = {os.path.relpath(r.location, folder): r.language for r in few.collect()}
    assert "b/copy.py" not in got and "min.js" not in got and got["b/c.go"] == "Go (gen)"


@pytest.mark.parametrize("kind", ["tabular", "wide", "json", "json2", "csv", "csv-stream", "cloc-yaml", "html", "html-table", "sql", "sql-insert", "openmetrics"])
def test_formats(spark, folder, kind):
    o = normalise(Options(paths=(str(folder / "a.py"), str(folder / "b")), format=kind, flags=frozenset({"by_file", "uloc", "dryness", "percent", "locomo"})))
    target, body = api.write(api.count(spark, o), o)[0]
    assert target == "" and "Python" in body and body


def test_several_formats(spark, folder):
    o = Options(paths=(str(folder),), format_multi="csv:stdout,json:out.json")
    assert [t for t, _ in api.write(api.count(spark, o), o)] == ["", "out.json"]


def test_config(tmp_path, caplog):
    (tmp_path / "global").write_text("--sort name # c\n--output x.txt\n-c")
    (tmp_path / config.PROJECT_FILE).write_text("--sort code\n--exclude-dir 'a b/'")
    env = {config.CONFIG_ENV: str(tmp_path / "global")}
    o = options(["p"], env, str(tmp_path))
    assert o.sort == "code" and o.output == "" and o.has("no_complexity") and o.exclude_dir[-1] == "a b" and o.paths == ("p",)
    assert options(["--sort", "lines"], env, str(tmp_path)).sort == "lines"
    assert options(["--no-config"], env, str(tmp_path)).sort == "files"
    o = options(["--no-min-gen", "-a", "--wide", "--remap-all", "'-*- C++':C Header", "--count-as", "jsp:html"], {}, "/")
    assert o.has("no_min") and o.has("no_gen") and o.has("gen") and o.has("uloc") and o.format == "wide"
    assert o.remap_all == (("-*- C++", "C Header"),) and o.count_as == {"jsp": "html"}
    for bad in (["--hotspots", "--depth=-1"], ["--timeline", "--buckets=0"], ["--hotspots", "--coupling"], ["--coupling-for", "a", "--timeline"], ["--hotspots", "--by-author"], ["--report", "x.html", "--buckets=0"]):
        with pytest.raises(ValueError):
            options(bad, {}, "/")
    assert options(["--depth=-1", "--coupling"], {}, "/").depth == -1 and options(["--coupling-weighted"], {}, "/").has("coupling")
    assert options(["--by-author", "--timeline"], {}, "/").has("timeline") and options(["--by-author", "--buckets=0"], {}, "/").buckets == 0
    with caplog.at_level("WARNING", "linespan"):
        options(["a", "b", "c", "--hotspots", "--uloc", "--no-min", "--sort", "code"], {}, "/")
    assert [r.message.rpartition(" for ")[2] for r in caplog.records][-1] == "--uloc, --no-min, --sort" and caplog.messages[0].endswith(": b, c")
    assert config.similar("by-fil", ["by-file", "uloc"]) == ["by-file"]


def commit(repo, when, author, **contents):
    for name, body in contents.items():
        p = repo / name.replace("__", ".")
        p.write_text(body)
    env = os.environ | {"GIT_AUTHOR_NAME": author, "GIT_COMMITTER_NAME": author, "GIT_AUTHOR_EMAIL": f"{author}@x.org", "GIT_COMMITTER_EMAIL": f"{author}@x.org", "GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000"}
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True, env=env)
    subprocess.run(["git", "-C", str(repo), "commit", "-qm", "x"], check=True, env=env)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = tmp_path_factory.mktemp("repo")
    subprocess.run(["git", "-C", str(r), "init", "-q"], check=True)
    day = 86_400
    commit(r, 1_735_689_600, "ann", a__go="package a\n\nfunc f() {\n\tif x {\n\t}\n}\n", b__go="package b\n")
    commit(r, 1_735_689_600 + day, "bob", a__go="package a\n\nfunc g() {\n\tif x {\n\t}\n}\n", b__go="package b\n\nvar y = 1\n")
    os.rename(r / "b.go", r / "c.go")
    commit(r, 1_735_689_600 + 2 * day, "ann", a__go="package a\n\nfunc g() {\n\tif y {\n\t}\n}\n")
    return r


def test_git_tables(spark, repo):
    log = git.commits(spark, str(repo))
    assert [(r.seq, r.author) for r in log.orderBy("seq").collect()] == [(0, "ann"), (1, "bob"), (2, "ann")]
    got = {(r.seq, r.path): (r.from_path, [tuple(x) for x in r.added], [tuple(x) for x in r.removed]) for r in git.file_changes(log, str(repo)).collect()}
    assert got[0, "a.go"] == ("", [(1, 6)], []) and got[1, "a.go"] == ("", [(3, 1)], [(3, 1)])
    assert got[2, "c.go"][0] == "b.go" and got[2, "c.go"][1:] == ([], [])
    assert git.commits(spark, str(repo), 2).count() == 2


def test_git_reports(spark, repo):
    h = api.GitHistory(spark, str(repo))
    spots = {r.path: (r.commits, r.complexity, r.authors) for r in h.hotspots().collect()}
    assert spots["a.go"] == (3, 1, 2) and spots["c.go"][0] == 3
    pair = h.coupling().collect()[0]
    assert (pair.a, pair.b, pair.shared) == ("a.go", "c.go", 3)
    owners = {r.author: r.code for r in h.authors().collect()}
    assert owners == {"ann": 5, "bob": 2}
    assert sum(r.commits for r in h.author_timeline(4).collect()) == 3
    last = [r for r in h.language_timeline(4).collect() if r.bucket == 3]
    assert [(r.language, r.code) for r in last] == [("Go", 7)]


def test_mailmap():
    text = "# c\nAnn <ann@x.org> <old@x.org>\nBob <bob@x.org>\nCat <cat@x.org> Kit <kit@x.org> # note\n"
    assert git.parse_mailmap(text) == [(None, "old@x.org", "Ann", "ann@x.org"), (None, "bob@x.org", "Bob", ""), ("Kit", "kit@x.org", "Cat", "cat@x.org")]
