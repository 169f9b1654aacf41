import base64
import csv
import io
import json
import math
import re
from xml.etree import ElementTree

from pyspark.sql import functions as F

from linespan import api, cli
from linespan.functions import cost, text
from linespan.plans import history as plans
from linespan.serve import badge, card, report, tools
from linespan.sinks import history, render
from linespan.sources.config import Options, options
from linespan.streaming import live


def languages():
    return [{"language": "Go", "files": 2, "lines": 30, "code": 20, "comment": 5, "blank": 5, "complexity": 4, "cognitive": 6, "bytes": 900, "uloc": 18}, {"language": "C", "files": 1, "lines": 10, "code": 6, "comment": 2, "blank": 2, "complexity": 1, "cognitive": 1, "bytes": 100, "uloc": 9}]


def test_table_widths():
    assert {len(x) for x in render.tabular(languages(), render.Style(cocomo=False, size=False)).splitlines()} == {79}
    assert {len(x) for x in render.tabular(languages(), render.Style(cocomo=False, size=False), wide=True).splitlines()} == {109}
    assert {len(x) for x in render.tabular(languages(), render.Style(cocomo=False, size=False, cognitive=True), wide=True).splitlines()} == {120}


def test_json_and_csv():
    out = json.loads(render.json_text(languages(), render.Style(percent=True)))
    assert out[0]["Name"] == "Go" and out[0]["Count"] == 2 and "Cognitive" not in out[0] and out[0]["CodePercent"] == 20 / 26 * 100
    assert "Cognitive" in json.loads(render.json_text(languages(), render.Style(cognitive=True)))[0]
    two = json.loads(render.json2_text(languages(), render.Style(locomo=True)))
    assert two["estimatedCost"] > 0 and two["estimatedLLMPreset"] == "medium"
    assert render.csv_text(languages()).splitlines()[0] == "Language,Lines,Code,Comments,Blanks,Complexity,Bytes,Files,ULOC"
    assert list(render.openmetrics(languages()))[-1] == "# EOF\n"


def test_escapes():
    f = [{"language": "C", "location": "d/it's\0.c", "filename": "it's.c", "lines": 1, "code": 1, "comment": 0, "blank": 0, "complexity": 0, "bytes": 1}]
    assert "'d/it''s.c', 'd/', 'it''s.c'" in "".join(render.sql_insert(f))
    assert render.trim_left("abcdef", 4) == "~def" and render.width("漢a") == 3
    assert "<script>" not in render.html_table([languages()[0] | {"language": "<script>"}])


def test_cost(spark):
    m = cost.Cocomo(wage=56_000)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert 580 < one(m.cost(F.lit(26))) < 585
    assert 2_602_460 < one(m.cost(F.lit(77_873))) < 2_602_480
    assert 2.6 < one(cost.Cocomo().months(F.lit(537))) < 2.8
    assert cost.project_type("own,1,2,3,4") == ("own", (1.0, 2.0, 3.0, 4.0)) and cost.project_type("what")[0] == "organic"
    e = cost.Locomo().estimate(F.lit(100), F.lit(25))
    assert one(e["output_tokens"]) == 2500.0 and one(e["input_tokens"]) == 100 * 20 * 3.5 * 2.5
    assert one(cost.Locomo().estimate(F.lit(0), F.lit(5))["cost"]) == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\n\n",), ("\n",), (" \t\r\nb",), (None,)], "t string")
    got = [tuple(r) for r in df.select(text.line_count(F.col("t")), text.blank_count(F.col("t")), F.size(text.unique_line_array(F.col("t")))).collect()]
    assert got == [(0, 0, 1), (1, 0, 1), (1, 0, 1), (2, 1, 1), (1, 1, 1), (2, 1, 2), (0, 0, 1)]
    names = spark.createDataFrame([(n,) for n in ("a.d.ts", "a.ts", ".x", "A", "a.")], "n string")
    assert [r[0] for r in names.select(text.extension(F.col("n"))).collect()] == ["d.ts", "ts", ".x", "a", ""]
    mails = spark.createDataFrame([("a@B.c.Org",), ("x",)], "m string")
    assert [tuple(r) for r in mails.select(text.email_domain(F.col("m")), text.registrable_domain(text.email_domain(F.col("m")))).collect()] == [("b.c.org", "c.org"), ("", "")]


def test_views():
    assert history.tag([1, 5, 0, 0]) == "quiet 2" and history.tag([1, 5, 5]) == "rising"
    rows = [{"a": "x", "b": "y", "shared": 2, "commits_a": 3, "commits_b": 3, "degree": 50.04}]
    assert history.table("csv", "coupling", rows).splitlines() == ["FileA,FileB,Shared,CommitsA,CommitsB,Degree", "x,y,2,3,3,50.0"]
    assert json.loads(history.table("json", "coupling", rows))[0]["Degree"] == 50.0
    assert len(render.sparkline([1, 2, 3], 8)) == 8 and render.bar(0.5, 4) == "██░░"
    assert render.downsample([1, 3, 5, 7], 2) == [2, 6]


def test_badge():
    assert badge.value("code", languages()) == ("Code lines", "26") and badge.short(2500) == "2.5k"
    assert badge.colour("red") == "#e05d44" and badge.colour("abc") == "#abc" and badge.colour("zzzz") == "#007ec6"
    assert badge.svg("a<", "b").startswith("<svg") and "a&lt;" in badge.svg("a<", "b")
    assert badge.junk("wp-login.php") and not badge.junk("github.com/a/b")


def test_tools(spark, tmp_path):
    (tmp_path / "a.py").write_text("if x:\n    pass\n")
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "analyze", "arguments": {"path": str(tmp_path), "by_file": True}}}, {"id": 4, "method": "tools/call", "params": {"name": "hotspots", "arguments": {"path": str(tmp_path / "no")}}}, {"id": 5, "method": "what"}]
    out = io.StringIO()
    tools.serve(spark, io.StringIO("\n".join(map(json.dumps, lines))), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5]
    said = json.loads(got[2]["result"]["content"][0]["text"])
    assert said["totalCode"] == 2 and said["languages"][0]["top"][0]["rank"] == 1
    assert got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601


def test_report_and_cli(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("if x:\n    pass\n")
    data = report.collect(spark, Options(paths=(str(tmp_path),)))
    page = report.page(data, Options(paths=(str(tmp_path),), report_title="<T>"))
    assert "og:image" in page and "og:image" not in report.page(data, Options(paths=(str(tmp_path),), report_skip=("card",)))
    assert "&lt;T&gt;" in page and "Python" in page and sum(r["lines"] for r in data["lengths"]) == 2
    assert cli.main([str(tmp_path), "-f", "csv", "--no-config"]) == 0
    assert "Python,2,2,0,0" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none"), "--no-config"]) == 1
    assert cli.main(["-l", "--no-config"]) == 0 and "Python (py" in capsys.readouterr().out


def test_history_pieces():
    rows = [{"a": "x,1", "b": "y", "shared": 2, "commits_a": 3, "commits_b": 3, "degree": 50.04}, {"a": "p", "b": None}]
    for kind in ("csv", "json", "tabular"):
        for some in (rows, rows[:1], []):
            assert "".join(history.pieces(kind, "coupling", iter(some))) == history.table(kind, "coupling", some)


def test_card_and_pictures():
    rows = [{"language": f"L{i}", "code": i, "files": 1, "lines": 2 * i, "complexity": 0} for i in range(10)]
    shares = card.parts(rows)
    assert [n for n, _, _ in shares] == ["L9", "L8", "L7", "L6", "L5", "L4", "other"] and sum(n for _, n, _ in shares) == 45
    arcs = [float(x) for x in re.findall(r'dasharray="([0-9.]+) ', card.ring(shares))]
    assert len(arcs) == 7 and abs(sum(arcs) - 2 * math.pi * 60) < 0.1
    assert card.ring([]) == "" and card.bars([]) == "" and card.bars([{"low": 0, "lines": 0}]) == ""
    high = [float(x) for x in re.findall(r'<rect [^>]*height="([0-9.]+)"', card.bars([{"low": 0, "lines": 1}, {"low": 20, "lines": 4}]))]
    assert high == [30, 120]
    picture = card.card("<T>", rows, "$1")
    ElementTree.fromstring(picture)
    assert "&lt;T&gt;" in picture and ">90<" in picture and "$1" in picture
    ElementTree.fromstring(card.card("none", []))
    assert base64.b64decode(card.data_url(picture).partition(",")[2]).decode() == picture


def test_csv_of_files_goes_by_name(spark, tmp_path):
    for name, lines in (("x/b.py", 1), ("y/a.py", 2), ("z/a.py", 3), ("z/c.sh", 9)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("a = 1\n" * lines + f"# {name}\n")
    def order(*flags):
        o = options([str(tmp_path), "--by-file", "-f", "csv", "--no-config", *flags], {}, "/")
        return [r["Provider"].removeprefix(f"{tmp_path}/") for r in csv.DictReader(io.StringIO(api.write(api.count(spark, o), o)[0][1]))]
    assert order() == order("--sort", "cognitive") == ["y/a.py", "z/a.py", "x/b.py", "z/c.sh"]
    assert order("--sort", "code") == ["z/c.sh", "z/a.py", "y/a.py", "x/b.py"]
    assert order("--sort", "langs") == ["x/b.py", "y/a.py", "z/a.py", "z/c.sh"]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\n\ny"), ("a", ""), ("b", "z")], "language string, content string")
    df.write.parquet(str(tmp_path / "in"))
    q = live.summary(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "memory", "live_summary")
    q.processAllAvailable()
    got = {r.language: (r.files, r.lines, r.code) for r in spark.table("live_summary").collect()}
    q.stop()
    assert got == {"a": (2, 3, 2), "b": (1, 1, 1)}
    seen = []
    q = live.each_batch(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda batch, i: seen.append(batch.count()), str(tmp_path / "mark"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 3


def test_observed_hotspots_are_those_of_all_changes(spark, tmp_path):
    kind = "seq bigint, path string, author_key string, lines_changed bigint, code_churn bigint, comment_churn bigint"
    first = [(0, "a", "x", 5, 3, 1), (0, "b", "x", 1, 1, 0), (1, "a", None, 2, 0, 2)]
    later = [(2, "a", "x", 7, 7, 0), (3, "b", "y", 4, 2, 2), (4, "gone", "y", 9, 9, 0)]
    head = spark.createDataFrame([("a", "Go", 3), ("b", "C", 4), ("still", "C", 9)], "path string, language string, complexity bigint")
    folder = str(tmp_path / "in")
    spark.createDataFrame(first, kind).write.parquet(folder)
    q = live.observe(spark.readStream.schema(kind).parquet(folder), "memory", "observed")
    try:
        for so_far, more in ((first, later), (first + later, [])):
            q.processAllAvailable()
            got = live.finalise(spark.table("observed"), head).orderBy("path").collect()
            assert got == plans.hotspots(spark.createDataFrame(so_far, kind), head).orderBy("path").collect() and len(got) == 2
            if more:
                spark.createDataFrame(more, kind).write.mode("append").parquet(folder)
    finally:
        q.stop()


def test_badge_figures():
    assert [badge.short(n) for n in (0, 999, 1000, 1001, 9_950, 12_345, 999_999, 3_456_789, 2e9, 7e12)] == ["0", "999", "1.0k", "1.1k", "10k", "12k", "1000k", "3.5M", "2.0G", "7.0T"]


def test_badge_server():
    asked, clock = [], [0.0]
    b = badge.Badges(lambda address: asked.append(address) or languages(), keep=10, most=2, now=lambda: clock[0])
    status, kind, body = b.answer("/github/own/thing?category=lines&badge-bg-color=red")
    assert status == 200 and kind.startswith("image/svg") and "Total lines" in body and "#e05d44" in body
    assert b.answer("/github.com/own/thing")[0] == 200 and asked == ["https://github.com/own/thing.git"]
    clock[0] = 11
    b.answer("/github/own/thing")
    assert len(asked) == 2
    for x in "abc":
        b.answer(f"/gitlab/own/{x}")
    assert len(b.known) == 2 and b.answer("/x")[0] == 400 and b.answer("/health-check/")[2] == "ok"
    assert badge.Badges(lambda a: (_ for _ in ()).throw(ValueError("no such"))).answer("/github/a/b") == (400, "text/plain", "no such")
    import threading
    import urllib.request

    server = b.server(0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(f"http://127.0.0.1:{server.server_port}/github/own/thing") as r:
        assert r.status == 200 and r.read().startswith(b"<svg")
    server.shutdown()


def test_model_cost_options():
    from linespan.sources.config import options

    o = options(["--locomo", "--locomo-input-price", "2", "--locomo-output-price", "4", "--locomo-tps", "10", "--locomo-cycles", "3", "--locomo-review", "0.6", "--locomo-config", "1,2,x,4,5", "--no-config"])
    from linespan import api

    got = render.locomo(100, 25, api.style(o))
    # a part that is no number keeps its default: complexity 5
    assert got["output_tokens"] == 100 * 1 * 3 and got["input_tokens"] == 100 * 2 * 3.5 * 3 and got["cycles"] == 3
    assert abs(got["cost"] - (2100 * 2 + 300 * 4) / 1e6) < 1e-12 and got["seconds"] == 30 and got["review_hours"] == 1.0
    assert cost.Locomo.of(config="1,2,3") == cost.Locomo() and render.locomo(100, 25, render.Style())["output_tokens"] == 2500.0


def test_unknown_flags_completion_and_log(tmp_path, capsys, caplog):
    assert cli.main(["--no-complexty"]) == 1
    assert "did you mean --no-complexity" in capsys.readouterr().err
    for shell in ("bash", "zsh", "fish", "powershell"):
        assert cli.main(["--completion", shell, "--no-config"]) == 0 and "by-file" in capsys.readouterr().out
    assert cli.main(["--completion", "csh", "--no-config"]) == 1
    (tmp_path / "a.py").write_text("x = 1\n")
    assert cli.main([str(tmp_path), "--by-file", "-f", "csv-stream", "--trace", "-o", str(tmp_path / "out.csv"), "--no-config"]) == 0
    assert "a.py" in (tmp_path / "out.csv").read_text() and any("languages" in r.message for r in caplog.records)


def test_pieces_come_one_at_a_time():
    def files():
        for i in range(3):
            seen.append(i)
            yield {"language": "C", "location": f"{i}.c", "filename": f"{i}.c", "lines": 1, "code": 1, "comment": 0, "blank": 0, "complexity": 0, "bytes": 1, "uloc": 1}

    for kind in ("csv-stream", "sql-insert"):
        seen = []
        pieces = render.parts(kind, languages(), render.Style(), files(), by_file=True)
        while not seen:
            next(pieces)
        assert seen == [0]


def test_tool_inputs():
    assert set(tools.INPUTS) == set(tools.TOOLS) and "depth" in tools.INPUTS["hotspots"]


def test_remote_name(tmp_path):
    import subprocess

    from linespan.sources.git import remote_name

    subprocess.run(["git", "init", "-q", str(tmp_path / "r")], check=True)
    assert remote_name(str(tmp_path / "r")) == ""
    for url in ("git@host:own/thing.git", "https://host/own/thing.git/", "host:thing"):
        subprocess.run(["git", "-C", str(tmp_path / "r"), "config", "remote.origin.url", url], check=True)
        assert remote_name(str(tmp_path / "r")) == "thing"
