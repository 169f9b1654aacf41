import random

import pytest
from pyspark.sql import functions as F

from linespan.functions.buckets import bucket
from linespan.plans import blame, history


def tables(spark, commits, head):
    rows = [(i, k, p, f) for i, c in enumerate(commits) for k, (p, f) in enumerate((x if isinstance(x, tuple) else (x, "")) for x in c)]
    return spark.createDataFrame(rows, "seq bigint, change_idx int, path string, from_path string"), spark.createDataFrame([(p, 1) for p in head], "path string, complexity bigint")


def pairs(df):
    return {(r.a, r.b): (r.shared, r.commits_a, r.commits_b, round(r.degree, 1)) for r in df.collect()}


def test_coupling(spark):
    changes, head = tables(spark, ["ab", "ab", "a", "bc"], "abc")
    assert pairs(history.coupling(changes, head)) == {("a", "b"): (2, 3, 3, 50.0)}
    changes, head = tables(spark, ["ab", "ab"], "ab")
    assert pairs(history.coupling(changes, head)) == {("a", "b"): (2, 2, 2, 100.0)}
    changes, head = tables(spark, ["abcd", "ab", "ab"], "abcd")
    assert pairs(history.coupling(changes, head, max_files=3)) == {("a", "b"): (2, 3, 3, 50.0)}
    assert pairs(history.coupling(changes, head.where("path <> 'b'"), max_files=3)) == {}


def test_coupling_follows_renames(spark):
    changes, head = tables(spark, [["old", "b"], ["old", "b"], [("new", "old"), "b"]], ["new", "b"])
    found = history.coupling(changes, head, renames=history.rename_map(changes))
    assert pairs(found) == {("b", "new"): (3, 3, 3, 100.0)}
    r = history.coupling_for(found, "new").collect()[0]
    assert (r.partner, r.couple, r.reverse) == ("b", 100.0, 100.0)


def test_rename_chains(spark):
    chain = [[(f"p{i + 1}", f"p{i}")] for i in range(10)]
    changes, _ = tables(spark, chain, [])
    assert {r.old: r.new for r in history.rename_map(changes).collect()} == {f"p{i}": "p10" for i in range(10)}
    changes, _ = tables(spark, [["a"]], [])
    assert history.rename_map(changes).count() == 0


@pytest.mark.parametrize(
    ("previous", "lines", "added", "removed", "author", "want"),
    [([1] * 5, 6, [(3, 2)], [(3, 1)], 2, [1, 1, 2, 2, 1, 1]), ([1] * 4, 2, [], [(2, 2)], 2, [1, 1]), ([], 4, [], [], 1, [0] * 4), ([], 2, [(1, 2)], [], 7, [7, 7])],
)
def test_apply_diff(previous, lines, added, removed, author, want):
    assert blame.apply_diff(previous, lines, added, removed, author, before=0) == want


def test_replay_and_owners(spark):
    span = "array<struct<start:int,count:int>>"
    rows = [(0, "a", 1, [(1, 3)], [], [1, 1, 2], [1, 0, 0]), (1, "a", 2, [(2, 1)], [(2, 1)], [1, 1, 2], [1, 2, 0]), (1, "b", 2, [(1, 1)], [], [1], [0])]
    df = spark.createDataFrame(rows, f"seq bigint, path string, author_id bigint, added {span}, removed {span}, line_types array<int>, complexity array<int>")
    got = {(r.path, r.author_id): (r.code, r.comment, r.complexity) for r in blame.owned_lines(blame.replay(df)).collect()}
    assert got == {("a", 1): (1, 1, 1), ("a", 2): (1, 0, 2), ("b", 2): (1, 0, 0)}
    base = spark.createDataFrame([("b", [1, 1])], "path string, line_types array<int>")
    own = history.ownership(blame.owned_lines(blame.replay(df, base)), blame.BEFORE)
    assert round(sum(r.owns_percent for r in own.collect()), 6) == 100


def test_plurality_and_bus_factor(spark):
    rows = [("a", 1, 5), ("a", 2, 5), ("b", -1, 9), ("b", 3, 1), ("c", -1, 2)]
    lines = spark.createDataFrame(rows, "path string, author_id bigint, code bigint").withColumns({"comment": F.lit(0), "complexity": F.lit(0)})
    assert {r.path: r.author_id for r in history.plurality(lines, -1).collect()} == {"a": 1, "b": 3, "c": -1}
    own = history.ownership(lines, -1).where("author_id <> -1")
    assert history.bus_factor(own).first()[0] == 2
    assert round(own.agg(F.sum("in_window_percent")).first()[0], 6) == 100


def test_clamped_sum(spark):
    rng = random.Random(1)
    rows = [(w, i, rng.randint(-9, 9)) for w in range(20) for i in range(30)]
    series = spark.createDataFrame(rows, "who int, bucket int, delta int")
    start = spark.createDataFrame([(w, w % 5) for w in range(20)], "who int, code bigint")
    got = {(r.who, r.bucket): r.code for r in history.trajectory(series, "who", start).collect()}
    for w in range(20):
        now = w % 5
        for _, i, d in (r for r in rows if r[0] == w):
            now = max(0, now + d)
            assert got[w, i] == now


def test_buckets(spark):
    df = spark.createDataFrame([(0,), (1,), (99,), (100,), (-5,), (500,)], "s bigint").withColumn("ts", F.timestamp_seconds("s"))
    at = lambda a, b, n: [r[0] for r in df.orderBy("s").select(bucket(F.col("ts"), F.lit(a), F.lit(b), n)).collect()]
    assert at(0, 100_000_000, 10) == [0, 0, 0, 9, 9, 9]
    assert at(0, 3, 10) == [0] * 6


def test_identities(spark):
    rows = [(0, "Ann", "a@x.org", 1), (1, "ann", "b@X.org", 2), (2, "root", "r@x.org", 3), (3, "root", "s@x.org", 4), (4, "Old", "old@y.org", 5), (5, "Bob", "", 6)]
    c = spark.createDataFrame(rows, "seq bigint, author string, email string, when bigint")
    mail = spark.createDataFrame([(None, "old@y.org", "Ann", "a@x.org")], "commit_name string, commit_email string, proper_name string, proper_email string")
    got = {r.seq: (r.author, r.author_id) for r in history.identities(c, mail).collect()}
    assert got == {0: ("Ann", 0), 1: ("Ann", 0), 2: ("root", 2), 3: ("root", 3), 4: ("Ann", 0), 5: ("Bob", 5)}
    assert len({r.author_id for r in history.identities(c, None, fold=False).collect()}) == 6


def test_hotspots_and_line_types(spark):
    rows = [(i, "hot", i % 2, 3, 2, 1) for i in range(4)] + [(9, "cool", 1, 1, 1, 0), (9, "gone", 1, 1, 1, 0)]
    c = spark.createDataFrame(rows, "seq bigint, path string, author_key int, lines_changed bigint, code_churn bigint, comment_churn bigint")
    head = spark.createDataFrame([("hot", "Go", 5), ("cool", "Go", 5)], "path string, language string, complexity bigint")
    got = {r.path: (r.commits, r.lines_changed, r.authors, r.score) for r in history.hotspots(c, head).collect()}
    assert got == {"hot": (4, 12, 2, 100.0), "cool": (1, 1, 1, 25.0)}
    df = spark.createDataFrame([([(1, 2), (4, 9)], [1, 2, 1, 1, 2])], "r array<struct<start:int,count:int>>, t array<int>")
    assert df.select(history.lines_of_type(F.col("r"), F.col("t"), 1), history.lines_of_type(F.col("r"), F.col("t"), 2), history.range_lines(F.col("r"))).first() == (2, 2, 11)


def test_window(spark):
    c = spark.createDataFrame([(f"h{i}", i * 86_400) for i in range(6)], "hash string, t bigint").withColumn("when", F.timestamp_seconds("t"))
    for depth, want in ((3, {"h3": 0, "h4": 1, "h5": 2}), (0, {f"h{i}": i for i in range(6)})):
        assert {r.hash: r.seq for r in history.window_commits(c, depth).collect()} == want


def test_fold_tail(spark):
    df = spark.createDataFrame([(i, 100 - i) for i in range(20)], "who int, code bigint")
    got = {r.who: r.code for r in history.fold_tail(df, "who", [F.desc("code")], ["code"]).collect()}
    assert len(got) == 16 and got["others (5)"] == sum(100 - i for i in range(15, 20))


def test_display_names(spark):
    rows = [("A", "a@x.org"), ("A", "a@y.org"), ("B", "b@p.x.org"), ("B", "b@q.x.org"), ("C", "c@x.org"), ("C", "d@x.org"), ("D", None), (None, None)]
    df = spark.createDataFrame(rows, "author string, email string")
    got = {(r.author, r.email): r.display for r in history.disambiguate(df).collect()}
    assert got["A", "a@x.org"] == "A (x.org)" and got["B", "b@p.x.org"] == "B (p.x.org)" and got["C", "d@x.org"] == "C (d@x.org)" and got["D", None] == "D"
    assert len(got) == len(rows)


def test_names_of_the_baseline_alone_stay(spark):
    series = history.dense(spark.createDataFrame([("Go", 1, 2, 5)], "language string, bucket int, commits long, delta long"), "language", 3)
    start = spark.createDataFrame([("Go", 10), ("C", 7), ("C", 1)], "language string, code bigint")
    got = sorted(tuple(r) for r in history.trajectory(series, "language", start).select("language", "bucket", "commits", "code").collect())
    assert got == [("C", 0, 0, 8), ("C", 1, 0, 8), ("C", 2, 0, 8), ("Go", 0, 0, 10), ("Go", 1, 2, 15), ("Go", 2, 0, 15)]
    assert history.trajectory(series.limit(0), "language", start).select("language", "code").distinct().count() == 2


def test_fold_series(spark):
    rows = [(f"a{i:02}", b, i if b else 1, b) for i in range(20) for b in range(2)]
    got = {(r.who, r.bucket): (r.commits, r.delta, r["rank"]) for r in history.fold_series(spark.createDataFrame(rows, "who string, bucket int, commits long, delta long"), "who", [F.desc("commits")], ["commits", "delta"]).collect()}
    assert len(got) == 32 and got["a19", 1] == (19, 1, 1) and got["others (5)", 0] == (5, 0, 16) and got["others (5)", 1] == (10, 5, 16)


def test_replay_over_batches(spark):
    """A file's commits may lie in several Arrow batches, and several files in one."""
    rng = random.Random(5)
    span = "array<struct<start:int,count:int>>"
    rows, want = [], {}
    for path in "abcdefg":
        owners: list[int] = []
        for seq in rng.sample(range(100), 9):
            rows.append([seq, path, seq % 4])
        for r in sorted(x for x in rows if x[1] == path):
            n = rng.randint(0, 6)
            added, removed = [(rng.randint(1, 4), rng.randint(0, 2))], [(rng.randint(1, 4), rng.randint(0, 2))]
            owners = blame.apply_diff(owners, n, added, removed, r[2])
            r += [added, removed, [1] * n, list(range(n))]
        want |= {(path, i): a for i, a in enumerate(owners, 1)}
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        df = spark.createDataFrame([tuple(r) for r in rows], f"seq bigint, path string, author_id bigint, added {span}, removed {span}, line_types array<int>, complexity array<int>")
        got = [(r.path, r.line_no, r.author_id, r.complexity) for r in blame.replay(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(p, i): a for p, i, a, _ in got} == want and all(c == i - 1 for _, i, _, c in got)
