"""Queries over the driver's tables, one for each operator, and SQL that says the same.

Documents are files (language: lang, location: source/doc_id); orders are commits, their parts the changed files, and parts
the files that are there now; events are the commits of users and the lines of event types over time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linespan import rules
from linespan.functions import cost, text
from linespan.operators import classify, detect, rollup
from linespan.plans import blame, history
from linespan.sources import ignore


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as counted text files; what isn't asked for is pruned."""
    content = F.coalesce("text", F.lit(""))
    lines, blank = text.line_count(content), text.blank_count(content)
    return load(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("location"), F.col("lang").alias("language"), content.alias("content"), F.octet_length(content).cast("long").alias("bytes"),
        lines.alias("lines"), (lines - blank).alias("code"), F.lit(0).cast("long").alias("comment"), blank.alias("blank"), F.lit(0).cast("long").alias("complexity"), text.generated(content, ["license", "copyright"]).alias("generated"), F.lit(False).alias("binary"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files with blank lines: (conv_id, content), turns in order with an empty line between them."""
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("content"))


FILES_SQL = r"""(SELECT source || '/' || CAST(doc_id AS VARCHAR) AS location, lang AS language, coalesce(text, '') AS content, strlen(coalesce(text, '')) AS bytes,
 CAST(len(string_split(coalesce(text, ''), chr(10))) - CASE WHEN coalesce(text, '') = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS lines,
 CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) = '')) - CASE WHEN coalesce(text, '') = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS blank
 FROM documents)"""
SUMMARY_SQL = f"SELECT language, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(lines - blank) AS BIGINT) AS code, CAST(0 AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank, CAST(0 AS BIGINT) AS complexity FROM {FILES_SQL} GROUP BY language"

_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = (f, sql)
        return f

    return add


@query(SUMMARY_SQL)
def language_summary(spark, d):
    return rollup.by_language(files(spark, d))


@query(f"SELECT CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(code) AS BIGINT) AS code, CAST(0 AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank, CAST(0 AS BIGINT) AS complexity FROM ({SUMMARY_SQL})")
def language_totals(spark, d):
    return rollup.totals(files(spark, d))


@query(f"SELECT language, {', '.join(f'round(CASE WHEN sum({c}) OVER () <> 0 THEN {c} / sum({c}) OVER () * 100 ELSE 0 END, 6) AS {c}_percent' for c in ('files', 'bytes', 'lines', 'code'))} FROM ({SUMMARY_SQL})")
def language_percent(spark, d):
    out = rollup.percentages(rollup.by_language(files(spark, d)))
    return out.select("language", *[F.round(f"{c}_percent", 6).alias(f"{c}_percent") for c in ("files", "bytes", "lines", "code")])


@query(f"SELECT location, language, CAST(bytes AS BIGINT) AS bytes, lines, lines - blank AS code, blank FROM {FILES_SQL}")
def file_lines(spark, d):
    return files(spark, d).select("location", "language", "bytes", "lines", "code", "blank")


@query(r"""SELECT conv_id, CAST(len(l) AS BIGINT) AS lines, CAST(len(list_filter(l, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '')) AS BIGINT) AS blank
FROM (SELECT conv_id, string_split(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), chr(10)) AS l FROM conversations GROUP BY conv_id)""")
def chat_lines(spark, d):
    return chats(spark, d).select("conv_id", text.line_count(F.col("content")).alias("lines"), text.blank_count(F.col("content")).alias("blank"))


_LINES_SQL = "(SELECT lang, source, doc_id, unnest(string_split(rtrim(coalesce(text, ''), chr(10)), chr(10))) AS line FROM documents)"


@query(f"SELECT lang AS language, count(DISTINCT line) AS uloc FROM {_LINES_SQL} GROUP BY lang")
def uloc_language(spark, d):
    return rollup.unique_lines(files(spark, d), ["language"])


@query(f"SELECT count(DISTINCT line) AS uloc FROM {_LINES_SQL}")
def uloc_global(spark, d):
    return rollup.unique_lines(files(spark, d), [])


@query(f"SELECT location, (SELECT CAST(count(DISTINCT x) AS BIGINT) FROM (SELECT unnest(string_split(rtrim(content, chr(10)), chr(10))) AS x)) AS uloc FROM {FILES_SQL}")
def uloc_file(spark, d):
    return files(spark, d).select("location", F.size(text.unique_line_array(F.col("content"))).cast("long").alias("uloc"))


@query(f"SELECT round((SELECT count(DISTINCT line) FROM {_LINES_SQL}) / nullif((SELECT sum(lines) FROM {FILES_SQL}), 0), 9) AS dryness")
def dryness(spark, d):
    f = files(spark, d)
    total = f.agg(F.sum("lines").alias("lines"))  # one row
    return rollup.unique_lines(f, []).join(F.broadcast(total)).select(F.round(F.col("uloc") / F.nullif(F.col("lines"), F.lit(0)), 9).alias("dryness"))


def _lengths(spark, d, *keep):
    return files(spark, d).select(*keep, F.explode(text.line_lengths(F.col("content"))).alias("length"))


@query(f"""SELECT b.bucket, b.bucket * 20 AS low, count(l.bucket) AS lines FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS bucket) b
LEFT JOIN (SELECT least(strlen(line) // 20, 6) AS bucket FROM {_LINES_SQL}) l ON b.bucket = l.bucket GROUP BY b.bucket""")
def line_length_histogram(spark, d):
    return rollup.length_histogram(_lengths(spark, d))


@query(f"SELECT lang AS language, CAST(max(strlen(line)) AS BIGINT) AS longest, CAST(sum(strlen(line)) // count(*) AS BIGINT) AS mean FROM {_LINES_SQL} GROUP BY lang")
def line_length_max_mean(spark, d):
    each = _lengths(spark, d, "language").groupBy("language")
    return each.agg(F.max("length").cast("long").alias("longest"), F.floor(F.sum("length") / F.count(F.lit(1))).cast("long").alias("mean"))


@query(f"SELECT source || '/' || CAST(doc_id AS VARCHAR) AS location, CAST(max(strlen(line)) AS BIGINT) AS longest FROM {_LINES_SQL} GROUP BY source, doc_id ORDER BY longest DESC, location LIMIT 10")
def line_length_outliers(spark, d):
    """The ten files with the longest lines: a report of ten rows is what this is."""
    return files(spark, d).select("location", F.array_max(text.line_lengths(F.col("content"))).cast("long").alias("longest")).orderBy(F.desc("longest"), "location").limit(10)


@query(f"SELECT location, lines > 0 AND bytes // lines >= 255 AS at_255, lines > 0 AND bytes // lines >= 1921 AS at_1921 FROM {FILES_SQL}")
def minified_flag(spark, d):
    flag = lambda n: text.minified(F.col("bytes"), F.col("lines"), F.lit(False), n)
    return files(spark, d).select("location", flag(255).alias("at_255"), flag(1921).alias("at_1921"))


_MARKED = " OR ".join(f"(strpos(lower(content), '{m}') > 0 AND strlen(content[1:strpos(lower(content), '{m}') - 1]) + {len(m)} <= 1000)" for m in ("license", "copyright"))


@query(f"SELECT location, {_MARKED} AS generated FROM {FILES_SQL}")
def generated_flag(spark, d):
    """All files; the marker has to end within the first 1000 bytes, whatever the text."""
    return files(spark, d).select("location", "generated")


@query("SELECT min(source || '/' || CAST(doc_id AS VARCHAR)) AS location, sha256(coalesce(text, '')) AS content_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents GROUP BY 2, 3")
def dedup_files(spark, d):
    hashed = files(spark, d).select("location", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "bytes")
    return rollup.drop_duplicates(hashed)


@query(f"SELECT location, lines, CAST(bytes AS BIGINT) AS bytes FROM {FILES_SQL} WHERE bytes < 20000 AND lines < 40")
def large_filter(spark, d):
    return files(spark, d).where((F.col("bytes") < 20_000) & (F.col("lines") < 40)).select("location", "lines", "bytes")


@query("""SELECT location, extension FROM (SELECT source || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '.txt' WHEN doc_id % 3 = 1 THEN '.md' ELSE '.lock' END AS location,
CASE WHEN doc_id % 3 = 0 THEN 'txt' WHEN doc_id % 3 = 1 THEN 'md' ELSE 'lock' END AS extension, source FROM documents) WHERE extension <> 'lock' AND source NOT LIKE '%7' AND NOT contains(location, '99')""")
def path_filters(spark, d):
    """Extensions kept, directories and parts of names left out."""
    kind = F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".lock")
    named = load(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), kind).alias("location"), "source")
    rows = named.withColumn("extension", text.extension(F.regexp_extract("location", "([^/]*)$", 1)))
    return rows.where(F.col("extension").isin("txt", "md") & ~F.col("location").rlike("^[^/]*7/") & ~F.contains("location", F.lit("99"))).select("location", "extension")


@query(f"SELECT language, round(sum(bytes) / 1000000, 6) AS si, round(sum(bytes) / 1048576, 6) AS binary, round(sum(bytes) / 1024000, 6) AS mixed FROM {FILES_SQL} GROUP BY language")
def size_units(spark, d):
    s = rollup.by_language(files(spark, d))
    return s.select("language", *[F.round(cost.megabytes(F.col("bytes"), u), 6).alias(u) for u in ("si", "binary", "mixed")])


@query(f"""SELECT language, round(e, 6) AS effort, round(e * 56286 / 12 * 2.4, 4) AS cost, round(2.5 * pow(e, 0.38), 6) AS months, round(e / (2.5 * pow(e, 0.38)), 6) AS people
FROM (SELECT language, 2.4 * pow(code / 1000, 1.05) AS e FROM ({SUMMARY_SQL}))""")
def cocomo(spark, d):
    m, code = cost.Cocomo(), F.col("code")
    s = rollup.by_language(files(spark, d))
    return s.select("language", F.round(m.effort(code), 6).alias("effort"), F.round(m.cost(code), 4).alias("cost"), F.round(m.months(code), 6).alias("months"), F.round(m.people(code), 6).alias("people"))


def _parts(spark, d):
    return load(spark, d, "part").groupBy(F.col("p_brand").alias("language")).agg(F.sum(F.round("p_retailprice").cast("long")).alias("code"), F.sum("p_size").cast("long").alias("complexity"))


_PARTS_SQL = "(SELECT p_brand AS language, CAST(sum(CAST(round(p_retailprice) AS BIGINT)) AS BIGINT) AS code, CAST(sum(p_size) AS BIGINT) AS complexity FROM part GROUP BY p_brand)"


@query(f"""SELECT language, round(o, 4) AS output_tokens, round(i, 4) AS input_tokens, round(i / 1e6 * 3 + o / 1e6 * 15, 6) AS cost, round(o / 50, 4) AS seconds, round(code * 0.01 / 60, 6) AS review_hours
FROM (SELECT language, code, code * 10 * (1.5 + sqrt(q) * 2) AS o, code * 20 * (1 + sqrt(q) * 5) * (1.5 + sqrt(q) * 2) AS i FROM (SELECT *, complexity / code AS q FROM {_PARTS_SQL}))""")
def locomo(spark, d):
    e = cost.Locomo().estimate(F.col("code"), F.col("complexity"))
    return _parts(spark, d).select("language", *[F.round(e[k], n).alias(k) for k, n in (("output_tokens", 4), ("input_tokens", 4), ("cost", 6), ("seconds", 4), ("review_hours", 6))])


@query(f"SELECT CAST(sum(lines) AS BIGINT) AS lines, round(3.2 * pow(sum(lines - blank) / 1000, 1.05), 6) AS effort, round(3.2 * pow(sum(lines - blank) / 1000, 1.05) * (56286 / 12) * 1.8, 4) AS cost FROM {FILES_SQL}")
def badge_totals(spark, d):
    t, b = rollup.totals(files(spark, d)), cost.badge(F.col("code"))
    return t.select("lines", F.round(b["effort"], 6).alias("effort"), F.round(b["cost"], 4).alias("cost"))


@query(f"SELECT language, round(CASE WHEN code <> 0 THEN complexity / code * 100 ELSE 0 END, 8) AS weighted FROM {_PARTS_SQL}")
def weighted_complexity(spark, d):
    return _parts(spark, d).select("language", F.round(rollup.weighted_complexity(F.col("complexity"), F.col("code")), 8).alias("weighted"))


def _changes(spark, d):
    """Line items as changes: (seq: order, path: part, author_key: customer)."""
    items = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("path")).agg(F.sum(F.col("l_quantity").cast("long")).alias("lines_changed"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0).cast("long")).alias("code_churn"))
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("author_key"))
    return items.join(orders, "seq").withColumn("comment_churn", F.col("lines_changed") - F.col("code_churn"))


def _touched(spark, d):
    """Only which parts an order has; what coupling needs."""
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("path"))


def _head(spark, d):
    return load(spark, d, "part").where(F.col("p_size") > 10).select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("language"), F.col("p_size").cast("long").alias("complexity"))


@query("""WITH c AS (SELECT l_orderkey AS seq, l_partkey AS path, sum(CAST(l_quantity AS BIGINT)) AS n, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS code FROM lineitem GROUP BY 1, 2),
r AS (SELECT c.path, p_brand AS language, CAST(p_size AS BIGINT) AS complexity, count(*) AS commits, CAST(sum(n) AS BIGINT) AS lines_changed, count(DISTINCT o_custkey) AS authors, CAST(sum(code) AS BIGINT) AS code_churn, CAST(sum(n - code) AS BIGINT) AS comment_churn
FROM c JOIN orders ON seq = o_orderkey JOIN part ON path = p_partkey WHERE p_size > 10 GROUP BY 1, 2, 3)
SELECT *, round(complexity * commits / max(complexity * commits) OVER () * 100, 6) AS score FROM r""")
def hotspots(spark, d):
    return history.hotspots(_changes(spark, d), _head(spark, d)).withColumn("score", F.round("score", 6))


def _coupling_sql(cap: int, rows: str, head: str) -> str:
    return f"""WITH f AS (SELECT DISTINCT {rows}), s AS (SELECT seq FROM f GROUP BY seq HAVING count(*) BETWEEN 2 AND {cap}),
p AS (SELECT x.path AS a, y.path AS b, count(*) AS shared FROM f x JOIN f y ON x.seq = y.seq AND x.path < y.path WHERE x.seq IN (SELECT seq FROM s) GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT f.path, h.complexity, count(*) AS n FROM f JOIN ({head}) h ON f.path = h.path GROUP BY 1, 2)
SELECT a, b, shared, x.n AS commits_a, y.n AS commits_b, round(shared / (x.n + y.n - shared) * 100, 6) AS degree, CAST(shared * least(x.complexity, y.complexity) AS BIGINT) AS weighted FROM p JOIN t x ON a = x.path JOIN t y ON b = y.path"""


_PART_HEAD = "SELECT p_partkey AS path, p_size AS complexity FROM part WHERE p_size > 10"
_PARTS_OF = "l_orderkey AS seq, l_partkey AS path FROM lineitem"
_rounded = lambda df, *c: df.withColumns({x: F.round(x, 6) for x in c})


@query(_coupling_sql(30, _PARTS_OF, _PART_HEAD))
def coupling_pairs(spark, d):
    return _rounded(history.coupling(_touched(spark, d), _head(spark, d)), "degree")


@query(_coupling_sql(5, _PARTS_OF, _PART_HEAD))
def coupling_weighted(spark, d):
    """The same with a smaller cap, which leaves commits out here."""
    return _rounded(history.order_coupling(history.coupling(_touched(spark, d), _head(spark, d), max_files=5), weighted=True), "degree")


def _users(spark, d):
    e = load(spark, d, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("seq"), F.col("user_id").alias("path"))
    return e, e.select("path").distinct().withColumns({"complexity": F.col("path") % 7, "language": F.lit("user")})


_USERS_OF = "epoch_us(ts) // 3600000000 AS seq, user_id AS path FROM events"


@query(f"""WITH c AS ({_coupling_sql(20, _USERS_OF, "SELECT DISTINCT user_id AS path, user_id % 7 AS complexity FROM events")}),
t AS (SELECT min(user_id) AS u FROM events)
SELECT CASE WHEN a = u THEN b ELSE a END AS partner, shared, CASE WHEN a = u THEN commits_a ELSE commits_b END AS target_commits, CASE WHEN a = u THEN commits_b ELSE commits_a END AS partner_commits, degree, weighted,
round(shared / CASE WHEN a = u THEN commits_a ELSE commits_b END * 100, 6) AS couple, round(shared / CASE WHEN a = u THEN commits_b ELSE commits_a END * 100, 6) AS reverse FROM c, t WHERE a = u OR b = u""")
def coupling_for(spark, d):
    changes, head = _users(spark, d)
    target = changes.agg(F.min("path")).first()[0]
    return _rounded(history.coupling_for(history.coupling(changes, head, max_files=20), target), "degree", "couple", "reverse")


@query(f"""WITH c AS ({_coupling_sql(30, _PARTS_OF, _PART_HEAD)}),
t AS (SELECT min(a) AS u FROM c)
SELECT CASE WHEN a = u THEN b ELSE a END AS partner, shared, CASE WHEN a = u THEN commits_a ELSE commits_b END AS target_commits, CASE WHEN a = u THEN commits_b ELSE commits_a END AS partner_commits, degree, weighted,
round(shared / CASE WHEN a = u THEN commits_a ELSE commits_b END * 100, 6) AS couple, round(shared / CASE WHEN a = u THEN commits_b ELSE commits_a END * 100, 6) AS reverse FROM c, t WHERE a = u OR b = u""")
def coupling_for_parts(spark, d):
    """Over orders and parts: an order has as many parts in a large table as in a small one, so the cap empties none."""
    pairs = history.coupling(_touched(spark, d), _head(spark, d))
    target = pairs.agg(F.min("a")).first()[0]
    return _rounded(history.coupling_for(pairs, target), "degree", "couple", "reverse")


_BUCKET = "CASE WHEN w > 0 THEN greatest(0, least({n} - 1, (epoch_us(ts) - s) // w)) ELSE 0 END"
_WINDOW = "(SELECT min(epoch_us(ts)) AS s, (max(epoch_us(ts)) - min(epoch_us(ts))) // {n} AS w FROM events)"
BUCKETS = 60


@query(f"SELECT user_id, CAST({_BUCKET.format(n=BUCKETS)} AS INTEGER) AS bucket, count(*) AS commits, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS delta FROM events, {_WINDOW.format(n=BUCKETS)} GROUP BY 1, 2")
def author_timeline(spark, d):
    return history.timeline(load(spark, d, "events"), "user_id", "ts", F.round("value").cast("long"), BUCKETS)


@query(f"""WITH t AS (SELECT event_type, CAST({_BUCKET.format(n=BUCKETS)} AS INTEGER) AS bucket, count(*) AS commits, sum(CAST(round(value) AS BIGINT) - 50) AS delta FROM events, {_WINDOW.format(n=BUCKETS)} GROUP BY 1, 2),
g AS (SELECT DISTINCT event_type, b.bucket FROM t, (SELECT CAST(unnest(range({BUCKETS})) AS INTEGER) AS bucket) b),
f AS (SELECT g.event_type, g.bucket, coalesce(commits, 0) AS commits, CAST(coalesce(delta, 0) AS BIGINT) AS delta FROM g LEFT JOIN t USING (event_type, bucket)),
s AS (SELECT *, sum(delta) OVER (PARTITION BY event_type ORDER BY bucket) AS total FROM f)
SELECT event_type, bucket, commits, delta, CAST(total - least(0, min(total) OVER (PARTITION BY event_type ORDER BY bucket)) AS BIGINT) AS code FROM s""")
def language_timeline(spark, d):
    series = history.timeline(load(spark, d, "events"), "event_type", "ts", F.round("value").cast("long") - 50, BUCKETS)
    return history.trajectory(history.dense(series, "event_type", BUCKETS), "event_type")


_START_SQL = "(SELECT event_type, CAST(count(*) AS BIGINT) AS code FROM events WHERE event_type < 'p' GROUP BY 1 UNION ALL SELECT r_name, CAST(r_regionkey * 100 AS BIGINT) FROM region)"


@query(f"""WITH t AS (SELECT event_type, CAST({_BUCKET.format(n=BUCKETS)} AS INTEGER) AS bucket, count(*) AS commits, sum(CAST(round(value) AS BIGINT) - 50) AS delta FROM events, {_WINDOW.format(n=BUCKETS)} GROUP BY 1, 2),
g AS (SELECT event_type, b.bucket FROM (SELECT event_type FROM t UNION SELECT event_type FROM {_START_SQL}), (SELECT CAST(unnest(range({BUCKETS})) AS INTEGER) AS bucket) b),
f AS (SELECT g.event_type, g.bucket, coalesce(commits, 0) AS commits, CAST(coalesce(delta, 0) AS BIGINT) AS delta, coalesce(code, 0) AS start FROM g LEFT JOIN t USING (event_type, bucket) LEFT JOIN {_START_SQL} USING (event_type)),
s AS (SELECT *, start + sum(delta) OVER (PARTITION BY event_type ORDER BY bucket) AS total FROM f)
SELECT event_type, bucket, commits, delta, CAST(total - least(0, min(total) OVER (PARTITION BY event_type ORDER BY bucket)) AS BIGINT) AS code FROM s""")
def language_timeline_baseline(spark, d):
    """Kinds of events with lines from before the window; regions have only those."""
    events = load(spark, d, "events")
    series = history.dense(history.timeline(events, "event_type", "ts", F.round("value").cast("long") - 50, BUCKETS), "event_type", BUCKETS)
    before = events.where("event_type < 'p'").groupBy("event_type").agg(F.count(F.lit(1)).alias("code"))
    only = load(spark, d, "region").select(F.col("r_name").alias("event_type"), (F.col("r_regionkey") * 100).cast("long").alias("code"))
    return history.trajectory(series, "event_type", before.unionByName(only))


@query(f"""WITH t AS (SELECT user_id, CAST({_BUCKET.format(n=BUCKETS)} AS INTEGER) AS bucket, count(*) AS commits, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS delta FROM events, {_WINDOW.format(n=BUCKETS)} GROUP BY 1, 2),
r AS (SELECT user_id, row_number() OVER (ORDER BY sum(commits) DESC, user_id) AS n FROM t GROUP BY 1)
SELECT CASE WHEN n <= 15 THEN CAST(user_id AS VARCHAR) ELSE 'others (' || CAST((SELECT count(*) FROM r) - 15 AS VARCHAR) || ')' END AS user_id, CAST(least(n, 16) AS INTEGER) AS rank, bucket,
CAST(sum(commits) AS BIGINT) AS commits, CAST(sum(delta) AS BIGINT) AS delta FROM t JOIN r USING (user_id) GROUP BY 1, 2, 3""")
def author_timeline_folded(spark, d):
    """The fifteen busiest and the others together: the report's length."""
    series = history.timeline(load(spark, d, "events"), "user_id", "ts", F.round("value").cast("long"), BUCKETS)
    return history.fold_series(series, "user_id", [F.desc("commits")], ["commits", "delta"])


def _owned(spark, d):
    """Quantities of parts by supplier as lines that an author touched last."""
    q = F.col("l_quantity").cast("long")
    return load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author_id")).agg(F.sum(q).alias("code"), F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0)).alias("comment"), F.count(F.lit(1)).alias("complexity"))


_OWNED_SQL = "(SELECT l_partkey AS path, l_suppkey AS author_id, sum(CAST(l_quantity AS BIGINT)) AS code, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS comment, count(*) AS complexity FROM lineitem GROUP BY 1, 2)"
_PLURALITY_SQL = f"SELECT path, author_id, CAST(code AS BIGINT) AS code FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY (author_id = 1)::INT, code DESC, author_id) AS r FROM {_OWNED_SQL} WHERE code > 0) WHERE r = 1"
_OWNERS_SQL = f"""SELECT author_id, CAST(o.code AS BIGINT) AS code, CAST(comment AS BIGINT) AS comment, CAST(complexity AS BIGINT) AS complexity, coalesce(files, 0) AS files,
round(o.code / sum(o.code) OVER () * 100, 8) AS owns_percent, round(CASE WHEN author_id = 1 THEN 0 ELSE o.code / sum(CASE WHEN author_id = 1 THEN 0 ELSE o.code END) OVER () * 100 END, 8) AS in_window_percent
FROM (SELECT author_id, sum(code) AS code, sum(comment) AS comment, sum(complexity) AS complexity FROM {_OWNED_SQL} GROUP BY 1) o LEFT JOIN (SELECT author_id, count(*) AS files FROM ({_PLURALITY_SQL}) GROUP BY 1) USING (author_id)"""


@query(_PLURALITY_SQL)
def plurality_owner(spark, d):
    return history.plurality(_owned(spark, d), 1)


@query(_OWNERS_SQL)
def ownership_percent(spark, d):
    return _with_8(history.ownership(_owned(spark, d), 1))


def _with_8(df):
    return df.withColumns({c: F.round(c, 8) for c in ("owns_percent", "in_window_percent")})


@query(f"SELECT count(*) AS bus_factor FROM (SELECT coalesce(sum(in_window_percent) OVER (ORDER BY code DESC, author_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({_OWNERS_SQL}) WHERE code > 0 AND author_id <> 1) WHERE b <= 50")
def bus_factor(spark, d):
    return history.bus_factor(_with_8(history.ownership(_owned(spark, d), 1)).where(F.col("author_id") != 1))


@query(f"SELECT CASE WHEN r <= 15 THEN CAST(author_id AS VARCHAR) ELSE 'others (' || CAST((SELECT count(*) FROM ({_OWNERS_SQL})) - 15 AS VARCHAR) || ')' END AS author_id, CAST(sum(code) AS BIGINT) AS code, CAST(sum(files) AS BIGINT) AS files FROM (SELECT *, row_number() OVER (ORDER BY code DESC, author_id) AS r FROM ({_OWNERS_SQL})) GROUP BY 1")
def owners_folded(spark, d):
    rows = history.ownership(_owned(spark, d), 1).select("author_id", "code", "files")
    out = history.fold_tail(rows, "author_id", [F.desc("code"), F.col("author_id")], ["code", "files"])
    return out.select("author_id", *[F.col(c).cast("long").alias(c) for c in ("code", "files")])


@query(f"SELECT language, location, lines, CAST(rank AS INTEGER) AS rank FROM (SELECT language, location, lines, row_number() OVER (PARTITION BY language ORDER BY lines DESC, location) AS rank FROM {FILES_SQL}) WHERE rank <= 10")
def top_files_per_language(spark, d):
    """Ten files of each language: a report that has this length."""
    return rollup.top_files(files(spark, d).select("language", "location", "lines"), 10)


METRICS = ("files", "lines", "code", "comment", "blank", "complexity", "bytes")


@query(" UNION ALL ".join(f"SELECT '{m}{'s' if m in ('comment', 'blank') else ''}' AS metric, language, CAST({m} AS BIGINT) AS value FROM ({SUMMARY_SQL})" for m in METRICS))
def openmetrics_rows(spark, d):
    s = rollup.by_language(files(spark, d))
    pairs = F.array(*[F.struct(F.lit(m + "s" * (m in ("comment", "blank"))).alias("metric"), F.col(m).cast("long").alias("value")) for m in METRICS])
    return s.select("language", F.explode(pairs).alias("m")).select("m.metric", "language", "m.value")


@query("SELECT CAST(o_custkey AS VARCHAR) AS author, CAST(epoch_us(max(o_orderdate)) AS BIGINT) AS last_commit, count(*) AS commits FROM orders GROUP BY 1")
def last_commits(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("author")).agg(F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("last_commit"), F.count(F.lit(1)).alias("commits"))


@query()
def pages_html_counts(spark, d):
    pages = load(spark, d, "pages").select("page_id", F.lit("HTML").alias("language"), F.col("html").alias("content"))
    return classify.count_files(pages).drop("content")


_NAMES = ("a.txt", "b.html", "Makefile", "d.json", "run", ".gitignore", "x.d.ts", "q.of-no-language")
_KEYWORDS = " + ".join(f"CAST(contains(text, '{k}') AS INTEGER)" for k in dict.fromkeys(rules.table()["CloudFormation (JSON)"].keywords))


@query(f"""SELECT doc_id, source || '/' || name AS location, CASE WHEN name LIKE '%.d.ts' THEN 'd.ts' WHEN name LIKE 'q.%' THEN 'of-no-language' WHEN name LIKE '_.%' THEN split_part(name, '.', 2) ELSE name END AS extension,
CASE name WHEN 'a.txt' THEN 'Plain Text' WHEN 'b.html' THEN 'HTML' WHEN 'd.json' THEN CASE WHEN {_KEYWORDS} >= 3 THEN 'CloudFormation (JSON)' ELSE 'JSON' END WHEN 'run' THEN 'Python'
WHEN '.gitignore' THEN 'gitignore' WHEN 'x.d.ts' THEN 'TypeScript Typings' WHEN 'Makefile' THEN 'Makefile' ELSE 'Unknown' END AS language
FROM (SELECT *, {list(_NAMES)}[CAST(doc_id % {len(_NAMES)} AS INTEGER) + 1] AS name FROM documents)""")
def detect_language(spark, d):
    """Documents under invented names, told apart by name, first line and content."""
    name = F.get(F.array(*[F.lit(x) for x in _NAMES]), (F.col("doc_id") % len(_NAMES)).cast("int"))
    docs = load(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", name).alias("location"), name.alias("filename"), F.concat(F.lit("#!/usr/bin/env python3\n"), "text").alias("content"))
    return detect.detect(docs, keep_unknown=True).select("doc_id", "location", "extension", "language")


@query()
def cognitive_complexity(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.lit("Python").alias("language"), F.col("text").alias("content"))
    return classify.count_files(docs).select("doc_id", "lines", "code", "comment", "blank", "complexity", "cognitive")


@query("""WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS seq, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS author_id, greatest(CAST(floor(o_totalprice / 10000) AS BIGINT), 1) AS n FROM orders),
r AS (SELECT *, first_value(n) OVER w + 2 AS size, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM c WINDOW w AS (PARTITION BY path ORDER BY seq DESC)),
k AS (SELECT path, author_id, least(n, greatest(size - newer, 0)) AS lines, size FROM r),
o AS (SELECT path, author_id, lines FROM k UNION ALL SELECT path, -1, min(size) - sum(lines) FROM k GROUP BY path)
SELECT path, CAST(author_id AS BIGINT) AS author_id, CAST(sum(lines) AS BIGINT) AS code, CAST(0 AS BIGINT) AS comment, CAST(0 AS BIGINT) AS complexity FROM o WHERE lines > 0 GROUP BY 1, 2""")
def blame_replay(spark, d):
    """Orders of a customer as commits that put as many lines in front as they cost ten thousands, and leave two more of
    the file: the newest commit's lines, then those before it, and of a file that had fewer, lines from before the window."""
    n = F.greatest(F.floor(F.col("o_totalprice") / 10_000), F.lit(1)).cast("int")
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("path"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("author_id"), n.alias("n"))
    span = lambda c: F.array(F.struct(F.lit(1).alias("start"), c.alias("count")))
    changes = orders.select("seq", "path", "author_id", span(n := F.col("n")).alias("added"), F.array().cast("array<struct<start:int,count:int>>").alias("removed"), F.array_repeat(F.lit(1), n + 2).alias("line_types"), F.array_repeat(F.lit(0), n + 2).alias("complexity"))
    return blame.owned_lines(blame.replay(changes))


def _chain(spark, d):
    """Renames of parts, in chains of two: 5k + 1 became 5k + 2, which became 5k + 3."""
    part = F.col("p_partkey")
    moved = load(spark, d, "part").where((part % 5).isin(1, 2))
    return history.rename_map(moved.select(part.alias("seq"), F.lit(0).alias("change_idx"), part.cast("string").alias("from_path"), (part + 1).cast("string").alias("path")))


_NOW = "CAST(CASE WHEN {p} % 5 IN (1, 2) THEN {p} - {p} % 5 + 3 ELSE {p} END AS VARCHAR)"
_text_path = lambda df: df.withColumn("path", F.col("path").cast("string"))


@query(f"""WITH c AS (SELECT l_orderkey AS seq, {_NOW.format(p="l_partkey")} AS path, sum(CAST(l_quantity AS BIGINT)) AS n, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS code FROM lineitem GROUP BY 1, 2, l_partkey),
r AS (SELECT c.path, p_brand AS language, CAST(p_size AS BIGINT) AS complexity, count(*) AS commits, CAST(sum(n) AS BIGINT) AS lines_changed, count(DISTINCT o_custkey) AS authors, CAST(sum(code) AS BIGINT) AS code_churn, CAST(sum(n - code) AS BIGINT) AS comment_churn
FROM c JOIN orders ON seq = o_orderkey JOIN part ON c.path = CAST(p_partkey AS VARCHAR) WHERE p_size > 10 GROUP BY 1, 2, 3),
s AS (SELECT *, complexity * commits / max(complexity * commits) OVER () * 100 AS score FROM r)
SELECT * REPLACE (round(score, 6) AS score) FROM s ORDER BY s.score DESC, path LIMIT 50""")
def hotspots_renamed(spark, d):
    """The first fifty after renames, the changes of old names counted with the last one."""
    moved = history.follow(_text_path(_changes(spark, d)), _chain(spark, d), "path")
    return history.hotspots(moved, _text_path(_head(spark, d))).orderBy(F.desc("score"), "path").limit(50).withColumn("score", F.round("score", 6))


_MOVED_PAIRS = f"""WITH f AS (SELECT DISTINCT l_orderkey AS seq, CAST(l_partkey AS VARCHAR) AS path, {_NOW.format(p="l_partkey")} AS now FROM lineitem), s AS (SELECT seq FROM f GROUP BY seq HAVING count(*) BETWEEN 2 AND 30),
p AS (SELECT least(x.now, y.now) AS a, greatest(x.now, y.now) AS b, count(*) AS shared FROM f x JOIN f y ON x.seq = y.seq AND x.path < y.path WHERE x.seq IN (SELECT seq FROM s) AND x.now <> y.now GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT now, p_size AS complexity, count(*) AS n FROM f JOIN part ON now = CAST(p_partkey AS VARCHAR) WHERE p_size > 10 GROUP BY 1, 2)
SELECT a, b, shared, x.n AS commits_a, y.n AS commits_b, shared / (x.n + y.n - shared) * 100 AS degree, CAST(shared * least(x.complexity, y.complexity) AS BIGINT) AS weighted FROM p JOIN t x ON a = x.now JOIN t y ON b = y.now"""


@query(f"SELECT * REPLACE (round(degree, 6) AS degree) FROM ({_MOVED_PAIRS})")
def coupling_renamed(spark, d):
    return _rounded(history.coupling(_text_path(_touched(spark, d)), _text_path(_head(spark, d)), renames=_chain(spark, d)), "degree")


@query(f"SELECT * REPLACE (round(degree, 6) AS degree) FROM (SELECT * FROM ({_MOVED_PAIRS}) ORDER BY shared DESC, degree DESC, a, b LIMIT 15)")
def coupling_overview(spark, d):
    """The first fifteen, as the overview has them."""
    pairs = history.coupling(_text_path(_touched(spark, d)), _text_path(_head(spark, d)), renames=_chain(spark, d))
    return _rounded(history.order_coupling(pairs).limit(15), "degree")


_PEOPLE = """WITH c AS (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 50 = 2 THEN 'root' ELSE 'c' || (o_custkey % 50) END AS author, 'M' || (o_custkey % 7) || '@' || CASE o_custkey % 3 WHEN 0 THEN 'a.example' WHEN 1 THEN 'x.B.example' ELSE 'c.example' END AS email FROM orders),
m AS (SELECT seq, CASE WHEN author = 'c1' AND lower(email) = 'm1@x.b.example' THEN 'One' WHEN lower(email) = 'm4@x.b.example' THEN 'Mapped' ELSE author END AS author, CASE WHEN author = 'c1' AND lower(email) = 'm1@x.b.example' THEN 'one@d.example' ELSE email END AS email FROM c),
g AS (SELECT min(seq) AS author_id, arg_min(author, seq) AS author, arg_min(email, seq) AS email, count(*) AS commits FROM m GROUP BY lower(author), CASE WHEN author = 'root' THEN email ELSE lower(split_part(email, '@', 2)) END),
d AS (SELECT *, lower(split_part(email, '@', 2)) AS domain, CASE WHEN email LIKE '%@x.B.%' THEN 'b.example' ELSE lower(split_part(email, '@', 2)) END AS short FROM g),
n AS (SELECT author, count(*) AS n, count(DISTINCT short) AS n1, count(DISTINCT domain) AS n2 FROM d GROUP BY author)
SELECT author_id, author, email, commits, CASE WHEN n = 1 THEN author ELSE author || ' (' || CASE WHEN n1 = n THEN short WHEN n2 = n THEN domain ELSE email END || ')' END AS display FROM d JOIN n USING (author)"""


@query(_PEOPLE)
def identities(spark, d):
    """Customers as authors: a mailmap by name and mail and by mail alone, folded by mail domain, names told apart."""
    who = F.col("o_custkey")
    host = F.when(who % 3 == 0, "a.example").when(who % 3 == 1, "x.B.example").otherwise("c.example")
    name = F.when(who % 50 == 2, "root").otherwise(F.concat(F.lit("c"), (who % 50).cast("string")))
    log = load(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), name.alias("author"), F.concat(F.lit("M"), (who % 7).cast("string"), F.lit("@"), host).alias("email"))
    entries = [("c1", "m1@X.b.example", "One", "one@d.example"), (None, "m4@x.b.example", "Mapped", "")]
    mailmap = spark.createDataFrame(entries, "commit_name string, commit_email string, proper_name string, proper_email string")
    people = history.identities(log, mailmap).groupBy("author_id", "author", "email").agg(F.count(F.lit(1)).alias("commits"))
    return history.disambiguate(people)


@query(f"""WITH f AS (SELECT *, {_MARKED} AS generated FROM {FILES_SQL}), k AS (SELECT min(location) AS location FROM f GROUP BY bytes, sha256(content))
SELECT location, CAST(bytes AS BIGINT) AS bytes, lines FROM f WHERE location IN (SELECT location FROM k) AND NOT generated AND NOT (lines > 0 AND bytes // lines >= 255) AND lines < 40""")
def drops_in_order(spark, d):
    """Copies, minified, generated and long files dropped; a copy's keeper is chosen before the others go."""
    rows = files(spark, d).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    marked = rows.withColumn("minified", text.minified(F.col("bytes"), F.col("lines"), F.col("generated")))
    return rollup.drop_in_order(marked, True, True, True, 40).select("location", "bytes", "lines")


_PATHS_SQL = "(SELECT doc_id, source || '/' || (doc_id % 10) || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.lock' WHEN 2 THEN '.d.ts' ELSE '' END AS location FROM documents)"
_IGNORE = "*.lock\n!*5.lock\n/src1/3/\n7/\nsrc2/**/1*\n# a comment\n/src3/*.txt"


@query(rf"""SELECT location, regexp_extract(location, '^(.*/)', 1) AS directory, CASE WHEN regexp_matches(location, '^src2/(.*/)?1[^/]*(/|$)') THEN true WHEN location LIKE '%/7/%' OR location LIKE 'src1/3/%' THEN true WHEN suffix(location, '5.lock') THEN false ELSE suffix(location, '.lock') END AS ignored,
CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'lock' WHEN 2 THEN 'd.ts' ELSE CAST(doc_id AS VARCHAR) END AS extension FROM {_PATHS_SQL}""")
def ignore_rules(spark, d):
    """Invented paths: their folder, extension, and whether rules of an ignore file leave them out."""
    n = F.col("doc_id")
    end = F.when(n % 4 == 0, ".txt").when(n % 4 == 1, ".lock").when(n % 4 == 2, ".d.ts").otherwise("")
    name = F.concat(n.cast("string"), end)
    rows = load(spark, d, "documents").select(F.concat_ws("/", "source", (n % 10).cast("string"), name).alias("location"), name.alias("name"))
    rules_ = ignore.Ignore([("", ignore.parse(_IGNORE))])
    return rows.select("location", text.directory(F.col("location")).alias("directory"), ignore.ignored(F.col("location"), rules_).alias("ignored"), text.extension(F.col("name")).alias("extension"))


@query(f"SELECT location, CAST(bytes AS BIGINT) AS bytes FROM {FILES_SQL} ORDER BY bytes DESC, location LIMIT 50")
def files_by_bytes(spark, d):
    return rollup.sort_files(files(spark, d), "bytes").limit(50).select("location", "bytes")


@query(r"""SELECT doc_id, sha256(replace(text, chr(39), chr(39) || chr(39))) AS sql_sha256, sha256(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n')) AS label_sha256 FROM documents""")
def escapes(spark, d):
    """Texts as literals of SQL and as labels of metrics (the tables' texts have no NUL)."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return load(spark, d, "documents").select("doc_id", digest(text.sql_escape(F.col("text"))).alias("sql_sha256"), digest(text.label_escape(F.col("text"))).alias("label_sha256"))


QUERIES = {name: f for name, (f, _) in _Q.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _Q.items() if sql}
