"""Reports over a history of commits: hotspots, coupling, owners, timelines.

Inputs are tables: ``commits`` (seq, author, email, when), ``changes`` (seq, path, ...), ``head`` (path, language,
complexity). Every report is a plan of joins and aggregates.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linespan.functions.buckets import bucket, micros

#: Pairs shared fewer times are left out, and larger commits pair no files.
MIN_SHARED, MAX_FILES = 2, 30
#: Shares that make the bus factor, authors that a report lists, commits of the default window.
BUS_PERCENT, LISTED, DEPTH = 50.0, 15, 1000
#: Entries up to which a mailmap is broadcast.
BROADCAST_ROWS = 50_000
#: Names that many people have; they are never folded by their mail domain.
UNFOLDED = ["", "unknown", "root", "user", "admin", "dev", "developer", "guest", "nobody", "none"]


class Observer(Protocol):
    """A report that others bring along."""

    def report(self, commits: DataFrame, changes: DataFrame, head: DataFrame) -> DataFrame: ...


def survivors(rows: DataFrame, head: DataFrame) -> DataFrame:
    return rows.join(head.select("path"), "path", "left_semi")


def window_commits(commits: DataFrame, depth: int = DEPTH, time: str = "when") -> DataFrame:
    """The newest ``depth`` commits (0: all), numbered by seq from 0, the oldest. A limited window fits into one task;
    all commits are numbered by ranges of time, each from where the one before ends."""
    if depth:
        newest = commits.orderBy(F.desc(time), F.desc("hash")).limit(depth)
        return newest.withColumn("seq", F.row_number().over(Window.partitionBy().orderBy(time, "hash")).cast("long") - 1)
    day = F.to_date(time)
    sizes = commits.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy().orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inner = Window.partitionBy(day).orderBy(time, "hash")
    return commits.withColumn("_in", F.row_number().over(inner)).join(starts, day == F.col("_day")).withColumn("seq", (F.col("_from") + F.col("_in") - 1).cast("long")).drop("_in", "_day", "_from")


def range_lines(ranges: Column) -> Column:
    """Lines in an array of (start, count)."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + r["count"])


def lines_of_type(ranges: Column, types: Column, kind: int) -> Column:
    """Lines of a class in an array of (start, count), starts from 1; what lies outside is ignored."""

    def own(r: Column) -> Column:
        first = F.greatest(r["start"], F.lit(1))
        n = F.greatest(r["count"] - (first - r["start"]), F.lit(0))
        return F.size(F.filter(F.slice(types, first, n), lambda x: x == kind))

    return F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + own(r))


def resolve_mail(commits: DataFrame, mailmap: DataFrame | None) -> DataFrame:
    """author and email by a mailmap (commit_name or null, commit_email, proper_name, proper_email): an entry for name
    and mail goes before one for the mail; empty proper fields keep the commit's."""
    if mailmap is None:
        return commits
    m = mailmap.select(F.col("commit_name").alias("_n"), F.lower("commit_email").alias("_e"), F.nullif("proper_name", F.lit("")).alias("_pn"), F.nullif("proper_email", F.lit("")).alias("_pe"))
    few = F.broadcast if mailmap.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    both = few(m.where(F.col("_n").isNotNull()).dropDuplicates(["_n", "_e"]))
    mail = few(m.where(F.col("_n").isNull()).dropDuplicates(["_e"]).select(F.col("_e").alias("_e2"), F.col("_pn").alias("_pn2"), F.col("_pe").alias("_pe2"), F.lit(True).alias("_by_mail")))
    out = commits.join(both, (F.col("author") == F.col("_n")) & (F.lower("email") == F.col("_e")), "left").join(mail, F.lower("email") == F.col("_e2"), "left")
    hit = F.col("_n").isNotNull()
    name = F.when(hit, F.coalesce("_pn", "author")).otherwise(F.coalesce("_pn2", "author"))
    address = F.when(hit, F.coalesce("_pe", "email")).otherwise(F.coalesce("_pe2", "email"))
    return out.withColumns({"author": name, "email": address}).drop("_n", "_e", "_pn", "_pe", "_e2", "_pn2", "_pe2", "_by_mail")


def identities(commits: DataFrame, mailmap: DataFrame | None = None, fold: bool = True) -> DataFrame:
    """``commits`` with author_key, and name and email of the identity's first commit. Commits of one name and one mail
    domain are one person, unless the name is one that many share."""
    from linespan.functions.text import email_domain

    c = resolve_mail(commits, mailmap)
    domain = email_domain(F.col("email"))
    exact = F.concat_ws("\0", F.lit("x"), "author", "email")
    key = F.when((domain != "") & ~F.lower("author").isin(*UNFOLDED), F.concat_ws("\0", F.lit("d"), F.lower("author"), domain)).otherwise(exact) if fold else exact
    keyed = c.withColumn("author_key", key)
    first = keyed.groupBy("author_key").agg(F.min_by(F.struct("author", "email"), "seq").alias("_first"), F.min("seq").alias("author_id"))
    return keyed.drop("author", "email").join(first, "author_key").select(*[x for x in keyed.columns if x not in ("author", "email")], F.col("_first.author").alias("author"), F.col("_first.email").alias("email"), "author_id")


def hotspots(changes: DataFrame, head: DataFrame) -> DataFrame:
    """path, language, complexity, commits, lines_changed, authors, code_churn, comment_churn, score for each path that is
    still there. ``changes``: seq, path, author_key, lines_changed, code_churn, comment_churn. The score is complexity
    times commits, the highest being 100."""
    each = changes.groupBy("path").agg(F.count(F.lit(1)).alias("commits"), *[F.sum(c).cast("long").alias(c) for c in ("lines_changed", "code_churn", "comment_churn")], F.count_distinct("author_key").alias("authors"))
    return scored(each, head)


def scored(each: DataFrame, head: DataFrame) -> DataFrame:
    """``hotspots`` from a row for each path: path, commits, lines_changed, code_churn, comment_churn, authors."""
    raw = each.join(head.select("path", "language", "complexity"), "path").withColumn("_raw", F.col("complexity") * F.col("commits"))
    most = raw.agg(F.max("_raw").alias("_most"))  # one row
    score = F.when(F.col("_most") > 0, F.col("_raw") / F.col("_most") * 100).otherwise(0.0)
    return raw.join(F.broadcast(most)).select("path", "language", "complexity", "commits", "lines_changed", "authors", "code_churn", "comment_churn", score.alias("score"))


def rename_map(changes: DataFrame, hops: int = 64) -> DataFrame:
    """(old, new): where each renamed path ended up. ``changes`` has seq, change_idx, from_path, path; the last rename of
    a path counts, and chains are followed for ``hops`` steps, twice as far in each round."""
    moved = changes.where(F.col("from_path").isNotNull() & (F.col("from_path") != "") & (F.col("from_path") != F.col("path")))
    step = moved.groupBy(F.col("from_path").alias("old")).agg(F.max_by("path", F.struct("seq", "change_idx")).alias("new"))
    done = 1
    while done < hops:
        ahead = step.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        further = step.join(ahead, F.col("new") == F.col("_old"), "left")
        if not further.where(F.col("_new").isNotNull() & (F.col("_new") != F.col("new"))).limit(1).count():
            break
        step = further.select("old", F.coalesce("_new", "new").alias("new"))
        done *= 2
    return step


def follow(rows: DataFrame, renames: DataFrame | None, *columns: str) -> DataFrame:
    """``rows`` with paths in these columns replaced by what they were renamed to."""
    for c in columns if renames is not None else ():
        r = renames.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        rows = rows.join(r, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return rows


def coupling_files(changes: DataFrame) -> DataFrame:
    """Distinct (seq, path)."""
    return changes.select("seq", "path").distinct()


def coupling_pairs(changes: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """(a, b, shared) with a < b for files of one commit, for commits of 2 to ``max_files`` files. Commits that are too
    large leave before anything is paired, so a commit makes max_files * (max_files - 1) / 2 pairs at most."""
    files = coupling_files(changes)
    small = files.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_files)).select("seq")
    own = files.join(small, "seq", "left_semi")
    other = own.select("seq", F.col("path").alias("b"))
    return own.select("seq", F.col("path").alias("a")).join(other, "seq").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def coupling(changes: DataFrame, head: DataFrame, max_files: int = MAX_FILES, min_shared: int = MIN_SHARED, renames: DataFrame | None = None) -> DataFrame:
    """a, b, shared, commits_a, commits_b, degree, weighted for pairs of files that are still there. degree is shared /
    (commits_a + commits_b - shared) in per cent, weighted is shared times the smaller complexity."""
    pairs = coupling_pairs(changes, max_files)
    totals = coupling_files(changes).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    if renames is not None:
        pairs = follow(pairs, renames, "a", "b").where(F.col("a") != F.col("b"))
        pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("shared").cast("long").alias("shared"))
        totals = follow(totals, renames, "path").groupBy("path").agg(F.sum("n").cast("long").alias("n"))
    alive = totals.join(head.select("path", "complexity"), "path")
    side = lambda s: alive.select(F.col("path").alias(s), F.col("n").alias(f"commits_{s}"), F.coalesce("complexity", F.lit(0)).alias(f"_{s}"))
    found = pairs.where(F.col("shared") >= min_shared).join(side("a"), "a").join(side("b"), "b")
    either = F.col("commits_a") + F.col("commits_b") - F.col("shared")
    return found.select("a", "b", "shared", "commits_a", "commits_b", F.when(either > 0, F.col("shared") / either * 100).otherwise(0.0).alias("degree"), (F.col("shared") * F.least("_a", "_b")).cast("long").alias("weighted"))


def order_coupling(pairs: DataFrame, weighted: bool = False) -> DataFrame:
    return pairs.orderBy(*([F.desc("weighted")] if weighted else []), F.desc("shared"), F.desc("degree"), "a", "b")


def coupling_for(pairs: DataFrame, target: object) -> DataFrame:
    """The partners of one file: couple is the share of its commits, reverse of the partner's."""
    mine = F.col("a") == F.lit(target)
    rows = pairs.where(mine | (F.col("b") == F.lit(target)))
    rows = rows.select(F.when(mine, F.col("b")).otherwise(F.col("a")).alias("partner"), "shared", F.when(mine, F.col("commits_a")).otherwise(F.col("commits_b")).alias("target_commits"), F.when(mine, F.col("commits_b")).otherwise(F.col("commits_a")).alias("partner_commits"), "degree", "weighted")
    part = lambda of: F.when(F.col(of) > 0, F.col("shared") / F.col(of) * 100).otherwise(0.0)
    return rows.select("*", part("target_commits").alias("couple"), part("partner_commits").alias("reverse"))


def ownership(lines: DataFrame, sentinel: object = None) -> DataFrame:
    """author_id, code, comment, complexity, files, owns_percent, in_window_percent by last toucher. ``lines`` has path,
    author_id, code, comment, complexity (of the lines of a path an author touched last). The author ``sentinel`` stands
    for all before the window and doesn't count in the window's share."""
    whose = lines.groupBy("author_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("code", "comment", "complexity")])
    owned = plurality(lines, sentinel).groupBy("author_id").agg(F.count(F.lit(1)).alias("files"))
    rows = whose.join(owned, "author_id", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    inside = F.when(F.col("author_id").eqNullSafe(F.lit(sentinel)), 0).otherwise(F.col("code"))
    whole = whose.agg(F.sum("code").alias("_all"), F.sum(inside).alias("_in"))  # one row
    rows = rows.join(F.broadcast(whole))
    return rows.select("author_id", "code", "comment", "complexity", "files", F.when(F.col("_all") > 0, F.col("code") / F.col("_all") * 100).otherwise(0.0).alias("owns_percent"), F.when((F.col("_in") > 0) & ~F.col("author_id").eqNullSafe(F.lit(sentinel)), F.col("code") / F.col("_in") * 100).otherwise(0.0).alias("in_window_percent"))


def plurality(lines: DataFrame, sentinel: object = None) -> DataFrame:
    """(path, author_id, code): who has most code of a path; authors go before the sentinel, then the smaller id wins."""
    each = lines.groupBy("path", "author_id").agg(F.sum("code").cast("long").alias("code")).where(F.col("code") > 0)
    rank = F.struct((F.lit(0) - F.col("author_id").eqNullSafe(F.lit(sentinel)).cast("int")).alias("own"), F.col("code"), (-F.col("author_id")).alias("id"))
    return each.groupBy("path").agg(F.max(rank).alias("_best")).select("path", (-F.col("_best.id")).alias("author_id"), F.col("_best.code").alias("code"))


def bus_factor(owners: DataFrame) -> DataFrame:
    """The fewest authors, by code, who have over half of the window's code: a row with bus_factor. ``owners`` has
    author_id, code, in_window_percent; there is a row for each author, so one task adds them up."""
    order = Window.partitionBy().orderBy(F.desc("code"), "author_id")
    before = F.coalesce(F.sum("in_window_percent").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return owners.where(F.col("code") > 0).withColumn("_before", before).where(F.col("_before") <= BUS_PERCENT).agg(F.count(F.lit(1)).alias("bus_factor"))


def bounds(rows: DataFrame, ts: str) -> DataFrame:
    """One row: start and end in microseconds."""
    return rows.agg(F.min(micros(F.col(ts))).alias("_start"), F.max(micros(F.col(ts))).alias("_end"))


def timeline(rows: DataFrame, who: str, ts: str, delta: Column, n: int) -> DataFrame:
    """(who, bucket, commits, delta) for each bucket that has rows."""
    at = bucket(F.col(ts), F.col("_start"), F.col("_end"), n)
    return rows.join(F.broadcast(bounds(rows, ts))).groupBy(F.col(who), at.alias("bucket")).agg(F.count(F.lit(1)).alias("commits"), F.sum(delta).cast("long").alias("delta"))


def dense(series: DataFrame, who: str, n: int) -> DataFrame:
    """All buckets of each series, those without rows with zeros."""
    grid = series.select(who).distinct().select(who, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    return grid.join(series, [who, "bucket"], "left").select(who, "bucket", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("delta", F.lit(0)).alias("delta"))


def trajectory(series: DataFrame, who: str, baseline: DataFrame | None = None) -> DataFrame:
    """``series`` with code: the running sum of delta from the baseline (who, code), never below 0 at any bucket, and
    what is cut off stays cut off. With S the plain running sum that is S - min(0, least S so far). Names that only the
    baseline has are there too."""
    s = series
    if baseline is not None:
        start = baseline.groupBy(who).agg(F.sum("code").alias("_base"))
        # what only the baseline has keeps its lines in all buckets
        last = series.agg(F.coalesce(F.max("bucket"), F.lit(0)).alias("_last"))  # one row
        still = start.join(series.select(who).distinct(), who, "left_anti").join(F.broadcast(last))
        zero = [F.lit(0).cast(series.schema[c].dataType).alias(c) for c in ("commits", "delta") if c in series.columns]
        names = [who, "bucket", *[c for c in ("commits", "delta") if c in series.columns]]
        s = series.select(*names).unionByName(still.select(who, F.explode(F.sequence(F.lit(0).cast(series.schema["bucket"].dataType), F.col("_last"))).alias("bucket"), *zero))
        s = s.join(start, who, "left")
    base = F.lit(0) if baseline is None else F.coalesce("_base", F.lit(0))
    so_far = Window.partitionBy(who).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = s.withColumn("_sum", base + F.sum("delta").over(so_far))
    return summed.withColumn("code", (F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far))).cast("long")).drop("_sum", "_base")


def fold_tail(rows: DataFrame, name: str, order: list[Column], sums: list[str], listed: int = LISTED) -> DataFrame:
    """The first ``listed`` rows; the others become one, 'others (N)'. For results with a row for each author."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy().orderBy(*order)))
    tail = ranked.where(F.col("_rank") > listed).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in sums]).where(F.col("_n") > 0)
    return ranked.where(F.col("_rank") <= listed).select(F.col(name).cast("string").alias(name), *sums).unionByName(tail.select(F.concat(F.lit("others ("), F.col("_n").cast("string"), F.lit(")")).alias(name), *sums))


def fold_series(series: DataFrame, name: str, order: list[Column], sums: list[str], listed: int = LISTED) -> DataFrame:
    """Timelines of the first ``listed`` names; those of the others are added up, bucket by bucket, as 'others (N)'.
    ``order`` is over the sums of each name. For results with a row for each name and bucket."""
    totals = series.groupBy(F.col(name).alias("_name")).agg(*[F.sum(c).alias(c) for c in sums])
    ranked = totals.select("_name", F.row_number().over(Window.partitionBy().orderBy(*order, "_name")).alias("_rank"))
    n = ranked.agg((F.count(F.lit(1)) - listed).alias("_others"))  # one row
    label = F.when(F.col("_rank") <= listed, F.col(name).cast("string")).otherwise(F.concat(F.lit("others ("), F.col("_others").cast("string"), F.lit(")")))
    told = series.join(ranked, F.col(name).eqNullSafe(F.col("_name"))).join(F.broadcast(n))
    return told.groupBy(label.alias(name), F.least("_rank", F.lit(listed + 1)).alias("rank"), "bucket").agg(*[F.sum(c).cast("long").alias(c) for c in sums])


def disambiguate(authors: DataFrame) -> DataFrame:
    """``authors`` (author, email) with display: names that several have are told apart by the shortest form of their mail
    that does so for all of them: the last two labels of its domain, the domain, or the whole address."""
    from linespan.functions.text import email_domain, registrable_domain

    domain = email_domain(F.coalesce("email", F.lit("")))
    forms = {"_f1": registrable_domain(domain), "_f2": domain, "_f3": F.coalesce("email", F.lit(""))}
    rows = authors.withColumns(forms)
    counts = rows.groupBy(F.col("author").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(F.nullif(f, F.lit(""))).alias(f"_n{f}") for f in forms])
    rows = rows.join(counts, F.col("author").eqNullSafe(F.col("_name")), "left")
    mark = F.when(F.col("_n_f1") == F.col("_n"), F.col("_f1")).when(F.col("_n_f2") == F.col("_n"), F.col("_f2")).otherwise(F.col("_f3"))
    display = F.when(F.col("_n") > 1, F.concat("author", F.lit(" ("), mark, F.lit(")"))).otherwise(F.col("author"))
    return rows.select(*authors.columns, display.alias("display"))
