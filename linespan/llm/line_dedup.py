"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

``references`` is the exact table, a row for each (line key, document). ``counts`` rolls it up to a row for each key:
how many documents hold it and which is the largest. Keys with enough references are in cuckoo filters, one for each
shard of the key space. A line is first looked up in its shard's filter, where it is; only lines that the filter lets
through are shuffled to meet the exact counts, so a false positive costs time and never a line.

``LineIndex`` keeps both between batches. A batch changes the references of its own documents, and its keys whose count
passes the limit on the way up are inserted into their shard's filter, those on the way down deleted from it. Lines that
fall below the limit thus return to the documents that had lost them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linespan.llm.common import materialise, shielded, small_batches

#: ASCII white space that is stripped from both ends of a line: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys that a shard of the key space holds about, and lines that meet a copy of its filter in one group.
SHARD_KEYS, GROUP_LINES = 20_000, 500_000
#: Filters of so many bytes in all go to where the lines are; of more, lines and filters meet by shard.
BROADCAST_BYTES = 32 << 20
#: Shards of an index that is changed by batches, and the keys in a filter's overflow from which on it is built anew.
INDEX_SHARDS, OVERFLOW = 256, 1_000
SLOTS = 4
KICKS = 500


class CuckooFilter:
    """A cuckoo filter over unsigned 64-bit keys: 16-bit fingerprints, 4 slots a bucket, partial-key cuckoo hashing.

    ``insert`` counts every call, so a key inserted twice must be deleted twice. No false negatives; keys that
    don't fit after ``KICKS`` evictions go to a small exact overflow list instead of being refused.
    """

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * 0.84 < max(capacity, 1):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.overflow: list[int] = []
        self._turn = 0

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def _places(self, keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self._mix(np.atleast_1d(np.asarray(keys, dtype=np.uint64)))
        mark = ((h >> np.uint64(48)).astype(np.int64) % 65535 + 1).astype(np.uint16)
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (self._mix(mark) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def insert(self, key: int) -> None:
        mark, a, b = (x[0] for x in self._places(key))
        for at in (a, b):
            if (free := np.flatnonzero(self.table[at] == 0)).size:
                self.table[at, free[0]] = mark
                return
        at, undo = a, []
        for _ in range(KICKS):
            self._turn = (self._turn + 1) % SLOTS
            undo.append((at, self._turn, self.table[at, self._turn]))
            mark, self.table[at, self._turn] = self.table[at, self._turn], mark
            at = self._other(np.array([at]), np.array([mark]))[0]
            if (free := np.flatnonzero(self.table[at] == 0)).size:
                self.table[at, free[0]] = mark
                return
        for at, slot, was in reversed(undo):
            self.table[at, slot] = was
        self.overflow.append(int(key))

    def insert_all(self, keys: np.ndarray) -> None:
        """As many calls of ``insert``; those that find room in their first bucket at once are placed together."""
        keys = np.asarray(keys, dtype=np.uint64)
        mark, a, _ = self._places(keys)
        order = np.argsort(a, kind="stable")
        start = np.r_[True, a[order][1:] != a[order][:-1]]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        slot = nth + np.count_nonzero(self.table[a[order]], axis=1)
        fits = slot < SLOTS if not self.table.size or not np.any(self.table) else np.zeros(len(order), bool)
        self.table[a[order][fits], slot[fits]] = mark[order][fits]
        for key in keys[order][~fits]:
            self.insert(int(key))

    def delete(self, key: int) -> bool:
        """Takes one insertion of ``key`` back; False if there was none."""
        if int(key) in self.overflow:
            self.overflow.remove(int(key))
            return True
        mark, a, b = (x[0] for x in self._places(key))
        for at in (a, b):
            if (found := np.flatnonzero(self.table[at] == mark)).size:
                self.table[at, found[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        if not len(keys):
            return np.zeros(0, bool)
        mark, a, b = self._places(keys)
        hit = (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)
        return hit | np.isin(keys, np.array(self.overflow, dtype=np.uint64)) if self.overflow else hit

    def to_bytes(self) -> bytes:
        return np.array([len(self.table)], dtype="<u8").tobytes() + self.table.astype("<u2").tobytes() + np.array(self.overflow, dtype="<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n = int(np.frombuffer(data[:8], "<u8")[0])
        out = cls(0)
        end = 8 + n * SLOTS * 2
        out.table = np.frombuffer(data[8:end], "<u2").reshape(n, SLOTS).astype(np.uint16)
        out.overflow = [int(x) for x in np.frombuffer(data[end:], "<u8")]
        return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line long enough to be judged: doc_id, row (tells rows of one doc_id apart), pos, and its key
    as two 64-bit hashes."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"))


def references(rows: DataFrame) -> DataFrame:
    """The exact table: a row for each (key, document), with the number of lines."""
    return rows.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)).alias("lines"))


def counts(refs: DataFrame) -> DataFrame:
    """A row for each key: in how many documents it is, and the largest of them. Counted in part before the shuffle."""
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("last_doc"))


def _shard(k1: Column, shards: int) -> Column:
    return F.pmod(k1, F.lit(shards)).cast("int")


def filters(eligible: DataFrame, shards: int, room: int = 0) -> DataFrame:
    """(shard, filter): a cuckoo filter for every shard that holds a key, with room for twice as many and ``room`` keys if
    there are to be more."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter(max(room, 2 * len(pdf)) if room else len(pdf))
        f.insert_all(pdf.k1.to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [f.to_bytes()]})

    return eligible.select("k1", _shard(F.col("k1"), shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def changed(kept: DataFrame, changes: DataFrame) -> DataFrame:
    """``kept`` (shard, filter) after ``changes`` (shard, k1, up): keys inserted, or deleted where up is false. A filter
    that isn't there yet starts with room for ``SHARD_KEYS``."""

    def change(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(SHARD_KEYS)
        for k1, up in zip(new.k1.to_numpy().view(np.uint64).tolist(), new.up, strict=True):
            if up:
                f.insert(k1)
            elif not f.delete(k1):
                raise ValueError("a key was to be deleted that the filter doesn't hold")
        return pd.DataFrame({"shard": [int(key[0])], "filter": [f.to_bytes()], "overflow": [len(f.overflow)]})

    return kept.select("shard", "filter").groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, "shard int, filter binary, overflow long")


def probed(rows: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """The ``rows`` that their shard's filter lets through."""
    dealt = rows.withColumn("shard", _shard(F.col("k1"), shards))
    schema = "doc_id long, row long, pos int, k1 long, k2 long"
    names = [c.split()[0] for c in schema.split(", ")]
    if (kept.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= BROADCAST_BYTES:
        small_batches(rows.sparkSession)
        shared = rows.sparkSession.sparkContext.broadcast({r.shard: bytes(r["filter"]) for r in kept.select("shard", "filter").collect()})

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {shard: CuckooFilter.from_bytes(data) for shard, data in shared.value.items()}
            for b in batches:
                k1, at = b.column("k1").to_numpy().view(np.uint64), b.column("shard").to_numpy()
                order = np.argsort(at, kind="stable")
                maybe = np.zeros(len(k1), bool)
                bounds = np.r_[0, np.flatnonzero(np.diff(at[order])) + 1, len(at)] if len(at) else np.zeros(1, int)
                for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                    if (f := held.get(int(at[order[low]]))) is not None:
                        maybe[order[low:high]] = f.contains(k1[order[low:high]])
                yield b.select(names).filter(pa.array(maybe))

        return dealt.mapInArrow(look, schema)

    def probe(key: tuple, lines: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        if lines.empty or blobs.empty:
            return lines.iloc[:0][names]
        return lines.loc[CuckooFilter.from_bytes(blobs["filter"].iloc[0]).contains(lines.k1.to_numpy().view(np.uint64)), names]

    # each shard's lines are dealt over groups of a bounded size, so a line that a third of all documents hold fills none
    dealt = materialise(dealt, "line-keys")
    groups = materialise(dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / GROUP_LINES).cast("int").alias("groups")), "line-groups")
    blobs = kept.select("shard", "filter").join(groups, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    groups = groups.withColumnRenamed("groups", "of")
    dealt = dealt.join(groups, "shard").select(*names, "shard", F.pmod(F.xxhash64("doc_id", "row", "pos"), F.col("of")).cast("int").alias("salt"))
    return dealt.groupBy("shard", "salt").cogroup(blobs.groupBy("shard", "salt")).applyInPandas(probe, schema)


def dropped_lines(rows: DataFrame, eligible: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """(doc_id, row, pos) of the lines that go: let through by the filters, then held against the exact counts. Lines of a
    key that many documents hold are split by adaptive execution, the counts being a row for each key."""
    found = probed(rows, kept, shards).join(eligible.select("k1", "k2", "last_doc"), ["k1", "k2"])
    return found.where(F.col("doc_id") != F.col("last_doc")).select("doc_id", "row", "pos")


@shielded("_doc", "_row", "_gone")
def rewrite(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped; text null or empty is one empty line."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    by_doc = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set("pos").alias("_gone"))
    own = docs.join(by_doc, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_row")), "left").drop("_doc", "_row")
    lines = split_lines(F.col("text"))
    # the lines between those that go, so that a text is gone through once however many these are
    gone = F.array_sort("_gone")
    ends = F.concat(gone, F.array(F.size(lines)))
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), gone), ends, lambda a, b: F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0))))
    kept = F.when(F.col("_gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    return own.select("*", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text")).drop("_gone")


class LineIndex:
    """The state between batches: the exact reference table and the filters of the keys that are over the limit.

    ``insert`` and ``delete`` return a new state; deleting what was inserted gives the former decisions back. Both write
    the references of the documents that stay once more; filters change by the keys that pass the limit.
    """

    def __init__(self, refs: DataFrame | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, kept: DataFrame | None = None, shards: int = INDEX_SHARDS):
        self.refs, self.min_docs, self.min_chars, self.shards = refs, min_docs, min_chars, shards
        self.kept = kept if kept is not None or refs is None else materialise(filters(self.eligible(), shards, SHARD_KEYS), "line-filters")

    def insert(self, docs: DataFrame) -> LineIndex:
        """References of ``docs`` are added; those of a document that is there already take the place of its old ones."""
        docs = docs.where(F.col("doc_id").isNotNull())
        new = materialise(references(line_rows(docs, self.min_chars)), "line-batch")
        return self._changed(new, docs.select("doc_id").distinct())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """References of these documents are taken back; unknown ids change nothing."""
        return self._changed(None, doc_ids.select("doc_id").distinct())

    def _changed(self, new: DataFrame | None, ids: DataFrame) -> LineIndex:
        if self.refs is None:
            return self if new is None else LineIndex(new, self.min_docs, self.min_chars, shards=self.shards)
        gone = self.refs.join(ids, "doc_id", "left_semi").select(*self.refs.columns)
        left = self.refs.join(ids, "doc_id", "left_anti").select(*self.refs.columns)
        refs = materialise(left if new is None else left.unionByName(new), "line-refs")
        touched = gone.select("k1", "k2").unionByName((new if new is not None else gone).select("k1", "k2")).distinct()
        over = lambda df: counts(df.join(touched, ["k1", "k2"], "left_semi")).where(F.col("refs") >= self.min_docs).select("k1", "k2")
        was, now = over(self.refs), over(refs)
        up = now.join(was, ["k1", "k2"], "left_anti").withColumn("up", F.lit(True))
        down = was.join(now, ["k1", "k2"], "left_anti").withColumn("up", F.lit(False))
        changes = up.unionByName(down).withColumn("shard", _shard(F.col("k1"), self.shards))
        kept = materialise(changed(self.kept, changes.select("shard", "k1", "up")), "line-filters")
        full = (kept.agg(F.max("overflow")).first()[0] or 0) > OVERFLOW
        return LineIndex(refs, self.min_docs, self.min_chars, None if full else kept.select("shard", "filter"), self.shards)

    def eligible(self) -> DataFrame:
        return counts(self.refs).where(F.col("refs") >= self.min_docs)

    def apply(self, docs: DataFrame) -> DataFrame:
        rows = line_rows(docs.where(F.col("doc_id").isNotNull()), self.min_chars)
        return rewrite(docs, dropped_lines(rows, self.eligible(), self.kept, self.shards))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All of ``docs`` (columns doc_id and text at least) with kept_text, n_lines, n_dropped.

    Lines whose key (stripped of ASCII blanks at both ends, A-Z lower-cased) has at least ``min_chars`` code points and
    is in at least ``min_docs`` documents stay only in the largest doc_id. Several such lines in that document all
    stay. Null or empty text is one empty line. Rows that repeat a doc_id count as one document; each loses its own
    lines. A null doc_id takes part in no count and loses nothing. Empty tables give empty results; other columns pass
    through, those named like the results are replaced.
    """
    rows = line_rows(docs.where(F.col("doc_id").isNotNull()), min_chars)
    known = materialise(counts(references(rows)).where(F.col("refs") >= min_docs), "line-counts")
    # a shard's filter is built by one task
    shards = max(1, -(-known.count() // SHARD_KEYS))
    kept = materialise(filters(known, shards), "line-filters")
    return rewrite(docs, dropped_lines(rows, known, kept, shards))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every document; see ``dedup_lines``."""
    out = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM {docs})),
hot AS (SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.pos, l.line, h.key IS NOT NULL AND l.doc_id <> h.last_doc AS gone
           FROM lines l LEFT JOIN hot h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
FROM marked GROUP BY doc_id
"""
REPORT_SQL = f"SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept_text) AS kept_sha256 FROM ({DEDUP_SQL.format(docs='documents')})"
