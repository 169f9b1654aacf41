"""Document fingerprints from closed syncmers of words, in DataFrame functions only.

A k-mer is ``K`` words in a row, an inner substring ``S`` of them. A k-mer is an anchor (a closed syncmer) if the least
hash among its inner substrings is that of the first or the last one. That depends on nothing outside the k-mer, so a
passage gives the same anchors wherever it stands, and a changed word touches only the k-mers that hold it. Two texts
are matched by all their anchors, which gives the positions of what they share and the Jaccard index of the anchor sets.
The ``SKETCH`` least anchor hashes are kept as a fingerprint of bounded size; nothing is compared by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linespan.llm.common import partitions, shielded

K, S, SKETCH = 5, 2, 128
#: Text of a range of ids in bytes about, ranges at most, sampled ids for each; bounds that are looked through together.
RANGE_BYTES, MOST_RANGES, SAMPLED, STRIDE = 128 << 20, 40_000, 64, 200
#: Words are runs outside [\x20\x09-\x0D]; longer ones count as several words, so that text without blanks has anchors too.
WORD = r"[^\x20\x09-\x0D]{1,16}"


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array<struct<position, kmer>>, the anchors of ``text`` in order (position: of the first word).

    Texts of fewer than ``K`` words, and the few longer ones without an anchor, get one: all their words.
    """
    words, hashes, inner = f"_{out}_words", f"_{out}_hashes", f"_{out}_inner"
    df = df.withColumn(words, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    df = df.withColumn(inner, F.zip_with(words, F.slice(words, S, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    n = F.size(words)
    spans = K - S + 1
    h, s = F.col(words), F.col(inner)

    def anchor(i: Column) -> Column:
        edge, middle = F.least(F.get(s, i), F.get(s, i + (spans - 1))), F.least(*[F.get(s, i + j) for j in range(1, spans - 1)])
        return F.when(edge <= middle, F.struct(i.alias("position"), F.xxhash64(*[F.get(h, i + j) for j in range(K)]).alias("kmer")))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(K)) - K), anchor), lambda x: x.isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).alias("kmer")))
    df = df.withColumn(hashes, F.when(n >= K, found))
    return df.withColumn(out, F.when(F.size(hashes) > 0, F.col(hashes)).otherwise(whole)).drop(words, hashes, inner)


def sketch(anchors: Column) -> Column:
    """The least hashes of the anchors, as 32-bit numbers: array<long>."""
    kmers = F.transform(anchors, lambda x: F.shiftrightunsigned(x["kmer"], 32))
    return F.slice(F.sort_array(F.array_distinct(kmers)), 1, SKETCH)


def to_text(sketched: Column) -> Column:
    """A fingerprint as hex digits, eight for each hash."""
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def with_matches(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with match_<out>, where the anchors ``a`` and ``b`` share a k-mer: array<struct<position, other>>, the first
    positions of it in each, in order; and near_<out>, the share of the k-mers of both that are shared, 0 to 1."""
    tagged, firsts = f"_{out}_tagged", f"_{out}_firsts"
    side = lambda c, n: F.transform(c, lambda x: F.struct(x["kmer"].alias("kmer"), F.lit(n).alias("side"), x["position"].alias("position")))
    df = df.withColumn(tagged, F.sort_array(F.concat(side(F.col(a), 0), side(F.col(b), 1))))
    t = F.col(tagged)
    df = df.withColumn(firsts, F.filter(t, lambda x, i: (i == 0) | (F.get(t, i - 1)["kmer"] != x["kmer"]) | (F.get(t, i - 1)["side"] != x["side"])))
    f = F.col(firsts)
    both = F.zip_with(f, F.slice(f, 2, F.size(f)), lambda x, y: F.when(x["kmer"] == y["kmer"], F.struct(x["position"].alias("position"), y["position"].alias("other"))))
    df = df.withColumn(f"match_{out}", F.sort_array(F.filter(both, lambda x: x.isNotNull())))
    shared = F.size(f"match_{out}")
    return df.withColumn(f"near_{out}", shared / (F.size(f) - shared)).drop(tagged, firsts)


def _halving(key: Column, bounds: list[int], first: int = 0) -> Column:
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _halving(key, bounds[:mid], first)).otherwise(_halving(key, bounds[mid + 1 :], first + mid + 1))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of these sorted bounds are at or below ``key``: among every ``STRIDE``-th, then among those up
    to the next, which are a literal of the plan: a branch for each of many bounds makes code that takes too much memory to
    compile."""
    if len(bounds) < 16:
        return _halving(key, bounds)
    every = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    strides = F.lit(0)
    if len(bounds) >= STRIDE:
        rough = F.split(F.lit(",".join(map(str, bounds[STRIDE - 1 :: STRIDE]))), ",").cast("array<bigint>")
        strides = F.size(F.filter(rough, lambda x: x <= key)) * STRIDE
    return F.get(F.transform(F.array(strides), lambda n: n + F.size(F.filter(F.slice(every, n + 1, F.lit(STRIDE)), lambda x: x <= key))), F.lit(0))


@shielded("_key", "_range", "_in", "_top", "_to")
def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, ...) with next_<column> of the row after it in descending doc_id.

    After the last comes the first. Repeated ids follow each other by their text's hash and text; null ids come last.
    Rows are dealt into ranges of ids, as many as there are shuffle partitions or more, so that a range has about
    ``RANGE_BYTES`` of text (of one id all rows are in one); the bounds are quantiles of a sample of ids and decide
    nothing else. The top row of each range also goes, as a ghost, to the range above it, so that no range needs another.
    """
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    rows, size = keyed.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(1, min(max(partitions(docs.sparkSession), (size or 0) // RANGE_BYTES), MOST_RANGES))
    drawn = F.shiftrightunsigned(F.xxhash64("_key", F.lit("ranges")), 12) / F.lit(float(1 << 52))
    sampled = keyed.where(drawn < SAMPLED * parts / max(rows, 1))
    quantiles = sampled.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()[0]
    bounds = sorted(set(quantiles or []))
    keyed = keyed.withColumn("_range", _bucket(F.col("_key"), bounds))
    tops = sorted(tuple(r) for r in keyed.groupBy("_range").agg(F.max("_key")).collect())  # a row for each range
    if not tops:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns])
    ghosts = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    marks = docs.sparkSession.createDataFrame(ghosts, "_top bigint, _to int")
    both = keyed.join(F.broadcast(marks), F.col("_key") == F.col("_top"), "left")
    own = F.struct(F.lit(False).alias("ghost"), F.col("_range").alias("at"))
    also = F.struct(F.lit(True).alias("ghost"), F.col("_to").alias("at"))
    dealt = both.withColumn("_in", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, also))))
    order = Window.partitionBy("_in.at").orderBy("_in.ghost", F.desc("_key"), F.xxhash64("text"), "text")
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("_in.ghost")).drop("_key", "_range", "_top", "_to", "_in")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n_chars / 3) code points are replaced by the
    first as many (or all) of the next document's, in descending doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, match_edited and
    match_next (see ``with_matches``), a row for each row of ``docs``. Null text is the empty text. Texts without a word
    have a fingerprint of their own, equal for all such. A single document is its own next one. Other columns are ignored;
    an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(own.withColumn("n_chars", F.char_length("text").cast("long")), ["text"])
    take = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - take).cast("int")), F.substring("next_text", F.lit(1), take))
    pairs = pairs.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    for text, anchors in (("text", "anchors"), ("next_text", "next_anchors"), ("edited", "edited_anchors")):
        pairs = with_anchors(pairs, text, anchors).drop(text)
    pairs = with_matches(with_matches(pairs, "anchors", "edited_anchors", "edited"), "anchors", "next_anchors", "next")
    prints = [to_text(sketch(F.col(c))).alias(name) for c, name in (("anchors", "fingerprint"), ("edited_anchors", "edited_fingerprint"))]
    return pairs.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next", "match_edited", "match_next")
