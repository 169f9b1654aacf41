"""Pairs of texts that share most of their shingles: bands of least hashes find them, whole sets confirm them.

Two texts with a Jaccard index of 0.8 differ in some ten of the 64 bits of their SimHashes, often in more than fifteen. A
trie that is walked with such a budget cuts nothing off above the leaves, so pairs that far apart are looked up here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linespan.llm.common import materialise, partitions, small_batches
from linespan.llm.simhash import SEED, spans

WORDS, LEAST = 5, 0.8
#: A pair at 0.8 has no band in common with a probability of (1 - 0.8 ** 4) ** 24, about 3 in a million.
BANDS, EACH = 24, 4
#: Hashes that are multiplied at once; shingles that a group holds about, and from which a band's value is split.
CHUNK, GROUP = 1 << 10, 1 << 21

_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 63, BANDS * EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * EACH, dtype=np.uint64)


def shingle_set(text: str | None, words_each: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted hashes; words and shingles are those of ``simhash.fingerprint``."""
    data, starts, last = spans(text, words_each)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, last, strict=True)), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> list[int]:
    """The values of the bands of a set that isn't empty, as signed numbers."""
    least = np.full(BANDS * EACH, ~np.uint64(0))
    for k in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[k : k + CHUNK, None] * _TIMES + _PLUS).min(axis=0), out=least)
    values = [xxhash.xxh64_intdigest(least[k * EACH : (k + 1) * EACH].tobytes(), k) for k in range(BANDS)]
    return np.array(values, np.uint64).view(np.int64).tolist()


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def linked(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links that join all of these sets (none empty) whose Jaccard index is ``least`` or more, over other links where
    not directly. Every link is such a pair itself. What is reached already is compared no more."""
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(int(token.max()) + 1, bool)
    rest, rest_token = np.arange(1, len(sets)), token[ends[0] :]
    todo, out = [0], []
    while len(rest):
        if not todo:
            todo, rest, rest_token = [int(rest[0])], rest[1:], rest_token[size[rest[0]] :]
            continue
        i = todo.pop()
        mine = token[ends[i] - size[i] : ends[i]]
        marked[mine] = True
        both = np.add.reduceat(marked[rest_token].astype(np.int64), np.cumsum(size[rest]) - size[rest])
        marked[mine] = False
        near = both / (size[i] + size[rest] - both) >= least
        if near.any():
            found = rest[near].tolist()
            out += [(i, j) for j in found]
            todo += found
            rest_token = rest_token[np.repeat(~near, size[rest])]
            rest = rest[~near]
    return out


def alike(docs: DataFrame, words_each: int = WORDS, least: float = LEAST) -> DataFrame:
    """(a, b): links of doc_ids that join all documents whose sets of shingles have a Jaccard index of ``least`` or more.

    Equal sets are one class, whose least doc_id stands for it. Classes that share the value of a band are compared
    within it by their whole sets; of bands with the same members one is compared. A value whose sets are more than a
    task should hold is cut into chunks, and each pair of chunks is a group. Texts without a word and rows without a
    doc_id are linked with nothing.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words_each) for t in b.column("text").to_pylist()]
            data = [pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *data], names=["doc_id", "key", "n", "bands"])

    small_batches(docs.sparkSession)
    prints = materialise(own.mapInArrow(banded, "doc_id bigint, key bigint, n bigint, bands array<bigint>").where("n > 0"), "bands")
    first = prints.groupBy("key").agg(F.min("doc_id").alias("rep"))
    same = prints.join(first, "key").where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    alone = prints.join(first.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("rep"))).select("rep", "key", "n", "bands").dropDuplicates(["rep", "key"])
    rows = alone.select("rep", "key", "n", F.explode("bands").alias("band"))
    members = rows.groupBy("band").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("rep", "key")).alias("who")).where("x <> y")
    values = materialise(members.groupBy("who", "x", "y", "n").agg(F.min("band").alias("band")).select("band", "n"), "band-values")
    total = values.agg(F.sum("n")).first()[0] or 0
    groups = max(partitions(spark), -(-total // GROUP))
    kept = materialise(rows.drop("n").join(values, "band").select("band", "rep", "key", F.ceil(F.col("n") / GROUP).cast("int").alias("chunks")), "band-members")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words_each) for t in b.column("text").to_pylist()]
            data = [pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("rep"), *data], names=["rep", "key", "hashes"])

    named = own.withColumnRenamed("doc_id", "rep").join(kept.select("rep").distinct(), "rep")
    sets = named.mapInArrow(whole, "rep bigint, key bigint, hashes array<bigint>").dropDuplicates(["rep", "key"])
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    dealt = kept.select("band", "rep", "key", "chunks", chunk.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    part = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("band"), F.lit(groups))).otherwise(F.xxhash64("band", F.least("i", "j"), F.greatest("i", "j")))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, at in pdf.groupby("band").indices.items():
            rep = pdf.rep.to_numpy()[at]
            out += [(rep[i], rep[j]) for i, j in linked([pdf.hashes.iloc[k] for k in at], least)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    joined = dealt.select(part.alias("part"), "band", "rep", "key").join(sets, ["rep", "key"]).select("part", "band", "rep", "hashes")
    return same.unionByName(joined.groupBy("part").applyInPandas(compared, "a bigint, b bigint"))
