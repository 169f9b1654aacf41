"""SimHash near-dedup: fingerprints, and their self-join on a binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linespan.llm.common import materialise, partitions, small_batches
from linespan.llm.components import components

BITS, SEED, SHINGLE = 64, 42, 3
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def spans(text: str | None, words_each: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text with a blank between each two, and where its shingles start and end in that."""
    words = (text or "").encode().lower().split()
    if not words:
        return b"", [], []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - words_each + 1)
    last = ends[words_each - 1 :] if len(words) >= words_each else ends[-1:]
    return b" ".join(words), starts[:n].tolist(), last.tolist()


def fingerprint(text: str | None, words_each: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned number; no words: zero.

    Words are runs of bytes outside [\\x20\\x09-\\x0D] after lower-casing A-Z; shingles of ``words_each`` words count as
    often as they occur, and fewer words are one shingle. A bit is set if it is in over half of the hashes.
    """
    data, starts, last = spans(text, words_each)
    n = len(starts)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(data[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], last[k : k + CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


#: Bits that may differ, and the least number of blocks that a fingerprint is cut into: one more than may differ.
BUDGET, BLOCKS = 3, 4
#: Fingerprints a group holds about, and at which a single block value is split.
GROUP, HOT = 20_000, 4_096
#: Pairs of trie nodes that are followed at once; leaves a node pair may still have to be compared one by one.
FRONTIER, LEAF = 1 << 19, 16


class Forest:
    """A spanning forest over 0..n-1 that links are added to in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            left = x != y
            a, b, x, y = a[left], b[left], x[left], y[left]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
        self.root = root


def trie_join(codes: np.ndarray, exact: int, budget: int = BUDGET) -> np.ndarray:
    """For each of these distinct sorted 64-bit codes the first code it is linked with, over any number of links.

    Links are pairs that agree in the first ``exact`` bits and differ in at most ``budget`` others. The sorted codes are
    a binary trie: a node is a range, its children are found by counting zeros of the next bit. Pairs of nodes walk
    down together from the roots of the subtries at depth ``exact``, each carrying the number of bits in which its two
    prefixes differ, and pairs beyond the budget are cut off with all that lies below them.
    """
    n = len(codes)
    forest = Forest(n)
    zeros: dict[int, np.ndarray] = {}

    def below(depth: int) -> np.ndarray:
        if depth not in zeros:
            zeros[depth] = np.r_[0, np.cumsum((codes >> np.uint64(BITS - 1 - depth)) & np.uint64(1) == 0)]
        return zeros[depth]

    cut = np.flatnonzero(np.r_[True, (codes[1:] >> np.uint64(BITS - exact)) != (codes[:-1] >> np.uint64(BITS - exact))]) if exact and n else np.zeros(min(n, 1), int)
    lo, hi = cut, np.r_[cut[1:], n] if n else cut
    more = hi - lo > 1
    todo = [(exact, lo[more], hi[more], lo[more], hi[more], np.zeros(int(more.sum()), np.int8))]
    while todo:
        depth, alo, ahi, blo, bhi, err = todo.pop()
        if len(alo) > FRONTIER:
            for k in range(0, len(alo), FRONTIER):
                part = slice(k, k + FRONTIER)
                todo.append((depth, alo[part], ahi[part], blo[part], bhi[part], err[part]))
            continue
        size = (ahi - alo) * (bhi - blo)
        small = size <= LEAF if depth < BITS else np.ones(len(size), bool)
        if small.any():
            pair = np.repeat(np.flatnonzero(small), size[small])
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
            wide = (bhi - blo)[pair]
            i, j = alo[pair] + nth // wide, blo[pair] + nth % wide
            near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
            forest.add(i[near], j[near])
        if small.all():
            continue
        alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        z = below(depth)
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        same = alo == blo  # ranges at one depth are equal or apart
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        apart = ~same
        parts.append((amid[apart], ahi[apart], blo[apart], bmid[apart], err[apart] + 1))
        both = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (both[4] <= budget) & (both[1] > both[0]) & (both[3] > both[2]) & ~((both[0] == both[2]) & (both[1] - both[0] == 1))
        if keep.any():
            todo.append((depth + 1, *(x[keep] for x in both)))
    return forest.root


def tables(blocks: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of all but ``BUDGET`` of so many blocks, all blocks as (lowest bit, bits) with the chosen first, and
    how many bits those have. Fingerprints within the budget agree in all of some choice."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    cut = [(low, high - low) for low, high in zip(cuts, cuts[1:], strict=False)][::-1]
    chosen = combinations(range(blocks), blocks - BUDGET)
    return [([cut[i] for i in own] + [cut[i] for i in range(blocks) if i not in own], sum(cut[i][1] for i in own)) for own in chosen]


def blocks_for(n: int) -> int:
    """The fewest blocks that leave about ``HOT`` of n fingerprints, if they are spread, for each value of a choice."""
    blocks = BLOCKS
    while blocks < 8 and n > HOT << min(bits for _, bits in tables(blocks)):
        blocks += 1
    return blocks


def arranged(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks in another order, the first highest."""
    out = np.zeros(len(fp), np.uint64)
    for low, bits in order:
        out = (out << np.uint64(bits)) | ((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1))
    return out


def _join_group(blocks: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order, exact = tables(blocks)[int(pdf["choice"].iloc[0])]
        codes, first = np.unique(arranged(pdf.fp.to_numpy().view(np.uint64), order), return_index=True)
        rep = pdf.rep.to_numpy()[first]
        root = trie_join(codes, exact)
        linked = root != np.arange(len(codes))
        return pd.DataFrame({"a": rep[linked], "b": rep[root[linked]]})

    return run


def links(classes: DataFrame, blocks: int | None = None) -> DataFrame:
    """(a, b): links between the representatives of (fp, rep) that join all whose fingerprints differ in at most
    ``BUDGET`` bits, over other links where not directly.

    Fingerprints are cut into ``blocks``, more of them the more there are; all but ``BUDGET`` blocks are equal in such a
    pair, so each fingerprint goes to a trie for every choice of these, with its bits in that order. Tries are cut by
    the value of the choice into groups; a value that very many fingerprints share is cut into chunks, and each pair of
    chunks is a group.
    """
    spark = classes.sparkSession
    n = classes.count()
    blocks = blocks or blocks_for(n)

    def value(order: list[tuple[int, int]], exact: int) -> Column:
        out, bits = F.lit(0).cast("long"), 0
        for low, width in order:
            if bits < exact:
                out, bits = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)), bits + width
        return out

    turns = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), value(*t).alias("value")) for i, t in enumerate(tables(blocks))])).alias("t")
    rows = classes.where(F.col("rep").isNotNull()).select("fp", "rep", turns).select("fp", "rep", "t.choice", "t.value")
    hot = rows.groupBy("choice", "value").count().where(F.col("count") > HOT).select("choice", "value", F.ceil(F.col("count") / HOT).cast("int").alias("chunks"))
    dealt = rows.join(hot, ["choice", "value"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    groups = max(partitions(spark), -(-n // GROUP))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.select("fp", "rep", "choice", "value", "chunks", chunk.alias("i"), other.alias("j"))
    key = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("choice", "value"), F.lit(groups))).otherwise(F.xxhash64("choice", "value", F.least("i", "j"), F.greatest("i", "j")))
    return dealt.select("choice", key.alias("key"), "fp", "rep").groupBy("choice", "key").applyInPandas(_join_group(blocks), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``.

    Fingerprints that differ in at most three bits are linked, and so are the doc_ids a and b of ``also``; component_id is the smallest doc_id reachable. Null
    text, like text without a word, has fingerprint zero and is linked like any other. Rows that repeat a doc_id count
    as one document (its texts are linked). A null doc_id is linked with nothing: its component_id is that of the
    others with its fingerprint, or null if there is none. Extra columns are ignored; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs), "simhash")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    same = prints.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where((F.col("x") != F.col("y")) & F.col("doc_id").isNotNull()).select("doc_id")
    repeated = prints.join(same, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = links(classes).unionByName(repeated)
    if also is not None:
        also = materialise(also, "also-linked")
        ends = also.select(F.col("a").alias("doc_id")).unionByName(also.select(F.col("b").alias("doc_id"))).distinct()
        own = prints.join(ends, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        edges = edges.unionByName(also).unionByName(own)
    found = components(edges)
    reached = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(reached, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; see ``near_duplicates``."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
