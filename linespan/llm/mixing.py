"""Mixing sources by temperature.

A source with T tokens gets a weight in proportion to T ** alpha. The exponent is found by bisection: the largest
flattening (smallest alpha) that keeps every source within a repetition limit, or the one whose weights have a target
entropy. Weights and a token budget then say how many epochs each source is read. Whole epochs take all documents; the
last, partial one walks the source's blocks in that epoch's permutation and stops inside the block where the budget
ends, in the permutation of its documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linespan.llm.common import materialise, shielded

REPEAT_LIMIT = 2.0
#: Documents a block holds about, and blocks a source has at most (then they hold more).
BLOCK_DOCS, MAX_BLOCKS = 1_000, 4_096
#: Tables of plans up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000
SEED = 17
#: Exponents that one pass over the table of sources tries; passes until the exponent is known to about 1e-9.
TRIES, PASSES = 16, 8


@dataclass(frozen=True)
class Target:
    """One of: ``entropy`` of the weights as a share of its maximum (0 to 1), or ``repeat``, the most epochs of any source.

    ``budget``: tokens of the whole mix; None: as many as it takes to read the least repeated source once, so that no
    document is left out.
    """

    repeat: float | None = REPEAT_LIMIT
    entropy: float | None = None
    budget: float | None = None


def tokens(text: Column) -> Column:
    """Words of a text: runs outside ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _fits(target: Target, alpha: float, total: float, spread: float, least: float, most: float, sources: int) -> bool:
    """Whether an exponent meets the target; what does at some alpha does at every larger one.

    total: sum of T ** alpha, spread: sum of T ** alpha * ln T, least and most: of T, all in units of the largest T.
    """
    if target.entropy is not None:
        h = math.log(total) - alpha * spread / total
        return h <= target.entropy * math.log(sources) + 1e-12
    if target.budget is None:
        return (most / least) ** (1 - alpha) <= target.repeat * (1 + 1e-12)
    return target.budget * least ** (alpha - 1) / total <= target.repeat * (1 + 1e-12)


def exponent(sources: DataFrame, target: Target) -> float:
    """The smallest exponent in [0, 1] that meets the target (1 if none does), bisected in ``PASSES`` passes over
    (source, total), several exponents at once; only sums come to the driver."""
    scale = sources.agg(F.max("total"), F.min("total"), F.count(F.lit(1))).first()
    if not scale[2]:
        return 1.0
    most, least, n = float(scale[0]), scale[1] / scale[0], scale[2]
    if target.budget is not None:
        target = Target(target.repeat, target.entropy, target.budget / most)
    low, high = 0.0, 1.0
    x = F.col("total") / F.lit(most)
    for _ in range(PASSES):
        tried = [low + (high - low) * i / TRIES for i in range(TRIES + 1)]
        sums = sources.agg(*[f(a) for a in tried for f in (lambda a: F.sum(F.pow(x, F.lit(a))), lambda a: F.sum(F.pow(x, F.lit(a)) * F.log(x)))]).first()
        ok = [_fits(target, a, sums[2 * i], sums[2 * i + 1], least, 1.0, n) for i, a in enumerate(tried)]
        if ok[0] or not any(ok):
            return tried[0] if ok[0] else high
        low, high = tried[ok.index(True) - 1], tried[ok.index(True)]
    return high


def weigh(docs: DataFrame, target: Target) -> DataFrame:
    """(source, total, docs, alpha, weight, epochs, blocks) for every source; ``docs`` has source and n_tokens.

    A source without tokens has weight 0 and one epoch, so its (empty) documents stay once.
    """
    sizes = materialise(docs.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    full = sizes.where(F.col("total") > 0)
    alpha = exponent(full, target)
    most = float(full.agg(F.max("total")).first()[0] or 1)
    raw = F.pow(F.col("total") / most, F.lit(alpha))
    total, least = full.agg(F.sum(raw), F.min(raw / F.col("total"))).first()
    if not total:
        total, least = 1.0, 1.0
    weight = F.when(F.col("total") > 0, raw / F.lit(total)).otherwise(0.0)
    budget = F.lit(float(target.budget if target.budget is not None else total / least))
    epochs = F.when(F.col("total") > 0, weight * budget / F.col("total")).otherwise(1.0)
    blocks = F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(MAX_BLOCKS)).cast("int")
    # rounded: the source that sets the budget is read once, not once less a rounding error
    return materialise(sizes.select("source", "total", "docs", F.lit(alpha).alias("alpha"), weight.alias("weight"), F.round(epochs, 9).alias("epochs"), blocks.alias("blocks")), "mix-weights")


def _beside(df: DataFrame, small: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def _mark(*parts: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


@shielded("_source", "_whole", "_rest", "_blocks", "_n", "_s", "_b", "_last", "_left", "_reads")
def mix(docs: DataFrame, target: Target | None = None) -> DataFrame:
    """The mix: a row of ``docs`` for every time it is read, with n_tokens, epoch (from 1), block, block_key and doc_key.

    Reading a source's rows by epoch, block_key, doc_key is the block permutation; within a partial epoch the rows that
    are there are its prefix whose tokens reach the source's budget (over by less than its last document). ``docs`` has
    doc_id, text and source at least. A null source is a source. Null and empty texts have no tokens: they are read in
    every whole epoch, and in a partial one as far as it goes. Repeated rows are separate documents. An empty table
    gives no rows. Columns named like the results are replaced, others pass through.
    """
    names = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block", "block_key", "doc_key")]
    own = docs.select(*names).withColumn("n_tokens", tokens(F.col("text")))
    plan = weigh(own, target or Target()).select(F.col("source").alias("_source"), F.floor("epochs").cast("int").alias("_whole"), ((F.col("epochs") - F.floor("epochs")) * F.col("total")).alias("_rest"), F.col("blocks").alias("_blocks"))
    dealt = _beside(own, plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", F.pmod(_mark(F.col("doc_id"), F.col("text")), F.col("_blocks")).cast("int"))
    partial = F.col("_whole") + 1
    sums = dealt.groupBy("_source", "block", "_whole", "_rest").agg(F.sum("n_tokens").alias("_n"))
    walk = Window.partitionBy("_source").orderBy(_mark(partial, F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.coalesce(F.sum("_n").over(walk), F.lit(0))
    cut = sums.select(F.col("_source").alias("_s"), F.col("block").alias("_b"), F.when(left >= F.col("_n"), F.when(left > 0, "all").otherwise("none")).when(left > 0, "part").otherwise("none").alias("_last"), left.alias("_left"))
    cut = materialise(cut, "mix-blocks")
    both = _beside(dealt, cut, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    key = _mark(partial, F.col("doc_id"), F.col("text"))
    inner = Window.partitionBy("_s", "_b").orderBy(key, "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    # one block of each source at most is cut inside; the others need no order
    ended = both.where(F.col("_last") == "part").withColumn("_reads", F.col("_whole") + (F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)) < F.col("_left")).cast("int"))
    rest = both.where(F.col("_last") != "part").withColumn("_reads", F.col("_whole") + (F.col("_last") == "all").cast("int"))
    read = rest.unionByName(ended).where(F.col("_reads") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_reads"))))
    return read.select(*names, "n_tokens", "epoch", "block", _mark(F.col("epoch"), F.col("block")).alias("block_key"), _mark(F.col("epoch"), F.col("doc_id"), F.col("text")).alias("doc_key"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, block_key, doc_key for every reading of a document; see ``mix``."""
    out = mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"))
    return out.select("doc_id", "source", "n_tokens", "epoch", "block", "block_key", "doc_key")
