"""From raw documents to token ids: language ID, line dedup, SimHash near-dedup, mixing, byte-level BPE.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs; all but the last return the columns of documents, and rows they don't reject unchanged but for
what the stage is there to change.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linespan.llm import bpe, langid, line_dedup, mixing, shingles, simhash
from linespan.llm.common import drop_written, load, settle

#: Documents whose mean probability of the predicted language is lower than this are rejected, like those without one.
#: It is hardly more than chance among four languages: short texts that are mostly numbers and addresses are above it. Among
#: up to three the largest probability is always above it. Of the 10 000 documents of sf0.1 it rejects none (least: 0.320).
LEAST_SCORE = 0.28


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Null texts and texts without a letter go. In effect no others do: ``LEAST_SCORE`` only
    rejects what is nearly uniform over four languages or more, not every text in a language that wasn't learned. Where no
    document has a lang to learn from, nothing can be judged and only texts that are null or have no letter go."""
    model = langid.fit(docs)
    judged = langid.predict(docs, model)
    if not model.labels:
        return judged.where(F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).select(*docs.columns)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that others hold too (see ``line_dedup.dedup_lines``); n_chars follows the text."""
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    out = line_dedup.dedup_lines(docs)
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates: texts whose sets of five-word shingles have a
    Jaccard index of 0.8 or more, or whose fingerprints differ in at most three bits. Rows that repeat a doc_id are one
    document: of its rows with equal texts one stays, the least by the other columns. Rows without a doc_id stay, as they
    can't be told apart."""
    near = simhash.near_duplicates(docs, shingles.alike(docs))
    first = near.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_first")).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col("_first"), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.col("text")
    one = kept.groupBy("doc_id", text.isNull(), F.xxhash64(text), F.xxhash64(F.lit("second"), text)).agg(F.min(F.struct(*rest, "text")).alias("_row"))
    return one.select("doc_id", "_row.*").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, once for each time that the mix reads it: no source is read more than ``mixing.REPEAT_LIMIT`` times
    and none less than once."""
    return mixing.mix(docs).select(*docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids and decoded_sha256 (of the bytes that the ids decode to) of every row."""
    own = docs.select("doc_id", "source", "lang", "text")
    return bpe.encode(own, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids", "decoded_sha256"), keep_text=False)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_bytes),
]

#: SQL can't express a trained network, the fingerprints or the merges; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        drop_written(before)  # what the next stage reads is written
    return STAGES[-1][1](spark, docs, sf_dir)
