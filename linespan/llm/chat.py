"""Chat formatting by rotating the perspective through a conversation's participants.

For every participant the dialogue is rendered once with that speaker as the assistant and the others as named users;
only the assistant's words are learned from (mask 1). A rendered dialogue is kept as its segments, a row for each turn,
with offsets into the whole, so a conversation of any length is never gathered into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers whose segments are placed together, and parts that the rows of one turn number are placed in.
PART, BUCKETS = 512, 4_096
#: Copies of a row that are told apart at once.
COPIES = 1_000
#: Roles that speak for nobody: they are rendered for every perspective and no perspective is theirs.
SYSTEM = ("system",)


def escape(text: Column) -> Column:
    """Markers inside a text are broken up, so that only the format makes turns."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate(turns: DataFrame) -> DataFrame:
    """Segments of every dialogue from every participant's perspective.

    ``turns`` has conv_id, turn, role, text. Returns conv_id, perspective, turn, speaker, as_role, head, body, tail,
    mask, start and end: the segment is head + body + tail, mask is 1 if body and tail are to be learned from, and
    start and end are its place in the rendered dialogue in code points. A segment is
    ``<|assistant|>\\n``, ``<|user name=...|>\\n`` or ``<|system|>\\n``, the text, ``<|end|>\\n``.

    Turns stand in the order of turn, then of a hash of speaker and text; null turns come last. Null role: the speaker
    'unknown'; null text: the empty text. Repeated rows are separate turns. A conversation in which only system speaks
    has no perspective and gives no rows. A null conv_id is a conversation like any other. Other columns are ignored.

    Segments are placed by their lengths, without the texts; these are shuffled once, to meet their places.
    """
    own = turns.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown")).alias("speaker"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    whole = ["conv", F.col("turn").isNull(), "turn", "speaker", "body"]
    own = own.withColumns({"u1": F.xxhash64(*whole), "u2": F.xxhash64(F.lit("second"), *whole)})
    system, mine = F.col("speaker").isin(*SYSTEM), F.col("speaker") == F.col("perspective")
    speakers = own.where(~system).select("conv", F.col("speaker").alias("perspective")).distinct()
    sized = own.groupBy("conv", "turn", "speaker", "u1", "u2", F.char_length("body").alias("chars")).agg(F.count(F.lit(1)).alias("n"))
    head = F.when(mine, F.lit("<|assistant|>\n")).when(system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), escape(F.col("speaker")), F.lit("|>\n")))
    tail = F.lit("<|end|>\n")
    size = F.char_length(head) + F.col("chars") + F.char_length(tail)
    places = _starts(sized.join(speakers, "conv").select("conv", "perspective", F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "u1", "u2", (size * F.col("n")).alias("size")))
    texts = own.groupBy("u1", "u2").agg(*[F.first(c).alias(c) for c in ("conv_id", "turn", "speaker", "body")], F.count(F.lit(1)).alias("n"))
    met = texts.join(places, ["u1", "u2"])
    some = met.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES))))
    each = some.withColumn("copy", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + COPIES, F.col("n")) - 1)))
    each = each.withColumns({"head": head, "tail": tail}).withColumn("size", (F.char_length("head") + F.char_length("body") + F.char_length("tail")).cast("long"))
    start = F.col("start") + F.col("copy") * F.col("size")
    as_role = F.when(mine, "assistant").when(system, "system").otherwise("user")
    return each.select("conv_id", "perspective", "turn", "speaker", as_role.alias("as_role"), "head", "body", "tail", mine.cast("int").alias("mask"), start.alias("start"), (start + F.col("size")).alias("end"))


def _starts(rows: DataFrame) -> DataFrame:
    """perspective, u1, u2 and start of each row of (conv, perspective, turn, u1, u2, size). A window holds the rows of a
    turn that share a bucket of their hash, the buckets of ``PART`` turn numbers, or the parts of a dialogue."""
    rows = rows.withColumns({"bucket": F.shiftrightunsigned("u1", 52).cast("int"), "part": F.floor(F.col("turn") / PART)})
    dialogue, held = ["conv", "perspective"], ["conv", "perspective", "part", "turn", "bucket"]
    before = lambda by, order, what: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = rows.groupBy(*held).agg(F.sum("size").alias("size"))
    parts = buckets.groupBy(*dialogue, "part").agg(F.sum("size").alias("size"))
    parts = parts.select(*dialogue, "part", before(dialogue, ["part"], "size").alias("to_part"))
    # as signed numbers the upper half of u1 comes first; buckets are numbered alike
    signed = F.when(F.col("bucket") >= BUCKETS // 2, F.col("bucket") - BUCKETS).otherwise(F.col("bucket"))
    buckets = buckets.select(*held, before([*dialogue, "part"], ["turn", signed], "size").alias("to_bucket"))
    placed = rows.withColumn("inside", before(held, ["u1", "u2"], "size"))
    return placed.join(buckets, held).join(parts, [*dialogue, "part"]).select("perspective", "u1", "u2", (F.col("to_part") + F.col("to_bucket") + F.col("inside")).alias("start"))


def render(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text, spans: whole dialogues, for conversations known to be short enough for a row."""
    pieces = F.sort_array(F.collect_list(F.struct("start", "end", "mask", F.concat("head", "body", "tail").alias("segment"), F.char_length("head").alias("skip"))))
    whole = segments.groupBy("conv_id", "perspective").agg(pieces.alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["mask"] == 1), lambda p: F.struct((p["start"] + p["skip"]).alias("start"), p["end"].alias("end")))
    return whole.select("conv_id", "perspective", F.array_join(F.transform("pieces", lambda p: p["segment"]), "").alias("text"), spans.alias("spans"))


#: What ``rotate`` returns where no two turns of a conversation share a number.
ROTATE_SQL = r"""
WITH own AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') AS body FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM own WHERE speaker <> 'system'),
segments AS (
  SELECT own.conv_id, perspective, CAST(turn AS BIGINT) AS turn, speaker,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS as_role,
         CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
              ELSE '<|user name=' || replace(replace(speaker, '<|', '<\|'), '|>', '|\>') || '|>' END || chr(10) AS head,
         body, '<|end|>' || chr(10) AS tail, CAST(speaker = perspective AS INTEGER) AS mask
  FROM own JOIN speakers ON own.conv_id IS NOT DISTINCT FROM speakers.conv_id),
placed AS (
  SELECT *, CAST(sum(length(head) + length(body) + length(tail)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST) AS BIGINT) AS "end" FROM segments)
SELECT *, "end" - length(head) - length(body) - length(tail) AS "start" FROM placed
"""
