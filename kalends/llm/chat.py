"""Multi-party dialogues, rendered once from the perspective of each participant.

In a participant's rendering its own turns are the assistant's and are to be learnt; all others speak as named
users; system turns stay what they are. The result has a row per rendered turn with its place in the rendering, so no
conversation, however long, is gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SYSTEM = "system"
#: Turn numbers that one window orders together.
CHUNK = 256


def perspectives(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per conversation, participant and turn: conv_id, perspective, position, turn, speaker, segment, start,
    length, train_start, train_length.

    Roles other than `system` are the participants; a null role is one of its own, a null text is empty. A
    segment is `<|im_start|>assistant` or `<|im_start|>user name=...` or `<|im_start|>system`, a line feed, the text,
    `<|im_end|>` and a line feed. Inside texts and roles `<|` becomes `<\\|` (and what looks so already gets one more
    backslash), in roles also a backslash two and a line feed `\\n`, so neither can forge a mark or a turn, and different
    texts and roles stay different; no role is written like the null one, `\\unknown`. start counts the characters of the rendering
    before the segment; train_start and train_length mark what the assistant says with its end mark (null and 0 for
    others). Turns go by number (nulls first), speaker and text, so repeated rows follow one another. A conversation
    with system turns alone has no perspective and no rows; null conv_ids are one conversation; an empty table gives
    an empty result.

    Starts are sums over chunks of turn numbers, then inside the chunk. The chunks' sums need lengths alone, so texts go through
    the join with the participants and the order inside chunks, and through nothing else.
    """
    name = F.replace(F.replace(F.replace("role", F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|")), F.lit("\n"), F.lit("\\n"))
    told = turns.select(
        "conv_id", "turn", F.coalesce(name, F.lit("\\unknown")).alias("speaker"), F.regexp_replace(F.coalesce("text", F.lit("")), r"<(\\*)\|", r"<\\$1|").alias("said")
    ).withColumns({"order": F.md5("said"), "said_length": F.char_length("said").cast("long")})
    who = told.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = F.concat(
        F.lit("<|im_start|>"),
        F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), "speaker")),
        F.lit("\n"),
    )
    said = F.concat("said", F.lit("<|im_end|>"))
    rendered = (
        told.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
        .withColumn("segment", F.concat(head, said, F.lit("\n")))
        .withColumn("length", F.char_length(head) + F.col("said_length") + 11)
        .withColumn("head", F.when(own, F.char_length(head)).cast("long"))
        .withColumn("train_length", F.when(own, F.col("said_length") + 10).otherwise(0).cast("long"))
        .withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))))
    )
    key = ["conv_id", "perspective"]
    sums = rendered.groupBy(*key, "chunk").agg(F.sum("length").alias("chars"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(*key).orderBy("chunk")
    sums = sums.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("chunk").alias("k"),
        (F.sum("chars").over(earlier) - F.col("chars")).alias("chars_before"), (F.sum("rows").over(earlier) - F.col("rows")).alias("rows_before"),
    )
    inside = Window.partitionBy(*key, "chunk").orderBy("turn", "speaker", "order")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rendered.withColumn("n", F.row_number().over(inside)).withColumn("chars", F.sum("length").over(upto) - F.col("length"))
        .join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("chunk") == F.col("k")))
        .withColumn("start", F.col("chars_before") + F.col("chars"))
        .select(
            "conv_id", "perspective", (F.col("rows_before") + F.col("n") - 1).alias("position"), "turn", "speaker", "segment", "start", "length",
            (F.col("start") + F.col("head")).alias("train_start"), "train_length",
        )
    )


ORACLE = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'), '\unknown') AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS said FROM conversations
), who AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM told WHERE speaker <> 'system'
), rendered AS (
  SELECT conv_id, perspective, turn, speaker, said,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM told JOIN who ON conv_id IS NOT DISTINCT FROM c
), placed AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS segment,
    row_number() OVER w - 1 AS position,
    CAST(sum(length(head || said || '<|im_end|>' || chr(10))) OVER w AS BIGINT) AS upto
  FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(said) ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, turn, speaker, md5(segment) AS segment_md5,
  upto - length(segment) AS start, CAST(length(segment) AS BIGINT) AS length,
  CASE WHEN speaker = perspective THEN upto - length(segment) + length(head) END AS train_start,
  CAST(CASE WHEN speaker = perspective THEN length(said) + 10 ELSE 0 END AS BIGINT) AS train_length
FROM placed
"""
