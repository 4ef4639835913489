"""Chat formatting with every participant in turn as the assistant.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant, the others as named users and the shared
roles (system) as they are. The result has a row per speaker and turn: its segment, the segment's place in the rendered dialogue, and the part
that the loss is taken on. The segments of a speaker, in order, are the dialogue; ``assemble`` joins them where one row is wanted.

Places are running sums of segment lengths. They are taken in slices of ``SLICE`` turns and over the totals of slices, so that a conversation
of any length is spread over tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SHARED = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SLICE = 256


def rotate_perspectives(turns: DataFrame, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """conv_id, speaker, turn, role, segment, start, end, trained, mask_start, mask_end.

    ``turns`` needs conv_id, turn, role and text; other columns are ignored. ``start`` and ``end`` are code points of the rendered dialogue, end
    exclusive; the mask, from the text to the end mark, is null where the speaker does not talk. Turns are ordered by turn (null first), then
    role and text; repeated rows are turns of their own. A null role is a participant named ``unknown``, a null text is empty, rows without
    conv_id are one conversation. Marks in a text are taken apart, so that a text cannot end its turn. A conversation of shared roles only has
    no rows, like an empty table.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("said_by"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    speakers = rows.where(~F.col("said_by").isin(*shared)).select(F.col("conv_id").alias("of"), F.col("said_by").alias("speaker")).distinct()
    rows = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))
    own = F.col("said_by") == F.col("speaker")
    role = F.when(own, F.lit("assistant")).when(F.col("said_by").isin(*shared), F.col("said_by")).otherwise(F.concat(F.lit("user name="), F.regexp_replace("said_by", r"[\s<>|]+", "_")))
    rows = rows.withColumn("role", role).withColumn("head", F.concat(F.lit(OPEN), F.col("role"), F.lit("\n")))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(CLOSE))).withColumn("length", F.length("segment").cast("long"))
    rows = rows.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))))
    totals = rows.groupBy("conv_id", "speaker", "slice").agg(F.sum("length").alias("length"))
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("of"), F.col("speaker").alias("by"), F.col("slice").alias("in_slice"), F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "speaker", "slice").orderBy(F.col("turn").asc_nulls_first(), "said_by", "body").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.drop("of").withColumn("upto", F.sum("length").over(inside))
    rows = rows.join(totals, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("speaker") == F.col("by")) & (F.col("slice") == F.col("in_slice")))
    end = F.col("before") + F.col("upto")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).withColumn("trained", F.col("said_by") == F.col("speaker"))
    return rows.select("conv_id", "speaker", "turn", "role", "segment", "start", "end", "trained",
                       F.when(F.col("trained"), F.col("start") + F.length("head")).alias("mask_start"), F.when(F.col("trained"), F.col("end") - 1).alias("mask_end"))


def assemble(segments: DataFrame) -> DataFrame:
    """conv_id, speaker, text, masks: one row per rendered dialogue, for conversations that fit into a row."""
    turns = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    whole = segments.groupBy("conv_id", "speaker").agg(turns.alias("turns"))
    masks = F.transform(F.filter("turns", lambda t: t["mask_start"].isNotNull()), lambda t: F.struct(t["mask_start"].alias("start"), t["mask_end"].alias("end")))
    return whole.select("conv_id", "speaker", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"), masks.alias("masks"))
