"""Chat formatting with rotated perspectives.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and
the others as named users; the spans of the assistant's words are the mask. Narrators (system turns)
take part in no rotation and stand as they are in each.

A conversation is rendered in parts of ``TURNS`` turn numbers, so a conversation of any length is never
in one row or one task; a part with more than ``ROWS`` rows, because many share a turn, is cut further: its
rows are ranked by ranges, and every ``ROWS`` ranks are a piece.
Everything is column expressions; a part is joined with the participants by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.workspace import materialise

#: Turn numbers in a part, and rows above which it is cut further.
TURNS, ROWS = 256, 1024
NARRATORS = ("system",)
UNNAMED = "unknown"


def header(role: Column, perspective: Column, narrators: tuple[str, ...] = NARRATORS) -> Column:
    """What stands before a turn's text."""
    return (
        F.when(role.isin(*narrators), F.concat(F.lit("<|im_start|>"), role, F.lit("\n")))
        .when(role == perspective, F.lit("<|im_start|>assistant\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), role, F.lit("\n")))
    )


FOOTER = "<|im_end|>\n"


def _in_pieces(said: DataFrame, rows: int) -> DataFrame:
    """The rows of large parts with their ``piece``, from 1: every ``rows`` ranks of a part by turn, role and text.

    The rows are dealt by ranges of that order, so a part lies over many tasks; the number of its rows in
    the ranges before makes a rank within a range one within the part. Equal rows are told apart by a number.
    """
    part = ["conversation", "part"]
    by = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), F.col("number")]
    numbered, _ = materialise(said.withColumn("number", F.monotonically_increasing_id()), "numbered")
    ranges = numbered.repartitionByRange(*part, *by).withColumn("range", F.spark_partition_id())
    ranges, _ = materialise(ranges, "ranges")
    sizes = ranges.groupBy(*part, "range").agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy(*part).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("conversation").alias("o_conversation"), F.col("part").alias("o_part"), F.col("range").alias("o_range"),
        F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"),
    )
    within = ranges.withColumn("rank", F.row_number().over(Window.partitionBy(*part, "range").orderBy(*by)) - 1)
    ranked = within.join(
        offsets,
        (F.col("range") == F.col("o_range"))
        & F.col("conversation").eqNullSafe(F.col("o_conversation"))
        & F.col("part").eqNullSafe(F.col("o_part")),
    )
    piece = F.floor((F.col("before") + F.col("rank")) / rows) + 1
    return ranked.select("conversation", "turn", "role", "text", "part", piece.alias("piece"))


def rotated(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    narrators: tuple[str, ...] = NARRATORS, turns: int = TURNS, rows: int = ROWS,
) -> DataFrame:
    """``conversation, perspective, part, piece, n_turns, text, mask``: rows for every participant.

    ``part`` counts spans of ``turns`` turn numbers, ``piece`` is 0 unless the part had to be cut; the rows
    of a perspective by ``part`` (null last) and ``piece`` are the whole dialogue. ``mask`` holds start and
    end, in characters of ``text``, of what the assistant says. Turns stand by number, null last, and of
    equal numbers by role and text, however many they are. Equal rows are as many turns. A null text is empty, a
    null or empty role is ``UNNAMED``; a null conversation is one of its own. A conversation of narrators only has
    no rows, and an empty table gives none. Texts of any length stay whole.
    """
    names = {conversation: "conversation", turn: "turn", role: "role", text: "text"}
    said = df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])
    said = said.select(
        "conversation",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(UNNAMED)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    said, _ = materialise(said.withColumn("part", F.floor(F.col("turn") / turns)), "said")
    speakers = said.filter(~F.col("role").isin(*narrators)).select(
        F.col("conversation").alias("of"), F.col("role").alias("perspective")
    ).distinct()
    large = said.groupBy("conversation", "part").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > rows)
    large, many = materialise(
        large.select(F.col("conversation").alias("l_conversation"), F.col("part").alias("l_part")), "large"
    )
    placed = said.withColumn("piece", F.lit(0).cast("long"))
    if many:
        in_large = said.conversation.eqNullSafe(large.l_conversation) & said.part.eqNullSafe(large.l_part)
        cut = _in_pieces(said.join(large, in_large, "left_semi"), rows)
        placed = said.join(large, in_large, "left_anti").withColumn("piece", F.lit(0).cast("long")).unionByName(cut)
    # A null turn number comes last.
    turn_row = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "text")
    parts = placed.groupBy("conversation", "part", "piece").agg(F.array_sort(F.collect_list(turn_row)).alias("turns"))
    seen = parts.join(speakers, parts.conversation.eqNullSafe(speakers.of))
    me = F.col("perspective")
    shown = seen.withColumn(
        "shown",
        F.transform(
            "turns",
            lambda t: F.struct(
                header(t["role"], me, narrators).alias("header"), t["text"].alias("text"), (t["role"] == me).alias("mine")
            ),
        ),
    )
    lengths = F.transform("shown", lambda t: F.length(t["header"]) + F.length(t["text"]) + len(FOOTER))
    shown = shown.withColumn("lengths", lengths).withColumn(
        "starts",
        F.transform(
            "lengths", lambda _, k: F.aggregate(F.slice("lengths", F.lit(1), k), F.lit(0), lambda total, n: total + n)
        ),
    )
    spans = F.transform(
        "shown",
        lambda t, k: F.struct(
            t["mine"].alias("mine"),
            (F.get("starts", k) + F.length(t["header"])).alias("start"),
            (F.get("starts", k) + F.length(t["header"]) + F.length(t["text"])).alias("end"),
        ),
    )
    mask = F.transform(
        F.filter(spans, lambda s: s["mine"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    )
    rendered = F.array_join(F.transform("shown", lambda t: F.concat(t["header"], t["text"], F.lit(FOOTER))), "")
    return shown.select(
        "conversation", "perspective", "part", "piece", F.size("turns").alias("n_turns"), rendered.alias("text"), mask.alias("mask")
    )
