"""Multi-party chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and all others as named
users; system turns stay system turns and are nobody's perspective. Target spans (character offsets of the assistant's
words and their end mark) say what a model learns from. A conversation is rendered in blocks of up to `BLOCK` turn
numbers, and a block that still has more rows (many rows with one turn number) is cut in order into parts of `BLOCK` rows,
so no conversation of any size meets in one task.

Defined results: a null or blank role is `unknown`, line breaks in a role become spaces, `<|` in a role or text becomes
`< |` (so neither can forge a header); null text is empty, a null turn comes before all others; rows repeated within a
conversation count once; rows with one turn number are ordered by speaker and text; a conversation without participants
yields no row, an empty table an empty one; texts are rendered whole, and a conversation is its rows in order of block
and part; a null conv_id is one conversation; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import written

BLOCK = 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _header(speaker: Column, me: Column) -> Column:
    return (
        F.when(speaker == me, F.lit(f"{OPEN}assistant\n"))
        .when(speaker == "system", F.lit(f"{OPEN}system\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n")))
    )


def _parts(rows: DataFrame, block: int) -> DataFrame:
    """rows with part: 0, or in a block of more than `block` rows the rank by turn, speaker and body, in steps of `block`.

    The rank is the place within a partition of one global sort plus the counts of the partitions before, so that no
    block is ordered in one task."""
    size = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    size = size.select(F.col("conv_id").alias("c"), F.col("block").alias("k"))
    at = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))
    order = ["conv_id", "block", "turn", "speaker", "body"]
    full = rows.join(size, at).select(*order).sort(*order)
    full = written(full.select("*", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("place")), "chat-order")
    piece = full.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.col("piece").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    before = F.sum("n").over(Window.partitionBy("c", "k").orderBy("p")) - F.col("n")
    piece = piece.select("c", "k", "p", (before - F.col("least")).alias("shift"))
    part = F.floor((F.col("place") + F.col("shift")) / block).cast("long").alias("part")
    cut = full.join(piece, at & (F.col("piece") == F.col("p"))).select("conv_id", "block", part, "turn", "speaker", "body")
    rest = rows.join(size, at, "left_anti").select("conv_id", "block", F.lit(0).cast("long").alias("part"), "turn", "speaker", "body")
    return rest.unionByName(cut)


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, speaker, block, part, n_turns, n_targets, text, target_spans ('from-to' of each, comma-joined)."""
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))  # noqa: E731  no text can open or close a turn
    speaker = F.trim(F.translate(F.coalesce(F.col("role").cast("string"), F.lit("")), "\r\n", "  "))
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        clean(F.when(speaker == "", "unknown").otherwise(speaker)).alias("speaker"),
        clean(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"),
    ).distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).cast("long"))
    rows = _parts(rows, block)

    people = rows.where(F.col("speaker") != "system").select(F.col("conv_id").alias("c"), F.col("speaker").alias("me")).distinct()
    blocks = rows.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "body"))).alias("said"))
    # array_sort puts structs with a null turn first, as struct comparison does
    seen = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    turn = F.transform("said", lambda t: F.struct(_header(t["speaker"], F.col("me")).alias("head"), F.concat(t["body"], F.lit(f"{CLOSE}\n")).alias("tail"), (t["speaker"] == F.col("me")).alias("mine")))
    seen = seen.select("conv_id", F.col("me").alias("speaker"), "block", "part", turn.alias("out"))
    end = F.length(F.lit("\n"))
    spans = F.aggregate(
        "out",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["tail"])).alias("at"),
            F.when(t["mine"], F.concat(acc["spans"], F.array(F.concat_ws("-", acc["at"] + F.length(t["head"]), acc["at"] + F.length(t["head"]) + F.length(t["tail"]) - end)))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return seen.select(
        "conv_id", "speaker", "block", "part",
        F.size("out").cast("long").alias("n_turns"),
        F.size(F.filter("out", lambda t: t["mine"])).cast("long").alias("n_targets"),
        F.array_join(F.transform("out", lambda t: F.concat(t["head"], t["tail"])), "").alias("text"),
        F.array_join(spans, ",").alias("target_spans"),
    )
