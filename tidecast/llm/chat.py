"""Multi-party perspective rotation of dialogues. DataFrame operations only.

For every participant of a dialogue (every role but `system`) the whole dialogue
is rendered once with that speaker as the assistant and the others as named
users. ``masks`` lists the character ranges to train on: the speaker's own words
and the end mark behind them. Ranges count code points of ``text``.

Messages are numbered by their place in the dialogue, whatever their turn numbers:
rows are dealt by ranges of (dialogue, turn, role, text), numbered inside a range and
moved on by the dialogue's rows in earlier ranges, so a dialogue with a third of all
rows is many tasks' work. A dialogue of at most ``block`` messages is one row for each
participant. Of a longer one, row k holds messages k * block to (k + 1) * block - 1 and
nothing of those before; a message is never cut. Messages are gathered by block before
they meet the participants, so the shuffle moves each once.

Defined cases: a null or blank role is the participant `unknown`; null text is
empty; rows without a conversation id belong to no dialogue and are left out; rows
without a turn stand behind all others; equal turns are ordered by
role, then text, and repeated rows stay; marks inside texts or names are broken
up so that they can't be taken for real ones; a dialogue of `system` rows only has
no participant and no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import written

BLOCK = 1024
SYSTEM, UNKNOWN = "system", "unknown"
END = "<|end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, body): every message with its place in the dialogue, from 0."""
    blank = F.trim(F.coalesce(F.col(role).cast("string"), F.lit("")))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(blank == "", UNKNOWN).otherwise(blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"),
        F.monotonically_increasing_id().alias("row"),  # so that rows that repeat can stand in several ranges
    )
    order = ["conv_id", F.asc_nulls_last("turn"), "role", "body", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids count the rows of a range in their order; range bounds hold for one run only, hence the written table
    dealt = written(dealt.select("conv_id", "role", "body", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "chat-messages")
    ranges = dealt.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a dialogue
    moved = ranges.select(F.col("conv_id").alias("own"), F.col("range").alias("own_range"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    both = dealt.join(moved, (F.col("conv_id") == F.col("own")) & (F.col("range") == F.col("own_range")))
    return both.select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "role", "body")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, speaker, block, n_messages, text, masks, n_trained)."""
    rows = messages(turns, conv, turn, role, text).withColumn("block", F.floor(F.col("place") / block))
    gathered = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("place", "role", "body"))).alias("parts"))
    gathered = written(gathered, "chat-blocks")
    roles = gathered.select(F.col("conv_id").alias("own"), F.explode(F.array_distinct("parts.role")).alias("speaker"))
    speakers = roles.where(F.col("speaker") != SYSTEM).distinct()
    both = gathered.join(speakers, F.col("conv_id") == F.col("own"))

    def rendered(m: Column) -> Column:
        user = F.concat(F.lit("<|user name="), _safe(m["role"]), F.lit("|>\n"))
        head = F.when(m["role"] == SYSTEM, "<|system|>\n").when(m["role"] == F.col("speaker"), "<|assistant|>\n").otherwise(user)
        return F.struct((m["role"] == F.col("speaker")).alias("own"), head.alias("head"), F.concat(_safe(m["body"]), F.lit(END)).alias("said"))

    both = both.select("conv_id", "speaker", "block", F.transform("parts", rendered).alias("parts"))

    def add(so_far: Column, m: Column) -> Column:
        start = so_far["at"] + F.length(m["head"])
        end = start + F.length(m["said"]) - 1
        mask = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(
            (end + 1).alias("at"),
            F.when(m["own"], F.concat_ws(",", so_far["masks"], mask)).otherwise(so_far["masks"]).alias("masks"),
            F.when(m["own"], so_far["trained"] + end - start).otherwise(so_far["trained"]).alias("trained"),
        )

    none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("masks"), F.lit(0).alias("trained"))
    both = both.withColumn("told", F.aggregate("parts", none, add))
    return both.select(
        "conv_id", "speaker", "block", F.size("parts").cast("long").alias("n_messages"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["said"])), "").alias("text"),
        F.coalesce("told.masks", F.lit("")).alias("masks"),
        F.col("told.trained").cast("long").alias("n_trained"),
    )
