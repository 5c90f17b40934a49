"""Block events as a stream: counts and flags of each project in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.features import COSTUME, LOOP, SEND, starts


def windowed_features(blocks: DataFrame, time_col: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(project_id, window, block_count and flags) of blocks(project_id, opcode, time_col), streaming or not.

    Rows later than `late` behind the watermark are dropped by a stream; state is one row for each open window and project.
    """
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return (
        blocks.withWatermark(time_col, late)
        .groupBy("project_id", F.window(time_col, length))
        .agg(
            F.count("*").alias("block_count"),
            some(starts(*LOOP)).alias("uses_loops"),
            some(starts("control_if")).alias("uses_conditionals"),
            some(starts("event_")).alias("uses_event_handling"),
            some(starts(SEND)).alias("uses_messaging"),
            some(starts(*COSTUME)).alias("uses_animation"),
            some(starts("sound_")).alias("uses_sound"),
        )
    )
