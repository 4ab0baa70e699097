"""Annotation feeds as streams: cleaning is stateless and runs as it is (bouts: bouts.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean


def stream_clean(
    events: DataFrame, labels: dict[str, str], limits: tuple[float, float, float], ranges: list[tuple[int, int]]
) -> DataFrame:
    """Adds label and flags; works on batch and streaming tables alike."""
    flags = F.array_compact(
        F.array(
            clean.flag_duration(F.col("duration_sec"), *limits),
            F.concat(F.lit("initiator_"), clean.flag_id(F.col("animal_id"), ranges))
        )
    )
    return events.withColumn(
        "label", clean.normalize_label(F.col("event_type"), labels)
    ).withColumn("flags", F.array_join(flags, "|"))
