"""Row-wise read operators on streams, and stateful ones under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import seq_hash
from ..operators.reads import demultiplex, quality_filter, trim


def clean(stream: DataFrame, up: str, down: str | None, min_qual: float = 30, max_ambigs: int = 0, min_length: int = 50, max_length: int = 500) -> DataFrame:
    """Trimmed and filtered reads; all of it is stateless, so it runs on a stream as on a table."""
    return quality_filter(trim(stream, up, down), min_qual, max_ambigs, None, min_length, max_length)


def split_samples(stream: DataFrame, tags: dict[str, str], up: str, down: str) -> DataFrame:
    return demultiplex(stream, tags, up, down)


def first_seen(stream: DataFrame, event_time: str, lateness: str = "10 minutes") -> DataFrame:
    """Each sequence once while the watermark allows: streaming dereplication with bounded state."""
    return stream.withColumn("uid", seq_hash(F.col("seq"))).withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["uid"])


def counts_by_window(stream: DataFrame, event_time: str, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Abundance of each sequence and sample per window."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), "sample", seq_hash(F.col("seq")).alias("uid")).agg(F.count(F.lit(1)).alias("n"))
