"""Load statistics of phases cut from a stream of events (an extension: the model itself has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def phase_loads(events: DataFrame, ranks: int = 8, length: str = "1 day", late: str | None = None) -> DataFrame:
    """phase_start, rank, load, n: sums of value in hundredths by tumbling window and rank (user_id modulo ranks); works on streams, with a watermark, and on tables."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        df = df.withWatermark("ts", late)
    w = F.window("ts", length)
    load = F.sum(F.round(F.col("value") * 100).cast("long"))
    return df.groupBy(w, (F.col("user_id") % ranks).cast("int").alias("rank")).agg(load.alias("load"), F.count("*").alias("n")).select(F.col("window.start").alias("phase_start"), "rank", "load", "n")
