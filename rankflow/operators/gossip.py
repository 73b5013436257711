"""Knowledge that spreads in synchronous rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def round_targets(ranks: DataFrame, k: int, fanout: int, seed: int, earlier: DataFrame | None = None) -> DataFrame:
    """src, dst: the `fanout` others with the least mixed hash of (src, dst, round), without those chosen before."""
    a, b = ranks.select(F.col("rank").alias("src")), ranks.select(F.col("rank").alias("dst"))
    pairs = a.join(b, F.col("src") != F.col("dst"))
    if earlier is not None:
        pairs = pairs.join(earlier, ["src", "dst"], "left_anti")
    x = (F.col("src").cast("long") + 3) * (F.col("dst") + 5) * 104729 + F.col("dst") * 7919 + k * 1299709 + seed * 15485863
    h = (x % 1000003) * (x % 999983) % 1000033
    return pairs.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy(h, "dst"))).where(F.col("pos") <= fanout).select("src", "dst")


def knowledge(ranks: DataFrame, rounds: int, fanout: int, seed: int) -> DataFrame:
    """knower, known after the rounds (one at least where there are two ranks): each passes on all it knows."""
    known, chosen = ranks.select(F.col("rank").alias("knower"), F.col("rank").alias("known")), None
    for k in range(1, max(1, rounds) + 1):
        now = round_targets(ranks, k, fanout, seed, chosen)
        sent = now.join(known, F.col("src") == F.col("knower")).select(F.col("dst").alias("knower"), "known")
        known = known.union(sent).distinct()
        chosen = now if chosen is None else chosen.union(now)
    return known
