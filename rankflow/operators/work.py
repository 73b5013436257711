"""Loads, work and memory of ranks, and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MemoryInfo, WorkModel
from ..model import Tables


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(0)).alias(n) for n in names]


def rank_load(t: Tables) -> DataFrame:
    """rank, load, n_tasks of every rank, empty ones too."""
    per = t.task.groupBy("rank").agg(F.sum("load").alias("load"), F.count("*").alias("n_tasks"))
    return t.rank_info.select("rank").join(per, "rank", "left").select("rank", *_zero("load", "n_tasks"))


def statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: least, most and mean of a column, and the imbalance (most / mean - 1, or 0 where the mean is not positive)."""
    row = df.agg(F.min(column).alias("min_v"), F.max(column).alias("max_v"), (F.sum(column) / F.count(F.lit(1))).alias("avg_v"))
    return row.withColumn("imbalance", F.when(F.col("avg_v") > 0, F.col("max_v") / F.col("avg_v") - 1).otherwise(F.lit(0.0)))


def edge_ranks(t: Tables) -> DataFrame:
    """Edges with the ranks of their ends; null for unknown tasks."""
    a = t.task.select(F.col("task_id").alias("from_task"), F.col("rank").alias("from_rank"))
    b = t.task.select(F.col("task_id").alias("to_task"), F.col("rank").alias("to_rank"))
    return t.edge.join(a, "from_task", "left").join(b, "to_task", "left").select("from_task", "to_task", "volume", "from_rank", "to_rank")


def communication(t: Tables) -> DataFrame:
    """rank, recv, send, intra: each edge counts at both of its ranks, once if they are one."""
    same = F.col("from_rank").eqNullSafe(F.col("to_rank"))
    ends = F.array(F.struct(F.col("from_rank").alias("rank"), F.lit(True).alias("out")), F.struct(F.col("to_rank").alias("rank"), F.lit(False).alias("out")))
    at = edge_ranks(t).withColumn("same", same).select("volume", "same", F.explode(ends).alias("e")).where("e.rank is not null and (e.out or not same)")
    one = lambda c: F.sum(F.when(c, F.col("volume")).otherwise(0))
    per = at.groupBy(F.col("e.rank").alias("rank")).agg(one(~F.col("same") & ~F.col("e.out")).alias("recv"), one(~F.col("same") & F.col("e.out")).alias("send"), one(F.col("same")).alias("intra"))
    return t.rank_info.select("rank").join(per, "rank", "left").select("rank", *_zero("recv", "send", "intra"))


def used_blocks(t: Tables) -> DataFrame:
    """rank, block_id, size, home_rank: the distinct blocks that a rank's tasks use; one that is not in the table of blocks raises."""
    used = t.task_block.join(t.task.select("task_id", "rank"), "task_id").select("rank", "block_id").distinct()
    known = t.block.select("block_id", "size", "home_rank", F.lit(True).alias("known"))
    missing = F.raise_error(F.concat(F.lit("no information on shared block "), F.col("block_id").cast("string")))
    return used.join(known, "block_id", "left").select("rank", "block_id", F.when(F.col("known"), F.col("size")).otherwise(missing.cast(t.block.schema["size"].dataType)).alias("size"), "home_rank")


def shared_bytes(t: Tables) -> DataFrame:
    """rank, off_home (bytes of used blocks whose home is another rank) and total."""
    per = used_blocks(t).groupBy("rank").agg(F.sum(F.when(F.col("home_rank") != F.col("rank"), F.col("size")).otherwise(0)).alias("off_home"), F.sum("size").alias("total"))
    return t.rank_info.select("rank").join(per, "rank", "left").select("rank", *_zero("off_home", "total"))


def memory_usage(t: Tables, flags: MemoryInfo = MemoryInfo()) -> DataFrame:
    """rank, max_working, max_serialized, usage."""
    take = lambda name, c: c if flags.on(name) else F.lit(0)
    per = t.task.groupBy("rank").agg(F.sum("mem_footprint").alias("fp"), F.max("mem_working").alias("max_working"), F.max("mem_serialized").alias("max_serialized"))
    df = t.rank_info.join(per, "rank", "left").join(shared_bytes(t).select("rank", F.col("total").alias("blocks")), "rank")
    df = df.select("rank", "footprint_bytes", "blocks", *_zero("fp", "max_working", "max_serialized"))
    usage = (
        take("has_mem_info", F.col("footprint_bytes"))
        + take("has_task_footprint_mem_info", F.col("fp"))
        + take("has_task_working_mem_info", F.col("max_working"))
        + take("has_task_serialized_mem_info", F.col("max_serialized"))
        + take("has_shared_block_mem_info", F.col("blocks"))
    )
    return df.select("rank", "max_working", "max_serialized", usage.alias("usage"))


def memory_fits(t: Tables, flags: MemoryInfo = MemoryInfo()) -> DataFrame:
    """rank, usage, fits: within the rank's memory; always where it is unlimited (null) or memory is off."""
    df = memory_usage(t, flags).join(t.rank_info.select("rank", "max_memory"), "rank")
    return df.select("rank", "usage", (F.lit(not flags.has_mem_info) | F.col("max_memory").isNull() | (F.col("usage") <= F.col("max_memory"))).alias("fits"))


def work_formula(m: WorkModel, compute: Column, inter: Column, intra: Column, shared: Column) -> Column:
    """The weighted sum; terms of weight 0 are left out of the plan."""
    out = F.lit(float(m.rank_alpha)) * compute
    for weight, term in ((m.beta, inter), (m.gamma, intra), (m.delta, shared)):
        if weight:
            out = out + F.lit(float(weight)) * term
    return out


def work_breakdown(t: Tables, m: WorkModel) -> DataFrame:
    """rank, compute, recv, send, intra, shared, work.  Tables that no weight asks for are not read."""
    df = rank_load(t).select("rank", F.col("load").alias("compute"))
    df = df.join(communication(t), "rank") if m.beta or m.gamma else df.select("*", *(F.lit(0).alias(c) for c in ("recv", "send", "intra")))
    df = df.join(shared_bytes(t).select("rank", F.col("off_home").alias("shared")), "rank") if m.delta else df.withColumn("shared", F.lit(0))
    return df.withColumn("work", work_formula(m, F.col("compute"), F.greatest("send", "recv"), F.col("intra"), F.col("shared")))
