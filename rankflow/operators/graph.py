"""Hygiene and shape of the task graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Tables
from .work import edge_ranks


def upsert_edges(raw: DataFrame) -> DataFrame:
    """Of rows (from_task, to_task, volume, seq) the last volume of each pair."""
    return raw.groupBy("from_task", "to_task").agg(F.max_by("volume", "seq").alias("volume"))


def first_tasks(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows (task_id, columns, seq) the first of each task."""
    return raw.groupBy("task_id").agg(F.min_by(F.struct(*columns), "seq").alias("x")).select("task_id", "x.*")


def merge_shards(task: DataFrame, edge: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One task, edge and rank_info table of shards that overlap; each input has a column shard, whose order settles who wins.

    Of a task the first shard counts, of an edge the last one's volume; footprints of a rank add up, and its largest memory holds.
    """
    tasks = first_tasks(task.withColumnRenamed("shard", "seq"), [c for c in task.columns if c not in ("task_id", "shard")])
    edges = upsert_edges(edge.withColumnRenamed("shard", "seq"))
    ranks = info.groupBy("rank").agg(F.sum("footprint_bytes").alias("footprint_bytes"), F.max("max_memory").alias("max_memory"))
    return tasks, edges, ranks


def symmetrize(t: Tables) -> DataFrame:
    """holder, from_task, to_task, volume: every edge at the ranks of both ends."""
    e = edge_ranks(t)
    holders = F.array_distinct(F.array("from_rank", "to_rank"))
    return e.select(F.explode(holders).alias("holder"), "from_task", "to_task", "volume").where("holder is not null")


def purge_dangling(edge: DataFrame, task: DataFrame) -> DataFrame:
    """Edges with at least one end among the tasks."""
    a, b = task.select(F.col("task_id").alias("from_task")), task.select(F.col("task_id").alias("to_task"))
    one = edge.join(a, "from_task", "left_semi")
    return one.unionByName(edge.join(a, "from_task", "left_anti").join(b, "to_task", "left_semi"))


def undirected(t: Tables) -> DataFrame:
    """u < v, weight: volumes of both directions between tasks of one rank."""
    e = edge_ranks(t).where("from_rank = to_rank and from_task <> to_task")
    return e.groupBy(F.least("from_task", "to_task").alias("u"), F.greatest("from_task", "to_task").alias("v")).agg(F.sum("volume").alias("weight"))


def sharing(t: Tables) -> DataFrame:
    """block_id, task_id, rank, size: each block that a task uses, once."""
    return t.task_block.join(t.task.select("task_id", "rank"), "task_id").join(t.block.select("block_id", "size"), "block_id").dropDuplicates(["task_id", "block_id"])


def coaccess(t: Tables) -> DataFrame:
    """u < v, weight: bytes of the blocks that two tasks of one rank share."""
    rows = sharing(t)
    a = rows.select("block_id", "rank", "size", F.col("task_id").alias("u"))
    b = rows.select("block_id", "rank", F.col("task_id").alias("v"))
    return a.join(b, ["block_id", "rank"]).where("u < v").groupBy("u", "v").agg(F.sum("size").alias("weight"))


def homed_blocks(t: Tables) -> DataFrame:
    """rank, block_id: the blocks that have their home on a rank."""
    return t.block.join(t.rank_info.select(F.col("rank").alias("home_rank")), "home_rank").select(F.col("home_rank").alias("rank"), "block_id")


def block_references(t: Tables) -> DataFrame:
    """block_id, n_tasks: of every block, unreferenced ones too."""
    n = t.task_block.groupBy("block_id").agg(F.countDistinct("task_id").alias("n_tasks"))
    return t.block.select("block_id").join(n, "block_id", "left").select("block_id", F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"))


def unreferenced_blocks(block: DataFrame, task_block: DataFrame) -> DataFrame:
    return block.join(task_block, "block_id", "left_anti").select("block_id")
