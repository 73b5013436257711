"""Clusters of tasks: ids, summaries, bytes inside and across."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import MAX_CLUSTERS, Tables


def global_id(local: Column, rank: Column) -> Column:
    return local.cast("long") + rank.cast("long") * F.lit(MAX_CLUSTERS)


def local_id(gid: Column) -> Column:
    return gid % MAX_CLUSTERS


def rank_of(gid: Column) -> Column:
    return F.floor(gid / MAX_CLUSTERS).cast("int")


def given_clusters(t: Tables, modulus: int = 16) -> DataFrame:
    """rank, task_id, gid: a fixed clustering, by the id's remainder inside each rank."""
    return t.task.select("rank", "task_id", global_id(F.col("task_id") % modulus, F.col("rank")).alias("gid"))


def unclustered(t: Tables, clusters: DataFrame) -> DataFrame:
    """Tasks without a cluster: empty if all have one."""
    return t.task.join(clusters, "task_id", "left_anti").select("task_id")


def add_cluster(clusters: DataFrame, tasks: DataFrame, gid: int | None = None) -> DataFrame:
    """Registers (rank, task_id) as one more cluster, of the id given or the next free one of the tasks' rank."""
    number = F.lit(gid)
    if gid is None:
        tasks = tasks.join(clusters.groupBy("rank").agg((F.max("gid") + 1).alias("free")), "rank", "left")
        number = F.coalesce("free", global_id(F.lit(0), F.col("rank")))
    return clusters.join(tasks, "task_id", "left_anti").unionByName(tasks.select("rank", "task_id", number.cast("long").alias("gid")))


def cluster_edges(t: Tables, clusters: DataFrame) -> DataFrame:
    """from_gid, to_gid, volume of every task edge; null for tasks without a cluster."""
    a = clusters.select(F.col("task_id").alias("from_task"), F.col("gid").alias("from_gid"))
    b = clusters.select(F.col("task_id").alias("to_task"), F.col("gid").alias("to_gid"))
    return t.edge.join(a, "from_task", "left").join(b, "to_task", "left").select("from_gid", "to_gid", "volume")


def loads(t: Tables, clusters: DataFrame) -> DataFrame:
    """gid, load, n_tasks."""
    return clusters.join(t.task.select("task_id", "load"), "task_id").groupBy("gid").agg(F.sum("load").alias("load"), F.count("*").alias("n_tasks"))


def intra_bytes(t: Tables, clusters: DataFrame) -> DataFrame:
    """gid, intra: bytes between tasks of one cluster."""
    e = cluster_edges(t, clusters).where("from_gid = to_gid").groupBy(F.col("from_gid").alias("gid")).agg(F.sum("volume").alias("intra"))
    return clusters.select("gid").distinct().join(e, "gid", "left").select("gid", F.coalesce("intra", F.lit(0)).alias("intra"))


def inter_edges(t: Tables, clusters: DataFrame) -> DataFrame:
    """from_gid, to_gid, volume, n_edges: directed sums between different clusters."""
    return cluster_edges(t, clusters).where("from_gid <> to_gid").groupBy("from_gid", "to_gid").agg(F.sum("volume").alias("volume"), F.count("*").alias("n_edges"))


def memory(t: Tables, clusters: DataFrame) -> DataFrame:
    """gid, footprint, max_working, max_serialized, and the largest of both among the rank's other clusters (0 if there are none)."""
    m = clusters.join(t.task.drop("rank"), "task_id").groupBy("rank", "gid").agg(F.sum("mem_footprint").alias("footprint"), F.max("mem_working").alias("max_working"), F.max("mem_serialized").alias("max_serialized"))
    for c in ("working", "serialized"):
        w = Window.partitionBy("rank").orderBy(F.col(f"max_{c}").desc(), "gid")
        every = Window.partitionBy("rank")
        m = m.withColumn("p", F.row_number().over(w))
        best, second = F.max(F.when(F.col("p") == 1, F.col(f"max_{c}"))).over(every), F.max(F.when(F.col("p") == 2, F.col(f"max_{c}"))).over(every)
        m = m.withColumn(f"outside_{c}", F.coalesce(F.when(F.col("p") == 1, second).otherwise(best), F.lit(0))).drop("p")
    return m.drop("rank")


def blocks(t: Tables, clusters: DataFrame) -> DataFrame:
    """gid, block_id, size: the blocks that a cluster's tasks use."""
    return clusters.join(t.task_block, "task_id").select("gid", "block_id").distinct().join(t.block.select("block_id", "size"), "block_id").select("gid", "block_id", "size")


def boundary_bytes(t: Tables, clusters: DataFrame) -> DataFrame:
    """gid, intra, boundary: rounded bytes inside, and across to other clusters, credited to both."""
    e = cluster_edges(t, clusters).withColumn("v", F.round("volume").cast("long"))
    ends = e.select("v", (F.col("from_gid") == F.col("to_gid")).alias("same"), F.explode(F.array_distinct(F.array("from_gid", "to_gid"))).alias("gid")).where("gid is not null")
    one = lambda c: F.sum(F.when(c, F.col("v")).otherwise(0))
    return ends.groupBy("gid").agg(one(F.col("same")).alias("intra"), one(~F.coalesce("same", F.lit(False))).alias("boundary"))


def counts(clusters: DataFrame) -> DataFrame:
    """One row: n_clusters, and the most that a rank has."""
    per = clusters.groupBy("rank").agg(F.countDistinct("gid").alias("n"))
    return per.agg(F.sum("n").alias("n_clusters"), F.max("n").alias("most"))


def summaries(t: Tables, clusters: DataFrame) -> DataFrame:
    """One row a cluster: load, tasks, bytes inside, memory, and lists of its edges to other clusters and of its blocks."""
    e = inter_edges(t, clusters)
    both = e.select(F.col("from_gid").alias("gid"), "from_gid", "to_gid", "volume").union(e.select(F.col("to_gid").alias("gid"), "from_gid", "to_gid", "volume"))
    edges = both.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("from_gid", "to_gid", "volume"))).alias("edges"))
    held = blocks(t, clusters).groupBy("gid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_id", "size")))).alias("blocks"))
    return loads(t, clusters).join(intra_bytes(t, clusters), "gid").join(memory(t, clusters), "gid").join(edges, "gid", "left").join(held, "gid", "left")
