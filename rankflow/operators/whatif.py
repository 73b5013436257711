"""Work and memory after moves, without making them.

Deltas are exact: what they say equals what a recomputation of the moved graph says.  Blocks are counted by references, edges
stay directed, and nothing falls below 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WorkModel
from ..model import Tables
from . import clusters as C
from .work import memory_usage, work_breakdown, work_formula


def after_task_moves(t: Tables, moves: DataFrame, m: WorkModel) -> DataFrame:
    """The breakdown of every rank after tasks (task_id, rank) have moved there; both tables of a move are only relabelled."""
    to = moves.select("task_id", F.col("rank").alias("new_rank"))
    placed = t.task.join(to, "task_id", "left").select("task_id", F.coalesce("new_rank", "rank").alias("rank"))
    return work_breakdown(t.placed(placed), m)


def cluster_moves(t: Tables, clusters: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """gid, src, dst: every cluster to every other rank; with pairs (src, dst), to those only."""
    own = clusters.select("gid", F.col("rank").alias("src")).distinct()
    if pairs is not None:
        return own.join(pairs.select("src", "dst"), "src").select("gid", "src", "dst")
    return own.join(t.rank_info.select(F.col("rank").alias("dst")), F.col("src") != F.col("dst"))


def _bytes_by_rank(t: Tables, clusters: DataFrame) -> DataFrame:
    """gid, rank, out_v, in_v: bytes from and to each cluster by the rank at the other end."""
    home = clusters.select("gid", "rank").distinct()
    e = C.inter_edges(t, clusters)
    out = e.join(home.withColumnRenamed("gid", "to_gid"), "to_gid").groupBy(F.col("from_gid").alias("gid"), "rank").agg(F.sum("volume").alias("out_v"), F.lit(0).cast("long").alias("in_v"))
    into = e.join(home.withColumnRenamed("gid", "from_gid"), "from_gid").groupBy(F.col("to_gid").alias("gid"), "rank").agg(F.lit(0).cast("long").alias("out_v"), F.sum("volume").alias("in_v"))
    return out.union(into).groupBy("gid", "rank").agg(F.sum("out_v").alias("out_v"), F.sum("in_v").alias("in_v"))


def _block_changes(t: Tables, clusters: DataFrame, moves: DataFrame) -> DataFrame:
    """gid, dst, lost_off, lost_all, won_off, won_all: bytes of blocks that leave the source rank, and that come new to the destination; off: only those with another home."""
    b = clusters.join(t.task_block, "task_id").groupBy("rank", "gid", "block_id").agg(F.lit(1).alias("one"))
    users = b.groupBy("rank", "block_id").agg(F.count("*").alias("users"))
    info = t.block.select("block_id", "size", "home_rank")
    used = b.select("gid", "block_id", F.col("rank").alias("src")).join(users.withColumnRenamed("rank", "src"), ["src", "block_id"]).join(info, "block_id")
    lost = used.where("users = 1").groupBy("gid").agg(F.sum(F.when(F.col("home_rank") != F.col("src"), F.col("size")).otherwise(0)).alias("lost_off"), F.sum("size").alias("lost_all"))
    there = users.select(F.col("rank").alias("dst"), "block_id")
    new = moves.select("gid", "dst").join(used.select("gid", "block_id", "size", "home_rank"), "gid").join(there, ["dst", "block_id"], "left_anti")
    won = new.groupBy("gid", "dst").agg(F.sum(F.when(F.col("home_rank") != F.col("dst"), F.col("size")).otherwise(0)).alias("won_off"), F.sum("size").alias("won_all"))
    return moves.join(lost, "gid", "left").join(won, ["gid", "dst"], "left").select("gid", "src", "dst", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("lost_off", "lost_all", "won_off", "won_all")))


def cluster_move_work(t: Tables, clusters: DataFrame, m: WorkModel, pairs: DataFrame | None = None) -> DataFrame:
    """For every move of a cluster (between the ranks of pairs, if given): gid, src, dst, the work of both ranks before and after, and the improvement of the larger."""
    base = work_breakdown(t, m)
    moves = _block_changes(t, clusters, cluster_moves(t, clusters, pairs))
    c = C.loads(t, clusters).select("gid", F.col("load").alias("c_load")).join(C.intra_bytes(t, clusters).select("gid", F.col("intra").alias("c_intra")), "gid")
    v = _bytes_by_rank(t, clusters)
    total = v.groupBy("gid").agg(F.sum("out_v").alias("out_all"), F.sum("in_v").alias("in_all"))
    df = moves.join(c, "gid").join(total, "gid", "left")
    for side in ("src", "dst"):
        df = df.join(v.select("gid", F.col("rank").alias(side), F.col("out_v").alias(f"out_{side}"), F.col("in_v").alias(f"in_{side}")), ["gid", side], "left")
        df = df.join(base.select(F.col("rank").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in ("compute", "recv", "send", "intra", "shared", "work"))), side)
    df = df.fillna(0, [f"{d}_{x}" for d in ("out", "in") for x in ("all", "src", "dst")])
    e = F.expr
    after = {
        "src": ("compute_src - c_load", "recv_src - (in_all - in_src) + out_src", "send_src - (out_all - out_src) + in_src", "intra_src - c_intra - out_src - in_src", "shared_src - lost_off"),
        "dst": ("compute_dst + c_load", "recv_dst - out_dst + (in_all - in_dst)", "send_dst - in_dst + (out_all - out_dst)", "intra_dst + c_intra + out_dst + in_dst", "shared_dst + won_off"),
    }
    for side, (compute, recv, send, intra, shared) in after.items():
        zero = lambda x: F.greatest(F.lit(0), e(x))
        df = df.withColumn(f"after_{side}", work_formula(m, zero(compute), F.greatest(zero(recv), zero(send)), zero(intra), zero(shared)))
    df = df.withColumn("improvement", F.greatest("work_src", "work_dst") - F.greatest("after_src", "after_dst"))
    return df.select("gid", "src", "dst", "work_src", "work_dst", "after_src", "after_dst", "improvement", "lost_all", "won_all")


def cluster_move_memory(t: Tables, clusters: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """gid, dst, usage (of the destination with the cluster), fits."""
    moves = _block_changes(t, clusters, cluster_moves(t, clusters, pairs))
    now = memory_usage(t).join(t.rank_info.select("rank", "max_memory"), "rank").withColumnRenamed("rank", "dst")
    c = C.memory(t, clusters).select("gid", "footprint", F.col("max_working").alias("cw"), F.col("max_serialized").alias("cs"))
    df = moves.join(c, "gid").join(now, "dst")
    usage = F.col("usage") + F.col("footprint") + F.greatest(F.lit(0), F.col("cw") - F.col("max_working")) + F.greatest(F.lit(0), F.col("cs") - F.col("max_serialized")) + F.col("won_all")
    return df.select("gid", "dst", usage.alias("usage"), (F.col("max_memory").isNull() | (usage <= F.col("max_memory"))).alias("fits"))


def candidates(t: Tables, clusters: DataFrame, m: WorkModel, known: DataFrame | None = None) -> DataFrame:
    """initiator, gid, src, dst, after_src, after_dst, improvement: the moves that ranks above the mean work can start, where the destination's memory has room.

    Such a rank gives a cluster to another rank, or receives one from it, which helps where it makes traffic or blocks local.
    known (knower, known): a rank takes only ranks that it knows into account; without it all.
    """
    base = work_breakdown(t, m)
    over = base.where(F.col("work") > base.agg(F.avg("work")).scalar()).select(F.col("rank").alias("initiator"))
    if known is None:
        seen = over.join(t.rank_info.select(F.col("rank").alias("other")), F.col("initiator") != F.col("other"))
    else:
        seen = known.select(F.col("knower").alias("initiator"), F.col("known").alias("other")).where("initiator <> other").join(over, "initiator")
    give = seen.select("initiator", F.col("initiator").alias("src"), F.col("other").alias("dst"))
    both = give.union(seen.select("initiator", F.col("other").alias("src"), F.col("initiator").alias("dst")))
    pairs = both.select("src", "dst").distinct()
    work = cluster_move_work(t, clusters, m, pairs)
    fits = cluster_move_memory(t, clusters, pairs).where("fits").select("gid", "dst")
    return work.join(fits, ["gid", "dst"]).join(both, ["src", "dst"]).select("initiator", "gid", "src", "dst", "after_src", "after_dst", "improvement")


def best(cands: DataFrame, n: int = 1) -> DataFrame:
    """The best n moves of each initiator: by improvement, then its own least work after, then the other's, then ids."""
    from pyspark.sql.window import Window

    own, other = (F.when(F.col("initiator") == F.col("src"), F.col(a)).otherwise(F.col(b)) for a, b in (("after_src", "after_dst"), ("after_dst", "after_src")))
    w = Window.partitionBy("initiator").orderBy(F.col("improvement").desc(), own, other, "dst", "src", "gid")
    return cands.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
