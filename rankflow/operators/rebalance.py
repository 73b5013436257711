"""Moving tasks or clusters between ranks until loads are even."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CMF, BalanceConfig, Criterion, Ordering
from ..functions.lineage import cut
from ..model import Tables
from . import clustering, gossip, whatif
from .rules import object_order
from .work import rank_load, statistics, work_breakdown


#: Resolution of the communication clusters of a balancing iteration.
LOOP_RESOLUTION = 1000.0


def _fits(kind: Criterion, over: float, under: float, load: float, average: float, alpha: float = 1.0) -> bool:
    """Whether an object may go; loads are scaled by the ranks' factor."""
    over, under, load = over * alpha, under * alpha, load * alpha
    return under + load <= average if kind is Criterion.Grapevine else load <= over - under


def _pick(candidates: list[int], load: dict[int, float], kind: CMF, target: float, draw: float) -> int | None:
    """The candidate whose cumulative odds first reach the draw."""
    if len(candidates) == 1:
        return candidates[0]
    scale = target if kind is CMF.Original else max(target, max(load[r] for r in candidates))
    odds = [1 - load[r] / scale if scale else 0.0 for r in candidates]
    total, run = sum(odds), 0.0
    for r, w in zip(candidates, odds):
        run += w
        if total and run / total >= draw:
            return r
    return None


def decide(tasks: list[tuple[int, float, bool]], own: int, load: dict[int, float], average: float, cfg: BalanceConfig) -> tuple[list[tuple[int, int]], float]:
    """The (task, destination) moves that one overloaded rank wants, for its tasks (id, load, migratable) in order; and its load after them."""
    load, a = dict(load), cfg.work.rank_alpha
    under = sorted(r for r, x in load.items() if x * a < average and r != own)
    moves, candidates = [], under
    for task, size, movable in tasks:
        if load[own] * a <= average or not under:
            break
        if cfg.cmf_type is CMF.Original:
            candidates = sorted(r for r, x in load.items() if x * a < average and r != own)
        elif cfg.cmf_type is CMF.NormByMaxExcludeIneligible:
            candidates = sorted(r for r in load if r != own and _fits(cfg.criterion, load[own], load[r], size, average, a))
        if not candidates:
            continue
        to = _pick(candidates, {r: x * a for r, x in load.items()}, cfg.cmf_type, average, cfg.draw)
        if to is not None and movable and _fits(cfg.criterion, load[own], load[to], size, average, a):
            moves.append((task, to))
            load[own] -= size
            load[to] += size
    return moves, load[own]


def transfer_tasks(t: Tables, cfg: BalanceConfig) -> DataFrame:
    """task_id, rank after one round: overloaded ranks decide by what they know, receivers accept in the order (source, turn) up to the largest load before."""
    alpha = cfg.work.rank_alpha
    per = rank_load(t).select("rank", (F.col("load") * F.lit(alpha)).cast("double").alias("load"))
    per = cut(per.select("*", *(F.lit(per.agg(f("load")).scalar()).alias(n) for f, n in ((F.avg, "average"), (F.max, "most")))))
    known = gossip.knowledge(t.rank_info.select("rank"), cfg.n_rounds, cfg.fanout, cfg.seed)
    known = known.join(per.select(F.col("rank").alias("known"), "load", "average"), "known").withColumnRenamed("knower", "rank")
    order = object_order(t, cfg.obj_ordering if cfg.obj_ordering is not Ordering.Arbitrary else Ordering.ElmID, alpha)
    tasks = order.join(t.task.select("task_id", F.col("load").cast("double").alias("load"), "migratable"), "task_id")

    def giver(objects: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        out = {"task_id": [], "src": [], "dst": [], "turn": [], "left": []}
        if len(objects) and len(seen):
            own = int(objects["rank"].iloc[0])
            objects = objects.sort_values("pos")
            loads = {int(r): float(x) for r, x in zip(seen["known"], seen["load"])}
            moves, left = decide(list(zip(objects["task_id"], objects["load"], objects["migratable"])), own, loads, float(seen["average"].iloc[0]), cfg)
            out = {"task_id": [m[0] for m in moves], "src": own, "dst": [m[1] for m in moves], "turn": range(len(moves)), "left": left}
        return pd.DataFrame(out)

    wanted = cut(tasks.groupBy("rank").cogroup(known.groupBy("rank")).applyInPandas(giver, "task_id long, src int, dst int, turn long, left double"))
    left = wanted.groupBy(F.col("src").alias("rank")).agg(F.min("left").alias("left"))
    info = per.join(left, "rank", "left").select(F.col("rank").alias("dst"), F.coalesce("left", "load").alias("held"), "most")
    sizes = t.task.select("task_id", F.col("load").cast("double").alias("load"))

    def taker(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "turn"])
        held, taken = float(rows["held"].iloc[0]), []
        for task, size, most in zip(rows["task_id"], rows["load"], rows["most"]):
            if (held + size) * alpha <= most:
                held += size
                taken.append(task)
        return pd.DataFrame({"task_id": taken, "rank": int(rows["dst"].iloc[0])})

    moved = wanted.join(sizes, "task_id").join(info, "dst").groupBy("dst").applyInPandas(taker, "task_id long, rank int").withColumnRenamed("rank", "new_rank")
    return t.task.select("task_id", "rank").join(moved, "task_id", "left").select("task_id", F.coalesce("new_rank", "rank").alias("rank"))


def transfer_clusters(t: Tables, clusters: DataFrame, cfg: BalanceConfig) -> DataFrame:
    """task_id, rank after one round: each rank above the mean work proposes the best cluster move, given or received, with the ranks it knows; proposals are granted by improvement, a rank being in one of them at most, so every granted delta holds."""
    known = gossip.knowledge(t.rank_info.select("rank"), cfg.n_rounds, cfg.fanout, cfg.seed)
    wanted = whatif.best(whatif.candidates(t, clusters, cfg.work, known)).where("improvement > 0")

    def grant(rows: pd.DataFrame) -> pd.DataFrame:
        busy, out = set(), []
        for gid, src, dst in rows.sort_values(["improvement", "initiator"], ascending=[False, True])[["gid", "src", "dst"]].itertuples(index=False):
            if src not in busy and dst not in busy:
                busy |= {src, dst}
                out.append((gid, dst))
        return pd.DataFrame(out, columns=["gid", "new_rank"])

    # one row a rank at most
    granted = wanted.select("gid", "initiator", "src", "dst", "improvement", F.lit(0).alias("all")).groupBy("all").applyInPandas(grant, "gid long, new_rank int")
    placed = clusters.select("task_id", "gid").join(F.broadcast(granted), "gid").select("task_id", "new_rank")
    return t.task.select("task_id", "rank").join(placed, "task_id", "left").select("task_id", F.coalesce("new_rank", "rank").alias("rank"))


@dataclass
class Balanced:
    assignment: DataFrame
    #: trial, iteration, max_work, avg_work, imbalance; iteration 0 is the start.
    history: DataFrame


def rebalance(t: Tables, cfg: BalanceConfig, early_stop: bool = False) -> Balanced:
    """Trials of iterations from the same start; the trial with the least largest work wins, the first of equals."""
    spark = t.task.sparkSession
    # read once: each iteration would go back to the sources else
    t = Tables(cut(t.task), cut(t.edge), cut(t.block), cut(t.task_block), cut(t.rank_info))
    start, rows, results = cut(t.task.select("task_id", "rank")), [], []
    for trial in range(cfg.num_trials):
        own = cfg if trial == 0 or cfg.deterministic else BalanceConfig(**{**cfg.__dict__, "seed": cfg.seed + trial})
        placed = start
        for i in range(cfg.num_iters + 1):
            now = t.placed(placed)
            s = statistics(work_breakdown(now, cfg.work), "work").first()
            rows.append((trial, i, float(s.max_v), float(s.avg_v), float(s.imbalance)))
            if i == cfg.num_iters or (early_stop and s.imbalance <= cfg.converge_tolerance):
                break
            if cfg.work.by_clusters:
                groups = clustering.potts_clusters(now, LOOP_RESOLUTION, by_tasks=False) if cfg.based_on_communication else clustering.block_matching(now)
                placed = cut(transfer_clusters(now, cut(groups), own))
            else:
                placed = cut(transfer_tasks(now, own))
        results.append((rows[-1][2], trial, placed))
    best = min(results, key=lambda r: r[:2])
    return Balanced(best[2], spark.createDataFrame(rows, "trial int, iteration int, max_work double, avg_work double, imbalance double"))


def run_spec(spark, spec) -> Balanced | None:
    """A run description read by config.run_spec: reads its folder and phase, and balances; nothing for the algorithm None."""
    from ..config import Algorithm
    from ..sources.json_shard import documents, read_phase

    if spec.algorithm is Algorithm.NoLB:
        return None
    return rebalance(read_phase(documents(spark, spec.data_folder), spec.phase_id), spec.config)


def verification(t: Tables, b: Balanced) -> DataFrame:
    """One row: tasks lost or added, change of the total load, and whether the largest load did not rise."""
    lost = t.task.join(b.assignment, "task_id", "left_anti").select(F.count("*").alias("tasks_lost"))
    after = rank_load(t.placed(b.assignment))
    before = rank_load(t)
    a = after.agg(F.sum("load").alias("a"), F.max("load").alias("ma"), F.sum("n_tasks").alias("na"))
    z = before.agg(F.sum("load").alias("z"), F.max("load").alias("mz"), F.sum("n_tasks").alias("nz"))
    return lost.select("tasks_lost", *(F.lit(x).alias(n) for n, x in (("tasks_added", a.select("na").scalar() - z.select("nz").scalar()), ("load_change", a.select("a").scalar() - z.select("z").scalar()))), (a.select("ma").scalar() <= z.select("mz").scalar()).alias("max_not_raised"))
