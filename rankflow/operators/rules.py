"""Who gives, who takes, in what order and with what odds: criteria, cumulative odds and object orders, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CMF, Criterion, Ordering
from ..model import Tables
from .work import rank_load


def accepts(criterion: Criterion, over: Column, under: Column, load: Column, average: Column, alpha: float = 1.0) -> Column:
    """Whether an object may go from an overloaded to an underloaded rank, by their scaled loads."""
    if criterion is Criterion.Grapevine:
        return ~(under + load * F.lit(alpha) > average)
    return load * F.lit(alpha) <= over - under


def loads_and_average(t: Tables, alpha: float = 1.0) -> DataFrame:
    """rank, load, average (one number, joined by a scalar subquery).  Loads are what compute is worth by the rank's factor, scaled by it once more where they are compared."""
    per = rank_load(t)
    if alpha != 1.0:
        per = per.withColumn("load", F.col("load") * F.lit(alpha))
        return per.select("rank", (F.col("load") * F.lit(alpha)).alias("load"), F.lit(per.agg(F.avg("load")).scalar()).alias("average"))
    return per.select("rank", "load", F.lit(per.agg(F.sum("load") / F.count(F.lit(1))).scalar()).alias("average"))


def underloaded(t: Tables) -> DataFrame:
    return loads_and_average(t).where("load < average").select("rank", "load")


def overloaded(t: Tables) -> DataFrame:
    return loads_and_average(t).where("load > average").select("rank", "load")


def sufficiently_underloaded(t: Tables, criterion: Criterion) -> DataFrame:
    """task_id, n_targets, first_target: ranks that the criterion lets each task of an overloaded rank go to (its own included, as it is tested like others).

    The ranks with their loads are one small array, held against every task in place: no pairs are made.
    """
    per = loads_and_average(t)
    all_ranks = per.agg(F.array_sort(F.collect_list(F.struct("rank", "load")))).scalar()
    tasks = t.task.select("task_id", "rank", F.col("load").alias("obj")).join(per.where("load > average"), "rank")
    ok = tasks.withColumn("r", all_ranks).withColumn("ok", F.filter("r", lambda x: accepts(criterion, F.col("load"), x["load"], F.col("obj"), F.col("average"))))
    return ok.select("task_id", F.size("ok").cast("long").alias("n_targets"), F.get("ok", F.lit(0))["rank"].alias("first_target"))


def cumulative_odds(ranks: DataFrame, kind: CMF, target: Column) -> DataFrame:
    """rank, cmf over candidates (rank, load): odds 1 - load * factor, summed in the order of ranks and normed; one candidate has 1."""
    every = Window.partitionBy(F.lit(0))
    factor = 1 / target if kind is CMF.Original else 1 / F.greatest(target, F.max("load").over(every).cast("double"))
    df = ranks.withColumn("w", 1 - F.col("load") * factor).withColumn("n", F.count(F.lit(1)).over(every))
    so_far = F.sum("w").over(every.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("total", F.sum("w").over(every)).withColumn("run", so_far)
    return df.select("rank", F.when(F.col("n") == 1, 1.0).when(F.col("total") != 0, F.col("run") / F.col("total")).alias("cmf"))


def sample(cmf: DataFrame, draw: float) -> DataFrame:
    """The first rank whose cumulative odds reach the draw; null if none does."""
    return cmf.where(F.col("cmf") >= draw).agg(F.min("rank").alias("rank"))


def object_order(t: Tables, ordering: Ordering, alpha: float = 1.0) -> DataFrame:
    """rank, task_id, pos: the order in which overloaded ranks offer their tasks; ties go by id."""
    over = loads_and_average(t, alpha).where("load > average").select("rank", F.col("load").alias("rload"), (F.col("load") - F.col("average")).alias("excess"))
    df = t.task.select("task_id", "rank", "load" if alpha == 1.0 else (F.col("load") * F.lit(alpha)).alias("load")).join(over, "rank")
    own = Window.partitionBy("rank")
    if ordering in (Ordering.ElmID, Ordering.Arbitrary):
        keys = [F.col("task_id")]
    elif ordering is Ordering.LargestObjects:
        keys = [F.col("load").desc(), F.col("task_id")]
    else:
        if ordering is Ordering.FewestMigrations:
            cut = F.min(F.when((F.col("load") >= F.col("excess")) & (F.col("load") < F.col("rload")), F.col("load"))).over(own)
        else:
            so_far = F.sum("load").over(own.orderBy("load", F.col("task_id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            df = df.withColumn("so_far", so_far)
            cut = F.min(F.when(F.col("so_far") >= F.col("excess"), F.col("load"))).over(own)
        df = df.withColumn("cut", F.coalesce(cut, "rload"))
        low = F.col("load") <= F.col("cut")
        keys = [F.when(low, 0).otherwise(1), F.when(low, -F.col("load")).otherwise(F.col("load")), F.col("task_id")]
    return df.select("rank", "task_id", F.row_number().over(own.orderBy(*keys)).cast("long").alias("pos"))
