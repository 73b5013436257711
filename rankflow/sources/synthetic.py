"""Task graphs of any size with shared blocks, made from integer draws: no shuffle but the one that adds up repeated edges.

Every count, load and endpoint is a function of ids and the seed, so any task can be named without a join, and reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Tables

P1, P2, P3 = 1000003, 999983, 1000033


@dataclass(frozen=True)
class Shape:
    """Sizes of a graph; a rank has from least_blocks to most_blocks blocks, a block from least_tasks to most_tasks tasks."""

    ranks: int = 8
    least_blocks: int = 5
    most_blocks: int = 20
    least_tasks: int = 2
    most_tasks: int = 12
    most_ends: int = 4
    mean_volume: int = 1000
    seed: int = 29


def draw_sql(key: str, stream: int, seed: int) -> str:
    """An integer below P3 for a key and a stream, in arithmetic that Spark and other SQL engines share."""
    whole = "floor({k}/{p})"
    u = f"(({key})%{P1}*104729+CAST({whole.format(k=f'CAST(({key}) AS DOUBLE)', p=P1)} AS BIGINT)*7919+{stream * 1299709 + seed * 15485863})%{P2}"
    return f"(({u})*(({u})+{2 * stream + 3})%{P3})"


def _draw(key: str, stream: int, s: Shape) -> str:
    return draw_sql(key, stream, s.seed)


def n_blocks_sql(rank: str, s: Shape) -> str:
    return f"({s.least_blocks}+{_draw(rank, 1, s)}%{s.most_blocks - s.least_blocks + 1})"


def n_tasks_sql(block: str, s: Shape) -> str:
    return f"({s.least_tasks}+{_draw(block, 2, s)}%{s.most_tasks - s.least_tasks + 1})"


def blocks(spark: SparkSession, s: Shape = Shape()) -> DataFrame:
    """block_id, size, home_rank."""
    rank = F.floor(F.col("id") / s.most_blocks).cast("long")
    ids = spark.range(s.ranks * s.most_blocks).select(F.col("id").alias("block_id"), rank.alias("rank"))
    kept = ids.where(f"block_id % {s.most_blocks} < {n_blocks_sql('rank', s)}")
    return kept.select("block_id", F.expr(f"CAST(1048576+{_draw('block_id', 3, s)}%1025 AS BIGINT)").alias("size"), F.col("rank").cast("int").alias("home_rank"))


def tasks(spark: SparkSession, s: Shape = Shape()) -> DataFrame:
    """The task columns, and block_id: the block that each task shares."""
    of = blocks(spark, s).select("block_id", "home_rank", F.expr(f"explode(sequence(0, CAST({n_tasks_sql('block_id', s)} AS INT) - 1))").alias("i"))
    of = of.select("block_id", F.col("home_rank").alias("rank"), "home_rank", (F.col("block_id") * s.most_tasks + F.col("i")).alias("task_id"))
    return of.select(
        "task_id",
        "rank",
        "home_rank",
        F.lit(True).alias("migratable"),
        F.expr(f"10+{_draw('task_id', 4, s)}/CAST({P3} AS DOUBLE)*10").alias("load"),
        F.expr(f"CAST(1020+{_draw('task_id', 5, s)}%1029 AS BIGINT)").alias("mem_working"),
        F.lit(256).cast("long").alias("mem_footprint"),
        F.lit(128).cast("long").alias("mem_serialized"),
        "block_id",
    )


def edges(task: DataFrame, s: Shape = Shape()) -> DataFrame:
    """from_task, to_task, volume: from none to most_ends ends a task, half of them incoming, at tasks of any rank."""
    ends = task.select("task_id", F.expr(f"explode(sequence(0, {s.most_ends - 1}))").alias("k")).where(f"k < {_draw('task_id', 6, s)}%{s.most_ends + 1}")
    ends = ends.select("task_id", (F.col("task_id") * s.most_ends + F.col("k")).alias("e"))
    ends = ends.withColumn("r", F.expr(f"{_draw('e', 7, s)}%{s.ranks}"))
    ends = ends.withColumn("b", F.expr(f"r*{s.most_blocks}+{_draw('e', 8, s)}%{n_blocks_sql('r', s)}"))
    ends = ends.withColumn("o", F.expr(f"b*{s.most_tasks}+{_draw('e', 9, s)}%{n_tasks_sql('b', s)}")).where("o <> task_id")
    volume = f"CAST(1+floor(-ln(1-{_draw('e', 10, s)}/CAST({P3} AS DOUBLE))*{s.mean_volume}) AS BIGINT)"
    out = F.expr(f"{_draw('e', 11, s)}%2 = 0")
    pair: list[Column] = [F.when(out, a).otherwise(b).alias(n) for n, a, b in (("from_task", F.col("task_id"), F.col("o")), ("to_task", F.col("o"), F.col("task_id")))]
    return ends.select(*pair, F.expr(volume).alias("v")).groupBy("from_task", "to_task").agg(F.sum("v").alias("volume"))


def graph(spark: SparkSession, s: Shape = Shape()) -> Tables:
    t = tasks(spark, s)
    info = spark.range(s.ranks).select(F.col("id").cast("int").alias("rank"), F.lit(0).cast("long").alias("footprint_bytes"), F.lit(None).cast("long").alias("max_memory"))
    return Tables(t.drop("block_id"), edges(t, s), blocks(spark, s), t.select("task_id", "block_id"), info)


def oracle(s: Shape = Shape()) -> str:
    """The same tables for the oracle: sb (blocks), st (tasks), se (edges)."""
    half = f"{_draw('e', 11, s)}%2=0"
    return f"""sb AS (SELECT block_id, CAST(1048576+{_draw('block_id', 3, s)}%1025 AS BIGINT) AS size, CAST(rank AS INT) AS home_rank
  FROM (SELECT r AS block_id, r//{s.most_blocks} AS rank FROM range({s.ranks * s.most_blocks}) t(r)) x WHERE block_id%{s.most_blocks} < {n_blocks_sql('rank', s)}),
st AS (SELECT *, 10+{_draw('task_id', 4, s)}/CAST({P3} AS DOUBLE)*10 AS load, CAST(1020+{_draw('task_id', 5, s)}%1029 AS BIGINT) AS mem_working
  FROM (SELECT block_id, home_rank AS rank, block_id*{s.most_tasks}+i AS task_id FROM sb, range({s.most_tasks}) g(i) WHERE i < {n_tasks_sql('block_id', s)}) x),
s1 AS (SELECT task_id, task_id*{s.most_ends}+k AS e FROM st, range({s.most_ends}) g(k) WHERE k < {_draw('task_id', 6, s)}%{s.most_ends + 1}),
s2 AS (SELECT *, {_draw('e', 7, s)}%{s.ranks} AS r FROM s1),
s3 AS (SELECT *, r*{s.most_blocks}+{_draw('e', 8, s)}%{n_blocks_sql('r', s)} AS b FROM s2),
s4 AS (SELECT *, b*{s.most_tasks}+{_draw('e', 9, s)}%{n_tasks_sql('b', s)} AS o FROM s3),
se AS (SELECT CASE WHEN {half} THEN task_id ELSE o END AS from_task, CASE WHEN {half} THEN o ELSE task_id END AS to_task,
  CAST(sum(CAST(1+floor(-ln(1-{_draw('e', 10, s)}/CAST({P3} AS DOUBLE))*{s.mean_volume}) AS BIGINT)) AS BIGINT) AS volume FROM s4 WHERE o<>task_id GROUP BY ALL)"""
