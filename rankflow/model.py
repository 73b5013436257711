"""Schemas of the task-graph tables and the bundle that operators take.

Rank is a column, not a shard: tasks, edges and blocks are global tables, and `rank_info` lists every rank, so that an empty one
still counts.  An unknown rank is null.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

TASK = "task_id long, rank int, home_rank int, migratable boolean, load double, mem_working double, mem_footprint double, mem_serialized double"
EDGE = "from_task long, to_task long, volume double"
BLOCK = "block_id long, size double, home_rank int"
TASK_BLOCK = "task_id long, block_id long"
RANK_INFO = "rank int, footprint_bytes double, max_memory double"

#: Clusters of one rank are numbered below this, however many tasks it has; a global id is local + rank * this.
MAX_CLUSTERS = 1 << 32


@dataclass(frozen=True)
class Tables:
    task: DataFrame
    edge: DataFrame
    block: DataFrame
    task_block: DataFrame
    rank_info: DataFrame

    def placed(self, assignment: DataFrame) -> Tables:
        """The same graph with tasks on the ranks of an assignment (task_id, rank)."""
        return replace(self, task=self.task.drop("rank").join(assignment.select("task_id", "rank"), "task_id"))


def empty_tables(spark) -> Tables:
    return Tables(*(spark.createDataFrame([], s) for s in (TASK, EDGE, BLOCK, TASK_BLOCK, RANK_INFO)))
