"""Graphviz text of task graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Tables

#: Fill colours of clusters, by id.
COLOURS = ("lightblue", "lightgreen", "lightyellow", "lightpink", "lightgray", "lightcyan", "lavender", "mistyrose", "honeydew", "aliceblue", "beige", "thistle")


def lines(t: Tables, clusters: DataFrame) -> DataFrame:
    """rank, section, ord, line: nodes of each rank's clusters, and edges once each; between ranks red, between clusters orange."""
    c = clusters.select("task_id", "gid")
    nodes = t.task.join(c, "task_id", "left").select(
        "rank", F.lit(1).alias("section"), F.col("task_id").alias("ord"), F.format_string('  t%d [label="t%d\\nL=%.1f"];', "task_id", "task_id", F.col("load").cast("double")).alias("line")
    )
    a = t.task.select(F.col("task_id").alias("from_task"), "rank").join(c.select(F.col("task_id").alias("from_task"), F.col("gid").alias("fg")), "from_task", "left")
    b = t.task.select(F.col("task_id").alias("to_task"), F.col("rank").alias("to_rank")).join(c.select(F.col("task_id").alias("to_task"), F.col("gid").alias("tg")), "to_task", "left")
    e = t.edge.join(a, "from_task").join(b, "to_task")
    colour = F.when(F.col("rank") != F.col("to_rank"), " color=red").when(F.col("fg") != F.col("tg"), " color=orange").otherwise("")
    line = F.format_string('  t%d -> t%d [label="%d"%s];', "from_task", "to_task", F.round("volume").cast("long"), colour)
    edges = e.select("rank", F.lit(2).alias("section"), F.col("from_task").alias("ord"), line.alias("line"))
    return nodes.unionByName(edges)


def document(t: Tables, clusters: DataFrame) -> DataFrame:
    """One text a rank: rank, dot."""
    body = lines(t, clusters).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))).alias("l"))
    return body.select("rank", F.concat(F.lit("digraph g {\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n}\n")).alias("dot"))


def write(t: Tables, clusters: DataFrame, folder: str) -> None:
    """Lines as text files, a folder a rank; nothing is gathered."""
    lines(t, clusters).repartition("rank").sortWithinPartitions("rank", "section", "ord", "line").select("rank", "line").write.partitionBy("rank").text(folder)
