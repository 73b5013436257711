"""The part graph: parts are tasks, consecutive lines of an order are edges, eight ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Tables

RANKS = 8


def line_edges(lineitem: DataFrame) -> DataFrame:
    """One row for each two consecutive lines of an order: from_task, to_task, volume and seq, its place in the input."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = lineitem.select(
        F.col("l_partkey").alias("from_task"),
        F.lead("l_partkey").over(order).alias("to_task"),
        F.col("l_quantity").cast("long").alias("volume"),
        (F.col("l_orderkey") * 100 + F.row_number().over(order)).alias("seq"),
    )
    return rows.where("to_task is not null and from_task <> to_task")


def part_graph(spark: SparkSession, sf_dir: str) -> Tables:
    part, lines = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sold = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("ld"))
    task = part.join(sold, "p_partkey", "left").select(
        F.col("p_partkey").alias("task_id"),
        ((F.col("p_size") * F.col("p_size")) % RANKS).cast("int").alias("rank"),
        (F.col("p_partkey") % RANKS).cast("int").alias("home_rank"),
        (F.col("p_partkey") % 10 != 0).alias("migratable"),
        F.coalesce("ld", F.lit(0)).alias("load"),
        (F.col("p_size") * 1024).cast("long").alias("mem_working"),
        (F.length("p_name") * 64).cast("long").alias("mem_footprint"),
        (F.col("p_size") * 128).cast("long").alias("mem_serialized"),
    )
    edge = line_edges(lines).groupBy("from_task", "to_task").agg(F.sum("volume").alias("volume"))
    brand = (F.substring("p_brand", 7, 100).cast("int") * 100 + F.col("p_size")).cast("long")
    used = part.select(F.col("p_partkey").alias("task_id"), F.explode(F.array(brand, 10000 + F.col("p_partkey") % 997)).alias("block_id"))
    block = used.select("block_id").distinct().select("block_id", (4096 + (F.col("block_id") % 64) * 512).alias("size"), (F.col("block_id") % RANKS).cast("int").alias("home_rank"))
    info = spark.range(RANKS).select(F.col("id").cast("int").alias("rank"), (1000000 + 1000 * F.col("id")).alias("footprint_bytes"), F.lit(60000000).cast("long").alias("max_memory"))
    return Tables(task, edge, block, used, info)


#: The same tables for the oracle.
SQL = """task AS (SELECT p_partkey AS task_id, CAST((p_size*p_size)%8 AS INT) AS rank, CAST(p_partkey%8 AS INT) AS home_rank, p_partkey%10<>0 AS migratable,
  CAST(coalesce(ld,0) AS BIGINT) AS load, CAST(p_size*1024 AS BIGINT) AS mem_working, CAST(length(p_name)*64 AS BIGINT) AS mem_footprint, CAST(p_size*128 AS BIGINT) AS mem_serialized
  FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS ld FROM lineitem GROUP BY l_partkey) x ON l_partkey=p_partkey),
line_edge AS (SELECT * FROM (SELECT l_partkey AS from_task, lead(l_partkey) OVER w AS to_task, CAST(l_quantity AS BIGINT) AS volume, l_orderkey*100 + row_number() OVER w AS seq
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice)) y WHERE to_task IS NOT NULL AND from_task<>to_task),
edge AS (SELECT from_task, to_task, CAST(sum(volume) AS BIGINT) AS volume FROM line_edge GROUP BY from_task, to_task),
task_block AS (SELECT p_partkey AS task_id, CAST(CAST(substr(p_brand,7) AS INT)*100+p_size AS BIGINT) AS block_id FROM part UNION ALL SELECT p_partkey, 10000+p_partkey%997 FROM part),
block AS (SELECT block_id, CAST(4096+(block_id%64)*512 AS BIGINT) AS size, CAST(block_id%8 AS INT) AS home_rank FROM (SELECT DISTINCT block_id FROM task_block) z),
rank_info AS (SELECT CAST(r AS INT) AS rank, CAST(1000000+1000*r AS BIGINT) AS footprint_bytes, CAST(60000000 AS BIGINT) AS max_memory FROM range(8) t(r))"""
