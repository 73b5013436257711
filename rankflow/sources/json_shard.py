"""Per-rank JSON documents, plain or Brotli, as task-graph tables with an explicit schema."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Tables, empty_tables

_ENTITY = "struct<type:string,migratable:boolean,id:long,seq_id:long,home:int,collection_id:long,objgroup_id:long,index:array<long>>"
SCHEMA = (
    f"phases array<struct<id:int,tasks:array<struct<entity:{_ENTITY},node:int,resource:string,time:double,subphases:array<struct<id:int,time:double>>>>,"
    f"communications:array<struct<type:string,messages:long,bytes:double,`from`:{_ENTITY},`to`:{_ENTITY}>>>>"
)


class IngestError(RuntimeError):
    """A document that lacks what is required."""


def is_compressed(head: bytes) -> bool:
    """The first character that is not blank is no brace."""
    return not head.lstrip()[:1] == b"{"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, body) of the files named *.{rank}.json or *.{rank}.json.br; a rank with both raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(folder)
    files = files.withColumn("shard", F.regexp_extract("path", r"\.(\d+)\.json(\.br)?$", 1)).where("shard <> ''")

    def inflate(batches):
        for batch in batches:
            body = []
            for x in batch.column("content").to_pylist():
                if is_compressed(x[:4096]):
                    with pa.CompressedInputStream(pa.BufferReader(x), "brotli") as s:
                        x = s.read()
                body.append(x.decode())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(body, pa.string())], ["shard", "body"])

    files = files.withColumn("n", F.count("*").over(Window.partitionBy("shard")))
    files = files.withColumn("shard", F.when(F.col("n") == 1, F.col("shard").cast("int")).otherwise(F.raise_error(F.concat(F.lit("two files for rank "), "shard"))))
    return files.select("shard", "content").mapInArrow(inflate, "shard int, body string")


def _required(column, name: str):
    return F.when(column.isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(column)


def read_phase(docs: DataFrame, phase: int) -> Tables:
    """The tables of one phase of documents (shard, body); of phases with one id the first counts; a missing phase raises."""
    spark = docs.sparkSession
    parsed = docs.select("shard", F.from_json("body", SCHEMA, {"mode": "FAILFAST"}).alias("d"))
    found = parsed.select("shard", F.posexplode("d.phases").alias("pos", "p")).where(F.col("p.id") == phase)
    found = found.groupBy("shard").agg(F.min_by("p", "pos").alias("p"))
    if not found.limit(1).count():
        raise IngestError(f"no phase {phase}")
    tasks = found.select("shard", F.posexplode("p.tasks").alias("pos", "t"))
    e = F.col("t.entity")
    rows = tasks.select(
        "shard",
        "pos",
        _required(F.coalesce(e["id"], e["seq_id"]), "task id").alias("task_id"),
        _required(F.col("t.node"), "node").alias("rank"),
        _required(e["home"], "home").alias("home_rank"),
        _required(e["migratable"], "migratable").alias("migratable"),
        _required(F.col("t.time"), "time").alias("load"),
    )
    first = rows.groupBy("task_id").agg(F.min_by(F.struct("rank", "home_rank", "migratable", "load"), F.struct("shard", "pos")).alias("x"))
    zero = [F.lit(0.0).alias(c) for c in ("mem_working", "mem_footprint", "mem_serialized")]
    task = first.select("task_id", "x.*", *zero)
    c = found.select("shard", F.posexplode("p.communications").alias("pos", "c"))
    ends = [_required(F.coalesce(F.col(f"c.{k}.id"), F.col(f"c.{k}.seq_id")), k).alias(f"{k}_task") for k in ("from", "to")]
    raw = c.select("shard", "pos", *ends, _required(F.col("c.bytes"), "bytes").alias("volume"))
    edge = raw.groupBy("from_task", "to_task").agg(F.max_by("volume", F.struct(-F.col("shard"), "pos")).alias("volume"))
    none = empty_tables(spark)
    info = docs.select(F.col("shard").alias("rank"), F.lit(0.0).alias("footprint_bytes"), F.lit(None).cast("double").alias("max_memory"))
    return Tables(task, edge, none.block, none.task_block, info)
