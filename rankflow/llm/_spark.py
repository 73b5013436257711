"""Session helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.  Where it is unset a temporary one is set, in local mode only; on a cluster that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None
    if not path:
        if not re.match(r"local(\[.*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts stay small on both sides: the session's limit is lowered where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shard_count(docs: DataFrame, text: str, target: int = 4 << 20) -> int:
    """Shards of about `target` bytes of text, two for each shuffle partition at least."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return int(max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // target)))


def without(df: DataFrame, made: list[str], needed: str) -> DataFrame:
    """The table without columns of the names that an operator makes; the one it reads stays."""
    if needed in made:
        raise ValueError(f"the text can't be in a column named {needed}, which is made here")
    return df.drop(*made)


#: Rows of one key that a task gets, about, in joins by `dealt_join`.
SHARE = 1000
#: Keys of hot rows that are broadcast at most (24 bytes each, about); beyond them they are joined.
MOST_BROADCAST = 100_000


def many(counted: DataFrame, key: str, share: int | None = None) -> DataFrame:
    """(key, copies) of the keys with more than `share` rows; counted: key, c."""
    share = share or SHARE
    return counted.where(F.col("c") > share).select(key, F.expr(f"1 + c div {share}").alias("copies"))


def dealt_join(big: DataFrame, small: DataFrame, on: str, hot: DataFrame, how: str = "inner", deal: list[str] | None = None) -> DataFrame:
    """big joined (inner or left) with small, which has one row a key.  hot (key, copies): keys whose rows are dealt, by a hash of `deal`, over as many copies of small's row."""
    n = hot.count()
    if not n:
        return big.join(small, on, how)
    hot = F.broadcast(hot) if n <= MOST_BROADCAST else hot
    part = F.coalesce(F.pmod(F.xxhash64(*(deal or big.columns)), F.col("copies")), F.lit(0).cast("long"))
    more = small.join(hot, on).withColumn("__part", F.explode(F.expr("sequence(1L, copies - 1)"))).drop("copies")
    copied = small.withColumn("__part", F.lit(0).cast("long")).unionByName(more)
    return big.join(hot, on, "left").withColumn("__part", part).drop("copies").join(copied, [on, "__part"], how).drop("__part")
