"""Session helpers: shared checkpoint folder, materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; set a folder of our own only where it is unset (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanforge-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder and cut the lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def blocks(df: DataFrame, key: str, size: int) -> Iterator[DataFrame]:
    """df in disjoint parts of about ``size`` rows, by the hash of ``key``; the whole if it is no larger.

    For inputs that are sent to every task: each part is small, whatever the size of df.
    """
    parts = -(-df.count() // size)
    for i in range(parts):
        yield df if parts == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their place (from 1) in ``order``: a sort over all tasks, then each task's rows counted from those before it."""
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered = materialise(rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", at))
    counts = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row a task
    before = counts.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ordered.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores when it comes from fewer files than there are cores; for operators that work long on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
