"""Materialising a table that many branches of a plan read, and thinning one before a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task where a table is dealt out anew.
TASK_ROWS = 200_000
#: Slots that hashes are dealt to: at most so many numbers are broadcast.
SLOTS = 1 << 20


def settle(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, or kept in storage where the session has none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df.persist()
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows, so that a task's memory doesn't grow with the table.

    Spark joins the small partitions of its own shuffles to about as many as there are cores; those of a
    repartition() to a number stay.
    """
    return max(-(-rows // TASK_ROWS), spark.sparkContext.defaultParallelism)


def maybe_among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of df whose key, a hash, may be among wanted's, so that a join deals out few others; what is broadcast is bounded by SLOTS."""
    slot = F.pmod(F.col(key), F.lit(SLOTS)).cast("int")
    slots = wanted.select(slot.alias("_slot")).distinct()
    return df.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")
