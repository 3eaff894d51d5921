"""A stream of new annotation files through the same validation; an extra, for the inputs are finite files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.validate import validate
from quillmark.sources.annotations import parse_yaml


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, glob: str = "*.yaml"):
    """Starts a query that writes the verdicts of files as they come to a Parquet folder, a partition `batch` a batch.

    A batch that is run again replaces its own partition, so no verdict comes twice.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    files = files.select("path", F.decode("content", "UTF-8").alias("text"))

    def each(batch: DataFrame, number: int) -> None:
        table, _ = validate(parse_yaml(batch))
        table.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
