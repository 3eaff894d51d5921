"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where none is set, a local session gets a new folder of this machine's; a cluster gets an error, for its
    executors would not see such a folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def write_table(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, so later stages and lost executors reread it."""
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/quillmark-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """write_table for what goes with the scratch() that it is written in, or by release()."""
    out = write_table(df)
    if _scratch:
        _scratch[-1].append(out)
    return out


#: Tables written within each open scratch().
_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Deletes what cut_lineage writes inside the block when it ends."""
    _scratch.append([])
    try:
        yield
    finally:
        release(*_scratch.pop())


def release(*written: DataFrame) -> None:
    """Deletes tables of cut_lineage that nothing will read again."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns, *names: str) -> list[str]:
    """Each name with as many underscores after it as keep it apart from the columns, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of a value's text modulo n; null for null."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % n


def held_out(n: int, remainder: int) -> Column:
    """Whether doc_id falls in the held-out fold; a null id is never held out."""
    return F.coalesce(crc_mod("doc_id", n) == remainder, F.lit(False))


def chunks(texts: list[str], most: int = 1_500_000):
    """Slices of consecutive texts of about `most` characters, each with at least one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_kept: list = [None, None]


def per_worker(key, make):
    """make()'s result, kept in a Python worker from task to task until another key comes.

    A worker keeps one such thing at a time, whatever ran in it before; None as the key lets it go.
    """
    if _kept[0] != key:
        _kept[:] = [None, None]
        _kept[:] = [key, make() if key is not None else None]
    return _kept[1]


LETTER = re.compile(r"[^\W\d_]")
