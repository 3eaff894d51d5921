"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs.  All return the columns of documents, further ones of any name included, and the last adds
each text's piece ids.
Texts may be of any length; of an empty table every stage makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import release, scratch, table, write_table
from quillmark.llm.linededup import dedup_lines
from quillmark.llm.mixing import apply_mixture
from quillmark.llm.pieces import encode_documents
from quillmark.llm.simhash import drop_near_copies
from quillmark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; those of null or empty text stay, and repeated rows share their fate."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go; every document stays, with n_chars counted anew.

    Documents are told by id and text; null texts stay null, and their n_chars as it is.
    """
    out = dedup_lines(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, told by id and text; null and empty texts are one component."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mixture reads it, once at least, in the order of its blocks; nulls and repeated rows too."""
    return apply_mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with the ids of the best and N-best piece segmentations and digests of them; null texts have no pieces."""
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: No SQL: the first and last stages fit a model and search a lattice.  tests/llm holds run() against its stages' rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's input goes once it is done."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch():
            made = write_table(stage(spark, docs, sf_dir))
        docs = made
        if last is not None:
            release(last)
        last = docs
    return docs
