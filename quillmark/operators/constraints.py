"""Constraint operators over focus nodes and their values; sets, not bags, unless said."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cardinality(focus: DataFrame, values: DataFrame, key: Sequence[str], value: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Focus rows whose number n of distinct values is under least or over most; none counts as 0."""
    n = values.groupBy(*key).agg(F.count_distinct(value).alias("n"))
    out = focus.join(n, list(key), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    low = F.lit(False) if least is None else F.col("n") < least
    high = F.lit(False) if most is None else F.col("n") > most
    return out.where(low | high)


def not_member(values: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Values that are not in the enumeration, one row each; Spark broadcasts members where their size allows."""
    return values.join(members, list(on), "left_anti")


def requires(active: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Active rows without any present row of the same key: FILTER NOT EXISTS."""
    return active.join(present.select(*on), list(on), "left_anti")


def all_of(focus: DataFrame, *parts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Focus rows that every part has a row for."""
    return reduce(lambda f, p: f.join(p.select(*on), list(on), "left_semi"), parts, focus)


def bag_union(*branches: DataFrame) -> DataFrame:
    """Branches one after the other; a row in two of them comes twice."""
    return reduce(DataFrame.unionByName, branches)


def set_union(*branches: DataFrame) -> DataFrame:
    return bag_union(*branches).distinct()


def count_table(df: DataFrame, keys: Sequence[str], **conditions: Column) -> DataFrame:
    """Rows by key, in all and where each condition holds, in one pass."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def tier(value: Column, *bounds: tuple[float, str], otherwise: str) -> Column:
    """Name of the first lower bound that value reaches."""
    out = reduce(lambda c, b: c.when(value >= b[0], b[1]), bounds[1:], F.when(value >= bounds[0][0], bounds[0][1]))
    return out.otherwise(otherwise)


def rank_of(value: Column, scale: Sequence[str]) -> Column:
    """Place of a value on an ordinal scale, from 1; null if it is not on it."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in scale]), value), F.lit(0))
