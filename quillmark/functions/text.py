"""Text and rectangle functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def or_empty(text: Column, strip: bool = True) -> Column:
    return F.coalesce(F.trim(text) if strip else text, F.lit(""))


def first_text(*texts: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def escape(text: Column) -> Column:
    """For a long Turtle literal: backslashes, triple quotes, and quotes at the very end, which would join the closing ones."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"""'), F.lit('\\"\\"\\"'))
    # A last quote is escaped already where the backslashes before it are odd in number.
    return F.regexp_replace(out, r'(?<!\\)((?:\\\\)*)"\z', r'$1\\"')


def node_name(text: Column) -> Column:
    return F.translate(text, ".-", "__")


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def fold_forms(text: Column) -> Column:
    """A text in Unicode's compatibility composition (NFKC), as PDF text needs, whose glyphs may join letters.

    Spark has no such function, so texts cross to Python, in Arrow batches; those of ASCII alone, which stay as they
    are, go as nulls.
    """
    return F.coalesce(_compatible(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def words(text: Column) -> Column:
    """Number of words, parted by white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def is_long_span(phrase: Column, cap: int = 15) -> Column:
    return words(phrase) >= cap


def bounding_box(quad: Column) -> Column:
    """(x0, y0, x1, y1) of a flat list x, y, x, y, ..."""
    n = F.size(quad)
    xs = F.transform(F.sequence(F.lit(0), n - 1, F.lit(2)), lambda i: F.get(quad, i))
    ys = F.transform(F.sequence(F.lit(1), n - 1, F.lit(2)), lambda i: F.get(quad, i))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def quad_boxes(flat: Column) -> Column:
    """Boxes of a flat list of quads, eight numbers each; the last may have fewer, two at least; null has none."""
    n = F.floor((F.size(F.coalesce(flat, F.array().cast("array<double>"))) + 6) / 8).cast("int")
    empty = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: bounding_box(F.slice(flat, k * 8 + 1, 8)))).otherwise(empty)


def relative_path(path: Column, base: str) -> Column:
    """path below base, else as it is."""
    base = base.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
