"""PDF marks: cleaning, popups, and text under highlights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.text import collapse, first_text, or_empty, quad_boxes
from quillmark.operators.lineage import settle

# Subtypes that are read.
SUBTYPES = ("Highlight", "Text", "Underline", "Squiggly", "StrikeOut")


def clean_marks(marks: DataFrame) -> DataFrame:
    """Notes trimmed, authors as they are, highlighted text collapsed; null only where it is no highlight."""
    text = F.when(F.col("type") == "Highlight", F.coalesce(collapse(F.col("highlighted_text")), F.lit("")))
    return marks.withColumns({"note": or_empty(F.col("note")), "author": or_empty(F.col("author"), strip=False), "highlighted_text": text})


def drop_noise(df: DataFrame, kind: str, noisy: str, *texts: str) -> DataFrame:
    """Rows but those of one kind whose texts are all empty."""
    empty = F.concat(*[or_empty(F.col(t)) for t in texts]) == ""
    return df.where(~(F.col(kind).eqNullSafe(noisy) & empty))


def keep_subtypes(marks: DataFrame) -> DataFrame:
    return marks.where(F.col("type").isin(*SUBTYPES))


def with_popups(marks: DataFrame, popups: DataFrame) -> DataFrame:
    """note is the mark's own, else its popup's, else empty; popups are a document's own where both tables have path."""
    key = [c for c in ("path", "mark_ref") if c in marks.columns and c in popups.columns]
    own = popups.groupBy(*key).agg(F.min("contents").alias("_popup"))
    return marks.join(own, key, "left").withColumn("note", first_text(F.col("note"), F.col("_popup"))).select(*marks.columns, *([] if "note" in marks.columns else ["note"]))


#: Points of a cell above which it is dealt to several tasks, and cells of a box above which it meets its key's points as they are.
DENSE, WIDE = 100_000, 4_096


def range_join(points: DataFrame, boxes: DataFrame, on: list[str], x: str, y: str | None = None, slack: tuple[float, float] = (1, 4), cell: float = 64.0, dense: int = DENSE) -> DataFrame:
    """points in boxes (x0, x1, and y0, y1 if y is given) of the same key, bounds widened by slack.

    Boxes are dealt to the cells of a grid, along x and, if given, y, that they touch, so rows meet only within
    a key and a cell, once each.  The points of a dense cell are dealt to parts of it, each of which gets the
    cell's boxes.  Boxes of over WIDE cells meet all points of their key.  Nulls and NaN are in no box.
    """
    axes = [(x, "x0", "x1", slack[0])] + ([] if y is None else [(y, "y0", "y1", slack[1])])
    inside = reduce(Column.__and__, [(F.col(at) >= F.col(low) - more) & (F.col(at) <= F.col(high) + more) for at, low, high, more in axes])
    cells = [f"_cell{k}" for k in range(len(axes))]
    spans = [(F.floor((F.col(low) - more) / cell), F.floor((F.col(high) + more) / cell)) for _, low, high, more in axes]
    number = reduce(Column.__mul__, [(b - a + 1).cast("double") for a, b in spans])
    proper = reduce(Column.__and__, [F.col(low) <= F.col(high) + 2 * more for _, low, high, more in axes])
    small = boxes.where(proper & (number <= WIDE))
    for name, (a, b) in zip(cells, spans, strict=True):
        small = small.withColumn(name, F.explode(F.sequence(a, b)))
    dealt = points.withColumns({name: F.floor(F.col(at) / cell) for name, (at, *_) in zip(cells, axes, strict=True)})
    key = [*on, *cells]
    crowded = settle(dealt.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > dense).select(*key, F.ceil(F.col("_n") / dense).cast("int").alias("_parts")))
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = dealt.withColumn("_place", place).join(crowded, key, "left").withColumn("_part", F.pmod("_place", F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts", "_place")
    small = small.join(crowded, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    met = dealt.join(small, [*key, "_part"]).drop(*cells, "_part").where(inside)
    return met.unionByName(points.join(boxes.where(proper & (number > WIDE)), on).where(inside))


def text_under(marks: DataFrame, runs: DataFrame) -> DataFrame:
    """marks (path, mark_ref, page, type, quads) with highlighted_text: runs (path, page, pos, x, y, text) in a quad's box.

    A run counts once for a mark; blank runs are left out; runs come in their order, within a document's page.
    Highlights without such runs get the empty text, other marks null.
    """
    key = ["path", "page"]
    lit = marks.where((F.col("type") == "Highlight") & F.col("quads").isNotNull())
    boxes = lit.select(*key, "mark_ref", F.explode(quad_boxes(F.col("quads"))).alias("b")).select(*key, "mark_ref", "b.*")
    met = range_join(runs.where(F.trim("text") != ""), boxes, key, "x", "y").select(*key, "mark_ref", "pos", "text").dropDuplicates([*key, "mark_ref", "pos"])
    joined = met.groupBy(*key, "mark_ref").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]).alias("t"))
    joined = joined.select(*key, "mark_ref", collapse(F.array_join("t", " ")).alias("highlighted_text"))
    out = marks.drop("highlighted_text").join(joined, [*key, "mark_ref"], "left")
    return out.withColumn("highlighted_text", F.when(F.col("type") == "Highlight", F.coalesce("highlighted_text", F.lit(""))))


def extracted(marks: DataFrame, popups: DataFrame, runs: DataFrame) -> DataFrame:
    """Marks of the subtypes that are read, with their popups' notes and the page text under highlights, cleaned.

    marks: (path, pos, page, type, author, note, rect, quads, mark_ref); popups: (path, mark_ref, contents); runs:
    (path, page, pos, x, y, text).
    """
    return clean_marks(text_under(with_popups(keep_subtypes(marks), popups), runs))


def numbered(df: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """n, a running number within a key, and of, their total."""
    w = Window.partitionBy(*within)
    return df.withColumns({"n": F.row_number().over(w.orderBy(*order)).cast("long"), "of": F.count("*").over(w)})


def quoted(text):
    """A text as Python shows it: in single quotes, or double ones where it holds only single ones."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def report(marks: DataFrame) -> DataFrame:
    """(path, n, text) of marks, numbered by page and place; the last text of a path gives their total."""
    # The lines of the report.
    lines = F.concat_ws(
        "\n",
        F.format_string("--- Annotation #%d (page %d) ---", "n", "page"),
        F.concat(F.lit("  subtype: /"), "type"),
        F.when(F.col("author") != "", F.concat(F.lit("  author: "), "author")),
        F.when(F.col("note") != "", F.concat(F.lit("  note/callout: "), quoted(F.col("note")))),
        F.when(F.coalesce("highlighted_text", F.lit("")) != "", F.concat(F.lit("  highlighted text: "), quoted(F.col("highlighted_text")))).when(
            (F.col("type") == "Text") & F.col("rect").isNotNull(), F.concat(F.lit("  location (rect): ["), F.array_join(F.col("rect").cast("array<string>"), ", "), F.lit("]"))
        ),
        F.lit(""),
    )
    body = numbered(marks, ["path"], ["page", "pos"]).select("path", "n", lines.alias("text"))
    total = marks.groupBy("path").agg(F.count("*").alias("_n")).select("path", (F.col("_n") + 1).alias("n"), F.format_string("Total annotations processed: %d", "_n").alias("text"))
    return body.unionByName(total).orderBy("path", "n")


def joined_text(df: DataFrame, key: list[str], pos: str, text: str, sep: str = " ") -> DataFrame:
    """Texts of a key in order, joined and collapsed."""
    return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(pos, text))).alias("_t")).select(*key, collapse(F.array_join(F.transform("_t", lambda r: r[text]), sep)).alias("joined"))


def write_json_array(marks: DataFrame, path: str) -> None:
    """A JSON array of each path's marks, as text."""
    rows = marks.groupBy("path").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("page", "pos", F.struct("page", "type", "author", "note", "rect", "highlighted_text").alias("m")))), lambda r: r["m"])).alias("value"))
    rows.select("value").write.mode("overwrite").text(path)
