"""Coverage: of the rows that a rule applies to, how many have a value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import values as V
from quillmark.plans.rules import COVERAGE_RULES, SCALAR_DIMS


def coverage(rows: DataFrame, rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(ord, dimension, populated, applicable) of (label, applies, filled) rules: one pass, one small row, turned."""
    cells = []
    for k, (_, applies, filled) in enumerate(rules):
        applies = F.coalesce(applies, F.lit(False))
        cells += [F.count_if(applies & F.coalesce(filled, F.lit(False))).alias(f"p{k}"), F.count_if(applies).alias(f"a{k}")]
    turned = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(label).alias("dimension"), F.col(f"p{k}").alias("populated"), F.col(f"a{k}").alias("applicable")) for k, (label, _, _) in enumerate(rules)]))
    return rows.agg(*cells).select(turned.alias("r")).select("r.*")


def annotation_rules() -> list[tuple[str, Column, Column]]:
    """The coverage rules over rows with an item variant."""
    at = lambda key: F.try_variant_get("item", f"$.{key}", "variant")

    def holds(dim: str, value: str) -> Column:
        if dim in SCALAR_DIMS:
            return (V.kind(at(dim)) == "STRING") & V.scalar(at(dim)).eqNullSafe(value)
        return V.contains(V.activation_set(at(dim)), value)

    any_of = lambda cs: reduce(lambda a, b: a | b, cs)
    all_of = lambda cs: reduce(lambda a, b: a & b, cs)
    return [(label, any_of([all_of([holds(*pair) for pair in branch]) for branch in branches]) if branches else F.lit(True), any_of([V.is_populated(at(k)) for k in keys])) for label, keys, branches in COVERAGE_RULES]


def annotation_coverage(items: DataFrame) -> DataFrame:
    return coverage(items, annotation_rules())


# Fixed value: the line over a coverage table; the corpus that it names is a parameter.
TITLE = "# Dimension coverage over %d GeneticEvidence items"


def title(table: DataFrame, corpus: str = "") -> DataFrame:
    """(ord, line): the line over a table, with the number of items: the first rule applies to all of them."""
    n = table.where("ord = 0").select("applicable")
    return n.select(F.lit(-3).alias("ord"), F.concat(F.format_string(TITLE, "applicable"), F.lit(f" ({corpus})" if corpus else "")).alias("line"))


def as_markdown(table: DataFrame, corpus: str = "") -> DataFrame:
    """(ord, line) of a coverage table under its title, labels padded to the widest."""
    width = table.agg(F.max(F.length("dimension")).alias("w"))
    # One row wide.
    lines = table.crossJoin(F.broadcast(width)).select("ord", F.format_string("| %s | %9d | %10d |", F.expr("rpad(dimension, w, ' ')"), "populated", "applicable").alias("line"))
    # The table's head.
    head = width.select(F.explode(F.array(F.struct(F.lit(-2).alias("ord"), F.format_string("| %s | Populated | Applicable |", F.expr("rpad('Dimension', w, ' ')")).alias("line")), F.struct(F.lit(-1).alias("ord"), F.format_string("| %s | --------: | ---------: |", F.expr("repeat('-', w)")).alias("line")))).alias("r")).select("r.*")
    return title(table, corpus).unionByName(head).unionByName(lines).orderBy("ord")


def as_tsv(table: DataFrame, path: str, corpus: str = "") -> None:
    """Title, head and lines of a coverage table, a few dozen rows, as one text file."""
    rows = table.select("ord", F.concat_ws("\t", "dimension", F.col("populated").cast("string"), F.col("applicable").cast("string")).alias("line"))
    head = title(table, corpus)
    # Fixed value: the head.
    names = head.select(F.lit(-2).alias("ord"), F.lit("Dimension\tPopulated\tApplicable").alias("line"))
    head.unionByName(names).unionByName(rows).coalesce(1).sortWithinPartitions("ord").select("line").write.mode("overwrite").text(path)
