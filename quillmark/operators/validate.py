"""Validation of evidence triples: closed world, each document by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.values import SENTINEL
from quillmark.operators.lineage import settle
from quillmark.operators.triples import item_triples
from quillmark.plans import rules as R
from quillmark.sources.annotations import MISSING, items

KEY = ["path", "s"]
RESULT = "array<struct<rule:string,property:string,component:string,value:string,message:string>>"


def node_values(triples: DataFrame, properties) -> DataFrame:
    """A row for each subject: path, s, types, invalid values, and for each property the set of its (o, o_kind), under its name."""
    is_type, bad = F.col("p") == "type", F.col("o_kind") == "invalid"
    sets = [F.collect_set(F.when((F.col("p") == p) & ~bad, F.struct("o", "o_kind"))).alias(p) for p in properties]
    return triples.groupBy(*KEY).agg(F.collect_set(F.when(is_type, F.col("o"))).alias("types"), F.collect_set(F.when(bad, F.col("o"))).alias("invalid"), *sets)


def _result(rule: str, prop: str, component: str, message: str, value: Column | None = None) -> Column:
    shown = F.lit(None).cast("string") if value is None else value
    return F.struct(F.lit(rule).alias("rule"), F.lit(prop).alias("property"), F.lit(component).alias("component"), shown.alias("value"), F.lit(message).alias("message"))


def _when(condition: Column, result: Column) -> Column:
    return F.when(condition, F.array(result)).otherwise(F.array().cast(RESULT))


def _counts(kind: str, rule: str, prop: str, least: int | None, most: int | None, message: str) -> list[Column]:
    n, of_kind = F.size(prop), F.array_contains("types", kind)
    out = [] if least is None else [_when(of_kind & (n < least), _result(rule, prop, "minCount", message))]
    return out if most is None else [*out, _when(of_kind & (n > most), _result(rule, prop, "maxCount", message))]


def _strangers(prop: str, members: list[str], rule: str, message: str) -> Column:
    """A result for each value of a property that is no member of its enumeration."""
    bad = F.filter(prop, lambda x: (x["o_kind"] != "iri") | ~x["o"].isin(members))
    return F.transform(bad, lambda x: _result(rule, prop, "class", message, x["o"]))


def _has(prop: str, value: str) -> Column:
    return F.exists(prop, lambda x: (x["o_kind"] == "iri") & (x["o"] == value))


def violations(triples: DataFrame) -> DataFrame:
    """(path, focus, rule, property, component, value, message), a row for each result of a rule.

    A focus that meets two branches of a conditional rule gives two rows.  The sentinel counts as a value
    of every enumeration.  A page that is written but is no integer, which item_triples(invalid=True) tells, is a
    result of the page rule.  The triples come together once, by subject; all rules are expressions over a
    subject's values.
    """
    found: list[Column] = []
    properties = dict.fromkeys([r[1] for r in R.PROPERTY_RULES] + [x for r in R.CONDITIONAL_RULES for x in [r[2], *(p for b in r[1] for p, _ in b)]] + [r[1] for r in R.SPAN_RULES])
    for rule, prop, dim, least, most, message in R.PROPERTY_RULES:
        found += _counts("GeneticEvidence", rule, prop, least, most, message)
        found.append(_strangers(prop, [*R.ENUMS[dim], SENTINEL], rule, message))
    item = F.array_contains("types", "GeneticEvidence")
    for rule, branches, prop, message in R.CONDITIONAL_RULES:
        for branch in branches:
            active = reduce(Column.__and__, [_has(p, v) for p, v in branch], item)
            found.append(_when(active & (F.size(prop) == 0), _result(rule, prop, "condition", message)))
    for rule, prop, least, most, message in R.SPAN_RULES:
        found += _counts("GeneticEvidenceAssertion" if prop == "sourceSpan" else "SourceSpan", rule, prop, least, most, message)
    # Only pages are read as anything but text.
    page = R.SPAN_RULES[1]
    found.append(F.transform("invalid", lambda x: _result(page[0], page[1], "datatype", page[4], x)))
    results = node_values(triples, properties).select("path", F.col("s").alias("focus"), F.explode(F.flatten(F.array(*found))).alias("r"))
    return results.select("path", "focus", "r.*")


def verdicts(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(path, conforms, n_violations, error) of each document; one with an error, as a missing file, fails."""
    n = found.groupBy("path").agg(F.count_distinct(F.struct("focus", "message")).alias("n_violations"))
    out = documents.select("path", "error").join(n, "path", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0).cast("long")))
    return out.select("path", ((F.col("n_violations") == 0) & F.col("error").isNull()).alias("conforms"), "n_violations", "error")


def run_summary(table: DataFrame) -> DataFrame:
    """(conforms, failed) of a whole run."""
    return table.agg(F.coalesce(F.bool_and("conforms"), F.lit(True)).alias("conforms"), F.count_if(~F.col("conforms")).alias("failed"))


def validate(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, violations) of parsed documents (path, doc, error), each settled: a file is parsed once."""
    documents = settle(documents)
    found = settle(violations(item_triples(items(documents), invalid=True)))
    return settle(verdicts(documents, found)), found


def report_lines(table: DataFrame, found: DataFrame) -> DataFrame:
    """(path, ord, line): PASS or FAIL, then focus node and message of each result of a failing document, a line each."""
    # The lines' texts.
    missing = F.when(F.col("error") == MISSING, F.lit(" (file not found)")).otherwise("") if "error" in table.columns else F.lit("")
    head = table.select("path", F.lit(0).alias("ord"), F.concat(F.when(F.col("conforms"), "PASS").otherwise("FAIL"), F.lit("  "), "path", missing).alias("line"))
    of = found.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("focus", "message"))).alias("r"))
    pair = lambda r: F.array(F.concat(F.lit("      Focus Node: gem:"), r["focus"]), F.concat(F.lit("      Message: "), r["message"]))
    body = of.select("path", F.posexplode(F.flatten(F.transform("r", pair))).alias("ord", "line")).select("path", (F.col("ord") + 1).alias("ord"), "line")
    return head.unionByName(body).orderBy("path", "ord")


def closing_lines(table: DataFrame) -> DataFrame:
    """(ord, path, line): what a run says at its end: how many documents failed, and then each of them, in order.

    A row for each failed document, since there may be any number; joined by ", ", their paths make up the line.
    """
    # The two lines.
    # Counted, sampled for the order and listed: three readings, and table may hold all rules.
    failed = settle(table.where(~F.col("conforms")).select("path"))
    told = failed.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" annotation(s) failed SHACL validation: "))).otherwise("All annotations conform to the SHACL shapes.").alias("line"))
    head = told.select(F.lit(0).alias("ord"), F.lit(None).cast("string").alias("path"), "line")
    return head.unionByName(failed.select(F.lit(1).alias("ord"), "path", F.col("path").alias("line"))).orderBy("ord", "path")
