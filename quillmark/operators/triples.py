"""Triples of evidence items, and their Turtle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import values as V
from quillmark.functions.text import escape, node_name
from quillmark.plans import rules as R
from quillmark.sources.annotations import claims
from quillmark.sources.files import write_documents

#: Of names in Turtle text; pass the vocabulary's own.
NAMESPACE = "https://example.org/evidence/"
COLUMNS = ("path", "s", "p", "o", "o_kind")


def unpivot(df: DataFrame, subject, columns: dict[str, str]) -> DataFrame:
    """(s, p, o): a row for each subject and named column that is not null; columns: column -> predicate."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for c, p in columns.items()])
    return df.select(subject.alias("s"), F.explode(pairs).alias("t")).select("s", "t.p", "t.o").where("o IS NOT NULL")


TRIPLES = "array<struct<s:string,p:string,o:string,o_kind:string>>"


def _triple(s: Column, p, o: Column, kind) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(s.alias("s"), lit(p).alias("p"), o.cast("string").alias("o"), lit(kind).alias("o_kind"))


def _property(key: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def _dimension_triples(node: Column, key: Column, v: Column, of: Column, strict: bool) -> Column:
    """Triples of one key of an item; of: the value's kind."""
    given = V.raw_values(v, of) if strict else F.concat(V.raw_values(v, of), V.object_value(v, of))
    prop = _property(key, R.CATEGORICAL)

    def category(value: Column) -> Column:
        folded = F.when(prop == "method", V.fold(value, V.METHOD_SYNONYMS)).otherwise(V.fold(value))
        token = V.is_token(folded)
        return _triple(node, prop, F.when(token, folded).otherwise(value), F.when(token, "iri").otherwise("literal"))

    text, flag = V.scalar(v, of), V.as_boolean(v, of)
    return (
        F.when(key.isin(*R.CATEGORICAL), F.transform(given, category))
        .when(key.isin(*R.LITERAL), F.when(text != "", F.array(_triple(node, _property(key, R.LITERAL), text, "literal"))))
        .when(key.isin(*R.BOOLEAN), F.when(flag.isNotNull(), F.array(_triple(node, _property(key, R.BOOLEAN), flag, "boolean"))))
    )


def _claim_triples(node: Column, claim: Column) -> Column:
    """Triples of one assertion and its span; a page that is no integer has o_kind invalid.  What isn't there is null."""
    a = F.concat(node, F.lit("_a"), claim["a_idx"].cast("string"))
    span = F.concat(a, F.lit("_span"))
    page = F.when(claim["page"].isNotNull(), _triple(span, "page", claim["page"], "integer")).when(claim["page_text"].isNotNull(), _triple(span, "page", claim["page_text"], "invalid"))
    return F.array(
        _triple(node, "assertion", a, "iri"),
        _triple(a, "type", F.lit("GeneticEvidenceAssertion"), "iri"),
        _triple(a, "assertionId", claim["assertion_id"], "literal"),
        F.when(claim["statement"] != "", _triple(a, "statement", claim["statement"], "literal")),
        F.when(claim["has_span"], _triple(a, "sourceSpan", span, "iri")),
        F.when(claim["has_span"], _triple(span, "type", F.lit("SourceSpan"), "iri")),
        page,
        F.when(claim["phrase"].isNotNull(), _triple(span, "phrase", claim["phrase"], "literal")),
    )


def item_triples(items: DataFrame, strict: bool = True, invalid: bool = False) -> DataFrame:
    """(path, s, p, o, o_kind) of items, as a set within each path; o_kind is iri, literal, integer or boolean.

    strict=False also gives an object's `value`, which is otherwise left out; invalid=True gives pages that are no
    integers, with o_kind invalid.  One pass: all triples of an item are one array, which is exploded once.
    Rows come dealt out by path, so what groups them by path, or by path and subject, moves none.
    """
    node = F.concat(F.lit("item_"), node_name(F.col("item_id")))
    known = [*R.CATEGORICAL, *R.LITERAL, *R.BOOLEAN]
    keys = F.filter(F.map_entries(F.try_variant_get("item", "$", "map<string,variant>")), lambda e: e["key"].isin(*known))
    # A value's kind is found once, in a row of its own.
    kinds = F.transform(keys, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("v"), V.kind(e["value"]).alias("of")))
    own = items.select("path", "item_id", node.alias("node"), kinds.alias("dims"), claims(F.col("item"), F.col("item_id")).alias("claims"))
    n = F.col("node")
    base = F.array(_triple(n, "type", F.lit("GeneticEvidence"), "iri"), _triple(n, "itemId", F.col("item_id"), "literal"))
    dims = F.transform("dims", lambda d: _dimension_triples(n, d["key"], d["v"], d["of"], strict))
    spans = F.transform("claims", lambda c: _claim_triples(n, c))
    none = F.array().cast(TRIPLES)
    flat = lambda x: F.coalesce(F.flatten(F.filter(x, lambda y: y.isNotNull())), none)
    every = F.filter(F.concat(base, flat(dims), flat(spans)), lambda t: t.isNotNull() & (t["o_kind"] != "invalid") if not invalid else t.isNotNull())
    return own.select("path", F.explode(every).alias("t")).select("path", "t.*").repartition("path").dropDuplicates(COLUMNS)


def node_collisions(items: DataFrame) -> DataFrame:
    """Ids of a document that would become one node, and ids that come twice."""
    return items.groupBy("path", node_name(F.col("item_id")).alias("node")).agg(F.sort_array(F.collect_list("item_id")).alias("ids")).where(F.size("ids") > 1)


def turtle(triples: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(path, text): a Turtle document of each path; subjects and their lines in order; gem: stands for namespace."""
    shown = (
        F.when(F.col("o_kind") == "iri", F.concat(F.lit("gem:"), "o"))
        .when(F.col("o_kind").isin("integer", "boolean"), F.col("o"))
        .otherwise(F.concat(F.lit('"""'), escape(F.col("o")), F.lit('"""')))
    )
    line = F.when(F.col("p") == "type", F.concat(F.lit("a "), shown)).otherwise(F.concat(F.lit("gem:"), "p", F.lit(" "), shown))
    lines = triples.select("path", "s", F.struct((F.col("p") != "type").alias("later"), "p", line.alias("line")).alias("x"))
    blocks = lines.groupBy("path", "s").agg(F.sort_array(F.collect_list("x")).alias("x"))
    blocks = blocks.select("path", "s", F.concat(F.lit("gem:"), "s", F.lit(" "), F.array_join(F.transform("x", lambda x: x["line"]), " ;\n    "), F.lit(" .")).alias("block"))
    head = f"@prefix gem: <{namespace}> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n\n"
    text = F.transform(F.sort_array(F.collect_list(F.struct("s", "block"))), lambda x: x["block"])
    return blocks.groupBy("path").agg(F.concat(F.lit(head), F.array_join(text, "\n\n"), F.lit("\n")).alias("text"))


def write_turtle(triples: DataFrame, out: str, base: str = "", namespace: str = NAMESPACE) -> None:
    """A Turtle file for each document, below out by the document's path below base: v0/x.yaml becomes v0/x.ttl."""
    write_documents(turtle(triples, namespace), out, base)
