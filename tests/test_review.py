"""Sources and review operators that the driver's queries don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions import values as V
from quillmark.operators import constraints as C
from quillmark.operators import coverage as Cov
from quillmark.operators import marks as M
from quillmark.operators import review as R
from quillmark.operators import triples as Tr
from quillmark.operators import validate as Va
from quillmark.sources import annotations as S

DOC = {
    "publication": {"id": "P1", "doi": "10.1/x", "title": "T"},
    "provenance": {"mode": "autonomous", "annotator": "a", "exemplars_used": ["x", "y"]},
    "candidate_extensions": [{"id": "CE-1", "dimension": "resolution", "location_in_this_annotation": "GE-1"}],
    "confidence_summary": {"per_item": [{"id": "GE-1", "confidence": "high"}, {"item": "GE-9", "notes": "n"}], "forced_fits": [{"dimension": "resolution", "candidate_extension": "CE-1"}, {"dimension": "method", "candidate_extension": None}]},
    "flags": [{"id": "F1", "type": "ai_uncertainty", "applies_to": ["GE-1", "GE-2 (target)"]}, {"id": "F2", "type": "ai_assumption", "applies_to": None}],
    "observations": [{"id": "O1", "level": "evidential", "observation": "text"}, {"id": "O2", "prominence": "high", "disposition": "kept"}],
    "evidence": [
        {"id": "GE-1", "label": "GWAS of x", "method": ["GWAS"], "flags": ["F1"], "candidate_extension_exercised": "CE-1", "special_considerations": [{"key": "cell", "value": "c"}], "variant_ascertainment": ["SYNTHETIC", "FROM_DATABASE"]},
        {"id": "GE-2", "label": "Allele protects", "method": "GWAS", "flags": ["F2"], "candidate_extension_exercised": ["CE-1", "CE-7"], "variant_ascertainment": "SYNTHETIC"},
        {"id": "GE-3", "label": "Results", "method": ["GWAS"], "credibility_comment": "by design"},
    ],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("p", json.dumps(DOC)), ("empty", "{}"), ("none", None)], "path string, t string").select("path", F.parse_json("t").alias("doc"), F.lit(None).cast("string").alias("error"))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_document_tables(docs):
    assert rows(S.publications(docs), "path", "doi", "title")[-1] == ("p", "10.1/x", "T")
    assert [r for r in rows(S.provenance(docs)) if r[0] == "p"] == [("p", "autonomous", None, "a", None, '["x","y"]')]
    assert rows(S.candidate_extensions(docs), "path", "ce_id", "dimension", "location") == [("p", "CE-1", "resolution", "GE-1")]
    assert rows(S.confidence(docs)) == [("p", "GE-1", "high", None), ("p", "GE-9", None, "n")]
    assert rows(S.forced_fits(docs)) == [("p", "method", None, None), ("p", "resolution", "CE-1", None)]
    assert rows(S.observations(docs)) == [("p", "O1", "evidential", "text"), ("p", "O2", "high", "kept")]
    assert rows(S.special_considerations(S.items(docs))) == [("p", "GE-1", "cell", "c")]


def test_flags_agree_both_ways(docs):
    assert rows(S.flag_disagreements(docs)) == [("p", "F1", "GE-2", "item"), ("p", "F2", "GE-2", "registry")]
    flags = S.flags(docs)
    assert rows(R.flag_counts(flags)) == [("p", "ai_assumption", 1), ("p", "ai_uncertainty", 1)]
    table = R.flag_table(flags).first()
    assert (table["total"], table["ai_uncertainty"], table["ai_assumption"], table["reviewer_query"]) == (2, 1, 1, 0)


def test_extensions_and_confidence(docs):
    found = S.items(docs)
    used = S.exercised(found)
    assert rows(used) == [("p", "GE-1", "CE-1"), ("p", "GE-2", "CE-1"), ("p", "GE-2", "CE-7")]
    assert rows(R.without_registered_extension(used, S.candidate_extensions(docs))) == [("p", "GE-2", "CE-7")]
    assert rows(R.without_extension(S.forced_fits(docs), S.candidate_extensions(docs)), "path", "dimension") == [("p", "method")]
    assert rows(R.confidence_gaps(found, S.confidence(docs))) == [("p", "GE-2", "summary"), ("p", "GE-3", "summary"), ("p", "GE-9", "items")]
    assert rows(R.provenance_gaps(S.provenance(docs).where("path = 'p'"))) == [("p", "annotated_at"), ("p", "protocol_version")]


def test_methods_labels_overview(spark, docs):
    dims = S.item_dims(S.items(docs))
    assert rows(R.overview(dims)) == [("p", 0, "GE-1", "GWAS of x", "GWAS"), ("p", 1, "GE-2", "Allele protects", "GWAS"), ("p", 2, "GE-3", "Results", "GWAS")]
    assert rows(R.ascertainment_split(dims)) == [("p", "FROM_DATABASE", ["GE-1"]), ("p", "SYNTHETIC", ["GE-1", "GE-2"])]
    assert rows(R.label_lint(R.overview(dims)), "item_id") == [("GE-1",), ("GE-3",)]
    assert rows(R.items_per_paper(S.items(docs))) == [("p", 3)]
    items = spark.createDataFrame([("p", "a", ["X", "Y"], None), ("p", "b", ["Y", "X"], " "), ("p", "c", ["X", "Y"], "why"), ("p", "d", ["Z"], None), ("p", "e", ["X", "Y"], None), ("p", "f", ["X", "Y"], None)], "path string, item_id string, methods array<string>, credibility_comment string")
    flags = spark.createDataFrame([("p", "e", "ai_uncertainty"), ("p", "b", "ai_assumption")], "path string, item_id string, type string")
    extensions = spark.createDataFrame([("p", "f")], "path string, item_id string")
    assert rows(R.unexplained_methods(items, flags, extensions)) == [("p", ["X", "Y"], "a"), ("p", ["X", "Y"], "b")]
    full = items.select("path", "item_id", "methods", F.lit("t").alias("target"), F.lit("HIGH").alias("credibility"))
    assert rows(R.split_candidates(full), "items") == [(["a", "b", "c", "e", "f"],)]


def test_review_rules(spark):
    tiers = spark.createDataFrame([(True, True), (True, False), (False, False)], "p boolean, a boolean").select(R.span_tier(F.col("p"), F.col("a")))
    assert [r[0] for r in tiers.collect()] == ["ok", "non_blocking", "blocking"]
    choice = spark.createDataFrame([(True, True), (False, True), (False, False)], "s boolean, c boolean").select(R.flag_decision(F.col("s"), F.col("c")))
    assert [r[0] for r in choice.collect()] == [None, "ai_assumption", "ai_uncertainty"]
    items = spark.createDataFrame([("p", "a"), ("p", "b")], "path string, item_id string")
    assert rows(R.default_verdicts(items, items.where("item_id = 'a'"))) == [("p", "a", "marked_for_edit"), ("p", "b", "approved")]
    terms, table = spark.createDataFrame([("GWAS",), ("X",)], "term string"), spark.createDataFrame([("GWAS", "ECO:1", "exact")], "term string, other string, relation string")
    assert rows(R.crosswalk(terms, table)) == [("GWAS", "ECO:1", "exact"), ("X", None, "none")]
    left, right = spark.createDataFrame([("d1", "v0")], "doi string, path string"), spark.createDataFrame([("d1", "v1"), ("d2", "w1")], "doi string, path string")
    assert rows(R.same_paper(left, right)) == [("d1", "v0", "v1"), ("d2", None, "w1")]
    cited = spark.createDataFrame([("accept",), ("accept",), ("defer",)], "disposition string")
    assert rows(R.by_key(cited, "disposition")) == [("accept", 2), ("defer", 1)]


def test_review_log_tables(spark):
    log = {"reviewed_annotation": "a.yaml", "verdicts": [{"ge_item": "GE-1", "decision": "approved", "flags_recorded": [{"type": "query", "level": "x", "note": "n"}]}], "migration_suggestions": [{"ge_item": "GE-1", "from": "A", "to": "B"}, {"ge_item": "GE-1", "from": "C", "to": "C"}], "promotion_recommendations": [{"candidate": "CE-1", "status": "s"}]}
    logs = spark.createDataFrame([("l", json.dumps(log))], "path string, t string").select("path", F.parse_json("t").alias("doc"))
    tables = S.review_tables(logs)
    assert rows(tables["verdicts"]) == [("l", "a.yaml", "GE-1", "approved", None)]
    assert rows(tables["verdict_flags"]) == [("l", "a.yaml", "GE-1", "query", "x", "n")]
    assert rows(tables["migrations"]) == [("l", "a.yaml", "GE-1", "A", "B")]
    assert rows(tables["promotions"]) == [("l", "CE-1", "s")]


def test_marks_from_files_to_reports(spark, tmp_path):
    marks = [
        {"page": 2, "type": "Text", "author": "", "note": "it's\nodd", "rect": [1.0, 2.5, 3.0, 4.0]},
        {"page": 1, "type": "Highlight", "author": "A", "note": "", "rect": [0, 0, 1, 1], "highlighted_text": "two  words"},
        {"page": 2, "type": "Link"},
    ]
    (tmp_path / "m.json").write_text(json.dumps(marks))
    found = M.clean_marks(M.keep_subtypes(S.scan_marks(spark, str(tmp_path))))
    assert rows(found, "pos", "page", "type") == [(0, 2, "Text"), (1, 1, "Highlight")]
    texts = [r["text"] for r in M.report(found).collect()]
    assert texts[0].split("\n")[:4] == ["--- Annotation #1 (page 1) ---", "  subtype: /Highlight", "  author: A", "  highlighted text: 'two words'"]
    assert texts[1].split("\n")[:4] == ["--- Annotation #2 (page 2) ---", "  subtype: /Text", '  note/callout: "it\'s\\nodd"', "  location (rect): [1.0, 2.5, 3.0, 4.0]"]
    assert texts[2] == "Total annotations processed: 2"
    M.write_json_array(found, str(tmp_path / "out"))
    again = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert [m["page"] for m in again] == [1, 2]
    with pytest.raises(ImportError, match="pypdf"):
        S.scan_pdf_marks(spark, str(tmp_path))


def test_lines_and_files(spark, tmp_path):
    table = spark.createDataFrame([("a", True, 0, None), ("b", False, 2, None), ("c", False, 0, "missing")], "path string, conforms boolean, n_violations long, error string")
    found = spark.createDataFrame([("b", "item_1", "m")], "path string, focus string, message string")
    assert [r["line"] for r in Va.report_lines(table, found).collect()] == ["PASS  a", "FAIL  b", "      Focus Node: gem:item_1", "      Message: m", "FAIL  c (file not found)"]
    head, *paths = [r["line"] for r in Va.closing_lines(table).collect()]
    assert head + ", ".join(paths) == "2 annotation(s) failed SHACL validation: b, c"
    assert [r["line"] for r in Va.closing_lines(table.where("conforms")).collect()] == ["All annotations conform to the SHACL shapes."]
    assert Va.run_summary(table).first() == (False, 2) and Va.run_summary(table.limit(0)).first() == (True, 0)
    Cov.as_tsv(spark.createDataFrame([(0, "Method", 1, 2)], "ord int, dimension string, populated long, applicable long"), str(tmp_path / "tsv"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "tsv")).collect()] == ["# Dimension coverage over 2 GeneticEvidence items", "Dimension\tPopulated\tApplicable", "Method\t1\t2"]


def test_small_functions(spark):
    df = spark.createDataFrame([(["a", "b"], "/x/y/z", "ﬁne … Ａ1")], "v array<string>, p string, t string")
    got = df.select(V.overlaps(F.col("v"), ("b", "c")), V.overlaps(F.col("v"), ("c",)), X.relative_path(F.col("p"), "/x"), X.relative_path(F.col("p"), "/q"), X.fold_forms(F.col("t"))).first()
    assert tuple(got) == (True, False, "y/z", "/x/y/z", "fine ... A1")
    assert C.set_union(df.select("p"), df.select("p")).count() == 1
    many = spark.createDataFrame([(" ".join("w" * 15),), ("w",), (None,)], "t string").select(X.is_long_span(F.col("t")))
    assert [r[0] for r in many.collect()] == [True, False, False]


def test_closing_lines_read_their_table_once(spark):
    """The rules behind a table run once, though its failed documents are counted, sampled for the order and listed."""
    seen = spark.sparkContext.accumulator(0)

    def conforms(path):
        seen.add(1)
        return int(path) % 3 == 0

    table = spark.range(30).select(F.col("id").cast("string").alias("path")).withColumn("conforms", F.udf(conforms, "boolean")("path"))
    rows = Va.closing_lines(table).collect()
    assert rows[0]["line"].startswith("20 annotation(s)") and [r["path"] for r in rows[1:]] == sorted(str(k) for k in range(30) if k % 3)
    assert seen.value == 30
