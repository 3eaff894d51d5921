"""The annotation engine over synthetic documents."""

import json
import random
import unicodedata

from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions import values as V
from quillmark.operators import coverage as Cov
from quillmark.operators import hierarchy as H
from quillmark.operators import marks as M
from quillmark.operators import review as R
from quillmark.operators import triples as Tr
from quillmark.operators import validate as Va
from quillmark.plans import rules
from quillmark.sources import annotations as S
from quillmark.streaming import watch

GOOD = {
    "id": "GE-1",
    "knowledge_domain": ["HUMAN_GENETICS"],
    "method": ["GWAS"],
    "target_type": "VARIANT",
    "resolution": "VARIANT",
    "credibility": "HIGH",
    "phenotype_scale": "CLINICAL",
    "variant_ascertainment": ["OBSERVED_IN_CASES"],
    "assertions": [{"id": "GE-1.A1", "statement": "It holds.", "source_span": {"page": 3, "key_phrase": "it holds"}}],
}


def documents(spark, *docs):
    rows = [(f"d{i}", json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "path string, json string").select("path", F.parse_json("json").alias("doc"), F.lit(None).cast("string").alias("error"))


def one(spark, **changes):
    item = {k: v for k, v in (GOOD | changes).items() if v != "DROP"}
    return documents(spark, {"evidence": [item]})


# The value forms: (raw, values for triples, populated, activation set).
FORMS = [
    (None, [], False, []),
    ("VARIANT", ["VARIANT"], True, ["VARIANT"]),
    (" Not_Applicable_Or_Omitted ", ["NOT_APPLICABLE_OR_OMITTED"], False, [" Not_Applicable_Or_Omitted "]),
    ("", [""], True, [""]),
    ("free text", ["free text"], True, ["free text"]),
    ([], [], False, []),
    ([None], [], False, []),
    (["not_applicable_or_omitted"], ["NOT_APPLICABLE_OR_OMITTED"], False, ["not_applicable_or_omitted"]),
    (["A", "not_applicable_or_omitted"], ["A", "NOT_APPLICABLE_OR_OMITTED"], True, ["A", "not_applicable_or_omitted"]),
    (["A", None], ["A"], True, ["A"]),
    ({"annotated_as": "not_applicable_or_omitted"}, ["NOT_APPLICABLE_OR_OMITTED"], False, []),
    ({"annotated_as": "X"}, ["X"], True, []),
    ({"value": "incomplete", "note": "n"}, [], True, []),
    ({}, [], True, []),
    (True, ["True"], True, []),
]


def test_value_forms(spark):
    df = spark.createDataFrame([(i, json.dumps(f[0])) for i, f in enumerate(FORMS)], "i int, j string").withColumn("v", F.parse_json("j"))
    rows = df.select("i", F.transform(V.raw_values(F.col("v")), lambda x: V.fold(x)).alias("values"), V.is_populated(F.col("v")).alias("p"), V.activation_set(F.col("v")).alias("a")).orderBy("i").collect()
    assert [(r["values"], r["p"], r["a"]) for r in rows] == [(v, p, a) for _, v, p, a in FORMS]


def test_value_null_column(spark):
    df = spark.sql("select cast(null as variant) v")
    assert tuple(df.select(V.raw_values(F.col("v")), V.is_populated(F.col("v")), V.activation_set(F.col("v")), V.as_boolean(F.col("v"))).first()) == ([], False, [], None)


def test_booleans(spark):
    df = spark.createDataFrame([(json.dumps(x),) for x in (True, "True", "true", "not_applicable_or_omitted", 1, False)], "j string")
    assert [r[0] for r in df.select(V.as_boolean(F.parse_json("j"))).collect()] == [True, True, True, False, False, False]


BROKEN = [
    ({}, []),
    ({"knowledge_domain": []}, [("V-S1", "minCount")]),
    ({"method": ["MAGIC"]}, [("V-S2", "class")]),
    ({"target_type": "DROP"}, [("V-S3", "minCount")]),
    ({"phenotype_scale": ["CLINICAL", "MOLECULAR"]}, [("V-S4", "maxCount")]),
    ({"target_resolution": "GENE"}, [("V-S5", "maxCount")]),
    ({"target_resolution": "VARIANT"}, []),
    ({"credibility": "SURE"}, [("V-S6", "class")]),
    ({"variant_ascertainment": ["GUESSED"]}, [("V-S7", "class")]),
    ({"variant_ascertainment": "DROP"}, [("V-S8", "condition")]),
    ({"variant_ascertainment": "not_applicable_or_omitted"}, []),
    ({"target_type": "GENE", "resolution": "GENE"}, [("V-S9", "condition")]),
    ({"method": ["IN_VIVO_EXPERIMENT"], "knowledge_domain": ["MODEL_ORGANISM"]}, [("V-S10", "condition")] * 2),
    ({"method": ["IN_VIVO"], "organism": "mouse"}, []),
    ({"measurement_target": ["LUCK"]}, [("V-S11", "class")]),
    ({"gene_relation": "X_likes_Y"}, [("V-S12", "class")]),
    ({"knockout_type": "PARTIAL"}, [("V-S13", "class")]),
    ({"resolution": "TRANSCRIPT"}, [("V-S5", "class")]),
    ({"assertions": [{"id": "a"}]}, [("V-S14", "minCount")]),
    ({"assertions": [{"id": "a", "source_span": {"phrase": "p"}}]}, [("V-S15", "minCount")]),
    ({"assertions": [{"id": "a", "source_span": {"page": 1}}]}, [("V-S16", "minCount")]),
    ({"assertions": [{"id": "a", "source_span": {"page": 1, "phrase": None, "key_phrase": "x"}}]}, [("V-S16", "minCount")]),
    ({"assertions": "DROP"}, []),
]


def test_each_rule_fires(spark):
    """One document for each case, all validated together: each is a graph by itself."""
    docs = documents(spark, *[{"evidence": [{k: v for k, v in (GOOD | c).items() if v != "DROP"}]} for c, _ in BROKEN])
    got = {}
    for r in Va.validate(docs)[1].collect():
        got.setdefault(r["path"], []).append((r["rule"], r["component"]))
    for i, (changes, want) in enumerate(BROKEN):
        assert sorted(got.get(f"d{i}", [])) == want, changes


def test_documents_are_apart_and_order_does_not_matter(spark):
    a, b = {"evidence": [GOOD]}, {"evidence": [GOOD | {"credibility": "SURE"}]}
    got = {r["path"]: r["conforms"] for r in Va.validate(documents(spark, a, b, {"evidence": None}, {}))[0].collect()}
    assert got == {"d0": True, "d1": False, "d2": True, "d3": True}


def test_phrase_and_key_phrase(spark):
    """The key phrase counts where there is no key `phrase`, whatever else has that word in it."""
    spans = [({"page": 1, "key_phrase": "phrase"}, "phrase"), ({"page": 1, "phrase": None, "key_phrase": "k"}, None), ({"phrase": "p", "key_phrase": "k"}, "p"), ({"note": {"phrase": 1}, "key_phrase": "k"}, "k"), ("no object", None), (None, None)]
    found = S.items(documents(spark, {"evidence": [{"assertions": [{"source_span": s} for s, _ in spans]}]}))
    assert [r["phrase"] for r in S.assertions(found).orderBy("a_idx").collect()] == [p for _, p in spans]


def test_one_pass(spark):
    """One scan, one exchange, and the files parsed once."""
    docs = S.parse_yaml(spark.createDataFrame([("a", "evidence: [{id: x}]")], "path string, text string"))
    plan = Tr.item_triples(S.items(docs))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange") == 1 and plan.count("Scan") == 1
    found = Va.violations(Tr.item_triples(S.items(docs), invalid=True))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert found.count("MapInPandas") == 1 and found.count("Exchange") == 1


def turtle_texts(text):
    """The texts of the long literals of a Turtle document, read letter by letter."""
    out, i = [], text.find('"""')
    while i >= 0:
        i, got = i + 3, []
        while not text.startswith('"""', i):
            got.append(text[i + 1] if text[i] == "\\" else text[i])
            i += 2 if text[i] == "\\" else 1
        out.append("".join(got))
        i = text.find('"""', i + 3)
    return out


def test_literals_read_back(spark):
    texts = ["a\\", 'a"', 'a\\"', 'a""', '"""', '""""', 'a\\\\"', '"""""', 'x\n"', '"', "\\", 'q"\n', 'say "hi" and """more""" then']
    rows = spark.createDataFrame([(str(k), "s", "p", t, "literal") for k, t in enumerate(texts)], "path string, s string, p string, o string, o_kind string")
    got = {int(r["path"]): turtle_texts(r["text"]) for r in Tr.turtle(rows).collect()}
    assert got == {k: [t] for k, t in enumerate(texts)}


def test_page_that_is_no_integer(spark):
    found = S.items(one(spark, assertions=[{"source_span": {"page": "3-4", "phrase": "p"}}]))
    got = Va.violations(Tr.item_triples(found, invalid=True)).collect()
    assert sorted((r["rule"], r["component"], r["value"]) for r in got) == [("V-S15", "datatype", "3-4"), ("V-S15", "minCount", None)]
    assert not Tr.item_triples(found).where("o_kind = 'invalid'").count()


def test_triples_and_turtle(spark):
    docs = one(spark, organism="mouse", exact_variant="True", penetrance={"value": "incomplete"}, subdomain="Candidate Gene Study", method=["IN_VITRO_EXPERIMENT"])
    found = S.items(docs)
    got = {(r["p"], r["o"], r["o_kind"]) for r in Tr.item_triples(found).collect()}
    assert {("method", "IN_VITRO", "iri"), ("organism", "mouse", "literal"), ("exactVariant", "true", "boolean"), ("page", "3", "integer"), ("subdomain", "Candidate Gene Study", "literal")} <= got
    assert not [g for g in got if g[0] == "penetrance"]
    loose = {(r["p"], r["o"]) for r in Tr.item_triples(found, strict=False).collect()}
    assert ("penetrance", "incomplete") in loose
    text = Tr.turtle(Tr.item_triples(found)).first()["text"]
    assert "gem:item_GE_1 a gem:GeneticEvidence ;" in text
    assert 'gem:phrase """it holds"""' in text


def test_colliding_ids(spark):
    docs = documents(spark, {"evidence": [{"id": "a.b"}, {"id": "a-b"}, {"id": "c"}, {}]})
    assert [r["ids"] for r in Tr.node_collisions(S.items(docs)).collect()] == [["a-b", "a.b"]]
    assert [r["item_id"] for r in S.items(docs).orderBy("idx").collect()][-1] == "item3"


def test_coverage_of_annotations(spark):
    items = [GOOD, GOOD | {"target_type": ["VARIANT"]}, GOOD | {"method": "IN_VIVO", "knowledge_domain": {"annotated_as": "GENE_FUNCTION"}}, GOOD | {"variant_ascertainment": None, "target_resolution": "GENE", "resolution": None}]
    table = Cov.annotation_coverage(S.items(documents(spark, {"evidence": items})))
    got = {r["dimension"]: (r["populated"], r["applicable"]) for r in table.collect()}
    assert got["Variant Ascertainment"] == (2, 3)
    assert got["Resolution"] == (4, 4)
    assert got["Organism"] == (0, 1)
    assert got["Measurement Target"] == (0, 0)
    lines = [r["line"] for r in Cov.as_markdown(table).collect()]
    assert lines[0] == "# Dimension coverage over 4 GeneticEvidence items" and len(lines) == 17 and len({len(x) for x in lines[1:]}) == 1
    assert Cov.as_markdown(table, "six papers").first()["line"] == "# Dimension coverage over 4 GeneticEvidence items (six papers)"


def test_yaml_scan(spark, tmp_path):
    (tmp_path / "reviews").mkdir()
    (tmp_path / "a.yaml").write_text("evidence:\n  - id: GE-1\n    date: 2026-01-02\n    on: true\n")
    (tmp_path / "b.yaml").write_text("evidence: [")
    (tmp_path / "c.yaml").write_text("# nothing\n")
    (tmp_path / "reviews" / "r.yaml").write_text("verdicts: []")
    docs = S.scan_documents(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["error"] is None for r in docs.collect()}
    assert got == {"a.yaml": True, "b.yaml": False, "c.yaml": True}
    want = spark.createDataFrame([(f"file:{tmp_path}/a.yaml",), ("nowhere",)], "path string")
    assert {r["path"]: r["error"] for r in S.requested(docs, want).collect()}["nowhere"] == "missing"
    assert S.items(docs).count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.yaml").write_text(json.dumps({"evidence": [GOOD]}))
    q = watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["conforms"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [True]


def test_marks(spark, tmp_path):
    rows = [
        {"page": 1, "type": "Highlight", "author": "A ", "note": "", "rect": [0, 0, 1, 1], "highlighted_text": " a \n b "},
        {"page": 1, "type": "Highlight", "author": "", "note": " ", "rect": [0, 0, 1, 1], "highlighted_text": ""},
        {"page": 2, "type": "Text", "author": "", "note": "", "rect": [0, 0, 1, 1]},
    ]
    (tmp_path / "m.raw.json").write_text(json.dumps(rows))
    clean = M.drop_noise(M.clean_marks(S.scan_marks(spark, str(tmp_path))), "type", "Highlight", "highlighted_text", "note")
    got = [(r["page"], r["author"], r["highlighted_text"]) for r in clean.orderBy("page").collect()]
    assert got == [(1, "A ", "a b"), (2, "", None)]


QUAD = [10.0, 20.0, 50.0, 20.0, 10.0, 30.0, 50.0, 30.0]


def test_text_under_highlight(spark):
    marks = spark.createDataFrame([("a", 1, 1, "Highlight", QUAD + [v + 5 for v in QUAD]), ("a", 2, 1, "Text", None), ("a", 3, 2, "Highlight", QUAD), ("b", 1, 1, "Highlight", QUAD)], "path string, mark_ref int, page int, type string, quads array<double>")
    runs = spark.createDataFrame([("a", 1, 2, 20.0, 25.0, "world"), ("a", 1, 1, 9.0, 17.0, "hello"), ("a", 1, 3, 90.0, 25.0, "far"), ("a", 1, 4, 20.0, 25.0, " "), ("b", 1, 1, 20.0, 25.0, "other")], "path string, page int, pos int, x double, y double, text string")
    got = {(r["path"], r["mark_ref"]): r["highlighted_text"] for r in M.text_under(marks, runs).collect()}
    assert got == {("a", 1): "hello world", ("a", 2): None, ("a", 3): "", ("b", 1): "other"}
    popups = spark.createDataFrame([("a", 2, "pop"), ("a", 1, "other"), ("b", 2, "not this")], "path string, mark_ref int, contents string")
    noted = marks.withColumns({"note": F.when(F.col("mark_ref") == 1, "own").otherwise(""), "author": F.lit("A"), "pos": F.col("mark_ref")})
    assert {(r["path"], r["mark_ref"]): r["note"] for r in M.with_popups(noted, popups).collect()} == {("a", 1): "own", ("a", 2): "pop", ("a", 3): "", ("b", 1): "own"}
    whole = {(r["path"], r["mark_ref"]): (r["note"], r["highlighted_text"]) for r in M.extracted(noted, popups, runs).collect()}
    assert whole == {("a", 1): ("own", "hello world"), ("a", 2): ("pop", None), ("a", 3): ("", ""), ("b", 1): ("own", "other")}


def test_boxes_against_comparing_all(spark):
    """Both axes, several documents, dense cells in parts, boxes without end, and odd numbers."""
    rng = random.Random(9)
    points = [(f"d{k % 4}", k, rng.uniform(-300, 300), rng.uniform(-300, 300)) for k in range(600)] + [("d1", 1000 + k, 5.0, 5.0) for k in range(50)]
    points += [("d0", 2000, None, 1.0), ("d0", 2001, float("nan"), 1.0), ("d9", 2002, 1.0, 1.0)]
    boxes = []
    for k in range(120):
        x, y = rng.uniform(-300, 300), rng.uniform(-300, 300)
        boxes.append((f"d{k % 5}", k, x, x + rng.choice((0.0, 5.0, 200.0)), y, y + rng.choice((0.0, 9.0, 300.0))))
    boxes += [("d1", 500, -1e9, 1e9, -1e9, 1e9), ("d1", 501, 3.0, 7.0, 3.0, 7.0), ("d1", 502, 90.0, 10.0, 0.0, 9.0), ("d1", 503, None, 1.0, 0.0, 1.0)]
    inside = lambda v, lo, hi, more: v is not None and lo is not None and lo - more <= v <= hi + more
    want = sorted((i, j) for p, i, x, y in points for q, j, x0, x1, y0, y1 in boxes if p == q and inside(x, x0, x1, 1) and inside(y, y0, y1, 4))
    a = spark.createDataFrame(points, "path string, i int, x double, y double")
    b = spark.createDataFrame(boxes, "path string, j int, x0 double, x1 double, y0 double, y1 double")
    for dense in (10, 10**6):
        assert sorted((r["i"], r["j"]) for r in M.range_join(a, b, ["path"], "x", "y", dense=dense).collect()) == want
    wide = sorted((i, j) for p, i, x, _ in points for q, j, x0, x1, *_ in boxes if p == q and inside(x, x0, x1, 1))
    assert sorted((r["i"], r["j"]) for r in M.range_join(a, b, ["path"], "x").collect()) == wide


def test_compatible_forms_of_all_characters(spark):
    texts = ["x".join(chr(c) for c in range(a, min(a + 4096, 0x110000)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 4096)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, t string")
    got = {r["k"]: r["f"] for r in df.select("k", X.fold_forms(F.col("t")).alias("f")).collect()}
    assert got == {k: unicodedata.normalize("NFKC", t) for k, t in enumerate(texts)} | {-1: None}


def test_hierarchy(spark):
    edges = rules.enum_edges(spark)
    over = H.closure(edges).cache()
    up = {r["ancestor"]: r["depth"] for r in over.where("node = 'GWAS'").collect()}
    assert up == {"GWAS": 0, "ASSOCIATION_STUDY": 1, "STATISTICAL_GENETICS": 2}
    methods = spark.createDataFrame([("d", "i", "GWAS"), ("d", "i", "STATISTICAL_GENETICS"), ("d", "j", "IN_VIVO")], "path string, item_id string, method string")
    assert [(r["method"], r["descendant"]) for r in H.redundant_ancestors(methods, over).collect()] == [("STATISTICAL_GENETICS", "GWAS")]
    assert H.under(methods, "method", over, "EXPERIMENT").count() == 1
    flags = spark.createDataFrame([("d", "i", "x")], "path string, item_id string, type string")
    assert H.unexplained_intermediates(methods, edges, flags).count() == 1
    moves = spark.createDataFrame([("d", "i", "GWAS", "FINE_MAPPING"), ("d", "j", "IN_VIVO", "IN_VIVO")], "path string, item_id string, old string, new string")
    assert sorted(r["value"] for r in H.migrate(methods.withColumnRenamed("method", "value"), moves).collect()) == ["FINE_MAPPING", "IN_VIVO", "STATISTICAL_GENETICS"]


def test_review(spark):
    v = spark.createDataFrame([("p", "GE-1", "approved", None), ("p", "GE-2", "marked_for_edit", None), ("p", "GE-3", "rejected", None), ("p", "GE-new-1", "approved", "phase 1")], "path string, item_id string, decision string, added_in_phase string")
    tally = {r["added"]: (r["total"], r["approved"], r["rejected"]) for r in R.verdict_tally(v).collect()}
    assert tally == {False: (3, 1, 1), True: (1, 1, 0)}
    items = spark.createDataFrame([("p", f"GE-{i}", "old") for i in (1, 2, 3)], "path string, item_id string, item string")
    none = spark.createDataFrame([], "path string")
    assert R.second_round(v, none).first()["warranted"]
    assert R.unmatched(items, v, ["path", "item_id"]).count() == 1
    uses = spark.createDataFrame([("c1", "doi1"), ("c1", "doi1"), ("c2", "doi1"), ("c2", "doi2")], "ce string, doi string")
    assert [r["ce"] for r in R.promotable(uses, "ce", "doi").collect()] == ["c2"]
    assert R.same_rows(items, items).first()["same"]
    assert R.version_diff(items, items.where("item_id <> 'GE-1'")).count() == 1


def test_spans(spark):
    spans = spark.createDataFrame([(1, "The  Cat\nsat"), (2, "dog"), (1, None)], "page int, phrase string")
    pages = spark.createDataFrame([(1, "on the mat the cat sat.")], "page int, text string")
    got = {(r["page"], r["phrase"]): r["anchored"] for r in R.phrase_anchors(spans, pages, ["page"]).collect()}
    assert got == {(1, "The  Cat\nsat"): True, (2, "dog"): False, (1, None): False}
    long = spark.createDataFrame([(" ".join("w" * 15),), (" ".join("w" * 14),), (None,)], "phrase string")
    assert R.long_spans(long).count() == 1


def test_anchors_against_comparing_all(spark):
    rng = random.Random(3)
    words = ["aa", "ab", "ba", "a", "\ufb01b", "Bab"]
    text = lambda n: rng.choice((" ", "  ", "\n")).join(rng.choice(words) for _ in range(n))
    pages = [(k % 3, text(rng.randint(0, 25))) for k in range(30)] + [(1, None), (2, "")]
    fold = lambda t: " ".join(t.replace("\ufb01", "fi").lower().split())
    cut = lambda t, n: t[(a := rng.randrange(max(1, len(t) - n))) : a + n]
    for least in (1, 14):
        phrases = [(k % 4, (cut(pages[k][1], rng.randint(least, 22)) if k % 2 else text(rng.randint(1, 6)))) for k in range(30)] + [(1, None), (0, ""), (3, "")]
        want = {(p, t): t is not None and any(q == p and x is not None and fold(t) in fold(x) for q, x in pages) for p, t in phrases}
        got = R.phrase_anchors(spark.createDataFrame(phrases, "page int, phrase string"), spark.createDataFrame(pages, "page int, text string"), ["page"]).collect()
        assert {(r["page"], r["phrase"]): r["anchored"] for r in got} == want and len(got) == len(phrases)


def test_flags_and_keys(spark):
    docs = documents(spark, {"flags": [{"id": "F1", "type": "ai_uncertainty", "note": "n"}], "evidence": [GOOD | {"flags": ["F1"], "ai_assumption": {"note": "m"}, "invented": 1}]})
    assert sorted((r["type"], r["note"]) for r in S.flags(docs).collect()) == [("ai_assumption", "m"), ("ai_uncertainty", "n")]
    assert [r["dim"] for r in R.invented_keys(S.item_dims(S.items(docs))).collect()] == ["invented"]


def test_escape(spark):
    df = spark.createDataFrame([('a"""b\\',), ('ends"',), (None,)], "t string")
    assert [r[0] for r in df.select(X.escape(F.col("t"))).collect()] == ['a\\"\\"\\"b\\\\', 'ends\\"', None]
