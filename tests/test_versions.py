"""Alignment, closure, edits, version order, the file source and the writer, each against a plain version."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmark.operators import hierarchy as H
from quillmark.operators import lineage
from quillmark.operators import triples as Tr
from quillmark.operators import versions as Ve
from quillmark.sources import annotations as S
from quillmark.sources import files as Fi


def greedy(left, right, least):
    """Pairs from the most alike on, over all pairs of a paper."""
    pairs = []
    for (p, a), x in left.items():
        for (q, b), y in right.items():
            if p == q and x & y and len(x & y) / len(x | y) >= least:
                pairs.append((p, -len(x & y) / len(x | y), a, b))
    out, used = set(), set()
    for p, s, a, b in sorted(pairs):
        if (p, 0, a) not in used and (p, 1, b) not in used:
            used |= {(p, 0, a), (p, 1, b)}
            out.add((p, a, b))
    return out


def test_alignment_against_comparing_all(spark):
    rng = random.Random(2)
    left, right = {}, {}
    for p in ("x", "y", "z"):
        for k in range(12):
            own = {f"f{rng.randrange(14)}" for _ in range(6)}
            left[p, f"a{k}"] = own
            right[p, f"b{rng.randrange(100)}{k}"] = {f for f in own if rng.random() < 0.8} | {f"f{rng.randrange(14)}"}
    left["only", "a"], right["x", "lone"] = {"q"}, {"nothing like it"}
    table = lambda d: spark.createDataFrame([(p, i, f) for (p, i), fs in d.items() for f in fs for _ in range(2)], "doi string, item_id string, feature string")
    got = Ve.align(table(left), table(right), "doi", 0.3).collect()
    want = greedy(left, right, 0.3)
    assert {(r["doi"], r["left_id"], r["right_id"]) for r in got if r["state"] == "matched"} == want
    assert {(r["doi"], r["left_id"]) for r in got if r["state"] == "removed"} == set(left) - {(p, a) for p, a, _ in want}
    assert {(r["doi"], r["right_id"]) for r in got if r["state"] == "added"} == set(right) - {(p, b) for p, _, b in want}
    assert len(got) == len(left) + len(right) - len(want)


def test_alignment_deals_rows_out(spark, monkeypatch):
    """Tasks follow the rows, and no table is broadcast, however small Spark takes it for."""
    monkeypatch.setattr(lineage, "TASK_ROWS", 5)
    side = lambda n: spark.range(n).select(F.lit("x").alias("doi"), F.concat(F.lit("i"), (F.col("id") / 3).cast("int")).alias("item_id"), F.concat(F.lit("f"), "id").alias("feature"))
    got = Ve.align(side(60), side(45), "doi")
    assert "Broadcast" not in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    rows = got.collect()
    assert sum(r["state"] == "matched" and r["left_id"] == r["right_id"] and r["similarity"] == 1 for r in rows) == 15
    assert sum(r["state"] == "removed" for r in rows) == 5 == len(rows) - 15
    assert [lineage.tasks_for(spark, n) for n in (0, 20, 21, 60)] == [4, 4, 5, 12]


def test_changes_broadcast_no_values(spark, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_ROWS", 5)
    side = lambda v: spark.range(60).select(F.lit("x").alias("doi"), F.col("id").cast("string").alias("item_id"), F.lit("d").alias("dim"), F.array(v).alias("values"))
    pairs = spark.range(60).select(F.lit("x").alias("doi"), F.col("id").cast("string").alias("left_id"), F.col("id").cast("string").alias("right_id"), F.lit("matched").alias("state"))
    got = Ve.dimension_changes(pairs, side(F.lit("a")), side(F.when(F.col("id") % 2 == 0, "b").otherwise("a")), "doi")
    assert "Broadcast" not in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert {(r["left_id"], *r["old"], *r["new"]) for r in got.collect()} == {(str(k), "a", "b") for k in range(0, 60, 2)}


def documents(spark, *docs):
    return spark.createDataFrame([(f"d{k}", json.dumps(d)) for k, d in enumerate(docs)], "path string, j string").select("path", F.parse_json("j").alias("doc"))


def test_alignment_of_documents(spark):
    """Ids differ; one item is dropped, one comes, one changes a dimension, gains and loses one."""
    item = lambda i, label, phrase, **more: {"id": i, "label": label, "method": ["GWAS"], **more, "assertions": [{"source_span": {"page": 1, "phrase": phrase}}]}
    old = [item("GE-1", "Allele protects carriers", "protects carriers", credibility="HIGH", organism="mouse"), item("GE-2", "Knockout loses weight", "lost weight"), item("GE-3", "Gone", "nowhere else")]
    new = [item("GE-9", "Knockout loses weight", "lost weight"), item("GE-7", "Allele protects carriers", "protects  Carriers", credibility="LOW", target_type="GENE"), item("GE-8", "Quite new finding here", "quite another")]
    docs = documents(spark, {"evidence": old}, {"evidence": new})
    found = S.items(docs)
    dims = S.item_dims(found)
    features = Ve.item_features(dims, S.assertions(found)).withColumn("doi", F.lit("10.1/x"))
    pairs = Ve.align(features.where("path = 'd0'"), features.where("path = 'd1'"), "doi")
    assert {(r["left_id"], r["right_id"], r["state"]) for r in pairs.collect()} == {("GE-1", "GE-7", "matched"), ("GE-2", "GE-9", "matched"), ("GE-3", None, "removed"), (None, "GE-8", "added")}
    side = lambda p: dims.where(F.col("path") == p).where("dim NOT IN ('id', 'assertions')").withColumn("doi", F.lit("10.1/x"))
    changes = Ve.dimension_changes(pairs, side("d0"), side("d1"), "doi").collect()
    assert {(r["left_id"], r["dim"], tuple(r["old"] or ()), tuple(r["new"] or ())) for r in changes} == {("GE-1", "credibility", ("HIGH",), ("LOW",)), ("GE-1", "organism", ("mouse",), ()), ("GE-1", "target_type", (), ("GENE",))}


def above(edges):
    """Shortest ways up, walked from each node."""
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    nodes = {x for e in edges for x in e if x is not None}
    out = {}
    for n in nodes:
        level, depth, seen = {n}, 0, {}
        while level := {b for a in level for b in up.get(a, ())} - set(seen):
            depth += 1
            seen |= dict.fromkeys(level, depth)
        out[n] = seen
    return out


@pytest.mark.parametrize("edges", [
    [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e"), ("a", "b"), (None, "x"), ("y", None)],
    [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("c", "f")],
    [(f"n{k}", f"n{k + 1}") for k in range(150)],
    [(f"{k}{s}", f"{k + 1}{t}") for k in range(14) for s in "ab" for t in "ab"],
])
def test_closure_of_diamonds_cycles_and_chains(spark, edges):
    df, want = spark.createDataFrame(edges, "child string, parent string"), above(edges)
    got = {(r["node"], r["ancestor"]): r["depth"] for r in H.closure(df).collect()}
    assert got == {(n, a): d for n, up in want.items() for a, d in up.items() if a != n} | {(n, n): 0 for n in want}
    assert {r["node"]: r["length"] for r in H.cycles(df).collect()} == {n: up[n] for n, up in want.items() if n in up}


def test_versions_are_numbers(spark):
    order = ["0.9", "1", "1.2", "v1.9", "1.10", "1.10.1", "2.0-draft", "10"]
    rows = spark.createDataFrame([(v,) for v in [*order, "1.0", None]], "v string").select("v", Ve.version_key(F.col("v")).alias("k")).collect()
    key = {r["v"]: r["k"] for r in rows}
    assert sorted(order, key=lambda v: key[v]) == order and key["1"] == key["1.0"] and key[None] is None


def test_rules_as_of_a_protocol(spark):
    rules = spark.createDataFrame([("r", "1.9"), ("r", "1.10"), ("s", "1.2"), ("s", "2.0"), ("t", None)], "rule string, introduced_in string")
    docs = spark.createDataFrame([("old", "1.9"), ("new", "1.10"), ("older", "1.1"), ("none", None)], "path string, protocol_version string")
    defects = docs.select("path").crossJoin(spark.createDataFrame([("r",), ("s",), ("t",), ("u",)], "rule string"))
    got = {(r["path"], r["rule"]): (r["revision"], r["grade"]) for r in Ve.baseline(defects, rules, docs).collect()}
    assert got["old", "r"] == ("1.9", "defect") and got["new", "r"] == ("1.10", "defect") and got["older", "r"] == (None, "note")
    assert got["new", "s"] == ("1.2", "defect") and got["older", "s"] == (None, "note")
    assert all(got[p, k] == (None, "defect") for p in ("old", "new", "older", "none") for k in "tu") and got["none", "r"] == (None, "defect")


def test_edits_keep_drop_add_and_strip(spark):
    item = {"id": "GE-1", "label": "old", "credibility": "HIGH", "invented": 1, "ai_uncertainty": "kept", "assertions": [{"statement": "s"}], "organism": None}
    doc = {"publication": {"doi": "d"}, "provenance": {"mode": "m"}, "evidence": [item, item | {"id": "GE-2"}, item | {"id": "GE-3"}, {"id": "GE-4"}]}
    docs = documents(spark, doc, {"evidence": [{"id": "GE-1"}]}, {"evidence": []})
    found = S.items(docs)
    verdicts = spark.createDataFrame([("d0", "GE-1", "marked_for_edit"), ("d0", "GE-2", "rejected"), ("d0", "GE-3", "approved"), ("d0", "GE-new-2", "rejected"), ("d1", "GE-1", "rejected")], "path string, item_id string, decision string")
    parse = lambda rows: spark.createDataFrame([(p, i, json.dumps(c)) for p, i, c in rows], "path string, item_id string, j string").select("path", "item_id", F.parse_json("j").alias("changes"))
    edits = parse([("d0", "GE-1", {"label": "new", "credibility": None, "assertions": [{"statement": "t", "source_span": {"page": 2}}]}), ("d0", "GE-1", {"resolution": "GENE"}), ("d0", "GE-3", {"label": "not asked for"})])
    added = parse([("d0", "GE-new-1", {"id": "GE-new-1", "odd": True}), ("d0", "GE-new-2", {"id": "GE-new-2"})]).withColumnRenamed("changes", "item")
    out = Ve.updated_items(found, verdicts, edits, added)
    got = {(r["path"], r["item_id"]): json.loads(r["j"]) for r in out.select("path", "item_id", F.to_json("item").alias("j")).collect()}
    plain = {k: v for k, v in item.items() if k != "invented"}
    changed = {k: v for k, v in plain.items() if k != "credibility"} | {"label": "new", "resolution": "GENE", "assertions": [{"statement": "t", "source_span": {"page": 2}}]}
    assert got == {("d0", "GE-1"): changed, ("d0", "GE-3"): plain | {"id": "GE-3"}, ("d0", "GE-4"): {"id": "GE-4"}, ("d0", "GE-new-1"): {"id": "GE-new-1"}}
    assert {(r["item_id"], r["dim"]) for r in Ve.stripped_keys(found).collect()} == {(f"GE-{k}", "invented") for k in (1, 2, 3)}
    reviews = spark.createDataFrame([("d0", "log.yaml", "2026-06-04", "one edit"), ("d1", "log2.yaml", "2026-06-05", "all gone")], "path string, log string, date string, summary string")
    new = {r["path"]: json.loads(r["j"]) for r in Ve.updated_documents(docs, out, reviews).select("path", F.to_json("doc").alias("j")).collect()}
    assert new["d0"] == {"publication": {"doi": "d"}, "provenance": {"mode": "m", "review_applied": {"log": "log.yaml", "date": "2026-06-04", "summary": "one edit"}}, "evidence": [changed, plain | {"id": "GE-3"}, {"id": "GE-4"}, {"id": "GE-new-1"}]}
    assert new["d1"]["evidence"] == [] and set(new) == {"d0", "d1"}


def test_files_are_planned_by_size_and_chosen_by_path(spark, tmp_path):
    (tmp_path / "v0" / "reviews").mkdir(parents=True)
    (tmp_path / "v1").mkdir()
    for at, text in {"v0/a.yaml": "evidence:\n  - id: GE-1\n    when: 2026-01-02\n", "v0/b.yaml": "evidence: [", "v1/a.yaml": "# nothing\n", "v0/reviews/r.yaml": "x: 1", "v1/c.txt": "x", "v1/d.yaml": ""}.items():
        (tmp_path / at).write_text(text)
    (tmp_path / "v1" / "bad.yaml").write_bytes(b"a: \xff\xfe")
    found = Fi.scan_annotation_files(spark, str(tmp_path))
    got = {r["path"].removeprefix(f"file:{tmp_path}/"): (r["doc"] is None, r["error"] is None) for r in found.select("path", F.to_json("doc").alias("doc"), "error").collect()}
    assert got == {"v0/a.yaml": (False, True), "v0/b.yaml": (True, False), "v1/a.yaml": (False, True), "v1/d.yaml": (False, True), "v1/bad.yaml": (True, False)}
    assert [r["item_id"] for r in S.items(found).collect()] == ["GE-1"]
    assert found.rdd.getNumPartitions() == 1 and Fi.scan_annotation_files(spark, str(tmp_path), task_bytes=1).rdd.getNumPartitions() == 5
    # A filter on path leaves nothing else to open: the plan has fewer partitions.
    small = Fi.scan_annotation_files(spark, str(tmp_path), task_bytes=1)
    assert small.where(F.col("path").startswith(f"file:{tmp_path}/v1")).rdd.getNumPartitions() == 3
    assert small.where(F.col("path") == f"file:{tmp_path}/v0/a.yaml").rdd.getNumPartitions() == 1
    assert {r["path"].rsplit("/", 1)[1]: r["error"] for r in Fi.scan_annotation_files(spark, paths=[str(tmp_path / "v0/a.yaml"), str(tmp_path / "none.yaml")]).collect()} == {"a.yaml": None, "none.yaml": "missing"}
    assert sorted(r["path"].rsplit("/", 1)[1] for r in Fi.scan_annotation_files(spark, str(tmp_path), glob="[ar].yaml", skip="v1").collect()) == ["a.yaml", "r.yaml"]
    assert [(r["ord"], r["item_id"]) for r in S.manifest_items(found, spark.createDataFrame([(f"file:{tmp_path}/v0/a.yaml", 7)], "path string, ord int")).collect()] == [(7, "GE-1")]


def test_documents_are_written_by_their_own_path(spark, tmp_path):
    rows = [(f"/corpus/v{v}/x{k}.yaml", "s", "type", f"V{v}", "iri") for v in (0, 1) for k in range(30)]
    triples = spark.createDataFrame(rows, "path string, s string, p string, o string, o_kind string").repartition(3)
    for _ in range(2):
        Tr.write_turtle(triples, str(tmp_path / "out"), "file:/corpus")
    there = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert there == sorted([f"v{v}/x{k}.ttl" for v in (0, 1) for k in range(30)] + ["_SUCCESS"])
    assert "gem:s a gem:V1 ." in (tmp_path / "out" / "v1" / "x3.ttl").read_text() and "gem:V0" in (tmp_path / "out" / "v0" / "x3.ttl").read_text()
    assert (tmp_path / "out" / "_SUCCESS").read_text() == "60" and not list(Path(tmp_path / "out").glob("_aside*"))
    for clash in (["/corpus/a.yaml", "/corpus/a.yml"], ["/corpus/../../etc/x.yaml"]):
        with pytest.raises(ValueError, match="no file of its own"):
            Fi.write_documents(spark.createDataFrame([(p, "t") for p in clash], "path string, text string"), str(tmp_path / "bad"), "/corpus")
    assert not (tmp_path / "bad").exists()
