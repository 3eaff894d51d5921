"""Driver queries of the engine's whole path: documents, items, triples, rules, verdicts, coverage, Turtle.

Each part of the driver's tables becomes an evidence item, ten a document, with values that a rule over its key
makes right, wrong, missing or odd.  The SQL works from the rule, not from the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.values import SENTINEL, TOKEN
from quillmark.operators import coverage as Cov
from quillmark.operators import triples as Tr
from quillmark.operators import validate as V
from quillmark.plans import rules as R
from quillmark.sources import annotations as S

#: Key -> (modulus, value by remainder, value of a sound item); a value is (JSON, objects, strings as written, counts as filled in).
VALUES: dict = {
    "knowledge_domain": (
        5,
        {
            0: ('"HUMAN_GENETICS"', ["HUMAN_GENETICS"], ["HUMAN_GENETICS"], True),
            1: ('["GENE_FUNCTION","MODEL_ORGANISM"]', ["GENE_FUNCTION", "MODEL_ORGANISM"], ["GENE_FUNCTION", "MODEL_ORGANISM"], True),
            2: ('"bogus_domain"', ["bogus_domain"], ["bogus_domain"], True),
            4: ('" Not_Applicable_or_omitted "', [SENTINEL], [], False),
        },
        0,
    ),
    "method": (
        4,
        {
            0: ('"IN_VIVO_EXPERIMENT"', ["IN_VIVO"], ["IN_VIVO_EXPERIMENT"], True),
            1: ('"GWAS"', ["GWAS"], ["GWAS"], True),
            2: ('["LINKAGE_ANALYSIS",null,"in vitro"]', ["LINKAGE_ANALYSIS", "in vitro"], ["LINKAGE_ANALYSIS", "in vitro"], True),
        },
        1,
    ),
    "target_type": (3, {0: ('"GENE"', ["GENE"], ["GENE"], True), 1: ('"VARIANT"', ["VARIANT"], ["VARIANT"], True), 2: ('["GENE","VARIANT"]', ["GENE", "VARIANT"], [], True)}, 0),
    "resolution": (6, {1: ('"POSITION"', ["POSITION"], [], True), 2: ('"GENE"', ["GENE"], [], True), 4: ('"WRONG"', ["WRONG"], [], True), 5: ('"not_applicable_or_omitted"', [SENTINEL], [], False)}, 2),
    "target_resolution": (6, {0: ('"GENE"', ["GENE"], [], True), 2: ('"VARIANT"', ["VARIANT"], [], True)}, None),
    "credibility": (4, {0: ('"HIGH"', ["HIGH"], [], True), 1: ('"LOW"', ["LOW"], [], True), 3: ('"very_high"', ["very_high"], [], True)}, 0),
    "phenotype_scale": (3, {0: ('"CLINICAL"', ["CLINICAL"], [], True), 1: ('["CLINICAL","CELLULAR"]', ["CLINICAL", "CELLULAR"], [], True)}, 0),
    "variant_ascertainment": (7, {0: ('"FROM_DATABASE"', ["FROM_DATABASE"], [], True), 1: ('"NOPE"', ["NOPE"], [], True)}, None),
    "mode_of_inheritance": (2, {0: ('"DOMINANT"', ["DOMINANT"], [], True)}, 0),
    "penetrance": (5, {2: ('{"annotated_as":"HIGH","value":"0.9"}', ["HIGH"], [], True), 3: ("[]", [], [], False)}, None),
    "organism": (3, {0: ('"mouse"', ["mouse"], [], True), 1: ('""', [], [], True)}, None),
    "measurement_target": (8, {0: ('"BINDING"', ["BINDING"], [], True), 1: ('"BAD"', ["BAD"], [], True)}, None),
    "gene_relation": (9, {0: ('"X_regulates_Y"', ["X_regulates_Y"], [], True), 1: ('"bad relation"', ["bad relation"], [], True)}, None),
    "knockout_type": (10, {0: ('"CONDITIONAL"', ["CONDITIONAL"], [], True), 1: ('"PARTIAL"', ["PARTIAL"], [], True)}, None),
    "mendelian_segregation": (4, {0: ("true", ["true"], [], True), 1: ('"yes"', ["false"], [], True)}, None),
}
PER_DOCUMENT = 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc variant, error): every fourth document is sound."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    sound = F.floor(k / PER_DOCUMENT) % 4 == 0
    fields = [F.concat(F.lit('"id":"GE.'), k.cast("string"), F.lit('"'))]
    for key, (modulus, values, good) in VALUES.items():
        odd = None
        for r, (raw, *_) in values.items():
            odd = (F if odd is None else odd).when(k % modulus == r, F.lit(f'"{key}":{raw}'))
        fields.append(F.when(sound, F.lit(None if good is None else f'"{key}":{values[good][0]}')).otherwise(odd))
    whole = F.to_json(F.struct((k % 20).alias("page"), F.col("p_name").alias("key_phrase")))
    one = F.concat(F.lit('"assertions":[{"statement":"s","source_span":'), whole, F.lit("}"))
    fields.append(
        F.when(sound, F.concat(one, F.lit("]")))
        .when(k % 3 == 0, F.concat(one, F.lit(',{"statement":""}]')))
        .when(k % 3 == 1, F.lit('"assertions":[{"statement":"s","source_span":{"page":"x"}}]'))
        .otherwise(F.lit('"assertions":null'))
    )
    items = part.select(F.concat(F.lit("part-"), F.floor(k / PER_DOCUMENT).cast("string")).alias("path"), F.struct(k.alias("k"), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("item")).alias("i"))
    docs = items.groupBy("path").agg(F.transform(F.sort_array(F.collect_list("i")), lambda i: i["item"]).alias("items"))
    return docs.select("path", F.parse_json(F.concat(F.lit('{"evidence":['), F.array_join("items", ","), F.lit("]}"))).alias("doc"), F.lit(None).cast("string").alias("error"))


def triples(docs: DataFrame) -> DataFrame:
    return Tr.item_triples(S.items(docs))


def results(docs: DataFrame) -> DataFrame:
    return V.violations(Tr.item_triples(S.items(docs), invalid=True))


def item_triples(spark, sf_dir):
    return triples(documents(spark, sf_dir))


def violations(spark, sf_dir):
    return results(documents(spark, sf_dir))


def verdicts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return V.verdicts(docs, results(docs)).drop("error")


def run_summary(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return V.run_summary(V.verdicts(docs, results(docs)))


def report_lines(spark, sf_dir):
    return V.report_lines(*V.validate(documents(spark, sf_dir)))


def closing_lines(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return V.closing_lines(V.verdicts(docs, results(docs)))


def annotation_coverage(spark, sf_dir):
    return Cov.annotation_coverage(S.items(documents(spark, sf_dir)))


def turtle(spark, sf_dir):
    return Tr.turtle(triples(documents(spark, sf_dir)))


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]::VARCHAR[]"


def _text(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else "'" + value.replace("'", "''") + "'"


def _case(key: str, of) -> str:
    """SQL for what a function makes of a key's value, by item."""
    modulus, values, good = VALUES[key]
    branches = " ".join(f"WHEN {r} THEN {of(v)}" for r, v in values.items())
    return f"CASE WHEN sound THEN {of(None if good is None else values[good])} ELSE CASE k % {modulus} {branches} ELSE {of(None)} END END"


def _values(key: str, prop: str, kind: str) -> str:
    return f"SELECT path, s, '{prop}' AS p, o, {kind} AS o_kind FROM (SELECT path, s, unnest({_case(key, lambda v: _list(v[1] if v else []))}) AS o FROM items)"


_TOKEN = f"CASE WHEN regexp_matches(o, '{TOKEN}') THEN 'iri' ELSE 'literal' END"
_ROWS = [_values(k, p, _TOKEN) for k, p in R.CATEGORICAL.items() if k in VALUES]
_ROWS += [_values(k, p, "'literal'") for k, p in R.LITERAL.items() if k in VALUES]
_ROWS += [_values(k, p, "'boolean'") for k, p in R.BOOLEAN.items() if k in VALUES]

_TRIPLES = f"""
    WITH items AS (SELECT p_partkey AS k, p_name, 'part-' || (p_partkey // {PER_DOCUMENT}) AS path, 'item_GE_' || p_partkey AS s, (p_partkey // {PER_DOCUMENT}) % 4 = 0 AS sound FROM part),
    claims AS (
        SELECT path, s, s || '_a0' AS a, 'GE.' || k || '.A0' AS id, 's' AS statement, CASE WHEN sound OR k % 3 = 0 THEN k % 20 END AS page, CASE WHEN sound OR k % 3 = 0 THEN p_name END AS phrase, CASE WHEN NOT sound AND k % 3 = 1 THEN 'x' END AS page_text, true AS has_span
        FROM items WHERE sound OR k % 3 < 2
        UNION ALL SELECT path, s, s || '_a1', 'GE.' || k || '.A1', NULL, NULL, NULL, NULL, false FROM items WHERE NOT sound AND k % 3 = 0
    ),
    triples AS (
        SELECT path, s, 'type' AS p, 'GeneticEvidence' AS o, 'iri' AS o_kind FROM items
        UNION SELECT path, s, 'itemId', 'GE.' || k, 'literal' FROM items
        UNION SELECT path, s, 'assertion', a, 'iri' FROM claims
        UNION SELECT path, a, 'type', 'GeneticEvidenceAssertion', 'iri' FROM claims
        UNION SELECT path, a, 'assertionId', id, 'literal' FROM claims
        UNION SELECT path, a, 'statement', statement, 'literal' FROM claims WHERE statement <> ''
        UNION SELECT path, a, 'sourceSpan', a || '_span', 'iri' FROM claims WHERE has_span
        UNION SELECT path, a || '_span', 'type', 'SourceSpan', 'iri' FROM claims WHERE has_span
        UNION SELECT path, a || '_span', 'page', page::VARCHAR, 'integer' FROM claims WHERE page IS NOT NULL
        UNION SELECT path, a || '_span', 'phrase', phrase, 'literal' FROM claims WHERE phrase IS NOT NULL
        {" ".join("UNION " + r for r in _ROWS)}
    )"""


def _rule(where: str, rule: str, prop: str, component: str, message: str, value: str = "NULL::VARCHAR") -> str:
    return f"SELECT t.path, t.s AS focus, '{rule}' AS rule, '{prop}' AS property, '{component}' AS component, {value} AS value, {_text(message)} AS message FROM triples t WHERE {where}"


def _number(kind: str, prop: str) -> tuple[str, str]:
    return f"t.p = 'type' AND t.o = '{kind}'", f"(SELECT count(DISTINCT v.o) FROM triples v WHERE v.path = t.path AND v.s = t.s AND v.p = '{prop}')"


def _rules() -> str:
    out = []
    for rule, prop, dim, least, most, message in R.PROPERTY_RULES:
        focus, n = _number("GeneticEvidence", prop)
        out += [_rule(f"{focus} AND {n} {op} {limit}", rule, prop, name, message) for op, limit, name in (("<", least, "minCount"), (">", most, "maxCount")) if limit is not None]
        members = ", ".join(_text(m) for m in [*R.ENUMS[dim], SENTINEL])
        out.append(_rule(f"t.p = '{prop}' AND (t.o_kind <> 'iri' OR t.o NOT IN ({members}))", rule, prop, "class", message, "t.o"))
    for rule, branches, prop, message in R.CONDITIONAL_RULES:
        focus, n = _number("GeneticEvidence", prop)
        for branch in branches:
            active = " AND ".join(f"EXISTS (SELECT 1 FROM triples v WHERE v.path = t.path AND v.s = t.s AND v.p = '{p}' AND v.o = '{o}' AND v.o_kind = 'iri')" for p, o in branch)
            out.append(_rule(f"{focus} AND {active} AND {n} = 0", rule, prop, "condition", message))
    for rule, prop, least, most, message in R.SPAN_RULES:
        focus, n = _number("GeneticEvidenceAssertion" if prop == "sourceSpan" else "SourceSpan", prop)
        out += [_rule(f"{focus} AND {n} {op} {limit}", rule, prop, name, message) for op, limit, name in (("<", least, "minCount"), (">", most, "maxCount")) if limit is not None]
    out.append(f"SELECT path, a || '_span', 'V-S15', 'page', 'datatype', page_text, {_text(R.SPAN_RULES[1][4])} FROM claims WHERE page_text IS NOT NULL")
    return " UNION ALL ".join(out)


_VIOLATIONS = f"{_TRIPLES}, violations AS ({_rules()})"
_VERDICTS = f"{_VIOLATIONS}, verdicts AS (SELECT path, count(DISTINCT v.focus || v.message) = 0 AS conforms, count(DISTINCT v.focus || v.message) AS n_violations FROM (SELECT DISTINCT path FROM items) LEFT JOIN violations v USING (path) GROUP BY path)"


def _coverage() -> str:
    rows = []
    for k, (label, keys, branches) in enumerate(R.COVERAGE_RULES):
        holds = " OR ".join("(" + " AND ".join(f"list_contains({_case(dim, lambda v: _list(v[2] if v else []))}, '{value}')" for dim, value in branch) + ")" for branch in branches) or "true"
        filled = " OR ".join(f"({_case(key, lambda v: str(bool(v and v[3])).lower())})" for key in keys)
        rows.append(f"SELECT {k} AS ord, '{label}' AS dimension, count(*) FILTER (({holds}) AND ({filled})) AS populated, count(*) FILTER ({holds}) AS applicable FROM items")
    return " UNION ALL ".join(rows)


QUERIES = {f.__name__: f for f in (item_triples, violations, verdicts, run_summary, report_lines, closing_lines, annotation_coverage, turtle)}
ORACLES = {
    "item_triples": f"{_TRIPLES} SELECT * FROM triples",
    "violations": f"{_VIOLATIONS} SELECT * FROM violations",
    "verdicts": f"{_VERDICTS} SELECT * FROM verdicts",
    "run_summary": f"{_VERDICTS} SELECT bool_and(conforms) AS conforms, count(*) FILTER (NOT conforms) AS failed FROM verdicts",
    "report_lines": f"""{_VERDICTS} SELECT path, 0 AS ord, CASE WHEN conforms THEN 'PASS  ' ELSE 'FAIL  ' END || path AS line FROM verdicts
        UNION ALL SELECT path, (2 * (row_number() OVER (PARTITION BY path, k ORDER BY focus, message)) - k)::INT, CASE k WHEN 1 THEN '      Focus Node: gem:' || focus ELSE '      Message: ' || message END
        FROM (SELECT DISTINCT path, focus, message FROM violations), (VALUES (1), (0)) t(k)""",
    "closing_lines": f"""{_VERDICTS} SELECT 0 AS ord, NULL::VARCHAR AS path, CASE WHEN count(*) > 0 THEN count(*) || ' annotation(s) failed SHACL validation: ' ELSE 'All annotations conform to the SHACL shapes.' END AS line FROM verdicts WHERE NOT conforms
        UNION ALL SELECT 1, path, path FROM verdicts WHERE NOT conforms""",
    "annotation_coverage": f"{_TRIPLES} {_coverage()}",
    "turtle": f"""{_TRIPLES},
        lines AS (SELECT path, s, p, CASE WHEN p = 'type' THEN 'a ' ELSE 'gem:' || p || ' ' END || CASE o_kind WHEN 'iri' THEN 'gem:' || o WHEN 'literal' THEN '\"\"\"' || o || '\"\"\"' ELSE o END AS line FROM triples),
        blocks AS (SELECT path, s, 'gem:' || s || ' ' || string_agg(line, ' ;' || chr(10) || '    ' ORDER BY p <> 'type', p, line) || ' .' AS block FROM lines GROUP BY path, s)
        SELECT path, '@prefix gem: <{Tr.NAMESPACE}> .' || chr(10) || '@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY s) || chr(10) AS text FROM blocks GROUP BY path""",
}
