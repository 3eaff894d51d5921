"""The rules' values written out once, apart from the tables that engine and SQL both read."""

from quillmark.plans import rules as R

MESSAGES = {
    "V-S1": "GeneticEvidence must declare at least one knowledge_domain from the enumeration.",
    "V-S2": "GeneticEvidence must declare at least one method from the enumeration.",
    "V-S3": "GeneticEvidence must declare exactly one target_type.",
    "V-S4": "GeneticEvidence must declare exactly one phenotype_scale.",
    "V-S5": "GeneticEvidence must declare exactly one resolution.",
    "V-S6": "GeneticEvidence must declare exactly one credibility rating.",
    "V-S7": "variant_ascertainment values must come from the enumeration.",
    "V-S8": "When target_type is VARIANT, variant_ascertainment is required.",
    "V-S9": "When knowledge_domain contains HUMAN_GENETICS and target_type is GENE, mode_of_inheritance is required.",
    "V-S10": "When method contains IN_VIVO (or legacy IN_VIVO_EXPERIMENT) or knowledge_domain contains MODEL_ORGANISM, organism is required.",
    "V-S11": "measurement_target values must come from the enumeration.",
    "V-S12": "gene_relation must come from the enumeration.",
    "V-S13": "knockout_type must come from the enumeration.",
    "V-S14": "Every assertion must carry exactly one source_span.",
    "V-S15": "A source_span must record a page number.",
    "V-S16": "A source_span must record a key phrase locating the passage.",
}
BOUNDS = {"V-S1": (1, None), "V-S2": (1, None), "V-S3": (1, 1), "V-S4": (1, 1), "V-S5": (1, 1), "V-S6": (1, 1), "V-S14": (1, 1), "V-S15": (1, None), "V-S16": (1, None)}


def test_messages_and_bounds():
    rules = [*R.PROPERTY_RULES, *R.CONDITIONAL_RULES, *R.SPAN_RULES]
    assert {r[0]: r[-1] for r in rules} == MESSAGES
    got = {r[0]: r[3:5] for r in R.PROPERTY_RULES} | {r[0]: r[2:4] for r in R.SPAN_RULES}
    assert {k: v for k, v in got.items() if v != (None, None)} == BOUNDS


def test_enumerations():
    assert {k: len(v) for k, v in R.ENUMS.items()} == {
        "knowledge_domain": 7, "method": 19, "target_type": 6, "resolution": 5, "credibility": 4, "phenotype_scale": 5,
        "variant_ascertainment": 4, "measurement_target": 7, "gene_relation": 3, "knockout_type": 2,
    }
    assert R.ENUMS["credibility"] == ["VERY_HIGH", "HIGH", "MEDIUM", "LOW"] and R.ENUMS["knockout_type"] == ["CONDITIONAL", "UNCONDITIONAL"]
    assert R.ENUMS["variant_ascertainment"] == ["OBSERVED_IN_CASES", "OBSERVED_IN_CONTROLS", "FROM_DATABASE", "SYNTHETIC"]
    assert [len(r[1]) for r in R.CONDITIONAL_RULES] == [1, 1, 3]
