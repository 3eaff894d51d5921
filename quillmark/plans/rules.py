"""Vocabularies and rules, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.functions.values import SENTINEL

# Enumerations by dimension.
ENUMS = {
    "knowledge_domain": ["HUMAN_GENETICS", "ANIMAL_GENETICS", "POPULATION_GENETICS", "COMPARATIVE_GENOMICS", "EPIGENETICS", "GENE_FUNCTION", "MODEL_ORGANISM"],
    "method": [
        "STATISTICAL_GENETICS", "EXPERIMENT", "BIOINFORMATICS_INFERENCE", "CLINICAL_EVIDENCE", "ASSOCIATION_STUDY", "GWAS",
        "CANDIDATE_GENE_STUDY", "FINE_MAPPING", "FAMILY_BASED", "LINKAGE_ANALYSIS", "TRANSMISSION_DISEQUILIBRIUM_TEST", "SEGREGATION_ANALYSIS",
        "META_ANALYSIS", "IN_VIVO", "IN_VITRO", "IN_SILICO", "IN_VIVO_EXPERIMENT", "IN_VITRO_EXPERIMENT",
        "BIOINFORMATICS_PREDICTION",
    ],
    "target_type": ["GENE", "RELATED_GENE", "VARIANT", "SEGMENT", "INTERVAL", "TRANSCRIPT"],
    "resolution": ["WINDOW", "FUNCTIONAL_ELEMENT", "POSITION", "GENE", "VARIANT"],
    "credibility": ["VERY_HIGH", "HIGH", "MEDIUM", "LOW"],
    "phenotype_scale": ["MOLECULAR", "CELLULAR", "HISTOLOGICAL", "ORGANISMAL", "CLINICAL"],
    "variant_ascertainment": ["OBSERVED_IN_CASES", "OBSERVED_IN_CONTROLS", "FROM_DATABASE", "SYNTHETIC"],
    "measurement_target": ["EXISTENCE", "EXPRESSION", "STABILITY", "BINDING", "LOCALIZATION", "ACTIVITY", "CATALYSIS"],
    "gene_relation": ["X_has_same_function_as_Y", "X_regulates_Y", "X_inhibits_Y"],
    "knockout_type": ["CONDITIONAL", "UNCONDITIONAL"],
}
# Fixed values: (child, parent) of methods.
METHOD_EDGES = [
    ("ASSOCIATION_STUDY", "STATISTICAL_GENETICS"),
    ("GWAS", "ASSOCIATION_STUDY"),
    ("CANDIDATE_GENE_STUDY", "ASSOCIATION_STUDY"),
    ("FINE_MAPPING", "ASSOCIATION_STUDY"),
    ("FAMILY_BASED", "STATISTICAL_GENETICS"),
    ("LINKAGE_ANALYSIS", "FAMILY_BASED"),
    ("TRANSMISSION_DISEQUILIBRIUM_TEST", "FAMILY_BASED"),
    ("SEGREGATION_ANALYSIS", "FAMILY_BASED"),
    ("META_ANALYSIS", "STATISTICAL_GENETICS"),
    ("IN_VIVO", "EXPERIMENT"),
    ("IN_VITRO", "EXPERIMENT"),
    ("IN_SILICO", "EXPERIMENT"),
]
# Key -> property.
CATEGORICAL = {
    "knowledge_domain": "knowledgeDomain",
    "method": "method",
    "target_type": "targetType",
    "resolution": "resolution",
    "target_resolution": "resolution",
    "credibility": "credibility",
    "phenotype_scale": "phenotypeScale",
    "variant_ascertainment": "variantAscertainment",
    "measurement_target": "measurementTarget",
    "gene_relation": "geneRelation",
    "knockout_type": "knockoutType",
    "mode_of_inheritance": "modeOfInheritance",
    "penetrance": "penetrance",
}
LITERAL = {"organism": "organism", "target": "target", "specificity_of_phenotype": "specificityOfPhenotype", "subdomain": "subdomain"}
BOOLEAN = {"mendelian_segregation": "mendelianSegregation", "exact_variant": "exactVariant", "genetic_background_considered": "geneticBackgroundConsidered"}
ALIASES = {"target_resolution": "resolution"}
# Ordinal scales, least first.
ORDINALS = {"credibility": ["LOW", "MEDIUM", "HIGH", "VERY_HIGH"], "phenotype_scale": ["MOLECULAR", "CELLULAR", "HISTOLOGICAL", "ORGANISMAL", "CLINICAL"]}
# Fixed values: (rule, property, dimension of its enumeration, least, most, message).
PROPERTY_RULES = [
    ("V-S1", "knowledgeDomain", "knowledge_domain", 1, None, "GeneticEvidence must declare at least one knowledge_domain from the enumeration."),
    ("V-S2", "method", "method", 1, None, "GeneticEvidence must declare at least one method from the enumeration."),
    ("V-S3", "targetType", "target_type", 1, 1, "GeneticEvidence must declare exactly one target_type."),
    ("V-S4", "phenotypeScale", "phenotype_scale", 1, 1, "GeneticEvidence must declare exactly one phenotype_scale."),
    ("V-S5", "resolution", "resolution", 1, 1, "GeneticEvidence must declare exactly one resolution."),
    ("V-S6", "credibility", "credibility", 1, 1, "GeneticEvidence must declare exactly one credibility rating."),
    ("V-S7", "variantAscertainment", "variant_ascertainment", None, None, "variant_ascertainment values must come from the enumeration."),
    ("V-S11", "measurementTarget", "measurement_target", None, None, "measurement_target values must come from the enumeration."),
    ("V-S12", "geneRelation", "gene_relation", None, None, "gene_relation must come from the enumeration."),
    ("V-S13", "knockoutType", "knockout_type", None, None, "knockout_type must come from the enumeration."),
]
# Fixed values: (rule, branches of (property, value) pairs that all hold, property required, message).
CONDITIONAL_RULES = [
    ("V-S8", [[("targetType", "VARIANT")]], "variantAscertainment", "When target_type is VARIANT, variant_ascertainment is required."),
    ("V-S9", [[("knowledgeDomain", "HUMAN_GENETICS"), ("targetType", "GENE")]], "modeOfInheritance", "When knowledge_domain contains HUMAN_GENETICS and target_type is GENE, mode_of_inheritance is required."),
    (
        "V-S10",
        [[("method", "IN_VIVO")], [("method", "IN_VIVO_EXPERIMENT")], [("knowledgeDomain", "MODEL_ORGANISM")]],
        "organism",
        "When method contains IN_VIVO (or legacy IN_VIVO_EXPERIMENT) or knowledge_domain contains MODEL_ORGANISM, organism is required.",
    ),
]
# Fixed values: (rule, property, least, most, message).
SPAN_RULES = [
    ("V-S14", "sourceSpan", 1, 1, "Every assertion must carry exactly one source_span."),
    ("V-S15", "page", 1, None, "A source_span must record a page number."),
    ("V-S16", "phrase", 1, None, "A source_span must record a key phrase locating the passage."),
]
# Fixed values: (label, keys, condition) of coverage; a condition is all of (dimension, value) or one of several.
COVERAGE_RULES = [
    ("Knowledge Domain", ["knowledge_domain"], []),
    ("Method", ["method"], []),
    ("Target Type", ["target_type"], []),
    ("Resolution", ["resolution", "target_resolution"], []),
    ("Credibility", ["credibility"], []),
    ("Phenotype Scale", ["phenotype_scale"], []),
    ("Variant Ascertainment", ["variant_ascertainment"], [[("target_type", "VARIANT")]]),
    ("Mode of Inheritance", ["mode_of_inheritance"], [[("knowledge_domain", "HUMAN_GENETICS"), ("target_type", "GENE")]]),
    ("Mendelian Segregation", ["mendelian_segregation"], [[("knowledge_domain", "HUMAN_GENETICS"), ("target_type", "GENE")]]),
    ("Penetrance", ["penetrance"], [[("knowledge_domain", "HUMAN_GENETICS"), ("target_type", "VARIANT")]]),
    ("Measurement Target", ["measurement_target"], [[("knowledge_domain", "GENE_FUNCTION")]]),
    ("Gene Relation", ["gene_relation"], [[("knowledge_domain", "GENE_FUNCTION")]]),
    ("Organism", ["organism"], [[("method", "IN_VIVO")], [("method", "IN_VIVO_EXPERIMENT")], [("knowledge_domain", "MODEL_ORGANISM")]]),
    ("Knockout Type", ["knockout_type"], [[("knowledge_domain", "MODEL_ORGANISM")]]),
]
#: Dimensions whose condition needs a plain scalar: a list never matches.
SCALAR_DIMS = ("target_type",)


def enum_members(spark: SparkSession) -> DataFrame:
    """(dim, value), the sentinel included: membership goes by both, for some values are in two dimensions."""
    return spark.createDataFrame([(d, v) for d, vs in ENUMS.items() for v in [*vs, SENTINEL]], "dim string, value string")


def enum_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METHOD_EDGES, "child string, parent string")


def known_keys() -> set[str]:
    """Keys that an item may have; others are reported as invented."""
    more = "id label source assertions flags special_considerations environmental_factors candidate_extension_exercised primary_method cited_evidence hpo_terms normalization_note"
    return {*CATEGORICAL, *LITERAL, *BOOLEAN, *more.split()}
