"""Value forms of a dimension, seen three ways.

A dimension may be written as a scalar, a list, an object or null.  Triples, coverage and activation each
read these forms in a way of their own; the three functions below keep them apart on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NA = "not_applicable_or_omitted"
SENTINEL = "NOT_APPLICABLE_OR_OMITTED"
METHOD_SYNONYMS = {
    "IN_VIVO_EXPERIMENT": "IN_VIVO",
    "IN_VITRO_EXPERIMENT": "IN_VITRO",
    "BIOINFORMATICS_PREDICTION": "BIOINFORMATICS_INFERENCE",
}
TOKEN = r"^[A-Za-z_][A-Za-z0-9_]*$"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def kind(v: Column) -> Column:
    """VOID, STRING, BOOLEAN, LIST, OBJECT or NUMBER of a variant; VOID for SQL null."""
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (name == "VOID"), "VOID")
        .when(name.isin("STRING", "BOOLEAN"), name)
        .when(name.startswith("ARRAY"), "LIST")
        .when(name.startswith("OBJECT"), "OBJECT")
        .otherwise("NUMBER")
    )


def scalar(v: Column, of: Column | None = None) -> Column:
    """Text of a scalar variant; booleans as True and False.  of: the variant's kind, where a column has it."""
    text = F.try_variant_get(v, "$", "string")
    return F.when((kind(v) if of is None else of) == "BOOLEAN", F.initcap(text)).otherwise(text)


def members(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def is_na(text: Column) -> Column:
    """Whether text is the sentinel, in any case and with blanks at its ends; null is not."""
    return F.coalesce(F.lower(F.trim(text)) == NA, F.lit(False))


def raw_values(v: Column, of: Column | None = None) -> Column:
    """Values that triples get: a list without nulls, an object's annotated_as, or the scalar."""
    of = kind(v) if of is None else of
    inner = F.try_variant_get(v, "$.annotated_as", "string")
    return (
        F.when(of == "VOID", no_strings())
        .when(of == "LIST", F.transform(F.filter(members(v), lambda x: kind(x) != "VOID"), lambda x: scalar(x)))
        .when(of == "OBJECT", F.when(F.coalesce(inner, F.lit("")) != "", F.array(inner)).otherwise(no_strings()))
        .otherwise(F.array(scalar(v, of)))
    )


def object_value(v: Column, of: Column | None = None) -> Column:
    """An object's `value`, which triples leave out unless asked for."""
    inner = F.when((kind(v) if of is None else of) == "OBJECT", F.try_variant_get(v, "$.value", "string"))
    return F.when(inner.isNotNull(), F.array(inner)).otherwise(no_strings())


def is_populated(v: Column, of: Column | None = None) -> Column:
    """Whether a value counts as filled in: the empty text and the empty object do."""
    of = kind(v) if of is None else of
    inner = F.try_variant_get(v, "$.annotated_as", "string")
    return (
        F.when(of == "VOID", False)
        .when(of == "LIST", F.exists(members(v), lambda x: (kind(x) != "VOID") & ~is_na(F.when(kind(x) == "STRING", scalar(x)))))
        .when(of == "OBJECT", ~is_na(inner))
        .when(of == "STRING", ~is_na(scalar(v, of)))
        .otherwise(True)
    )


def activation_set(v: Column, of: Column | None = None) -> Column:
    """Strings that switch conditional rules on: a string, or the strings of a list, as written."""
    of = kind(v) if of is None else of
    return (
        F.when(of == "STRING", F.array(scalar(v, of)))
        .when(of == "LIST", F.transform(F.filter(members(v), lambda x: kind(x) == "STRING"), lambda x: scalar(x)))
        .otherwise(no_strings())
    )


def fold(value: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Trimmed value with the sentinel in one form and synonyms replaced."""
    text = F.trim(value)
    out = F.when(is_na(text), SENTINEL)
    for old, new in (synonyms or {}).items():
        out = out.when(text == old, new)
    return out.otherwise(text)


def is_token(value: Column) -> Column:
    """Whether a value can be a name; others stay literals."""
    return F.coalesce(value.rlike(TOKEN), F.lit(False))


def as_boolean(v: Column, of: Column | None = None) -> Column:
    """true for true, 'true' and 'True'; false for anything else, the sentinel included; null for null."""
    text, of = F.try_variant_get(v, "$", "string"), kind(v) if of is None else of
    return F.when(of == "VOID", None).otherwise(of.isin("BOOLEAN", "STRING") & F.coalesce(text.isin("true", "True"), F.lit(False)))


def contains(values: Column, value: str) -> Column:
    """Membership that is never null."""
    return F.coalesce(F.array_contains(values, value), F.lit(False))


def overlaps(values: Column, some) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(s) for s in some])), F.lit(False))
