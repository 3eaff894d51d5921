"""Sources: YAML documents, review logs and extracted marks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import values as V

MARK = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("rect", T.ArrayType(T.DoubleType())),
        T.StructField("highlighted_text", T.StringType()),
    ]
)


def scan_marks(spark: SparkSession, path: str) -> DataFrame:
    """Extracted marks, a JSON array a file, with the file's path and pos, each mark's place in its file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", T.ArrayType(MARK)).alias("marks"))
    return files.select("path", F.posexplode("marks").alias("pos", "m")).select("path", "pos", "m.*")


def scan_pdf_marks(spark: SparkSession, path: str) -> DataFrame:
    """Marks of PDF files, as scan_marks gives them but with quads in place of highlighted_text, and mark_ref.

    Needs the library pypdf on driver and executors; without it, an ImportError says so before anything runs.
    A file that can't be read gives one row with its error.
    """
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise ImportError("reading PDF files needs the library pypdf; start from extracted marks (scan_marks) instead") from e

    def run(batches):
        import io

        import pypdf

        names = ["path", "pos", "page", "type", "author", "note", "rect", "quads", "mark_ref", "error"]
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    pos = 0
                    for number, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1):
                        for ref in page.get("/Annots") or []:
                            mark = ref.get_object()
                            text = lambda key: None if mark.get(key) is None else str(mark[key])  # noqa: B023, E731
                            floats = lambda key: None if mark.get(key) is None else [float(x) for x in mark[key]]  # noqa: B023, E731
                            rows.append((path, pos, number, (text("/Subtype") or "").lstrip("/"), text("/T"), text("/Contents"), floats("/Rect"), floats("/QuadPoints"), f"{path}#{pos}", None))
                            pos += 1
                except Exception as e:  # noqa: BLE001  whatever a file brings about is that file's
                    rows.append((path, *[None] * 8, str(e)))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, pos int, page int, type string, author string, note string, rect array<double>, quads array<double>, mark_ref string, error string")


def scan_files(spark: SparkSession, path: str, glob: str = "*.yaml", skip: str | None = "reviews") -> DataFrame:
    """(path, text) of files below path, without those that have a folder named skip; files of no bytes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    if skip:
        files = files.where(~F.array_contains(F.split("path", "/"), skip))
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def read_yaml(text: str | None) -> tuple[str | None, str | None]:
    """(JSON text, error) of a YAML document, one of them null; dates stay text."""
    import yaml

    try:
        return json.dumps(yaml.safe_load(text or ""), default=str), None
    except (yaml.YAMLError, ValueError, TypeError) as e:
        return None, str(e)


def parse_yaml(files: DataFrame) -> DataFrame:
    """(path, doc variant, error): YAML has no JVM reader, so it is parsed in Arrow batches.

    A malformed file gives its error and no document, and the others go on; dates stay text.
    """

    def run(batches):
        for b in batches:
            read = [read_yaml(text) for text in b["text"]]
            yield pd.DataFrame({"path": b["path"], "doc": [d for d, _ in read], "error": [e for _, e in read]}).astype(object)

    return files.select("path", "text").mapInPandas(run, "path string, doc string, error string").withColumn("doc", F.try_parse_json("doc"))


def scan_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_yaml(scan_files(spark, path, **options))


#: Error of a path that no file has.
MISSING = "missing"


def requested(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """Documents of a list of paths; a path without a file gives a row with an error."""
    return paths.select("path").join(documents, "path", "left").withColumn("error", F.when(F.col("doc").isNull(), F.coalesce("error", F.lit(MISSING))))


def manifest_items(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """items() of the documents of a manifest (path, and ord where their order matters), flattened to one table, with ord."""
    order = manifest.select("path", "ord") if "ord" in manifest.columns else manifest.select("path", F.lit(None).cast("int").alias("ord"))
    return items(documents.join(order.select("path").distinct(), "path", "left_semi")).join(order, "path")


def items(documents: DataFrame) -> DataFrame:
    """(path, idx, item_id, item variant): evidence items in order; null evidence has none."""
    evidence = F.try_variant_get("doc", "$.evidence", "array<variant>")
    out = documents.select("path", F.posexplode(evidence).alias("idx", "item"))
    return out.select("path", "idx", F.coalesce(F.try_variant_get("item", "$.id", "string"), F.concat(F.lit("item"), F.col("idx"))).alias("item_id"), "item")


def item_dims(found: DataFrame) -> DataFrame:
    """(path, idx, item_id, dim, raw variant, values, populated, activation) of every key of every item."""
    long = found.sparkSession.sql("SELECT path, idx, item_id, d.key AS dim, d.value AS raw FROM {found}, LATERAL variant_explode(item) AS d", found=found)
    raw, of = F.col("raw"), F.col("_kind")
    kinds = long.withColumn("_kind", V.kind(raw))
    return kinds.select(*long.columns, V.raw_values(raw, of).alias("values"), V.is_populated(raw, of).alias("populated"), V.activation_set(raw, of).alias("activation"))


def claims(item: Column, item_id: Column) -> Column:
    """An item's assertions as an array of structs; see assertions() for their fields."""
    written = F.try_variant_get(item, "$.assertions", "array<variant>")

    def read(a: Column, i: Column) -> Column:
        get = lambda p, t="string": F.try_variant_get(a, p, t)
        # The key, not its value: a phrase written as null leaves no room for the key phrase.
        has_phrase = F.coalesce(F.map_contains_key(get("$.source_span", "map<string,variant>"), "phrase"), F.lit(False))
        page, phrase = get("$.source_span.page"), F.when(has_phrase, get("$.source_span.phrase")).otherwise(get("$.source_span.key_phrase"))
        return F.struct(
            i.alias("a_idx"),
            F.coalesce(get("$.id"), F.concat(item_id, F.lit(".A"), i.cast("string"))).alias("assertion_id"),
            get("$.statement").alias("statement"),
            page.try_cast("int").alias("page"),
            page.alias("page_text"),
            phrase.alias("phrase"),
            F.coalesce(get("$.source_span.source_span_is_paraphrase", "boolean"), F.lit(False)).alias("is_paraphrase"),
            (page.isNotNull() | phrase.isNotNull()).alias("has_span"),
        )

    return F.transform(written, read)


def assertions(found: DataFrame) -> DataFrame:
    """(path, idx, item_id, a_idx, assertion_id, statement, page, page_text, phrase, is_paraphrase, has_span).

    phrase is key_phrase only where the span has no key `phrase`, be its value null.  A page that is no
    integer gives null and keeps its text.  A span is left out if it has neither a page nor a phrase.
    """
    return found.select("path", "idx", "item_id", F.explode(claims(F.col("item"), F.col("item_id"))).alias("c")).select("path", "idx", "item_id", "c.*")


def flags(documents: DataFrame) -> DataFrame:
    """(path, item_id, flag_id, type, note): a document's registry by its items, and flags written inline."""
    found = items(documents)
    registry = documents.select("path", F.explode(F.try_variant_get("doc", "$.flags", "array<variant>")).alias("f"))
    get = lambda p: F.try_variant_get("f", p, "string")
    registry = registry.select("path", get("$.id").alias("flag_id"), F.coalesce(get("$.type"), get("$.flag")).alias("type"), get("$.note").alias("note"))
    named = found.select("path", "item_id", F.explode(F.try_variant_get("item", "$.flags", "array<string>")).alias("flag_id"))
    by_id = named.join(registry, ["path", "flag_id"], "left").select("path", "item_id", "flag_id", "type", "note")
    inline = item_dims(found).where(F.col("dim").startswith("ai_") | F.col("dim").startswith("reviewer_"))
    inline = inline.select("path", "item_id", F.lit(None).cast("string").alias("flag_id"), F.col("dim").alias("type"), F.coalesce(F.try_variant_get("raw", "$.note", "string"), V.scalar(F.col("raw"))).alias("note"))
    return by_id.unionByName(inline)


def review_tables(logs: DataFrame) -> dict[str, DataFrame]:
    """verdicts, verdict_flags, migrations and promotions of parsed review logs."""
    part = lambda key: logs.select("path", F.try_variant_get("doc", "$.reviewed_annotation", "string").alias("reviewed"), F.explode(F.try_variant_get("doc", f"$.{key}", "array<variant>")).alias("x"))
    get = lambda p: F.try_variant_get("x", p, "string")
    verdicts = part("verdicts").select("path", "reviewed", get("$.ge_item").alias("item_id"), get("$.decision").alias("decision"), get("$.added_in_phase").alias("added_in_phase"), F.try_variant_get("x", "$.flags_recorded", "array<variant>").alias("flags"))
    f = lambda p: F.try_variant_get("f", p, "string")
    return {
        "verdicts": verdicts.drop("flags"),
        "verdict_flags": verdicts.select("path", "reviewed", "item_id", F.explode("flags").alias("f")).select("path", "reviewed", "item_id", F.coalesce(f("$.type"), f("$.flag")).alias("type"), f("$.level").alias("level"), f("$.note").alias("note")),
        "migrations": part("migration_suggestions").select("path", "reviewed", get("$.ge_item").alias("item_id"), get("$.from").alias("old"), get("$.to").alias("new")).where("old IS DISTINCT FROM new"),
        "promotions": part("promotion_recommendations").select("path", get("$.candidate").alias("candidate"), get("$.status").alias("status")),
    }


def _text_of(column: str):
    return lambda key: F.try_variant_get(column, f"$.{key}", "string")


def publications(documents: DataFrame) -> DataFrame:
    """(path, id, doi, citation, title) of each document's paper."""
    get = _text_of("doc")
    return documents.select("path", *[get(f"publication.{k}").alias(k) for k in ("id", "doi", "citation", "title")])


def provenance(documents: DataFrame) -> DataFrame:
    """(path, mode, protocol_version, annotator, annotated_at, exemplars_used) as written; lists as JSON text."""
    get = lambda k: F.try_variant_get("doc", f"$.provenance.{k}", "variant")
    shown = lambda v: F.when(V.kind(v) == "VOID", None).when(V.kind(v).isin("LIST", "OBJECT"), F.to_json(v)).otherwise(V.scalar(v))
    return documents.select("path", *[shown(get(k)).alias(k) for k in ("mode", "protocol_version", "annotator", "annotated_at", "exemplars_used")])


def _elements(rows: DataFrame, column: str, key: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.try_variant_get(column, f"$.{key}", "array<variant>")).alias("x"))


def candidate_extensions(documents: DataFrame) -> DataFrame:
    """(path, ce_id, dimension, description, location, status) of gaps that a document records."""
    get = _text_of("x")
    return _elements(documents, "doc", "candidate_extensions", "path").select("path", get("id").alias("ce_id"), get("dimension").alias("dimension"), get("description").alias("description"), get("location_in_this_annotation").alias("location"), get("status").alias("status"))


def confidence(documents: DataFrame) -> DataFrame:
    """(path, item_id, confidence, notes) of the confidence summary; an entry names its item by id or by item."""
    get = _text_of("x")
    return _elements(documents, "doc", "confidence_summary.per_item", "path").select("path", F.coalesce(get("id"), get("item")).alias("item_id"), get("confidence").alias("confidence"), F.coalesce(get("notes"), get("note")).alias("notes"))


def forced_fits(documents: DataFrame) -> DataFrame:
    """(path, dimension, ce_id, flag) of values that a summary owns up to have forced; null where it names none."""
    get = _text_of("x")
    return _elements(documents, "doc", "confidence_summary.forced_fits", "path").select("path", get("dimension").alias("dimension"), get("candidate_extension").alias("ce_id"), get("flag").alias("flag"))


def observations(logs: DataFrame) -> DataFrame:
    """(path, obs_id, level, text) of a review log's observations on the whole paper."""
    get = _text_of("x")
    return _elements(logs, "doc", "observations", "path").select("path", get("id").alias("obs_id"), F.coalesce(get("level"), get("prominence")).alias("level"), F.coalesce(get("observation"), get("disposition")).alias("text"))


def special_considerations(found: DataFrame) -> DataFrame:
    """(path, item_id, key, value) of an item's list of keys and values."""
    get = _text_of("x")
    return _elements(found, "item", "special_considerations", "path", "item_id").select("path", "item_id", get("key").alias("key"), get("value").alias("value"))


def exercised(found: DataFrame) -> DataFrame:
    """(path, item_id, ce_id): the extensions that an item exercises, written as one id or as a list."""
    raw = F.try_variant_get("item", "$.candidate_extension_exercised", "variant")
    return found.select("path", "item_id", F.explode(V.raw_values(raw)).alias("ce_id")).distinct()


def applications(documents: DataFrame) -> DataFrame:
    """(path, flag_id, item_id): the items that the flag registry says a flag applies to; remarks after an id go."""
    get = _text_of("x")
    of = F.explode(F.try_variant_get("x", "$.applies_to", "array<string>"))
    return _elements(documents, "doc", "flags", "path").select("path", get("id").alias("flag_id"), of.alias("item_id")).withColumn("item_id", F.regexp_extract("item_id", r"^\s*(\S+)", 1)).distinct()


def flag_disagreements(documents: DataFrame) -> DataFrame:
    """(path, flag_id, item_id, missing_in): flags of an item that the registry doesn't apply to it, and the reverse."""
    named = items(documents).select("path", "item_id", F.explode(F.try_variant_get("item", "$.flags", "array<string>")).alias("flag_id")).distinct()
    both = named.withColumn("_i", F.lit(True)).join(applications(documents).withColumn("_r", F.lit(True)), ["path", "flag_id", "item_id"], "full")
    return both.where("_i IS NULL OR _r IS NULL").select("path", "flag_id", "item_id", F.when(F.col("_i").isNull(), "item").otherwise("registry").alias("missing_in"))
