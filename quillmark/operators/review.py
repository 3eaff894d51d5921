"""Reviews, promotion, lints and version differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import collapse, fold_forms, words
from quillmark.operators.lineage import maybe_among, settle
from quillmark.operators.versions import is_schema_key

DECISIONS = ("approved", "approved_despite_flags", "marked_for_edit", "rejected")


def tally(rows: DataFrame, key: list[str], column: str, values) -> DataFrame:
    """Rows of a key, in all and by each value, in one pass."""
    return rows.groupBy(*key).agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in values])


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    """Decisions by document, drafted items apart from added ones."""
    added = F.col("added_in_phase").isNotNull() | F.col("item_id").startswith("GE-new-")
    return tally(verdicts.withColumn("added", added), ["path", "added"], "decision", DECISIONS)


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("path", "type").agg(F.count("*").alias("n"))


# Flags of manual and of drafted annotations.
FLAG_TYPES = ("reviewer_query", "reviewer_suggestion", "reviewer_disagreement", "ai_uncertainty", "ai_assumption")


def flag_table(flags: DataFrame) -> DataFrame:
    """(path, total, a column for each type) of flags: paper by type."""
    return tally(flags, ["path"], "type", FLAG_TYPES)


def items_per_paper(items: DataFrame) -> DataFrame:
    return items.groupBy("path").agg(F.count("*").alias("n_items"))


def promotable(uses: DataFrame, key: str, paper: str, least: int = 2, settled: DataFrame | None = None) -> DataFrame:
    """(key, papers) named by at least so many papers; versions of one paper count once; settled keys are left out."""
    out = uses.groupBy(key).agg(F.count_distinct(paper).alias("papers")).where(F.col("papers") >= least)
    return out if settled is None else out.join(settled.select(key).distinct(), key, "left_anti")


def share(rows: DataFrame, holds: Column) -> DataFrame:
    return rows.agg(F.count_if(holds).alias("n"), F.count("*").alias("of"))


#: Most words of a window, and most characters of a piece of a word.
WINDOW = 3


def _window(k: int, *words: Column) -> Column:
    return F.xxhash64(F.lit(k), *words)


def _border(a: int, b: int, left: Column, right: Column) -> Column:
    """Key of the end of a word and the beginning of the next one."""
    return F.xxhash64(F.lit(100 * a + b), F.right(left, F.lit(a)), F.left(right, F.lit(b)))


def _pieces(word: Column, q: int) -> Column:
    """Keys of all stretches of q characters of a word; none if it is shorter."""
    starts = F.when(F.length(word) >= q, F.sequence(F.lit(1), F.length(word) - (q - 1)))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(-q), F.substring(word, i, F.lit(q))))


def phrase_keys(phrases: DataFrame, on: list[str], window: int = WINDOW) -> DataFrame:
    """(on, phrase, n words, kind, o, h): all keys that a text has if it holds a phrase, and at what word o of it.

    The words of a phrase but its first and last stand whole in the text: of three words and more, the keys are
    all windows of up to `window` such words, as wide as the phrase allows.  Of two words, it is the end of the first with
    the beginning of the second; of one, all its stretches of characters.
    """
    w = F.split("phrase", " ")
    split = phrases.where("phrase <> ''").select(*on, "phrase", w.alias("w"), F.size(w).alias("n"))
    keyed = []
    for k in range(1, window + 1):
        own = split.where(F.col("n") == k + 2) if k < window else split.where(F.col("n") >= k + 2)
        at = own.select(*on, "phrase", "n", "w", F.explode(F.sequence(F.lit(1), F.col("n") - (k + 1))).alias("o"))
        keyed.append(at.select(*on, "phrase", "n", F.lit(f"w{k}").alias("kind"), "o", _window(k, *[F.get("w", F.col("o") + j) for j in range(k)]).alias("h")))
    for a in range(1, window + 1):
        for b in range(1, window + 1):
            lengths = (F.least(F.length(F.get("w", F.lit(0))), F.lit(window)) == a) & (F.least(F.length(F.get("w", F.lit(1))), F.lit(window)) == b)
            own = split.where((F.col("n") == 2) & lengths)
            keyed.append(own.select(*on, "phrase", "n", F.lit(f"b{a}{b}").alias("kind"), F.lit(0).alias("o"), _border(a, b, F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("h")))
    for q in range(1, window + 1):
        length = F.least(F.length("phrase"), F.lit(window))
        own = split.where((F.col("n") == 1) & (length == q))
        keyed.append(own.select(*on, "phrase", "n", F.lit(f"p{q}").alias("kind"), F.lit(0).alias("o"), F.explode(_pieces(F.col("phrase"), q)).alias("h")))
    return reduce(DataFrame.unionByName, keyed).distinct()


def page_keys(pages: DataFrame, on: list[str], kinds: list[str], window: int = WINDOW) -> DataFrame:
    """(on, _page, pos, h): keys of those kinds of pages (on, _page, w), w being their words, and their places."""
    shifted = [F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))) for k in range(window)]
    zipped = F.posexplode(F.arrays_zip(*[x.alias(f"w{k}") for k, x in enumerate(shifted)]))
    rows = pages.select(*on, "_page", zipped.alias("pos", "z")).select(*on, "_page", "pos", *[F.col(f"z.w{k}") for k in range(window)])
    col = lambda k: F.col(f"w{k}")
    one, many = [], []
    for kind in kinds:
        if kind[0] == "w":
            k = int(kind[1:])
            one.append(F.when(col(k - 1).isNotNull(), _window(k, *[col(j) for j in range(k)])))
        elif kind[0] == "b":
            a, b = int(kind[1]), int(kind[2])
            one.append(F.when((F.length(col(0)) >= a) & (F.length(col(1)) >= b), _border(a, b, col(0), col(1))))
        else:
            many.append(_pieces(col(0), int(kind[1:])))
    none = F.array().cast("array<bigint>")
    keys = F.concat(F.array(*one) if one else none, *[F.coalesce(x, none) for x in many])
    return rows.select(*on, "_page", "pos", F.explode(keys).alias("h")).where("h IS NOT NULL").distinct() if many else rows.select(*on, "_page", "pos", F.explode(keys).alias("h")).where("h IS NOT NULL")


def phrase_anchors(spans: DataFrame, pages: DataFrame, on: list[str], phrase: str = "phrase", text: str = "text", window: int = WINDOW) -> DataFrame:
    """spans with anchored: the phrase is in a text of the same key, white space, case and letter forms (NFKC) apart.

    A phrase's keys (phrase_keys) are counted over the texts of its key.  If one is nowhere, it is in none; else it
    meets only the places of its rarest one, and there it is compared with the words that it would cover.  Each
    phrase has keys of its own width, whatever others have; neither side is limited.  Null phrases are in no text, the
    empty one in any; repeated rows stay repeated.
    """
    same = lambda c: F.lower(collapse(fold_forms(F.col(c))))
    folded = settle(spans.withColumn("_phrase", same(phrase)))
    listed = folded.where("_phrase IS NOT NULL").select(*on, F.col("_phrase").alias("phrase")).distinct()
    source = pages.select(*on, same(text).alias("t")).where("t IS NOT NULL")
    # Of texts that come many times one is enough.
    source = settle(source.withColumn("_page", F.xxhash64("t")).dropDuplicates([*on, "_page"]).withColumn("w", F.split("t", " ")).drop("t"))
    keys = settle(phrase_keys(listed, on, window))
    # Kinds of keys, at most window + window^2 + window.
    kinds = sorted(r[0] for r in keys.select("kind").distinct().collect())
    few = maybe_among(page_keys(source, on, kinds, window), "h", keys)
    found = settle(few.join(keys.select(*on, "h").distinct(), [*on, "h"], "left_semi"))
    counted = found.groupBy(*on, "h").agg(F.count("*").alias("places"))
    best = keys.join(counted, [*on, "h"], "left").groupBy(*on, "phrase").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "h", "o", "n")).alias("b"))
    best = settle(best.where("b.places > 0").select(*on, "phrase", "b.h", "b.o", "b.n"))
    met = best.join(found, [*on, "h"]).select(*on, "phrase", "n", "_page", (F.col("pos") - F.col("o")).alias("start")).where("start >= 0").distinct()
    covered = F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ")
    hits = met.join(source, [*on, "_page"]).where(F.contains(covered, F.col("phrase"))).select(*on, "phrase")
    hits = hits.unionByName(listed.where("phrase = ''").join(source.select(*on).distinct(), on, "left_semi").select(*on, "phrase")).distinct()
    out = folded.join(hits.select(*on, F.col("phrase").alias("_phrase"), F.lit(True).alias("_hit")), [*on, "_phrase"], "left")
    return out.select(*spans.columns, F.coalesce("_hit", F.lit(False)).alias("anchored"))


def long_spans(spans: DataFrame, phrase: str = "phrase", cap: int = 15) -> DataFrame:
    """spans of cap words and more, with n_words; words are counted once for each."""
    return spans.withColumn("n_words", words(F.col(phrase))).where(F.col("n_words") >= cap)


def version_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side only, as bags, with side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(same, n_left, n_right): whether two bags are alike."""
    d = version_diff(left, right)
    return d.agg((F.count("*") == 0).alias("same"), F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right"))


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys that one side has and the other has not."""
    a = left.select(*on).distinct().withColumn("_l", F.lit(True))
    b = right.select(*on).distinct().withColumn("_r", F.lit(True))
    return a.join(b, on, "full").where("_l IS NULL OR _r IS NULL").select(*on, F.when(F.col("_l").isNull(), "left").otherwise("right").alias("missing_in"))


def split_candidates(items: DataFrame) -> DataFrame:
    """Items of a document with the same methods, target and credibility: to be looked at, no errors."""
    return items.groupBy("path", F.sort_array("methods").alias("methods"), "target", "credibility").agg(F.sort_array(F.collect_list("item_id")).alias("items")).where(F.size("items") > 1)


def unexplained_methods(items: DataFrame, flags: DataFrame, extensions: DataFrame) -> DataFrame:
    """(path, methods, item_id): items of a document that share their methods and say nowhere why they are apart.

    items has path, item_id, methods, credibility_comment.  An item explains itself by that comment, by a flag
    ai_uncertainty (flags: path, item_id, type), or by an extension it exercises (extensions: path, item_id).
    """
    key = ["path", "item_id"]
    own = items.withColumn("methods", F.sort_array("methods"))
    shared = own.groupBy("path", "methods").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    silent = own.where(F.coalesce(F.trim("credibility_comment"), F.lit("")) == "").join(shared, ["path", "methods"])
    silent = silent.join(flags.where("type = 'ai_uncertainty'").select(*key), key, "left_anti")
    return silent.join(extensions.select(*key), key, "left_anti").select("path", "methods", "item_id")


def without_registered_extension(exercised: DataFrame, extensions: DataFrame) -> DataFrame:
    """(path, item_id, ce_id) of exercised extensions that the document doesn't record."""
    return exercised.join(extensions.select("path", "ce_id"), ["path", "ce_id"], "left_anti").select("path", "item_id", "ce_id")


def confidence_gaps(items: DataFrame, confidence: DataFrame) -> DataFrame:
    """(path, item_id, missing_in): items that a confidence summary leaves out, and entries that name no item."""
    out = unmatched(items, confidence, ["path", "item_id"])
    return out.withColumn("missing_in", F.when(F.col("missing_in") == "right", "summary").otherwise("items"))


def overview(dims: DataFrame) -> DataFrame:
    """(path, idx, item_id, label, method): one line an item, methods joined."""
    of = lambda d: F.max(F.when(F.col("dim") == d, F.array_join("values", ", ")))
    return dims.groupBy("path", "idx", "item_id").agg(of("label").alias("label"), of("method").alias("method"))


def ascertainment_split(dims: DataFrame) -> DataFrame:
    """(path, ascertainment, items): how a document's variants came into it, and the items of each way."""
    ways = dims.where("dim = 'variant_ascertainment'").select("path", "item_id", F.explode("values").alias("ascertainment"))
    return ways.groupBy("path", "ascertainment").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def label_lint(items: DataFrame) -> DataFrame:
    """Labels that begin with a study type, refer to others, or name a theme or a role instead of a finding; advice only."""
    study = r"^(gwas|linkage|knockout|functional study|association study)\b"
    ahead = r"\b(see (below|above)|as follows|(next|previous) item)\b"
    theme = r"^(introduction|background|methods?|results?|discussion|conclusions?|summary|overview|main finding|supporting evidence|additional evidence|control|replication)\W*$"
    return items.where(F.lower("label").rlike(f"{study}|{ahead}|{theme}"))


def invented_keys(dims: DataFrame) -> DataFrame:
    """(path, item_id, dim) of keys that no list names; keys of flags and reviewers are free."""
    return dims.where(~is_schema_key(F.col("dim"))).select("path", "item_id", "dim")


def span_tier(paraphrase: Column, anchored: Column) -> Column:
    return F.when(anchored, "ok").when(paraphrase, "non_blocking").otherwise("blocking")


def flag_decision(supported: Column, committed: Column) -> Column:
    return F.when(supported, F.lit(None).cast("string")).when(committed, "ai_assumption").otherwise("ai_uncertainty")


def default_verdicts(items: DataFrame, flags: DataFrame) -> DataFrame:
    flagged = flags.select("path", "item_id").distinct().withColumn("_f", F.lit(True))
    return items.select("path", "item_id").join(flagged, ["path", "item_id"], "left").select("path", "item_id", F.when(F.col("_f"), "marked_for_edit").otherwise("approved").alias("decision"))


def second_round(verdicts: DataFrame, cross_cutting: DataFrame, several: int = 2) -> DataFrame:
    """Documents to review again: an item added, several edited, or a cross-cutting matter noted."""
    out = verdicts.groupBy("path").agg(F.bool_or(F.col("added_in_phase").isNotNull()).alias("added"), F.count_if(F.col("decision") == "marked_for_edit").alias("edits"))
    noted = cross_cutting.select("path").distinct().withColumn("_c", F.lit(True))
    return out.join(noted, "path", "left").select("path", (F.col("added") | (F.col("edits") >= several) | F.coalesce("_c", F.lit(False))).alias("warranted"))


def without_extension(forced: DataFrame, extensions: DataFrame) -> DataFrame:
    """Forced fits without a candidate extension, neither by the id that they name nor by their dimension."""
    left = forced.join(extensions.select("path", "dimension"), ["path", "dimension"], "left_anti")
    return left.join(extensions.select("path", "ce_id"), ["path", "ce_id"], "left_anti") if "ce_id" in forced.columns else left


def provenance_gaps(provenance: DataFrame) -> DataFrame:
    """(path, field) of required provenance that is null; see versions.baseline() for documents older than a rule."""
    fields = ("mode", "protocol_version", "annotator", "annotated_at", "exemplars_used")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    return provenance.select("path", F.explode(pairs).alias("x")).select("path", "x.field", "x.v").where("v IS NULL").drop("v")


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows by a key: cited evidence, dispositions and the like."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def scales(items: DataFrame, key: str = "path", value: str = "phenotype_scale") -> DataFrame:
    return items.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("scales"))


def crosswalk(terms: DataFrame, table: DataFrame, on: str = "term") -> DataFrame:
    """Terms with their outside term and relation; 'none' where the table has none."""
    return terms.join(table, on, "left").withColumn("relation", F.coalesce("relation", F.lit("none")))


def same_paper(left: DataFrame, right: DataFrame, on: str = "doi") -> DataFrame:
    """Versions of a paper side by side; item ids differ between them and are not joined on."""
    return left.select(on, F.col("path").alias("path_left")).join(right.select(on, F.col("path").alias("path_right")), on, "full")


def normalised_equal(df: DataFrame, text: str) -> DataFrame:
    """(text hash, copies) of texts that are equal but for white space."""
    return df.groupBy(F.sha2(collapse(F.col(text)), 256).alias("digest")).agg(F.count("*").alias("copies")).where("copies > 1")
